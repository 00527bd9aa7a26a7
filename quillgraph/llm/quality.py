"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over the
commonest words of its language are compared with references by Jensen-Shannon
distance. A reference is pooled from a language's documents in two passes:
first from those that pass the base rules, then only from those of them that are
near that first reference, so that junk does not set the norm. Short documents
are guarded: a histogram is judged only with enough characters or words behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import columns_of, documents_of, materialize, ship
from quillgraph.llm.words import chunks, numbered_words

# The common words whose shares make the word histogram, by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ou",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}
#: Distances over these fail a document.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.30
#: Guards: fewer characters or words are not judged by that histogram.
MIN_CHARS, MIN_WORDS = 200, 100
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: Word slots of a histogram, the last for all other words.
SLOTS = 1 + max(len(v.split()) for v in COMMON_WORDS.values())
OTHER = "other"


def _class_table() -> np.ndarray:
    """The class of every code point of the basic plane; beyond it all are `other`."""
    t = np.full(0x10000, CLASSES.index("other"), np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.islower():
            t[i] = CLASSES.index("lower")
        elif c.isupper():
            t[i] = CLASSES.index("upper")
        elif c.isalpha():
            t[i] = CLASSES.index("lower")
        elif c.isdigit():
            t[i] = CLASSES.index("digit")
        elif c.isspace():
            t[i] = CLASSES.index("space")
        elif c in ".,;:'\"()-!?":
            t[i] = CLASSES.index("stop")
        elif i < 128:
            t[i] = CLASSES.index("symbol")
    return t


def _repeat_words(codes: np.ndarray, size: int) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(codes) < 4:
        return 0
    pairs = codes[:-2] * size + codes[1:-1]
    if size > 2_000_000:  # three such numbers exceed 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * size + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for d in range(3):
        covered[d : len(codes) - 2 + d] |= twice
    return int(covered.sum())


def document_features(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, lang_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_points (code points), classes, words, row (that column, else null).

    lang_key is the language where its common words are known, else `other`.
    """
    ship(docs.sparkSession)
    schema = "doc_id bigint, lang_key string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_points bigint, classes array<bigint>, words array<bigint>, row bigint"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        known = {k: {w: i for i, w in enumerate(v.split())} for k, v in COMMON_WORDS.items()}
        symbols = np.array([ord(c) for c in SYMBOLS])
        is_symbol = np.zeros(0x10000, bool)
        is_symbol[symbols] = True
        blank = " \t\n\x0b\x0c\r"
        for b in chunks(batches):
            codes, vocabulary, starts = numbered_words(b.column("text"))
            size = max(1, len(vocabulary))
            n_words = np.diff(starts)
            length = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
            total = np.concatenate([[0], np.cumsum(length[codes])]) if len(codes) else np.zeros(1, np.int64)
            word_chars = total[starts[1:]] - total[starts[:-1]]
            bare = [w.lower().strip(".,;:!?") for w in vocabulary]
            langs = [x if x in known else OTHER for x in b.column("lang").to_pylist()]
            slot = {k: np.array([v.get(w, SLOTS - 1) for w in bare], np.int64) for k, v in known.items()}
            slot[OTHER] = np.full(len(bare), SLOTS - 1)
            symbol, dup, repeat, classes, words, points_of = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                points = np.where(points < 0x10000, points, 0xFFFF)
                classes.append(np.bincount(table[points], minlength=len(CLASSES)).tolist())
                points_of.append(len(points))
                symbol.append(int(is_symbol[points].sum()))
                # only lines with a word count; equal lines before make a repeat
                lines = [x for x in text.split("\n") if x.strip(blank)]
                dup.append(len(lines) - len(set(lines)))
                own = codes[starts[i] : starts[i + 1]]
                few, local = np.unique(own, return_inverse=True)
                repeat.append(_repeat_words(local.astype(np.int64), len(few)))
                words.append(np.bincount(slot[langs[i]][own], minlength=SLOTS).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(n_words), pa.array(word_chars), pa.array(symbol, pa.int64()), pa.array(dup, pa.int64()), pa.array(repeat, pa.int64()), pa.array(points_of, pa.int64()), pa.array(classes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64())), b.column("row")],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    there = columns_of(docs.withColumnRenamed(row, "row") if row else docs.drop("row"), doc_id="bigint", text="string", lang="string", row="bigint")
    return there.mapInArrow(features, schema)


def _distance(p, q, sp, sq):
    """Jensen-Shannon distance (base 2) of two count arrays with the sums sp and sq; null where one is empty."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: term(x / sp, (x / sp + y / sq) / 2) + term(y / sq, (x / sp + y / sq) / 2))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2)))


def _judged(f: DataFrame, trusted, max_class: float, max_word: float) -> DataFrame:
    """f with class_distance, word_distance and near, against the pooled histograms of its rows where `trusted` holds."""
    sums = lambda c, n: F.array(*[F.sum(F.when(trusted, F.col(c)[i]).otherwise(0)) for i in range(n)])
    total = lambda c: F.sum(F.when(trusted, F.col(c)).otherwise(0))
    # a row per known language and one for all others
    reference = f.groupBy("lang_key").agg(
        sums("classes", len(CLASSES)).alias("ref_classes"), sums("words", SLOTS).alias("ref_words"), total("n_points").alias("ref_points"), total("n_words").alias("ref_n_words")
    )
    j = f.join(F.broadcast(reference), "lang_key")
    by_class = _distance(F.col("classes"), F.col("ref_classes"), F.col("n_points"), F.col("ref_points"))
    by_word = _distance(F.col("words"), F.col("ref_words"), F.col("n_words"), F.col("ref_n_words"))
    j = j.withColumn("class_distance", F.when(F.col("n_points") >= MIN_CHARS, by_class))
    j = j.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & (F.col("lang_key") != OTHER), by_word))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return j.withColumn("near", near).drop("ref_classes", "ref_words", "ref_points", "ref_n_words")


def quality_verdicts(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, row: str | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept.

    docs: doc_id, text, lang; `row` names a bigint column that is passed through as
    row. Null texts have no words and fail; documents of unknown language are judged by their
    characters only; where a language has no trusted document its documents have no
    distance and only the base rules count; an empty table gives no rows.
    """
    f = document_features(docs, row)
    base = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    f = materialize(f.withColumn("base_failed", base), "features")
    first = _judged(f, ~F.col("base_failed"), max_class, max_word)
    first = materialize(first.withColumn("trusted", ~F.col("base_failed") & F.col("near")).drop("class_distance", "word_distance", "near"), "first-pass")
    out = _judged(first, F.col("trusted"), max_class, max_word)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("near")).drop("classes", "words", "lang_key", "trusted", "near", "n_points")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that quality_verdicts keeps, with the columns of documents.

    Verdicts are joined by a row number that is written with the documents.
    """
    rows = materialize(documents_of(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    good = quality_verdicts(rows, row="row").filter("kept").select("row")
    return rows.join(good, "row", "left_semi").drop("row")
