"""Resolving bibliography entries to papers, and similarity joins of small texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx


def first_hit(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(id, hit, prio): keys (id, prio, key) in index (key, hit); the least priority that is found."""
    found = keys.join(index, "key")
    return found.groupBy("id").agg(F.min_by("hit", F.struct("prio", "hit")).alias("hit"), F.min("prio").alias("prio"))


#: Fields that hold a paper's id, best first.
ID_FIELDS = ("eprint", "url", "journal", "booktitle", "note")


def lookups(field: Callable[[str], Column]) -> Column:
    """What an entry is looked up by, as an array of (prio, by_title, key): ids in ID_FIELDS, then the variants of the title."""
    by_id = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(False).alias("by_title"), (F.regexp_extract(field(n), r"(\d{4}\.\d{4,5})", 1) if n == "eprint" else tx.marked_id(field(n))).alias("key")) for i, n in enumerate(ID_FIELDS)])
    keys = F.when(field("title").isNotNull(), tx.title_keys(field("title"))).otherwise(F.array().cast("array<string>"))
    by_title = F.transform(keys, lambda k, i: F.struct((i + len(ID_FIELDS)).alias("prio"), F.lit(True).alias("by_title"), k.alias("key")))
    return F.concat(F.filter(by_id, lambda x: x["key"] != ""), by_title)


def with_hits(rows: DataFrame, title_index: DataFrame, known: DataFrame) -> DataFrame:
    """rows with prio, by_title and key: one for each id in known, or in title_index (title_key, id), that has the key, as hit."""
    index = known.select(F.lit(False).alias("by_title"), F.col("id").alias("key"), F.col("id").alias("hit")).unionByName(title_index.select(F.lit(True).alias("by_title"), F.col("title_key").alias("key"), F.col("id").alias("hit")))
    return rows.join(index.hint("shuffle_hash"), ["by_title", "key"]).drop("by_title", "key")


def resolved_citations(library: DataFrame, title_index: DataFrame, known: DataFrame) -> DataFrame:
    """library (paper_id, cite_key, fields map) to (paper_id, cite_key, target).

    Ids in eprint, url, journal, booktitle and note go first, in this order and
    where known; then the variants of the title in title_index (title_key, id).
    """
    rows = library.select("paper_id", "cite_key", F.inline(lookups(lambda n: F.col("fields")[n])))
    return with_hits(rows, title_index, known).groupBy("paper_id", "cite_key").agg(F.min_by("hit", F.struct("prio", "hit")).alias("target"))


def library_precedence(entries: DataFrame) -> DataFrame:
    """entries (paper_id, cite_key, origin, fields): bib over bbl over in-text bibliography."""
    prio = F.when(F.col("origin") == "bib", 2).when(F.col("origin") == "bbl", 1).otherwise(0)
    return entries.groupBy("paper_id", "cite_key").agg(F.max_by("fields", prio).alias("fields"))


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: sets (id, s array of distinct items) with a Jaccard similarity of `least` and a common item.

    Prefix filter: in an order of rare items first, two such sets share one of
    their first n - ceil(least * n) + 1 items; only those are joined.
    """
    items = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("t"))
    freq = items.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ordered = items.join(freq, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    prefix = ordered.select("id", "n", F.explode(F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("p")).select("id", "n", "p.t")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    pairs = a.join(b, "t").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b").distinct()
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sa, "a").join(sb, "b").filter((both >= 1) & (both / F.size(F.array_union("sa", "sb")) >= least)).select("a", "b")
