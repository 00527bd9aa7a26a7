"""Readers and writers of the file formats that graphs and corpora come in."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Iterator
from functools import reduce
from html import unescape
from itertools import accumulate, batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import latex
from quillgraph.operators.tables import written

METADATA = "id string, submitter string, authors string, title string, comments string, `journal-ref` string, doi string, `report-no` string, categories string, license string, abstract string, versions array<struct<version: string, created: string>>, update_date string, authors_parsed array<array<string>>"


def read_metadata(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Metadata JSON lines; bad lines are skipped, or fail where strict."""
    return spark.read.schema(METADATA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def title_index(metadata: DataFrame) -> DataFrame:
    """(title_key, id): titles of two words or more; of several ids of a title the greatest."""
    from quillgraph.functions.text import title_key

    k = metadata.select(title_key(F.col("title")).alias("title_key"), "id").filter(F.size(F.split("title_key", " ")) >= 2)
    return k.groupBy("title_key").agg(F.max("id").alias("id"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with columns in the order of their names."""
    df.select(sorted(df.columns)).write.json(path)


def embedding_columns(df: DataFrame) -> tuple[str, str]:
    """The id and vector columns: by their usual names, else the first two."""
    names = df.columns
    i = next((c for c in ("paper_id", "id", "vec_id") if c in names), names[0])
    v = next((c for c in ("embedding", "embeddings", "vector") if c in names), names[1])
    return i, v


def read_embeddings(spark: SparkSession, base: str, supplement: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, embedding): the base's, and of a supplement what the base lacks; ids (id) keeps only those."""
    d = spark.read.parquet(base)
    i, v = embedding_columns(d)
    out = d.select(F.col(i).alias("id"), F.col(v).alias("embedding"))
    if supplement:
        s = spark.read.parquet(supplement)
        i, v = embedding_columns(s)
        s = s.select(F.col(i).alias("id"), F.col(v).alias("embedding"))
        out = out.unionByName(s.join(out.select("id"), "id", "left_anti"))
    return out.join(ids.select("id"), "id", "left_semi") if ids is not None else out


def append_missing(new: DataFrame, path: str, key: str) -> int:
    """Appends to a Parquet table the rows whose key it lacks, and returns how many. One writer at a time."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.select(key).limit(0)
    rows = written(new.dropDuplicates([key]).join(old, key, "left_anti"))
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def evolved_store(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet store whose parts may have come with more columns later on; rows of older parts have nulls there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, ...) of a saved edge list: a Parquet table."""
    return spark.read.parquet(path)


def save_edge_list(edges: DataFrame, path: str) -> None:
    """Saves edges clustered by source, so that a source's references lie in one file, with tight statistics for pruning."""
    edges.repartition("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def ordered_papers(base: DataFrame, supplement: DataFrame) -> DataFrame:
    """(id, part, pos): the base in its order, then the supplement's other ids by id."""
    extra = supplement.select("id").distinct().join(base.select("id"), "id", "left_anti")
    return base.select("id", F.lit(0).alias("part"), F.col("pos").cast("string").alias("pos")).unionByName(extra.select("id", F.lit(1).alias("part"), F.col("id").cast("string").alias("pos")))


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


_GEXF_TAG = re.compile(r"<(node|edge)\b([^>]*?)(/>|>(.*?)</\1>)", re.S)
_GEXF_NODE = re.compile(r"<(node)\b([^>]*?)(/>|>(.*?)</node>)", re.S)
_GEXF_ATTR = re.compile(r"""(\w+)=(?:"([^"]*)"|'([^']*)')""")


# Characters that XML attribute values can't hold as they are.
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\n": "&#10;", "\r": "&#13;"}


def _attributes(tag: str) -> dict[str, str]:
    return {k: unescape(a or b) for k, a, b in _GEXF_ATTR.findall(tag)}


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, label, attributes map), edges (src, dst, sentence, pos)) of GEXF files, plain or gzipped; the sentence falls back to the label.

    pos has the file's number, in the order of names, times 2^32, plus the place in the file. A file is read whole; nodes pass over edges.
    """
    found = spark.read.format("binaryFile").load(path)
    number = {name: i for i, name in enumerate(sorted(r["path"] for r in found.select("path").toLocalIterator()))}

    def elements(raw: bytes, tag: re.Pattern, kind: str) -> Iterator[tuple[int, dict[str, str]]]:
        text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
        defined = [_attributes(x) for x in re.findall(r"<attribute\b[^>]*>", text)]
        names = {d.get("id", ""): d.get("title", "") for d in defined}
        for i, m in enumerate(tag.finditer(text)):
            if m[1] == kind:
                a = _attributes(m[2])
                for x in map(_attributes, re.findall(r"<attvalue\b[^>]*>", m[4] or "")):
                    a[names.get(x.get("for", ""), x.get("for", ""))] = x.get("value", "")
                yield i, a

    def rows(b: pa.RecordBatch, tag: re.Pattern, kind: str) -> Iterator[tuple[int, list[int], list[dict[str, str]]]]:
        for name, content in zip(b.column("path"), b.column("content"), strict=True):
            for some in batched(elements(content.as_py(), tag, kind), 20_000):
                yield number[name.as_py()] << 32, [i for i, _ in some], [a for _, a in some]

    def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, some in rows(b, _GEXF_NODE, "node"):
                own = pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, some))], pa.int32()), pa.array([k for a in some for k in a], pa.string()), pa.array([v for a in some for v in a.values()], pa.string()))
                columns = [pa.array([a.get("id") for a in some], pa.string()), pa.array([a.get("label", a.get("id")) for a in some], pa.string()), own]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "attributes"])

    def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, places, some in rows(b, _GEXF_TAG, "edge"):
                columns = [[a.get("source") for a in some], [a.get("target") for a in some], [a.get("sentence") or a.get("label", "") for a in some]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array([first + i for i in places], pa.int64())], names=["src", "dst", "sentence", "pos"])

    whole = found.select("path", "content")
    return whole.mapInArrow(node_rows, "id string, label string, attributes map<string,string>"), whole.mapInArrow(edge_rows, "src string, dst string, sentence string, pos bigint")


def _gexf_parts(nodes: DataFrame) -> tuple[dict, Column, Column]:
    """Fixed lines by part, a node's line and an edge's line."""
    quoted = lambda c: F.concat(F.lit('"'), reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _ESCAPES.items(), F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'))
    values = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(F.lit("<attvalue for="), quoted(e["key"]), F.lit(" value="), quoted(e["value"]), F.lit("/>"))), "")
    own = F.coalesce(values(F.col("attributes")), F.lit("")) if "attributes" in nodes.columns else F.lit("")
    fixed = {0: '<?xml version="1.0" encoding="UTF-8"?>', 1: '<gexf version="1.2"><graph defaultedgetype="directed">', 2: '<attributes class="edge"><attribute id="0" title="sentence" type="string"/></attributes>', 3: "<nodes>", 5: "</nodes>", 6: "<edges>", 8: "</edges>", 9: "</graph></gexf>"}
    node = F.concat(F.lit("<node id="), quoted(F.col("id")), F.lit(" label="), quoted(F.col("title")), F.lit("><attvalues>"), own, F.lit("</attvalues></node>"))
    edge = F.concat(F.lit("<edge source="), quoted(F.col("src")), F.lit(" target="), quoted(F.col("dst")), F.lit('><attvalues><attvalue for="0" value='), quoted(F.col("sentence")), F.lit("/></attvalues></edge>"))
    return fixed, node, edge


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a GEXF file, in order: nodes (id, title and, if there, attributes map) and edges (src, dst, sentence, pos)."""
    fixed, node, edge = _gexf_parts(nodes)
    frame = nodes.sparkSession.createDataFrame(list(fixed.items()), "part int, line string").select("part", F.array().cast("array<string>").alias("key"), "line")
    key = lambda *c: F.array(*[x.cast("string") for x in c])
    n = nodes.select(F.lit(4).alias("part"), key(F.col("id")).alias("key"), node.alias("line"))
    e = edges.select(F.lit(7).alias("part"), key(F.lpad(F.col("pos").cast("string"), 20, "0"), F.col("src"), F.col("dst")).alias("key"), edge.alias("line"))
    return frame.unionByName(n).unionByName(e).orderBy("part", "key").select("line")


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, largest: int = 250_000) -> None:
    """A folder with one GEXF file for other tools, sorted; Parquet is the primary format.

    With more than `largest` nodes or edges it has several gzipped files of about so many
    instead, each a whole GEXF document: first nodes, then edges, whose order is that of the files' names.
    Nodes are computed once; edges up to three times, and so had better be a written table.
    """
    n, e = written(nodes.select([c for c in ("id", "title", "attributes") if c in nodes.columns]), 16 << 20), edges.select("src", "dst", "sentence", "pos")
    several, most = n.count(), e.count()
    if max(several, most) <= largest:
        gexf_lines(n, e).coalesce(1).write.mode("overwrite").text(path)
        return
    fixed, node, edge = _gexf_parts(n)
    head, tail = "\n".join(fixed[k] for k in (0, 1, 2)), fixed[9]

    def documents(d: DataFrame, size: int, keys: list, line, parts: tuple[int, int]) -> DataFrame:
        lines = d.repartitionByRange(max(1, -(-size // largest)), *keys).sortWithinPartitions(*keys).select(line.alias("line"))
        before, after = f"{head}\n{fixed[parts[0]]}", f"{fixed[parts[1]]}\n{tail}"

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([before])], names=["line"])
            yield from (pa.RecordBatch.from_arrays([b.column(0)], names=["line"]) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([after])], names=["line"])

        return lines.mapInArrow(whole, "line string")

    documents(n, several, [F.col("id").cast("string")], node, (3, 5)).write.mode("overwrite").option("compression", "gzip").text(path)
    documents(e, most, [F.col("pos"), F.col("src").cast("string"), F.col("dst").cast("string")], edge, (6, 8)).write.mode("append").option("compression", "gzip").text(path)


def unpacked(archives: DataFrame, suffixes: tuple[str, ...] = (".tex", ".bbl", ".bib"), largest: int = 1_500_000) -> DataFrame:
    """(archive, name, text) of the text files in tar archives (path, content); larger ones are skipped, as is anthology.bib."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for where, content in zip(b["path"], b["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    rows += [(where, m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar if m.isfile() and m.name.endswith(suffixes) and m.size <= largest and not m.name.endswith("anthology.bib")]
            yield pd.DataFrame(rows, columns=["archive", "name", "text"])

    return archives.select("path", "content").mapInPandas(unpack, "archive string, name string, text string")


def archive_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".tex", ".bbl", ".bib"), largest: int = 1_500_000) -> DataFrame:
    """unpacked, for the tar files of a path."""
    return unpacked(spark.read.format("binaryFile").load(path), suffixes, largest)


def materialised_sources(texts: DataFrame) -> DataFrame:
    """(archive, main, tex): each archive's main file (else its longest) with its inputs in place; texts as of unpacked."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        files = dict(zip(pdf["name"], pdf["text"], strict=True))
        main = latex.main_file(files)
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "main": [main], "tex": [latex.inlined(files, main)]})

    return texts.groupBy("archive").applyInPandas(whole, "archive string, main string, tex string")


def latest_records(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the record that comes last in the order."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return records.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows of staged OAI record files (JSON lines with one `xml` string each); an empty update date falls back to the creation date."""
    x = spark.read.schema("xml string").json(path)
    get = lambda tag: F.nullif(F.trim(F.regexp_extract("xml", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    names = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<author>(.*?)</author>"), 1), lambda a: F.trim(F.concat_ws(" ", F.nullif(F.regexp_extract(a, r"<forenames>(.*?)</forenames>", 1), F.lit("")), F.regexp_extract(a, r"<keyname>(.*?)</keyname>", 1))))
    return x.select(get("id").alias("id"), F.array_join(names, ", ").alias("authors"), get("title").alias("title"), get("categories").alias("categories"), get("abstract").alias("abstract"), F.coalesce(get("updated"), get("created")).alias("update_date")).filter("id is not null")


def read_id_list(spark: SparkSession, path: str, keys: tuple[str, ...] = ("ids", "source_ids", "test_sources")) -> DataFrame:
    """(id) of JSON files that hold a list, or an object with one of the keys."""
    t = spark.read.text(path, wholetext=True)
    lists = [F.from_json("value", "array<string>"), *[F.from_json("value", f"{k} array<string>")[k] for k in keys]]
    return t.select(F.explode(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])).alias("id"))
