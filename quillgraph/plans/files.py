"""Queries on sources and sinks: each writes its files to the shared folder and reads them back."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import contracts, resolve, search, upserts
from quillgraph.operators.tables import shared_path, written
from quillgraph.plans.registry import Tables, query
from quillgraph.sources import files, harvest

_ID = "concat('2401.', lpad(cast(p_partkey as varchar), 5, '0'))"
_META = f"select {_ID} as id, p_name as title, p_type as abstract, '2024-01-02' as update_date from part"


def _metadata(t: Tables) -> DataFrame:
    key = F.concat(F.lit("2401."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    return t.read("part").select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.lit("2024-01-02").alias("update_date"))


def _json_lines(t: Tables, bad: bool) -> str:
    """The metadata as JSON lines, with broken ones among them."""
    path = shared_path(t.spark)
    lines = _metadata(t).select(F.to_json(F.struct("id", "title", "abstract", "update_date")).alias("value"))
    if bad:
        lines = lines.unionByName(lines.select(F.concat(F.substring("value", 1, 20), F.lit(" broken")).alias("value")))
    lines.write.text(path)
    return path


@query("s01_metadata_scan", f"with m as ({_META}) select title as title_key, max(id) as id from m where contains(title, ' ') group by 1")
def s01(t: Tables) -> DataFrame:
    return files.title_index(files.read_metadata(t.spark, _json_lines(t, bad=True)))


@query("s02_strict_scan", _META)
def s02(t: Tables) -> DataFrame:
    return files.read_metadata(t.spark, _json_lines(t, bad=False), strict=True).select("id", "title", "abstract", "update_date")


@query("s03_json_lines", f"""with m as ({_META}) select concat('{{"abstract":"', abstract, '","id":"', id, '","title":"', title, '","update_date":"', update_date, '"}}') as line from m""")
def s03(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    files.write_json_lines(_metadata(t), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("s05_append_missing", "select doc_id as id, case when doc_id % 3 <> 0 then source else lang end as topic, (select count(*) from documents where doc_id % 3 = 0 and doc_id % 2 = 0) as appended from documents where doc_id % 3 <> 0 or doc_id % 2 = 0")
def s05(t: Tables) -> DataFrame:
    path, d = shared_path(t.spark), t.read("documents").withColumnRenamed("doc_id", "id")
    d.filter("id % 3 <> 0").select("id", F.col("source").alias("topic")).write.parquet(path)
    n = files.append_missing(d.filter("id % 2 = 0").select("id", F.col("lang").alias("topic")), path, "id")
    return t.spark.read.parquet(path).withColumn("appended", F.lit(n).cast("bigint"))


@query("s08_vector_append", "select vec_id as id, round(embedding[1]::double + case when vec_id % 3 = 0 then 1 else 0 end, 5) as x from embeddings")
def s08(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    v = t.vec.select("id", F.col("v").alias("embedding"))
    v.filter("id % 3 <> 0").write.parquet(path)
    files.append_missing(v.select("id", F.transform("embedding", lambda x: x + 1).alias("embedding")), path, "id")
    return t.spark.read.parquet(path).select("id", F.round(F.col("embedding")[0], 5).alias("x"))


@query("s06_paper_order", "select p_partkey as id, 0 as part, cast(10000000 - p_partkey as varchar) as pos from part where p_partkey % 3 = 0 union all select p_partkey, 1, cast(p_partkey as varchar) from part where p_partkey % 3 <> 0")
def s06(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("id"), (10_000_000 - F.col("p_partkey")).alias("pos"))
    return files.ordered_papers(p.filter("id % 3 = 0"), p)


def _vector_files(t: Tables, names: tuple[str, str]) -> tuple[str, str]:
    """A base, and a supplement of all vectors, moved by one."""
    base, more = shared_path(t.spark), shared_path(t.spark)
    v = t.vec
    v.filter("id % 3 <> 0").select(F.col("id").alias(names[0]), F.col("v").alias(names[1]), F.lit("x").alias("note")).write.parquet(base)
    v.select(F.col("id").alias(names[0]), F.transform("v", lambda x: x + 1).alias(names[1]), F.lit("x").alias("note")).write.parquet(more)
    return base, more


@query("s07_vector_merge", "select vec_id as id, round(embedding[1]::double + case when vec_id % 3 = 0 then 1 else 0 end, 5) as x from embeddings")
def s07(t: Tables) -> DataFrame:
    return files.read_embeddings(t.spark, *_vector_files(t, ("paper_id", "embedding"))).select("id", F.round(F.col("embedding")[0], 5).alias("x"))


@query("s09_needed_vectors", "select vec_id as id, round(embedding[1]::double, 5) as x from embeddings where vec_id % 3 <> 0 and vec_id in (select doc_id from labels)")
def s09(t: Tables) -> DataFrame:
    base, _ = _vector_files(t, ("id", "embeddings"))
    return files.read_embeddings(t.spark, base, ids=t.read("labels").select(F.col("doc_id").alias("id"))).select("id", F.round(F.col("embedding")[0], 5).alias("x"))


@query("s11_column_names", "select vec_id as id, round(embedding[1]::double, 5) as x, 'key,numbers' as found from embeddings where vec_id % 3 <> 0")
def s11(t: Tables) -> DataFrame:
    base, _ = _vector_files(t, ("key", "numbers"))
    found = files.embedding_columns(t.spark.read.parquet(base))
    return files.read_embeddings(t.spark, base).select("id", F.round(F.col("embedding")[0], 5).alias("x"), F.lit(",".join(found)).alias("found"))


def _gexf(t: Tables) -> str:
    path, edges = shared_path(t.spark), written(t.edges, 16 << 20)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ids.select("id", F.concat(F.lit('a "title" & <'), F.col("id").cast("string")).alias("title"), F.create_map(F.lit("year"), (F.col("id") % 30 + 1990).cast("string")).alias("attributes"))
    files.write_gexf(nodes, edges, path)
    return path


@query("s12_gexf_edges", "select cast(src as varchar) as src, cast(dst as varchar) as dst, sentence, cast(row_number() over (order by pos, cast(src as varchar), cast(dst as varchar)) as bigint) as nth from edges", "edges")
def s12(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    _, e = files.read_gexf(t.spark, _gexf(t))
    e = written(e.withColumn("file", F.shiftright("pos", 32)), 16 << 20)
    # rows are numbered inside their file; one row a file is numbered through
    before = e.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("pos")) + F.col("before")
    return e.join(F.broadcast(before), "file").select("src", "dst", "sentence", nth.cast("bigint").alias("nth"))


@query("s13_gexf_nodes", "select cast(id as varchar) as id, concat('a \"title\" & <', id) as label, cast(id % 30 + 1990 as varchar) as year from nodes", "nodes")
def s13(t: Tables) -> DataFrame:
    n, _ = files.read_gexf(t.spark, _gexf(t))
    return n.select("id", "label", F.col("attributes")["year"].alias("year"))


@query("s14_edge_list", "select src, dst, sentence, pos from edges", "edges")
def s14(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    files.save_edge_list(t.edges, path)
    return files.edge_list(t.spark, path)


@query("s15_evolved_store", f"with m as ({_META}) select id, title, null::varchar as topic from m union all select id, concat(title, ' again'), abstract from m")
def s15(t: Tables) -> DataFrame:
    path, m = shared_path(t.spark), _metadata(t)
    m.select("id", "title").write.parquet(path)
    m.select("id", F.concat("title", F.lit(" again")).alias("title"), F.col("abstract").alias("topic")).write.mode("append").parquet(path)
    return files.evolved_store(t.spark, path).select("id", "title", "topic")


@query("s17_oai_records", f"with m as ({_META}) select id, 'Ada B. Lovelace, Plato' as authors, title, abstract as categories, 'about it' as abstract, case when right(id, 1) in ('0', '2', '4', '6', '8') then '2024-03-04' else '2024-01-02' end as update_date from m")
def s17(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    m = _metadata(t)
    updated = F.when(F.substring("id", -1, 1).cast("int") % 2 == 0, "<updated>2024-03-04</updated>").otherwise("<updated></updated>")
    authors = "<authors><author><keyname>Lovelace</keyname><forenames>Ada B.</forenames></author><author><keyname>Plato</keyname></author></authors>"
    xml = F.concat(F.lit("<record><id>"), "id", F.lit("</id><created>2024-01-02</created>"), updated, F.lit(authors + "<title>"), "title", F.lit("</title><categories>"), "abstract", F.lit("</categories><abstract>about it</abstract></record>"))
    m.select(F.to_json(F.struct(xml.alias("xml"))).alias("value")).write.text(path)
    return files.oai_records(t.spark, path)


@query("s18_author_names", "select c_custkey, concat(c_mktsegment, ' ', c_name, ', ', c_name) as authors from customer")
def s18(t: Tables) -> DataFrame:
    a = F.array(F.struct(F.col("c_mktsegment").alias("forenames"), F.col("c_name").alias("keyname")), F.struct(F.lit(None).cast("string").alias("forenames"), F.col("c_name").alias("keyname")))
    return t.read("customer").select("c_custkey", search.authors_text(a).alias("authors"))


def _archives(t: Tables) -> DataFrame:
    """(path, content): a tar archive for each document, with a main file that takes in another."""

    def pack(path: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for p, x in zip(path, text, strict=True):
            made = io.BytesIO()
            with tarfile.open(fileobj=made, mode="w") as tar:
                for name, body in (("body.tex", x or ""), ("paper.tex", "\\documentclass{article}\n\\begin{document}\\input{body}\\end{document} " + p), ("refs.bib", "@misc{k, title={T}}"), ("anthology.bib", "@misc{a, title={A}}"), ("figure.png", "no text")):
                    data = body.encode()
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            out.append(made.getvalue())
        return pd.Series(out)

    path = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    return t.read("documents").select(path.alias("path"), F.pandas_udf(pack, "binary")(path, "text").alias("content"))


@query("s19_archive_texts", "select concat('p', doc_id) as archive, n as name, case n when 'body.tex' then octet_length(encode(text)) when 'refs.bib' then 19 else 67 + length(concat('p', doc_id)) end::bigint as bytes from documents cross join (select unnest(['body.tex', 'paper.tex', 'refs.bib']) as n)")
def s19(t: Tables) -> DataFrame:
    return files.unpacked(_archives(t)).select("archive", "name", F.octet_length("text").cast("bigint").alias("bytes"))


@query("s28_whole_sources", "select concat('p', doc_id) as archive, 'paper.tex' as main, md5(concat('\\documentclass{article}', chr(10), '\\begin{document}', text, '\\end{document} p', doc_id)) as digest from documents")
def s28(t: Tables) -> DataFrame:
    return files.materialised_sources(files.unpacked(_archives(t))).select("archive", "main", F.md5(F.col("tex").cast("binary")).alias("digest"))


@query("s21_failed_ids", "select doc_id as id from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0")
def s21(t: Tables) -> DataFrame:
    d = t.read("documents").select(F.concat(F.lit("hep-th/"), F.col("doc_id").cast("string")).alias("id"), "doc_id")
    failed = d.filter("doc_id % 7 = 0").select("id").unionByName(d.filter("doc_id % 11 = 0").select(F.replace("id", F.lit("/"), F.lit("")).alias("id")))
    return upserts.not_failed(d, failed).select(F.col("doc_id").alias("id"))


@query("s22_shard_merge", "select src as qid, dst as cid, case when dst % 3 = 1 then sentence end as sentence from edges", "edges")
def s22(t: Tables) -> DataFrame:
    e = t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("cid"), "sentence")
    shards = [e.filter(f"cid % 3 = {i}") for i in range(3)]
    return contracts.merged_shards([shards[0].drop("sentence"), shards[1], shards[2].drop("sentence")], 3)


@query("s23_evaluation_merge", "select qid, round(avg(x), 6) as mean, count(*) as n from (select src as qid, dst::double as x from edges) group by 1", "edges")
def s23(t: Tables) -> DataFrame:
    e = t.edges.select(F.col("src").alias("qid"), F.col("dst").cast("double").alias("x"))
    whole = contracts.merged_shards([e.filter("x % 2 = 0"), e.filter("x % 2 = 1")], 2)
    return whole.groupBy("qid").agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("s24_pair_shards", "select src, dst from edges", "edges")
def s24(t: Tables) -> DataFrame:
    paths = [shared_path(t.spark) for _ in range(3)]
    for i, p in enumerate(paths):
        t.edges.filter(F.col("dst") % 3 == i).select("src", "dst").write.parquet(p)
    return t.spark.read.parquet(*paths)


@query("s27_id_lists", "select p_partkey as id from part where p_partkey % 2 = 0 union all select p_partkey from part where p_partkey % 2 = 1")
def s27(t: Tables) -> DataFrame:
    """One file with a plain list, one with an object that holds the list."""
    p = t.read("part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 2).alias("k"))
    lists = p.groupBy("k").agg(F.collect_list("id").alias("source_ids"))
    paths = [shared_path(t.spark), shared_path(t.spark)]
    lists.filter("k = 0").select(F.to_json("source_ids").alias("value")).coalesce(1).write.text(paths[0])
    lists.filter("k = 1").select(F.to_json(F.struct("source_ids")).alias("value")).coalesce(1).write.text(paths[1])
    both = [files.read_id_list(t.spark, f"{x}/part-*") for x in paths]
    return both[0].unionByName(both[1]).select(F.col("id").cast("bigint").alias("id"))


@query("s29_library_precedence", "select src as paper_id, cast(dst % 20 as varchar) as cite_key, case when bool_or(dst % 3 = 2) then 'bib' when bool_or(dst % 3 = 1) then 'bbl' else 'tex' end as title from edges group by 1, 2", "edges")
def s29(t: Tables) -> DataFrame:
    k = F.col("dst") % 3
    origin = F.when(k == 2, "bib").when(k == 1, "bbl").otherwise("tex")
    e = t.edges.select(F.col("src").alias("paper_id"), (F.col("dst") % 20).cast("string").alias("cite_key"), origin.alias("origin"), F.create_map(F.lit("title"), origin).alias("fields"))
    return resolve.library_precedence(e).select("paper_id", "cite_key", F.col("fields")["title"].alias("title"))


@query("s30_score_parts", "select src as qid, dst as cid, dst % 4 as part from edges", "edges")
def s30(t: Tables) -> DataFrame:
    e = t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("cid"), (F.col("dst") % 4).alias("part"))
    path = shared_path(t.spark)
    e.write.partitionBy("part").parquet(path)
    return t.spark.read.parquet(path).select("qid", "cid", F.col("part").cast("bigint").alias("part"))


@query("s31_latest_records", "select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def s31(t: Tables) -> DataFrame:
    return files.latest_records(t.read("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("s37_topic_arrays", "select doc_id as id, case when doc_id % 3 = 0 then concat(lang, ',s') else concat(source, ',b') end as topics from documents where doc_id % 3 = 0 or doc_id % 2 = 0")
def s37(t: Tables) -> DataFrame:
    d = t.read("documents").select(F.col("doc_id").alias("id"), "source", "lang")
    base = d.filter("id % 2 = 0").select("id", F.array("source", F.lit("b")).alias("topics"))
    more = d.filter("id % 3 = 0").select("id", F.array("lang", F.lit("s")).alias("topics"))
    return upserts.overridden(base, more, ("topics",)).select("id", F.array_join("topics", ",").alias("topics"))


@query("i05_incremental_merge", """with o as (select doc_id as id, source as title, n_chars as update_date from documents where doc_id % 2 = 0), n as (select doc_id as id, concat('new ', lang) as title, case when doc_id % 4 = 0 then n_chars - 1 else n_chars + 1 end as update_date from documents where doc_id % 3 = 0)
    select coalesce(o.id, n.id) as id, case when n.id is not null and (o.id is null or n.update_date >= o.update_date) then n.title else o.title end as title, case when n.id is not null and (o.id is null or n.update_date >= o.update_date) then n.update_date else o.update_date end as update_date from o full join n on o.id = n.id""")
def i05(t: Tables) -> DataFrame:
    """The merge of a snapshot as a stream of staged files, one micro-batch each."""
    from quillgraph.plans.tables import _snapshots
    from quillgraph.streaming.upserts import latest_version, merge_stream

    old, new = _snapshots(t)
    table, staged, state = (shared_path(t.spark) for _ in range(3))
    old.write.parquet(f"{table}/v=0")
    for k in range(2):
        new.filter(f"id % 2 = {k}").coalesce(1).write.mode("append").parquet(staged)
    incoming = t.spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(staged)
    merge_stream(t.spark, incoming, table, state).awaitTermination()
    return latest_version(t.spark, table)


@query("s16_staged_harvest", f"with m as ({_META}) select id, title, 7 as pages from m")
def s16(t: Tables) -> DataFrame:
    """Seven pages of records, each named by the token that the page before gave; the third fails at first."""
    path, m = shared_path(t.spark), _metadata(t)
    xml = F.concat(F.lit("<record><id>"), "id", F.lit("</id><created>2024-01-02</created><title>"), "title", F.lit("</title></record>"))
    failed = []

    def fetch(token: str | None) -> tuple[DataFrame, str | None]:
        k = int(token or 0)
        if k == 2 and not failed:
            failed.append(k)
            raise OSError("no answer")
        return m.filter(F.substring("id", -5, 5).cast("int") % 7 == k).select(xml.alias("xml")), str(k + 1) if k < 6 else None

    pages, rest = harvest.staged_harvest(fetch, path)
    return files.oai_records(t.spark, path).select("id", "title", F.lit(pages if rest is None else -1).alias("pages"))


def _fetched(i: str) -> bytes:
    n = int(i)
    if n % 7 == 0:
        raise OSError("not found")
    return b"x" * (n % 50)


@query("s20_downloads", "select doc_id as id, case when doc_id % 7 = 0 or doc_id % 50 > 40 then null else doc_id % 50 end as bytes, case when doc_id % 7 = 0 then 'not found' when doc_id % 50 > 40 then 'over 40 bytes' end as error from documents")
def s20(t: Tables) -> DataFrame:
    d = harvest.downloaded(t.read("documents").select(F.col("doc_id").cast("string").alias("id")), _fetched, 40)
    return d.select(F.col("id").cast("bigint").alias("id"), F.octet_length("content").cast("bigint").alias("bytes"), "error")


@query("s25_content_digests", "select k::integer as k, sum(length(p_name) + 1)::bigint as bytes, sha256(concat(string_agg(p_name, chr(10) order by p_name, p_partkey), chr(10))) as sha256 from (select *, p_partkey % 5 as k from part) group by 1")
def s25(t: Tables) -> DataFrame:
    """Digests of five files of names."""
    path, p = shared_path(t.spark), t.read("part")
    for i in range(5):
        p.filter(F.col("p_partkey") % 5 == i).orderBy("p_name", "p_partkey").select("p_name").coalesce(1).write.text(f"{path}/k={i}")
    d = files.content_digest(t.spark, path).filter(F.col("path").endswith(".txt"))
    return d.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("k"), "bytes", "sha256")
