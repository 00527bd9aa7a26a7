"""The paper store and its searches: index upkeep, browse, text and semantic search, pages and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators.ranking import bm25


def postings(papers: DataFrame, fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(id, terms): the index rows of papers, all fields' tokens in a row."""
    return papers.select("id", tx.tokens(F.concat_ws(" ", *fields)).alias("terms"))


def refreshed(index: DataFrame, papers: DataFrame, fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """The index with new rows for papers (delete and insert by id)."""
    return index.join(papers.select("id"), "id", "left_anti").unionByName(postings(papers, fields))


def text_search(index: DataFrame, queries: DataFrame, every_term: bool = True) -> DataFrame:
    """(qid, id, score): BM25 of papers that hold all (or any) of the query's terms; queries (qid, text)."""
    q = queries.select("qid", F.transform(F.array_distinct(tx.fts_query_terms(F.lower("text"))), lambda t: t).alias("terms"))
    s = bm25(index.select(F.col("id").alias("doc"), "terms"), q)
    if every_term:
        s = s.join(q.select("qid", F.size("terms").alias("_n")), "qid").filter(F.col("n_terms") == F.col("_n"))
    return s.select("qid", F.col("doc").alias("id"), "score")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, qid: str = "qid") -> DataFrame:
    """A page of each query's rows with `ord` and the exact `total`."""
    w = Window.partitionBy(qid)
    d = rows.withColumn("ord", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("total", F.count(F.lit(1)).over(w))
    return d.filter((F.col("ord") > offset) & (F.col("ord") <= offset + limit))


def corpus_search(papers: DataFrame, index: DataFrame, queries: DataFrame, degrees: DataFrame | None = None, years: tuple[int, int] | None = None, least_indegree: int = 0, surveys: bool = False, sort: str = "relevance", limit: int = 20, offset: int = 0) -> DataFrame:
    """Text search, exact filters, then the page: sorts are relevance, recency, title."""
    d = text_search(index, queries).join(papers.select("id", "title", "update_date", F.substring("abstract", 1, 500).alias("abstract")), "id")
    if years:
        d = d.filter(F.substring("update_date", 1, 4).cast("int").between(*years))
    if least_indegree and degrees is not None:
        d = d.join(degrees.select("id", "indeg"), "id").filter(F.col("indeg") >= least_indegree)
    if surveys:
        d = d.filter(tx.survey_title(F.col("title")))
    order = {"relevance": [F.round("score", 9).desc(), F.col("id")], "recency": [F.col("update_date").desc(), F.col("id").desc()], "title": [F.col("title"), F.col("id")]}[sort]
    return page(d, order, limit, offset)


def year_histogram(rows: DataFrame, date: str = "update_date", last: int = 40) -> DataFrame:
    """(year, n) of the newest `last` years."""
    h = rows.groupBy(F.substring(date, 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("_rn", F.row_number().over(Window.orderBy(F.col("year").desc()))).filter(F.col("_rn") <= last).drop("_rn")


def semantic_search(vectors: DataFrame, queries: DataFrame, least: float | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page by cosine: vectors (id, emb), queries (qid, emb)."""
    from quillgraph.functions.vectors import block_scores

    d = block_scores(queries.select(F.col("qid").alias("id"), "emb"), vectors.select("id", "emb")).select("qid", F.col("cid").alias("id"), F.round("cosine", 9).alias("score"))
    return page(d.filter(F.col("score") >= least) if least is not None else d, [F.col("score").desc(), F.col("id")], limit, offset)


def authors_text(authors: Column) -> Column:
    """Authors array<struct<forenames, keyname>> as `forenames keyname, ...`."""
    return F.array_join(F.transform(authors, lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"]))), ", ")


def store_rows(snapshot: DataFrame, origin: str = "snapshot") -> DataFrame:
    """Snapshot rows as store rows: text columns are empty, not null."""
    text = ("title", "authors", "categories", "abstract", "update_date")
    return snapshot.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in snapshot.columns else F.lit("").alias(c) for c in text], F.lit(origin).alias("origin"))
