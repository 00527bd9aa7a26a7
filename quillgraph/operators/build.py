"""Building a citation graph from parsed papers: edges, closure, growth, resumption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import latex
from quillgraph.operators import graph as g
from quillgraph.operators.resolve import lookups, with_hits
from quillgraph.operators.tables import written


def cited_edges(papers: DataFrame, title_index: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, sentence, pos) of papers (id, tex): citing sentences whose keys resolve to known papers."""
    r = latex.references(papers).select("paper_id", "ref", "sentence", "pos", F.inline(lookups(F.col)))
    # all of a paper's rows are sent to one task once
    hits = with_hits(r, title_index, known).repartition("paper_id")
    target = hits.groupBy("paper_id", "ref").agg(F.min_by("hit", F.struct("prio", "hit")).alias("dst"), F.first("sentence").alias("sentence"), F.first("pos").alias("pos")).filter(F.col("dst") != F.col("paper_id"))
    # references that no sentence names are edges without a sentence
    return target.groupBy(F.col("paper_id").alias("src"), "dst").agg(F.coalesce(F.min_by("sentence", "pos"), F.lit("")).alias("sentence"), F.coalesce(F.min("pos"), F.lit(2**31)).alias("pos"))


def seed_graph(papers: DataFrame, metadata: DataFrame, title_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the seeds' papers, without isolates."""
    e = written(cited_edges(papers, title_index, metadata.select("id")))
    return g.close_nodes(e, metadata), e


def grown_graph(papers: DataFrame, read: Callable[[DataFrame], DataFrame], metadata: DataFrame, title_index: DataFrame, similarity: DataFrame | None, rounds: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after rounds of expansion: the most cited unread papers are read, read(ids) returning (id, tex).

    Every round's edges are written, so a lost executor never costs an earlier round.
    """
    nodes, edges = seed_graph(papers, metadata, title_index)
    for _ in range(rounds):
        more = g.expansion_candidates(nodes, edges, similarity, budget).select("id")
        fresh = cited_edges(read(more), title_index, metadata.select("id"))
        if fresh.isEmpty():
            break
        edges = written(g.upsert_edges(edges, fresh).drop("added"))
        nodes = g.close_nodes(edges, metadata)
    return nodes, edges


def resumed(papers: DataFrame, done: DataFrame, put: Callable[[DataFrame], None], batches: int) -> int:
    """Hands papers that are not done to put(batch) in batches by a hash of the id, and returns how many batches had rows."""
    left = written(papers.join(done.select("id"), "id", "left_anti"))
    n = 0
    for i in range(batches):
        b = left.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
        if not b.isEmpty():
            put(b)
            n += 1
    return n
