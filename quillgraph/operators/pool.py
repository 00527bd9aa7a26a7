"""The ranked candidate pool of a query paper, from its universe to the exported list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.greedy import suppressed_titles
from quillgraph.operators.ranking import fused, rank0, ranked_union
from quillgraph.operators.universe import coarse_ranking

#: Rankers, the first of them that is there ranks the pool.
PRECEDENCE = ("ce_sent", "ce", "sent", "fusion", "citelink", "ltr", "mlp", "logistic", "linear", "heuristic")


def chosen_ranker(there: set[str]) -> str:
    """The first ranker of PRECEDENCE that is there; the heuristic always is."""
    return next(r for r in PRECEDENCE if r in there or r == "heuristic")


def cold_start_pool(features: DataFrame, papers: DataFrame, most: int, rankers: dict[str, Callable[[DataFrame], DataFrame] | dict] | None = None, window: int = 800, long_enough: int = 24) -> DataFrame:
    """(qid, cid, ord, title, score, ranker): each query's pool of `most` candidates.

    features: the structural features of its universe; papers: cid, title. rankers
    maps names of PRECEDENCE to functions of the `window` best by the heuristic,
    which return (qid, cid, score), or for linear to its weights. The first that
    is there ranks; candidates that it leaves out follow in the heuristic's
    order. A title equal to, or held by, one before it is left out.
    """
    rankers = rankers or {}
    name = chosen_ranker(set(rankers))
    base = coarse_ranking(features, "heuristic", 1 << 30)
    if name == "heuristic":
        first = base
    elif name == "linear":
        first = coarse_ranking(features, "linear", 1 << 30, weights=rankers[name])
    else:
        first = coarse_ranking(features, "model", window, score=rankers[name], prefilter=window)
    order = ranked_union([first, base], 1 << 30)
    titled = order.join(papers.select("cid", "title"), "cid")
    kept = suppressed_titles(titled, most, long_enough)
    out = kept.join(papers.select("cid", "title"), "cid").join(first.select("qid", "cid", "score"), ["qid", "cid"], "left")
    return out.select("qid", "cid", "ord", "title", "score", F.lit(name).alias("ranker"))


def score_dump(window: DataFrame, ce: DataFrame, cl: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, slot, cid, title, ce, cl, is_gold, has_ce): the raw scores of a window, for blending later; a missing score is null."""
    d = window.join(ce.select("qid", "cid", "ce"), ["qid", "cid"], "left").join(cl.select("qid", "cid", "cl"), ["qid", "cid"], "left").join(papers.select("cid", "title"), "cid", "left")
    return d.select("qid", "slot", "cid", "title", "ce", "cl", "is_gold", F.col("ce").isNotNull().alias("has_ce"))


def scored_window(window: DataFrame, ce: DataFrame, gat: DataFrame) -> DataFrame:
    """(qid, cid, ord, fused) of a frozen window (qid, slot, cid); raises where a score is missing or not finite."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = window.join(ce.select("qid", "cid", "ce"), ["qid", "cid"], "left").join(gat.select("qid", "cid", "gat"), ["qid", "cid"], "left")
    bad = d.agg(F.count_if(~good("ce")).alias("ce"), F.count_if(~good("gat")).alias("gat")).first()
    if bad["ce"] or bad["gat"]:
        raise ValueError(f"{bad['ce']} candidates without a finite CE score, {bad['gat']} without a finite graph score")
    f = fused(d).withColumn("fused", F.round("fused", 9))
    return f.withColumn("ord", (rank0(F.col("fused")) + 1).cast("bigint")).select("qid", "cid", "ord", "fused")


def exported(pool: DataFrame, most: int) -> DataFrame:
    """(qid, pool): the first `most` of each pool as an array of structs in order."""
    item = F.struct("ord", "cid", "title")
    return pool.filter(F.col("ord") <= most).groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("pool"), F.count(F.lit(1)).alias("n"))


