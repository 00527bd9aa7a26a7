"""Scores, ranks, fusion and shortlists; qid is on every table and every order is total."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.tables import written


def by(qid: str = "qid") -> Window:
    return Window.partitionBy(qid)


def rank0(score: Column, tie: str = "slot", qid: str = "qid") -> Column:
    """0-based rank, best first; nulls last, ties by slot."""
    return F.row_number().over(by(qid).orderBy(score.desc_nulls_last(), F.col(tie))) - 1


def zscore(score: Column, least_sd: float = 1e-6, qid: str = "qid") -> Column:
    """Over a query's known scores, by the population sd; 0 where that is below least_sd, null stays null."""
    w = by(qid)
    sd = F.stddev_pop(score).over(w)
    return F.when(score.isNotNull(), F.when(F.coalesce(sd, F.lit(0.0)) < least_sd, F.lit(0.0)).otherwise((score - F.avg(score).over(w)) / sd))


def rrf(scores: list[Column], k: int = 60, tie: str = "slot") -> Column:
    """Reciprocal rank fusion with 0-based ranks."""
    parts = [1.0 / (k + rank0(s, tie)) for s in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def fused(window: DataFrame, alpha: float = 0.4, k: int = 20, w: float = 0.4) -> DataFrame:
    """window (qid, slot, ce, gat) with `rrf` and `fused`: w * z(rrf) + (1 - w) * (alpha * z(gat) + (1 - alpha) * z(ce)).

    Where ce is null the score part is z(gat) alone and the rank is last.
    """
    zg, zc = zscore(F.col("gat")), zscore(F.col("ce"))
    d = window.withColumn("zg", zg).withColumn("zc", zc).withColumn("rrf", rrf([F.col("gat"), F.col("ce")], k))
    part = F.when(F.col("ce").isNull(), F.col("zg")).otherwise(alpha * F.col("zg") + (1 - alpha) * F.col("zc"))
    return d.withColumn("fused", w * zscore(F.col("rrf")) + (1 - w) * part).drop("zg", "zc")


def cascade(window: DataFrame, mode: str, most: int) -> DataFrame:
    """none, struct (the first slots), or the best by gat or ce."""
    if mode == "none":
        return window
    key = {"struct": -F.col("slot"), "gat": F.col("gat"), "ce": F.col("ce")}[mode]
    return window.withColumn("_r", rank0(key)).filter(F.col("_r") < most).drop("_r")


def blended(window: DataFrame, beta: float, struct_weight: float = 0.0, scored: int = 100, least_sd: float = 1e-6) -> DataFrame:
    """(1 - beta) * z(ce) + beta * z(cl) + struct_weight * struct for the first `scored` slots, the rest below them by slot."""
    d = window.withColumn("_s", F.col("slot") < scored)
    w = Window.partitionBy("qid", "_s")

    def z(c: str) -> Column:
        sd = F.stddev_pop(c).over(w)
        return F.when(sd < least_sd, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / sd)

    d = d.withColumn("_b", F.when(F.col("_s"), (1 - beta) * z("ce") + beta * z("cl") + struct_weight * F.col("struct")))
    floor = F.min("_b").over(by())
    return d.withColumn("blend", F.coalesce("_b", F.coalesce(floor, F.lit(0.0)) - 1 + 0.01 * z("struct"))).drop("_s", "_b")


def ranked_union(parts: list[DataFrame], most: int, qid: str = "qid", item: str = "cid", order: str = "ord") -> DataFrame:
    """(qid, cid, ord): the parts' items in turn, each once, at most `most`."""
    tagged = [p.select(qid, item, F.lit(i).alias("_p"), F.col(order).alias("_o")) for i, p in enumerate(parts)]
    all_parts = tagged[0]
    for t in tagged[1:]:
        all_parts = all_parts.unionByName(t)
    first = all_parts.groupBy(qid, item).agg(F.min(F.struct("_p", "_o")).alias("_f"))
    w = Window.partitionBy(qid).orderBy("_f", item)
    return first.withColumn("ord", F.row_number().over(w).cast("bigint")).filter(F.col("ord") <= most).select(qid, item, "ord")


def ordered_distinct(lists: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """lists (qid, cid, ord): the first of each item, renumbered, of those in allowed(qid, cid)."""
    d = lists.join(allowed, ["qid", "cid"], "left_semi") if allowed is not None else lists
    return ranked_union([d], most)


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: hits, precision, recall, rr and ndcg at k with the full gold; ranked (qid, cid, ord from 1), gold (qid, cid)."""
    g = gold.select("qid", "cid").distinct()
    n = g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = ranked.join(g.withColumn("is_gold", F.lit(True)), ["qid", "cid"], "left").fillna(False, ["is_gold"])
    return metrics_of(hit, k, n)


def metrics_of(ranked: DataFrame, k: int, n_gold: DataFrame | None = None) -> DataFrame:
    """As metrics, for ranked (qid, ord, is_gold); without n_gold the gold among the ranked counts."""
    on = F.col("is_gold") & (F.col("ord") <= k)
    base = ranked.groupBy("qid").agg(
        F.count_if(on).alias("hits"), F.min(F.when(on, F.col("ord"))).alias("_first"), F.sum(F.when(on, 1.0 / F.log2(F.col("ord") + 1.0)).otherwise(0.0)).alias("_dcg"), F.count_if("is_gold").alias("_in"),
    )
    base = base.join(n_gold, "qid", "left").fillna(0, ["n_gold"]) if n_gold is not None else base.withColumn("n_gold", F.col("_in"))
    most = F.least(F.lit(k), F.col("n_gold")).cast("int")
    ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return base.select(
        "qid", "n_gold", "hits", (F.col("hits") / k).alias("precision"), F.when(F.col("n_gold") > 0, F.col("hits") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"), F.when(ideal > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """(auc): by rank sums with average ranks of ties; scored (score, is_gold).

    Ties are summed first, so the ranks run over distinct scores.
    """
    t = scored.groupBy("score").agg(F.count_if("is_gold").alias("p"), F.count_if(~F.col("is_gold")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = t.withColumn("w", F.col("p") * (below + 0.5 * F.col("n")))
    return s.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def cocited(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(qid, cid, co): how many of a query's hubs (qid, hub) name each paper."""
    return edges.withColumnRenamed("src", "hub").withColumnRenamed("dst", "cid").join(hubs, "hub").groupBy("qid", "cid").agg(F.count(F.lit(1)).alias("co"))


def structural_features(cands: DataFrame, degrees: DataFrame, hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """The ten structural features of cands (qid, cid, support, lex, dense_rank, emb_sim); hubs (qid, hub)."""
    most = F.greatest(F.max("support").over(by()), F.lit(1e-6))
    co = cocited(edges, hubs)
    d = cands.join(degrees.withColumnRenamed("id", "cid"), "cid", "left").join(co, ["qid", "cid"], "left").fillna(0, ["indeg", "outdeg", "co"])
    dense = F.col("dense_rank").isNotNull()
    return d.select(
        "qid", "cid", (F.col("support") / most).alias("support_n"), F.log1p("support").alias("log_support"), "lex", (F.least(F.col("co"), F.lit(15)) / 15.0).alias("cocite_n"), F.log1p("indeg").alias("log_indeg"),
        F.log1p("outdeg").alias("log_outdeg"), dense.cast("double").alias("in_dense"), F.when(dense, 1.0 / (1.0 + F.col("dense_rank") / 25.0)).otherwise(0.0).alias("dense_bonus"), (F.col("support") > 0).cast("double").alias("has_support"), "emb_sim",
    )


FEATURES = ("support_n", "log_support", "lex", "cocite_n", "log_indeg", "log_outdeg", "in_dense", "dense_bonus", "has_support", "emb_sim")


def heuristic_score() -> Column:
    c = F.col
    return 10 * c("has_support") + 0.45 * c("support_n") + 0.30 * c("lex") + 0.15 * c("cocite_n") + 0.10 * c("dense_bonus")


def linear_score(weights: dict[str, float], bias: float, mean: dict[str, float], sd: dict[str, float]) -> Column:
    total = F.lit(bias)
    for k, w in weights.items():
        total = total + (F.col(k) - mean.get(k, 0.0)) / sd.get(k, 1.0) * w
    return total


def hub_support(edges: DataFrame, hubs: DataFrame, dense: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(support (qid, cid, support), focused hubs (qid, hub)); hubs (qid, hub), dense (qid, cid).

    A hub's weight is 1, 1.5 or 2.5 by how many dense hits it cites, 0.12 with none, over log2(2 + its references).
    """
    out = edges.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("od"))
    refs = hubs.join(edges.select(F.col("src").alias("hub"), F.col("dst").alias("cid")), "hub")
    hits = refs.join(dense.select("qid", "cid"), ["qid", "cid"], "left_semi").groupBy("qid", "hub").agg(F.count(F.lit(1)).alias("c"))
    h = hubs.join(out, "hub").join(hits, ["qid", "hub"], "left").fillna(0, ["c"])
    w = F.when(F.col("c") == 0, 0.12).when(F.col("c") == 1, 1.5).otherwise(2.5) / F.log2(2.0 + F.col("od"))
    s = refs.join(h.select("qid", "hub", w.alias("w")), ["qid", "hub"]).filter(F.col("cid") != F.col("qid")).filter(F.col("cid") != F.col("hub"))
    return s.groupBy("qid", "cid").agg(F.sum("w").alias("support")), h.filter("c >= 1").select("qid", "hub")


def _bm25_parts(docs: DataFrame, queries: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """((term, doc, part), (qid, term)): what each query term is worth in each document that has it; a query's terms count once each."""
    length = docs.select("doc", F.size("terms").alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg_len"))  # one row
    tf = docs.select("doc", F.explode("terms").alias("term"))
    q = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    tf = tf.join(q.select("term").distinct(), "term", "left_semi").groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "term").join(length, "doc").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return weighted.select("term", "doc", part.alias("part")), q


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc, score, n_terms) of all documents that share a term with the query; docs (doc, terms array), queries (qid, terms array)."""
    parts, q = _bm25_parts(docs, queries, k1, b)
    return parts.join(q, "term").groupBy("qid", "doc").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n_terms"))


#: Documents whose scores for all queries of a block a task holds at once.
BLOCK_DOCS, BLOCK_QUERIES = 4_096, 512


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each query, scores to six digits, ties by document.

    Documents and queries are dealt into blocks. A task adds up the scores of one
    block of documents for one block of queries, term by term, and passes on each
    query's k best, so that neither a frequent term nor the number of matches
    makes rows to shuffle.
    """
    docs = written(docs)
    parts, q = _bm25_parts(docs, queries, k1, b)
    n_docs, n_queries = (max(1, -(-d.count() // size)) for d, size in ((docs, BLOCK_DOCS), (queries, BLOCK_QUERIES)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = parts.select(block("doc", n_docs).alias("d_block"), "term", "doc", "part").withColumn("q_block", every(n_queries))
    right = q.select(block("qid", n_queries).alias("q_block"), "qid", "term").withColumn("d_block", every(n_docs))
    types = dict(queries.dtypes)["qid"], dict(docs.dtypes)["doc"]

    def best(key: tuple, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"qid": asked["qid"].iloc[:0], "doc": found["doc"].iloc[:0], "score": np.zeros(0)})
        asked = asked[asked["term"].isin(found["term"])]
        if not len(asked):
            return out
        # numbers in the order of the ids, so that ties go to the smaller one
        doc, docs_of = pd.factorize(found["doc"], sort=True)
        qid, queries_of = pd.factorize(asked["qid"], sort=True)
        scores = np.zeros((len(queries_of), len(docs_of)))
        rows = {t: i for t, i in found.groupby("term").indices.items()}
        part = found["part"].to_numpy()
        for term, i in asked.groupby("term").indices.items():
            at = rows[term]
            scores[np.ix_(qid[i], doc[at])] += part[at]
        scores = np.round(scores, 6)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, order, 1)
        row, column = np.nonzero(top > 0)
        return pd.DataFrame({"qid": queries_of[row], "doc": docs_of[order[row, column]], "score": top[row, column]})

    keys = ("d_block", "q_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"qid {types[0]}, doc {types[1]}, score double")
    w = by().orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def bm25_before(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc, score, rank): the top k of all documents of months before the query's, other than the query itself.

    docs (doc, month, terms array), queries (qid, month, terms array). Document
    counts, frequencies and the mean length are those of a query's eligible
    documents. Documents without a term of the query score zero and fill the
    list by id. A null month is never eligible; a query's terms count once each.
    """
    d = docs.select("doc", "month", "terms", F.size("terms").alias("len"))
    q = queries.select("qid", F.col("month").alias("cutoff"), F.array_distinct("terms").alias("terms"))
    cutoffs = q.select("cutoff").distinct()
    before = F.col("month") < F.col("cutoff")
    # sums by month first, so that the joins on months are between small tables
    months = d.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    stats = months.join(cutoffs, before).groupBy("cutoff").agg(F.sum("n").alias("N"), F.sum("len").alias("all_len"))
    qt = q.select("qid", "cutoff", F.explode("terms").alias("term"))
    tf = d.select("doc", "month", "len", F.explode("terms").alias("term")).join(qt.select("term").distinct(), "term", "left_semi").groupBy("term", "doc", "month", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term", "month").agg(F.count(F.lit(1)).alias("df")).join(qt.select("term", "cutoff").distinct(), "term").filter(before).groupBy("term", "cutoff").agg(F.sum("df").alias("df"))
    # a query that is an eligible document by its month counts in nothing
    own = q.select("qid", "cutoff").join(d.withColumnRenamed("doc", "qid"), "qid").filter(before).select("qid", F.lit(1).alias("own"), F.col("len").alias("own_len"), F.col("terms").alias("own_terms"))
    hits = tf.join(qt, "term").filter(before & (F.col("doc") != F.col("qid"))).join(df, ["term", "cutoff"]).join(stats, "cutoff").join(own, "qid", "left")
    n = F.col("N") - F.coalesce("own", F.lit(0))
    mean = F.greatest((F.col("all_len") - F.coalesce("own_len", F.lit(0))) / n, F.lit(1e-9))
    freq = F.col("df") - F.coalesce(F.array_contains("own_terms", F.col("term")), F.lit(False)).cast("int")
    part = F.log(1 + (n - freq + 0.5) / (freq + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    scored = hits.groupBy("qid", "doc").agg(F.sum(part).alias("score"))
    # k + 1 of the least ids of a cutoff hold enough documents for every list, whether or not the query and its hits are among them
    least = d.select("doc", "month").join(cutoffs, before).withColumn("_n", F.row_number().over(Window.partitionBy("cutoff").orderBy("doc"))).filter(F.col("_n") <= k + 1)
    zero = q.select("qid", "cutoff").join(least, "cutoff").filter(F.col("doc") != F.col("qid")).select("qid", "doc").join(scored, ["qid", "doc"], "left_anti")
    both = scored.unionByName(zero.withColumn("score", F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
