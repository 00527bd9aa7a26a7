"""Candidate universes: dense retrieval, feedback, hubs, neighbours, learned-ranking features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import gate_year
from quillgraph.functions.vectors import block_scores, cosine
from quillgraph.operators import evaluation as ev
from quillgraph.operators.ranking import ranked_union


def prototype_scores(corpus: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, score): each paper's best cosine, to nine digits, over the prototypes (emb); 0 for a paper without a vector."""
    p = prototypes.filter("emb is not null").select(F.monotonically_increasing_id().alias("id"), "emb")
    best = block_scores(p, corpus.filter("emb is not null").select("id", "emb")).groupBy(F.col("cid").alias("id")).agg(F.max("cosine").alias("_s"))
    return corpus.select("id").distinct().join(best, "id", "left").select("id", F.round(F.coalesce("_s", F.lit(0.0)), 9).alias("score"))


def domain_retrieval(corpus: DataFrame, prototypes: DataFrame, min_year: int | None, most: int, head: int = 100, margin: float = 0.05, tau: float | None = None, year: Column | None = None) -> DataFrame:
    """(id, score, ord): the year gate first, then the `most` best that reach tau (by default the head's median less a margin)."""
    s = prototype_scores(corpus, prototypes)
    if min_year is not None:
        s = s.filter((gate_year(F.col("id")) if year is None else year) >= min_year)
    d = s.select(F.lit(0).alias("qid"), F.col("id").alias("slot"), "id", "score")
    t = ev.default_threshold(d, head, margin) if tau is None else d.select("qid").distinct().withColumn("tau", F.lit(tau))
    kept = ev.dual_gate(d, t, most)
    # at most `most` rows
    return kept.withColumn("ord", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("bigint")).select("id", "score", "ord")


def expanded_dense(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], titles: DataFrame, hits: int = 200, feedback: int = 10, feedback_hits: int = 80) -> DataFrame:
    """(qid, cid, ord): hits of several query texts, then of the titles of the first hits; first seen counts.

    queries: qid, no, text. search(queries(qid, text), limit) returns (qid, text, cid, rank).
    """
    w = Window.partitionBy("qid")
    first = search(queries.select("qid", "text"), hits).join(queries, ["qid", "text"]).select("qid", "cid", (F.col("no") * 1_000_000 + F.col("rank")).alias("ord"))
    seen = ranked_union([first], 1 << 30)
    again = seen.filter(F.col("ord") <= feedback).join(titles.select(F.col("id").alias("cid"), "title"), "cid").select("qid", F.col("title").alias("text"), F.col("ord").alias("no"))
    more = search(again.select("qid", "text"), feedback_hits).join(again, ["qid", "text"]).select("qid", "cid", (F.col("no") * 1_000_000 + F.col("rank")).alias("ord"))
    return ranked_union([seen, more], 1 << 30).withColumn("ord", F.row_number().over(w.orderBy("ord")).cast("bigint"))


def second_hop(edges: DataFrame, support: DataFrame, least: float = 0.5, most: int = 50) -> DataFrame:
    """support (qid, cid, support) with a weak share, 0.2 / log2(2 + references), from the references of its best papers."""
    out = edges.groupBy(F.col("src").alias("cid")).agg(F.count(F.lit(1)).alias("od"))
    top = support.filter(F.col("support") >= least).join(out, "cid")
    top = top.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("support").desc(), "cid"))).filter(F.col("_rn") <= most)
    far = top.join(edges.select(F.col("src").alias("cid"), F.col("dst").alias("to")), "cid").filter((F.col("to") != F.col("qid")) & (F.col("to") != F.col("cid")))
    extra = far.groupBy("qid", F.col("to").alias("cid")).agg(F.sum(0.2 / F.log2(2.0 + F.col("od"))).alias("support"))
    return support.select("qid", "cid", "support").unionByName(extra).groupBy("qid", "cid").agg(F.sum("support").alias("support"))


def seed_neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, cid, weight): papers that a query's seeds (qid, id) cite, each worth 1 / log1p(the seed's references)."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("od"))
    s = seeds.select("qid", F.col("id").alias("src")).join(edges.select("src", "dst"), "src").join(out, "src")
    return s.groupBy("qid", F.col("dst").alias("cid")).agg(F.sum(1.0 / F.log1p("od")).alias("weight"))


def neighbour_features(cands: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per (qid, cid): common citers and common references with the seeds, whether a seed is cited, log seed weight."""
    e = edges.select("src", "dst").distinct()
    s = seeds.select("qid", F.col("id").alias("seed")).distinct()
    citers = s.join(e.withColumnRenamed("dst", "seed"), "seed").select("qid", F.col("src").alias("u")).distinct()
    refs = s.join(e.withColumnRenamed("src", "seed"), "seed").select("qid", F.col("dst").alias("u")).distinct()
    count = lambda d, n: d.groupBy("qid", "cid").agg(F.count(F.lit(1)).alias(n))
    c = cands.select("qid", "cid").distinct()
    pred = count(c.join(e.withColumnRenamed("dst", "cid").withColumnRenamed("src", "u"), "cid").join(citers, ["qid", "u"], "left_semi"), "common_citers")
    succ = count(c.join(e.withColumnRenamed("src", "cid").withColumnRenamed("dst", "u"), "cid").join(refs, ["qid", "u"], "left_semi"), "common_refs")
    cites = count(c.join(e.withColumnRenamed("src", "cid").withColumnRenamed("dst", "seed"), "cid").join(s, ["qid", "seed"], "left_semi"), "cites_seeds")
    out = c
    for d in (pred, succ, cites, seed_neighbourhood(e, seeds)):
        out = out.join(d, ["qid", "cid"], "left")
    return out.fillna(0).withColumn("log_seed_weight", F.log1p("weight")).drop("weight")


def graded_label(is_gold: Column, related: Column) -> Column:
    return F.when(is_gold, 4).when(related, 2).otherwise(0)


def sentence_alignment(queries: DataFrame, sentences: DataFrame, most: int = 16) -> DataFrame:
    """(qid, cid, align): a query's best cosine with a candidate's citing sentences, `most` of them evenly spread.

    queries: qid, cid, emb; sentences: cid, pos, emb.
    """
    w = Window.partitionBy("cid")
    s = sentences.withColumn("_i", F.row_number().over(w.orderBy("pos")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    s = s.filter((F.col("_i") % step == 0) & (F.col("_i") / step < most)).select("cid", F.col("emb").alias("_e"))
    return queries.join(s, "cid").groupBy("qid", "cid").agg(F.max(cosine(F.col("emb"), F.col("_e"))).alias("align"))


def neighbour_lists(edges: DataFrame, vectors: DataFrame, cocite: DataFrame, near: int = 16, total: int = 32) -> DataFrame:
    """(id, other, ord): a paper's `near` citers by cosine, to nine digits, then its co-cited papers by weight, `total` in all.

    vectors (id, emb) are whitened ones, where the cosine is to be one of whitened vectors.
    """
    v = vectors.select("id", "emb")
    c = edges.select(F.col("dst").alias("id"), F.col("src").alias("other")).join(v, "id").join(v.select(F.col("id").alias("other"), F.col("emb").alias("_e")), "other")
    w = Window.partitionBy("id")
    c = c.withColumn("_c", F.round(cosine(F.col("emb"), F.col("_e")), 9))
    c = c.withColumn("ord", F.row_number().over(w.orderBy(F.col("_c").desc(), "other"))).filter(F.col("ord") <= near)
    k = cocite.select(F.col("i").alias("id"), F.col("j").alias("other"), "w").withColumn("ord", F.row_number().over(w.orderBy(F.col("w").desc(), "other"))).filter(F.col("ord") <= total)
    return ranked_union([c.select("id", "other", "ord"), k.select("id", "other", "ord")], total, "id", "other")


def query_subgraph(edges: DataFrame, window: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(qid, src, dst): edges among a query's candidates, itself and their neighbours, without those from the query to its candidates."""
    near = neighbours.select(F.col("id").alias("cid"), "other")
    n = window.select("qid", F.col("cid").alias("id")).union(window.select("qid", "qid")).union(window.join(near, "cid").select("qid", "other")).distinct()
    e = n.withColumnRenamed("id", "src").join(edges.select("src", "dst"), "src").join(n.withColumnRenamed("id", "dst"), ["qid", "dst"], "left_semi")
    hidden = window.select("qid", F.col("qid").alias("src"), F.col("cid").alias("dst"))
    return e.join(hidden, ["qid", "src", "dst"], "left_anti").select("qid", "src", "dst")


def struct_features_of_universe(universe: DataFrame, queries: DataFrame, degrees: DataFrame, hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """The structural features of universe (qid, cid, title, abstract, support, dense_rank, emb_sim) for queries (qid, text)."""
    from quillgraph.functions.text import token_jaccard
    from quillgraph.operators.ranking import structural_features

    u = universe.join(queries.select("qid", "text"), "qid").withColumn("lex", token_jaccard(F.col("text"), F.concat_ws(" ", "title", "abstract")))
    return structural_features(u.select("qid", "cid", "support", "lex", "dense_rank", "emb_sim"), degrees, hubs, edges)


def coarse_ranking(features: DataFrame, mode: str, most: int, weights: dict | None = None, score: Callable[[DataFrame], DataFrame] | None = None, prefilter: int = 800) -> DataFrame:
    """(qid, cid, score, ord): heuristic, linear (weights, bias, mean, sd), or a model over the `prefilter` best by the heuristic.

    score(features) returns (qid, cid, score). Scores are compared to nine digits.
    """
    from quillgraph.operators.ranking import heuristic_score, linear_score

    order = lambda d: d.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "cid")).cast("bigint"))
    if mode == "heuristic":
        d = features.withColumn("score", heuristic_score())
    elif mode == "linear":
        d = features.withColumn("score", linear_score(**weights))
    elif mode == "model":
        cheap = order(features.withColumn("score", heuristic_score())).filter(F.col("ord") <= prefilter).drop("score", "ord")
        d = score(cheap)
    else:
        raise ValueError(f"mode {mode!r} is none of heuristic, linear, model")
    return order(d).filter(F.col("ord") <= most).select("qid", "cid", "score", "ord")


def reranked(features: DataFrame, score: Callable[[DataFrame], DataFrame], width: int, most: int) -> DataFrame:
    """(qid, cid, score, ord): a learned ranker's order; features (qid, cid, x array) are padded with zeros, or cut, to its `width`.

    score(features) returns (qid, cid, score): the booster, as a function of tables.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    d = features.select("qid", "cid", F.slice(F.concat(F.col("x").cast("array<double>"), zeros), 1, width).alias("x"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "cid")
    return score(d).withColumn("ord", F.row_number().over(w).cast("bigint")).filter(F.col("ord") <= most).select("qid", "cid", "score", "ord")
