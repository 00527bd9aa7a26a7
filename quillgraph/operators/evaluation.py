"""Gates, sweeps, summaries and comparisons of ranked windows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hashing import stable_hash, stable_hashes
from quillgraph.operators.ranking import zscore


def _ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.col(score).desc(), "slot")).cast("bigint"))


def default_threshold(scored: DataFrame, head: int, margin: float) -> DataFrame:
    """(qid, tau): the median of a query's `head` best scores, less a margin."""
    return _ranked(scored).filter(F.col("_rn") <= head).groupBy("qid").agg((F.median("score") - margin).alias("tau"))


def dual_gate(scored: DataFrame, tau: DataFrame, most: int) -> DataFrame:
    """Rows among the `most` best that reach tau; a low score is left out and stops nothing."""
    return _ranked(scored).filter(F.col("_rn") <= most).join(tau, "qid").filter(F.col("score") >= F.col("tau")).drop("_rn", "tau")


def knee_rank(scored: DataFrame, head: int, margin: float) -> DataFrame:
    """(qid, knee): the first rank below the head's median less a margin; null without one."""
    return _ranked(scored).join(default_threshold(scored, head, margin), "qid").groupBy("qid").agg(F.min(F.when(F.col("score") < F.col("tau"), F.col("_rn"))).alias("knee"))


def bucket_means(scored: DataFrame, edges: tuple[int, ...] = (100, 500)) -> DataFrame:
    b: Column = F.lit("tail")
    lows = [1, *[e + 1 for e in edges]]
    for lo, hi in list(zip(lows, edges, strict=False))[::-1]:
        b = F.when(F.col("_rn") <= hi, f"{lo:03d}-{hi:03d}").otherwise(b)
    return _ranked(scored).groupBy("qid", b.alias("bucket")).agg(F.avg("score").alias("mean"))


def alpha_sweep(window: DataFrame, alphas: list[float], k: int) -> DataFrame:
    """(alpha, hits10): mean hits of z-score blends; alphas are a fixed small list."""
    d = window.withColumn("zg", zscore(F.col("gat"))).withColumn("zc", zscore(F.col("ce"))).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    s = F.round(F.when(F.col("ce").isNull(), F.col("zg")).otherwise(F.col("alpha") * F.col("zg") + (1 - F.col("alpha")) * F.col("zc")), 6)
    r = d.withColumn("rn", F.row_number().over(Window.partitionBy("alpha", "qid").orderBy(s.desc(), "slot")))
    h = r.groupBy("alpha", "qid").agg(F.count_if(F.col("is_gold") & (F.col("rn") <= k)).alias("hits"))
    return h.groupBy("alpha").agg(F.avg("hits").alias("hits10"))


def blend_sweep(window: DataFrame, betas: list[float], k: int) -> DataFrame:
    """(beta, hits10, help, hurt, same): blends against beta 0, query by query."""
    d = window.withColumn("beta", F.explode(F.array(*map(F.lit, betas))))
    s = F.round((1 - F.col("beta")) * F.col("gat") + F.col("beta") * F.coalesce("ce", F.lit(-1.0)), 9)
    r = d.withColumn("rn", F.row_number().over(Window.partitionBy("beta", "qid").orderBy(s.desc(), "slot")))
    h = r.groupBy("beta", "qid").agg(F.count_if(F.col("is_gold") & (F.col("rn") <= k)).alias("hits"))
    zero = F.max(F.when(F.col("beta") == 0, F.col("hits"))).over(Window.partitionBy("qid"))
    h = h.withColumn("h0", zero)
    return h.groupBy("beta").agg(F.avg("hits").alias("hits10"), F.count_if(F.col("hits") > F.col("h0")).alias("help"), F.count_if(F.col("hits") < F.col("h0")).alias("hurt"), F.count_if(F.col("hits") == F.col("h0")).alias("same"))


def recall_at_gold(ranked: DataFrame) -> DataFrame:
    """(qid, r_at_g): recall among as many as there is gold."""
    n = F.count_if("is_gold").over(Window.partitionBy("qid"))
    d = ranked.withColumn("n", n)
    return d.groupBy("qid").agg(F.coalesce(F.try_divide(F.count_if(F.col("is_gold") & (F.col("ord") <= F.col("n"))), F.max("n")), F.lit(0.0)).alias("r_at_g"))


def summary(ranked: DataFrame) -> DataFrame:
    """One row: mean hits at 10 and 30, and the shares of queries with 8 hits and with a recall of 0.8."""
    h = ranked.groupBy("qid").agg(F.count_if(F.col("is_gold") & (F.col("ord") <= 10)).alias("h10"), F.count_if(F.col("is_gold") & (F.col("ord") <= 30)).alias("h30"), F.count_if("is_gold").alias("n")).filter("n > 0")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return h.agg(F.count(F.lit(1)).alias("queries"), F.avg("h10").alias("hits10"), F.avg("h30").alias("hits30"), share(F.col("h10") >= 8).alias("gate_hits"), share(F.col("h30") / F.col("n") >= 0.8).alias("gate_recall"))


def seed_aggregate(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and sample standard deviation, 0 for a single run."""
    return runs.groupBy(key).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


def judgment_counts(judgments: DataFrame) -> DataFrame:
    """(part, relevance, n): label counts over all, gold and other pairs."""
    sets = judgments.groupingSets([["relevance"], ["is_gold", "relevance"]], "is_gold", "relevance").agg(F.count(F.lit(1)).alias("n"), F.grouping("is_gold").alias("_g"))
    part = F.when(F.col("_g") == 1, "all").when(F.col("is_gold"), "gold").otherwise("other")
    return sets.select(part.alias("part"), "relevance", "n")


def miss_decomposition(ranked: DataFrame, k: int, window: int) -> DataFrame:
    """Per query: gold hit, in the window but missed, outside of it, and the best possible hits."""
    at = F.col("ord")
    return ranked.groupBy("qid").agg(
        F.count_if(F.col("is_gold") & (at <= k)).alias("hit"), F.count_if(F.col("is_gold") & (at > k) & (at <= window)).alias("in_window_miss"), F.count_if(F.col("is_gold") & (at > window)).alias("out_of_window"),
        F.least(F.lit(k), F.count_if(F.col("is_gold") & (at <= window))).cast("bigint").alias("ceiling"),
    )


def indegree_band(degrees: DataFrame) -> DataFrame:
    """One row: the in-degrees' distribution and the band that their median falls in."""
    p = lambda q: F.percentile("indeg", F.lit(q))
    d = degrees.agg(F.avg("indeg").alias("mean"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.avg(F.when(F.col("indeg") >= 8, 1.0).otherwise(0.0)).alias("at_least_8"))
    return d.withColumn("band", F.when(F.col("p50") >= 8, "dense").when(F.col("p50") >= 3, "middle").otherwise("sparse"))


def hard_negatives(scored: DataFrame, most: int) -> DataFrame:
    return _ranked(scored.filter("not is_gold")).filter(F.col("_rn") <= most).select("qid", "cid")


def all_terms_match(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc): documents with all of a query's terms; postings (doc, term), distinct."""
    q = queries.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    return q.join(postings, "term").groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).filter("c = n").select("qid", "doc")


def score_decomposition(scored: DataFrame) -> DataFrame:
    """Per query: gold's lead over the rest, gold's mean rank, hits at 10 and 50."""
    return _ranked(scored).groupBy("qid").agg(
        (F.avg(F.when(F.col("is_gold"), F.col("score"))) - F.avg(F.when(~F.col("is_gold"), F.col("score")))).alias("gap"), F.avg(F.when(F.col("is_gold"), F.col("_rn"))).alias("mean_gold_rank"),
        F.count_if(F.col("is_gold") & (F.col("_rn") <= 10)).alias("hits10"), F.count_if(F.col("is_gold") & (F.col("_rn") <= 50)).alias("hits50"),
    )


def paired_bootstrap(pairs: DataFrame, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(delta, lo, hi, p): mean of a - b, its 95 % interval over resampled queries, and a sign-flip p-value.

    A draw takes as many queries as there are, with replacement. Which ones, and
    the signs, come from hashes, so reruns agree. The draws are dealt to as many
    groups as the cluster has cores, and the differences, one a query, are sent
    once to each; what is drawn never leaves its task.
    """
    groups = max(1, pairs.sparkSession.sparkContext.defaultParallelism)
    d = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), "qid", (F.col("a") - F.col("b")).cast("double").alias("d"))
    d = d.repartitionById(groups, F.col("_g")).sortWithinPartitions("_g", "qid").select("_g", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        g, x, known = t["_g"].to_numpy(), pc.fill_null(t["d"], 0.0).to_numpy(), pc.is_valid(t["d"]).to_numpy()
        for first, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]):
            own, count = x[first:end], known[first:end]
            for part in itertools.batched(range(int(g[first]) + 1, draws + 1, groups), 1024):
                means = [_draw(own, count, i, seed) for i in part]
                yield pa.record_batch({"delta": pa.array([_mean(own.sum(), count.sum())] * len(part), pa.float64()), "m": pa.array([m for m, _ in means], pa.float64()), "s": pa.array([s for _, s in means], pa.float64())})

    r = d.mapInArrow(run, "delta double, m double, s double")
    n = F.count(F.lit(1))
    p = F.when(n > 0, (F.count_if(F.abs("s") >= F.abs("delta") - 1e-12) + 1) / (n + 1))
    return r.agg(F.max("delta").alias("delta"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), p.alias("p"))


def _mean(total: float, n: int) -> float | None:
    return float(total / n) if n else None


def _draw(x: np.ndarray, known: np.ndarray, draw: int, seed: int, step: int = 65_536) -> tuple[float | None, float | None]:
    """The means of a draw's queries and of all queries with a draw's signs; x is 0 where it isn't known."""
    n, drawn, flipped, count = len(x), 0.0, 0.0, 0
    for a in range(0, n, step):
        ks = range(a, min(a + step, n))
        i = (stable_hashes(b"%d|%d|%d" % (draw, k, seed) for k in ks) % n).astype(np.int64)
        drawn, count = drawn + x[i].sum(), count + known[i].sum()
        odd = stable_hashes(b"%d|%d|%d" % (k, draw, seed + 1) for k in ks) % 2 == 1
        flipped += np.where(odd, -x[a : a + step], x[a : a + step]).sum()
    return _mean(drawn, count), _mean(flipped, known.sum())


def subsample_spread(values: DataFrame, n: int) -> DataFrame:
    """(mean, se) of a sample of n without replacement, in closed form."""
    return values.agg(F.avg("x").alias("mean"), F.sqrt(F.var_samp("x") / n * (1 - n / F.count(F.lit(1)))).alias("se"))


def citation_rollup(outputs: DataFrame) -> DataFrame:
    """One row for outputs (qid, cite, id, title): shares that are non-empty, name the id, match the title, hold a keyword; mean of distinct ones and greatest pairwise Jaccard."""
    from quillgraph.functions import text as tx
    from quillgraph.functions.vectors import jaccard

    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    own = F.collect_list(F.struct("cite", tx.token_set(F.col("cite")).alias("s")))
    per = outputs.groupBy("qid").agg(
        share(F.trim("cite") != "").alias("non_empty"), share(F.col("cite").contains(F.col("id"))).alias("id_present"), share(tx.cite_matches_title(F.col("cite"), F.col("title"))).alias("title_consistent"), share(tx.title_keyword_hit(F.col("cite"), F.col("title"))).alias("keyword"), (F.countDistinct("cite") / F.count(F.lit(1))).alias("distinct"), own.alias("l"),
    )
    # a query's outputs are few
    most = F.coalesce(F.array_max(F.flatten(F.transform("l", lambda a, i: F.transform(F.filter("l", lambda b, j: j > i), lambda b: jaccard(a["s"], b["s"]))))), F.lit(0.0))
    return per.withColumn("max_jaccard", most).agg(*[F.avg(c).alias(c) for c in ("non_empty", "id_present", "title_consistent", "keyword", "distinct", "max_jaccard")])


def pair_cosines(vectors: DataFrame, pairs: int, seed: int = 0) -> DataFrame:
    """One row of statistics over cosines of about `pairs` random pairs: every vector meets others of its hash bucket."""
    from quillgraph.functions.vectors import cosine

    n = max(1, vectors.count())
    buckets = max(1, n * n // (2 * max(1, pairs)))
    b = vectors.select("id", "emb", (stable_hash("id", seed) % buckets).alias("b"))
    c = b.join(b.select("b", F.col("id").alias("id2"), F.col("emb").alias("emb2")), "b").filter("id < id2").select(cosine(F.col("emb"), F.col("emb2")).alias("c"))
    p = lambda q: F.percentile("c", F.lit(q))
    return c.agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"))


def grouped_recall(scored: DataFrame, k: int) -> DataFrame:
    """(recall): mean over groups with positives of the recall at k; scored (qid, slot, score, y)."""
    d = _ranked(scored)
    g = d.groupBy("qid").agg(F.sum("y").alias("p"), F.sum(F.when(F.col("_rn") <= k, F.col("y")).otherwise(0)).alias("h")).filter("p > 0")
    return g.agg(F.avg(F.col("h") / F.col("p")).alias("recall"))


def recipe_comparison(ranked: DataFrame, gold: DataFrame, base: str, k: int, top: int = 400) -> DataFrame:
    """ranked (recipe, qid, cid, ord): per recipe the mean recall at k, the mean Jaccard of its top with the base recipe's, and the lead in recall."""
    g = gold.select("qid", "cid").distinct()
    n = g.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.filter(F.col("ord") <= k).join(g, ["qid", "cid"], "left_semi").groupBy("recipe", "qid").agg(F.count(F.lit(1)).alias("h"))
    all_pairs = ranked.select("recipe", "qid").distinct().join(n, "qid").join(hit, ["recipe", "qid"], "left")
    recall = all_pairs.groupBy("recipe").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))
    t = ranked.filter(F.col("ord") <= top)
    own, b = t.groupBy("recipe", "qid").agg(F.collect_set("cid").alias("s")), t.filter(F.col("recipe") == base).groupBy("qid").agg(F.collect_set("cid").alias("b"))
    j = own.join(b, "qid").groupBy("recipe").agg(F.avg(F.size(F.array_intersect("s", "b")) / F.size(F.array_union("s", "b"))).alias("overlap"))
    lead = recall.filter(F.col("recipe") == base).select(F.col("recall").alias("r0"))
    return recall.join(j, "recipe").crossJoin(lead).select("recipe", "recall", "overlap", (F.col("recall") - F.col("r0")).alias("delta"))


def rank_features(scored: DataFrame) -> DataFrame:
    """Features of a second head on (qid, cid, score, ce, cl): the scores, the rank, 1 / (1 + rank), ce - cl."""
    d = scored.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")) - 1)
    return d.withColumn("inverse_rank", 1.0 / (1.0 + F.col("i"))).withColumn("ce_lead", F.col("ce") - F.col("cl"))


def window_blend(window: DataFrame, blend: float) -> DataFrame:
    """score = logit + blend * (1 - slot / window size)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return window.withColumn("score", F.col("logit") + blend * (1 - F.col("slot") / n))


def domain_report(scored: DataFrame, head: int, margin: float, domain: str = "domain") -> DataFrame:
    """(domain, n, tau, knee, p50, head_mean): for several domains, how a retrieval's scores (domain, slot, score) fall off; tau is the head's median less the margin."""
    d = scored.withColumn("qid", F.col(domain))
    t, k = default_threshold(d, head, margin), knee_rank(d, head, margin)
    head_mean = _ranked(d).filter(F.col("_rn") <= head).groupBy("qid").agg(F.avg("score").alias("head_mean"))
    n = d.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(0.5)).alias("p50"))
    return n.join(t, "qid").join(k, "qid").join(head_mean, "qid").select(F.col("qid").alias(domain), "n", "tau", "knee", "p50", "head_mean")


def promoted(metrics: DataFrame, candidate: str, baseline: str, bar: float) -> DataFrame:
    """(candidate, baseline, delta, promote) of metrics (system, value): promoted where the candidate is over the bar."""
    value = lambda s: F.max(F.when(F.col("system") == s, F.col("value")))
    return metrics.agg(value(candidate).alias("candidate"), value(baseline).alias("baseline")).select("candidate", "baseline", (F.col("candidate") - F.col("baseline")).alias("delta"), (F.col("candidate") > bar).alias("promote"))
