"""Citation graphs as nodes(id, ...) and edges(src, dst, sentence, pos): src cites dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hashing import stable_hash
from quillgraph.functions.ids import citer_allowed


def nonempty(c) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def close_nodes(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every id that an edge names, with its metadata; ids without any get a stub whose title is the id."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    m = metadata.select("id", "title", "abstract")
    return ids.join(m, "id", "left").select("id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.col("title").isNull().alias("stub"))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge for each (src, dst): the first's place, and the first sentence that isn't empty. Edges with unknown ends go."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    order = F.struct("_g", "pos")
    out = both.groupBy("src", "dst").agg(
        F.coalesce(F.min_by(nonempty("sentence"), F.when(nonempty("sentence").isNotNull(), order)), F.lit("")).alias("sentence"),
        F.min(order).alias("_o"),
    ).select("src", "dst", "sentence", F.col("_o.pos").alias("pos"), (F.col("_o._g") == 1).alias("added"))
    if nodes is not None:
        out = out.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return out


def upsert_nodes(old: DataFrame, new: DataFrame, fill: tuple[str, ...]) -> DataFrame:
    """Full join by id; a new value is taken only where the old one is empty."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in fill])
    return old.join(n, "id", "full").select("id", *[F.coalesce(nonempty(c), nonempty(f"_{c}"), F.lit("")).alias(c) for c in fill])


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "id", "left_semi")


def degrees(edges: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(id, indeg, outdeg); citers in masked(id) don't count for in-degrees."""
    seen = edges.join(masked.select(F.col("id").alias("src")), "src", "left_anti") if masked is not None else edges
    i = seen.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indeg"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outdeg"))
    return i.join(o, "id", "full").select("id", F.coalesce("indeg", F.lit(0)).cast("bigint").alias("indeg"), F.coalesce("outdeg", F.lit(0)).cast("bigint").alias("outdeg"))


def graph_stats(nodes: DataFrame, edges: DataFrame, eligible: int = 10) -> DataFrame:
    """One row: counts, out-degree percentiles of sources with `eligible` references, in-degree median over all nodes, sentence rate."""
    d = nodes.select("id").join(degrees(edges), "id", "left").fillna(0)
    el = F.when(F.col("outdeg") >= eligible, F.col("outdeg"))
    by_node = d.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("outdeg") >= 1).alias("sources"), F.count(el).alias("eligible_sources"),
        F.percentile(el, F.lit(0.5)).alias("outdeg_p50"), F.percentile(el, F.lit(0.9)).alias("outdeg_p90"), F.max("outdeg").alias("outdeg_max"), F.percentile("indeg", F.lit(0.5)).alias("indeg_p50"),
    )
    by_edge = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg(F.when(F.trim("sentence") != "", 1.0).otherwise(0.0)).alias("sentence_rate"))
    return by_node.crossJoin(by_edge)  # one row each


def sentence_coverage(edges: DataFrame) -> DataFrame:
    """Share of a source's edges that have a sentence."""
    return edges.groupBy("src").agg(F.avg(F.when(F.trim(F.coalesce("sentence", F.lit(""))) != "", 1.0).otherwise(0.0)).alias("coverage"), F.count(F.lit(1)).alias("n"))


def masked_view(edges: DataFrame, masked: DataFrame) -> DataFrame:
    """Edges without those that leave a masked source."""
    return edges.join(masked.select(F.col("id").alias("src")), "src", "left_anti")


def frozen_view(edges: DataFrame, months: DataFrame, cutoff: int) -> DataFrame:
    """Edges between nodes dated before the cutoff month."""
    old = months.filter(F.col("month") < cutoff).select("id")
    return edges.join(old.withColumnRenamed("id", "src"), "src", "left_semi").join(old.withColumnRenamed("id", "dst"), "dst", "left_semi")


def rolling_view(edges: DataFrame, queries: DataFrame, months: DataFrame, keep_same: bool = False, keep_unknown: bool = False) -> DataFrame:
    """(qid, src, dst): for each query(qid, cid) its candidates' citations that were there in its month.

    The query's own references are hidden. Queries meet edges by candidate, so
    no query is held against the whole graph.
    """
    q = queries.join(months.select(F.col("id").alias("qid"), F.col("month").alias("qm")), "qid", "left")
    e = edges.join(months.select(F.col("id").alias("src"), F.col("month").alias("sm")), "src", "left")
    seen = e.join(q.withColumnRenamed("cid", "dst"), "dst").filter(F.col("src") != F.col("qid"))
    return seen.filter(citer_allowed(F.col("sm"), F.col("qm"), keep_same, keep_unknown)).select("qid", "src", "dst")


def full_view(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, src, dst): the candidates' citations but for the query's own."""
    return edges.join(queries.withColumnRenamed("cid", "dst"), "dst").filter(F.col("src") != F.col("qid")).select("qid", "src", "dst")


def view(protocol: str, edges: DataFrame, queries: DataFrame, months: DataFrame, cutoff: int | None = None) -> DataFrame:
    """The protocol's view for queries(qid, cid): rolling, frozen or full."""
    if protocol == "rolling":
        return rolling_view(edges, queries, months)
    if protocol == "frozen":
        return full_view(frozen_view(edges, months, cutoff), queries)
    if protocol == "full":
        return full_view(edges, queries)
    raise ValueError(f"protocol {protocol!r} is none of rolling, frozen, full")


def graph_problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, n): self loops, parallel edges, ends without a node, ids that occur twice."""
    ids = nodes.select("id")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return (
        edges.agg(F.lit("self_loops").alias("check"), F.count_if(F.col("src") == F.col("dst")).alias("n"))
        .union(edges.groupBy("src", "dst").count().agg(F.lit("parallel_edges"), F.count_if(F.col("count") > 1)))
        .union(ends.join(ids, "id", "left_anti").agg(F.lit("unknown_ends"), F.count(F.lit(1))))
        .union(ids.groupBy("id").count().agg(F.lit("double_ids"), F.count_if(F.col("count") > 1)))
    )


def evidence_pool(edges: DataFrame, exclude: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """(dst, src, sentence, pos): citing sentences that aren't empty, without excluded citers."""
    e = edges.filter(nonempty("sentence").isNotNull())
    for c in (~exclude if exclude is not None else None, allowed):
        e = e.filter(c) if c is not None else e
    return e.select("dst", "src", "sentence", "pos")


def selected_evidence(pool: DataFrame, policy: str, most: int = 3, month: str = "month") -> DataFrame:
    """At most `most` sentences a cited paper: `stride` in graph order, `recent` newest first, `spread` evenly over time."""
    time = [F.col(month).asc_nulls_first(), F.col("src")] if policy != "stride" else [F.col("pos")]
    if policy not in ("stride", "recent", "spread"):
        raise ValueError(f"policy {policy!r} is none of stride, recent, spread")
    w = Window.partitionBy("dst")
    p = pool.withColumn("_i", F.row_number().over(w.orderBy(*time)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if policy == "recent":
        p = p.withColumn("ord", F.col("_n") - F.col("_i")).filter(F.col("ord") <= most)
    else:
        step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
        p = p.filter(F.col("_i") % step == 0).withColumn("ord", F.floor(F.col("_i") / step) + 1).filter(F.col("ord") <= most)
    return p.withColumn("ord", F.col("ord").cast("bigint")).drop("_i", "_n")


def cocitations(edges: DataFrame, most_refs: int = 80, keep: int = 64, seed: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, w): how many citers have both; `keep` partners a node, of most weight, then of least id.

    A citer's references are capped at most_refs in hash order before they are
    paired, so that a long list costs at most most_refs squared pairs; for citers
    with more references the counts are those of that sample.
    """
    w = Window.partitionBy(*extra, "src").orderBy(stable_hash("dst", "src", seed), "dst")
    e = edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most_refs).select(*extra, "src", "dst")
    a, b = e.withColumnRenamed("dst", "i"), e.withColumnRenamed("dst", "j")
    pairs = a.join(b, [*extra, "src"]).filter("i != j").groupBy(*extra, "i", "j").agg(F.count(F.lit(1)).alias("w"))
    top = Window.partitionBy(*extra, "i").orderBy(F.col("w").desc(), "j")
    return pairs.withColumn("_rn", F.row_number().over(top)).filter(F.col("_rn") <= keep).drop("_rn")


def folds(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, fold): ids dealt evenly in the order of a seeded hash; they are numbered inside the hash's first eight bits."""
    b = ids.select("id").distinct().withColumn("_h", stable_hash("id", seed)).withColumn("_b", F.shiftright("_h", 52))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "id")) - 1
    first = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    return b.withColumn("_i", inside).join(F.broadcast(first), "_b").select("id", ((F.col("_first") + F.col("_i")) % k).cast("int").alias("fold"))


def fold_out(edges: DataFrame, fold_of: DataFrame) -> DataFrame:
    """(fold, src, dst): for each fold the edges whose citer is not in it."""
    k = fold_of.select("fold").distinct()  # as many rows as folds
    e = edges.join(fold_of.select(F.col("id").alias("src"), F.col("fold").alias("own")), "src", "left")
    return e.crossJoin(F.broadcast(k)).filter(F.col("own").isNull() | (F.col("own") != F.col("fold"))).select("fold", "src", "dst")


def without_targets(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges but for the exact (src, dst) of targets."""
    return edges.join(targets.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, mid, dst): paths of two edges that don't return."""
    e2 = edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return edges.withColumnRenamed("dst", "mid").join(e2, "mid").filter("src != end").select("src", "mid", F.col("end").alias("dst"))


def later_cocited(edges: DataFrame, months: DataFrame) -> DataFrame:
    """(query, cited): references that a later citer of the query cites, too."""
    m = months.select(F.col("id"), F.col("month"))
    later = (
        edges.select(F.col("src").alias("citer"), F.col("dst").alias("query"))
        .join(m.select(F.col("id").alias("citer"), F.col("month").alias("cm")), "citer").join(m.select(F.col("id").alias("query"), F.col("month").alias("qm")), "query").filter("cm > qm").select("citer", "query")
    )
    refs = edges.select(F.col("src").alias("query"), F.col("dst").alias("cited"))
    also = edges.select(F.col("src").alias("citer"), F.col("dst").alias("cited"))
    return later.join(also, "citer").join(refs, ["query", "cited"], "left_semi").select("query", "cited").distinct()


def expansion_candidates(nodes: DataFrame, edges: DataFrame, similarity: DataFrame | None, budget: int) -> DataFrame:
    """(id, ord): nodes that are cited but cite nothing; by similarity where given (missing: -1), then in-degree, up to the budget."""
    d = nodes.select("id").join(degrees(edges), "id").filter("indeg >= 1 and outdeg = 0")
    if similarity is not None:
        d = d.join(similarity, "id", "left")
    d = d.withColumn("sim", F.coalesce("sim", F.lit(-1.0)) if similarity is not None else F.lit(0.0))
    order = [F.col("sim").desc(), F.col("indeg").desc(), F.col("id")]
    top = d.orderBy(*order).limit(budget)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def edge_softmax(messages: DataFrame) -> DataFrame:
    """messages (dst, src, logit, vec): per dst the softmax-weighted sum of its sources' vectors."""
    top = messages.groupBy("dst").agg(F.max("logit").alias("_m"))
    e = messages.join(top, "dst").withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    total = e.groupBy("dst").agg(F.sum("_e").alias("_z"))
    parts = e.join(total, "dst").select("dst", F.posexplode("vec").alias("d", "x"), (F.col("_e") / F.col("_z")).alias("_w"))
    sums = parts.groupBy("dst", "d").agg(F.sum(F.col("x") * F.col("_w")).alias("x"))
    return sums.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """(qid, id, rank): edges (qid, src, dst) of each query's subgraph, seeds (qid, id).

    The mass of nodes without references restarts at the seeds. Every step's table
    is written, so a lost executor costs one step.
    """
    from quillgraph.operators.tables import written

    e = edges.select("qid", "src", "dst").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    s = written(seeds.select("qid", "id").distinct().withColumn("p", 1.0 / n))
    out = e.groupBy("qid", "src").agg(F.count(F.lit(1)).alias("od"))
    flow = written(e.join(out, ["qid", "src"]).withColumnRenamed("src", "id"))
    rank = s
    for _ in range(steps):
        sent = flow.join(rank, ["qid", "id"]).groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.col("p") / F.col("od")).alias("got"))
        kept = sent.groupBy("qid").agg(F.sum("got").alias("moved"))
        back = s.join(kept, "qid", "left").select("qid", "id", (F.col("p") * (1 - damping * F.coalesce("moved", F.lit(0.0)))).alias("home"))
        rank = written(sent.join(back, ["qid", "id"], "full").select("qid", "id", (damping * F.coalesce("got", F.lit(0.0)) + F.coalesce("home", F.lit(0.0))).alias("p")))
    return rank.withColumnRenamed("p", "rank")


def cutoff_pack(edges: DataFrame, vectors: DataFrame, masked: DataFrame, required: DataFrame, near: int = 16, total: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, cocitations, neighbours) of a cutoff, all made after the masked sources' (id) references are gone.

    Raises where a required paper (id) has no vector (id, emb).
    """
    from quillgraph.operators.universe import neighbour_lists

    gone = required.select("id").distinct().join(vectors.select("id"), "id", "left_anti").count()
    if gone:
        raise ValueError(f"{gone} required papers have no vector")
    seen = masked_view(edges, masked)
    both = cocitations(seen)
    return seen, both, neighbour_lists(seen, vectors, both, near, total)


def leak_self_check(edges: DataFrame, targets: DataFrame, neighbours: DataFrame, scored: DataFrame, most_auc: float = 0.99, most_near: float = 0.85) -> DataFrame:
    """(name, ok): whether a model may have seen its targets (src, dst).

    No target edge is left once they are removed; in less than `most_near` of the
    targets is the query among the candidate's neighbours (id, other); the AUC of
    scored (score, is_gold) is not too good to be true.
    """
    from quillgraph.operators.contracts import verdicts
    from quillgraph.operators.ranking import roc_auc

    t = targets.select("src", "dst").distinct()
    left = without_targets(edges, t).join(t, ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("left"))
    near = t.join(neighbours.select(F.col("id").alias("dst"), F.col("other").alias("src"), F.lit(1).alias("_near")), ["src", "dst"], "left").agg(F.avg(F.coalesce("_near", F.lit(0))).alias("near"))
    one = left.crossJoin(near).crossJoin(roc_auc(scored))  # one row each
    return verdicts(one, {"no_target_left": F.col("left") == 0, "few_in_neighbours": F.col("near") < most_near, "plausible_auc": F.col("auc") <= most_auc})


def attention_dump(attention: DataFrame, most: int) -> DataFrame:
    """(dst, src, weight, ord): of each node the `most` sources with the highest mean weight over heads; attention (dst, src, head, weight)."""
    m = attention.groupBy("dst", "src").agg(F.avg("weight").alias("weight"))
    w = Window.partitionBy("dst").orderBy(F.round("weight", 9).desc(), "src")
    return m.withColumn("ord", F.row_number().over(w).cast("bigint")).filter(F.col("ord") <= most)
