"""Assembly of training and evaluation sets: windows, samples, tasks, pairs. Choices follow hashes, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hashing import stable_hash
from quillgraph.operators import splits
from quillgraph.operators.graph import degrees, selected_evidence


def gold_mask(window: DataFrame, gold: DataFrame) -> DataFrame:
    return window.join(gold.select("qid", "cid").distinct().withColumn("is_gold", F.lit(True)), ["qid", "cid"], "left").fillna(False, ["is_gold"])


def visible_window(retrieved: DataFrame, corpus: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(qid, cid, ord): retrieved (qid, cid, ord) that are in corpus (cid, month) and older than the query, the first `most` in order."""
    j = retrieved.join(corpus.select("cid", F.col("month").alias("cm")), "cid").join(queries.select("qid", F.col("month").alias("qm")), "qid").filter("cm < qm and cid <> qid")
    return j.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("ord", "cid")).cast("bigint")).filter(F.col("ord") <= most).select("qid", "cid", "ord")


def windows_with_evidence(window: DataFrame, edges: DataFrame, months: DataFrame, queries: DataFrame, most: int = 3, policy: str = "recent") -> DataFrame:
    """(qid, cid, ord, evidence): each candidate's citing sentences that were there before the query."""
    c = edges.filter(F.trim("sentence") != "").select(F.col("dst").alias("cid"), "src", "sentence", "pos").join(months.select(F.col("id").alias("src"), "month"), "src")
    p = window.join(queries.select("qid", F.col("month").alias("qm")), "qid").join(c, "cid").filter("month < qm and src <> qid")
    p = p.withColumn("dst", F.struct("qid", "cid"))
    s = selected_evidence(p.select("dst", "src", "sentence", "pos", "month", "qid", "cid"), policy, most).withColumnRenamed("ord", "_o")
    e = s.groupBy("qid", "cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "sentence"))), lambda x: x["sentence"]).alias("evidence"))
    return window.join(e, ["qid", "cid"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def adapted_queries(rows: DataFrame) -> DataFrame:
    """rows (qid, gold_ids, pos): of a repeated query the row with most gold, among those the first; gold counts added."""
    w = Window.partitionBy("qid").orderBy(F.size("gold_ids").desc(), "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").withColumn("raw_gold_count", F.size("gold_ids"))


def contrast_pairs(window: DataFrame, negatives: int = 7, hard: bool = True, least_candidates: int = 5, seed: int = 0) -> DataFrame:
    """(qid, cid, y): all gold of a window and up to `negatives` others for each, the first by slot or in hash order.

    Queries with fewer candidates, or without gold, are left out.
    """
    w = Window.partitionBy("qid")
    d = window.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_g", F.count_if("is_gold").over(w)).filter((F.col("_n") >= least_candidates) & (F.col("_g") >= 1))
    order = F.col("slot") if hard else stable_hash("qid", "cid", seed)
    n = d.filter("not is_gold").withColumn("_rn", F.row_number().over(w.orderBy(order, "cid"))).filter(F.col("_rn") <= F.col("_g") * negatives)
    return d.filter("is_gold").select("qid", "cid", F.lit(1).alias("y")).unionByName(n.select("qid", "cid", F.lit(0).alias("y")))


def list_sample(window: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(qid, cid, is_gold): `size` candidates of a query in hash order, at most a quarter of them gold."""
    h = stable_hash("qid", "cid", seed)
    r = F.row_number().over(Window.partitionBy("qid", "is_gold").orderBy(h, "cid"))
    d = window.withColumn("_r", r).filter(~F.col("is_gold") | (F.col("_r") <= max(1, size // 4)))
    return d.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("is_gold").desc(), h, "cid"))).filter(F.col("_k") <= size).select("qid", "cid", "is_gold")


def tasks(sources: DataFrame, bundles: int = 2, singles: int = 2, seed: int = 0) -> DataFrame:
    """(source_id, kind, no, cid): for each source its bundle tasks, and single tasks with one gold each, chosen by hash."""
    b = sources.select("source_id", F.explode(F.sequence(F.lit(1), F.lit(bundles))).alias("no")).select("source_id", F.lit("bundle").alias("kind"), "no", F.lit(None).cast(dict(sources.dtypes)["gold_ids"][6:-1]).alias("cid"))
    one = sources.filter(F.size("gold_ids") > 0).select("source_id", "gold_ids", F.explode(F.sequence(F.lit(1), F.lit(singles))).alias("no"))
    pick = F.element_at("gold_ids", (stable_hash("source_id", "no", seed) % F.size("gold_ids") + 1).cast("int"))
    return b.unionByName(one.select("source_id", F.lit("one").alias("kind"), "no", pick.alias("cid")))


def samples_with_negatives(gold: DataFrame, scored: DataFrame, negatives: int, seed: int = 0) -> DataFrame:
    """(qid, candidates): all gold and the best-scored others, shuffled by hash; scored (qid, cid, score)."""
    n = scored.join(gold.select("qid", "cid"), ["qid", "cid"], "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid"))).filter(F.col("_rn") <= negatives)
    both = gold.select("qid", "cid", F.lit(True).alias("is_gold")).unionByName(n.select("qid", "cid", F.lit(False).alias("is_gold")))
    item = F.struct(stable_hash("qid", "cid", seed).alias("h"), "cid", "is_gold")
    return both.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["cid"].alias("cid"), x["is_gold"].alias("is_gold"))).alias("candidates"))


def hash_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of the key, each key once."""
    return rows.dropDuplicates([key]).orderBy(stable_hash(key, seed), key).limit(n)


def selected_prefix(pool: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """(qid, cid, title, ord): a pool's first k, with gold titles where the pool has none."""
    return pool.filter(F.col("ord") <= k).join(titles.select("cid", F.col("title").alias("_t")), "cid", "left").select("qid", "cid", F.coalesce(F.nullif("title", F.lit("")), "_t").alias("title"), "ord")


def citation_eval_rows(pools: DataFrame, papers: DataFrame, gold: DataFrame, pool_n: int = 50, abstract_chars: int = 800) -> DataFrame:
    """(source_id, title, abstract, gold_ids, pool_ids, n_pool) of each source with a pool.

    pools: source_id, title, abstract, pool_ids (array, in order); papers: id,
    title, abstract, what stands in for an empty title or abstract; gold:
    source_id, gold_ids. Sources that papers lack are left out.
    """
    p = papers.select(F.col("id").alias("source_id"), F.col("title").alias("_t"), F.col("abstract").alias("_a"))
    text = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit(""))
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("_t"), F.lit("")), F.col("source_id").cast("string"))
    ids = F.slice("pool_ids", 1, pool_n)
    d = pools.join(p, "source_id").join(gold.select("source_id", "gold_ids"), "source_id", "left")
    none = F.array().cast(dict(gold.dtypes)["gold_ids"])
    return d.select("source_id", named.alias("title"), F.substring(text("abstract", "_a"), 1, abstract_chars).alias("abstract"), F.coalesce("gold_ids", none).alias("gold_ids"), ids.alias("pool_ids"), F.size(ids).alias("n_pool"))


def pair_matrix(window: DataFrame, vectors: DataFrame, edges: DataFrame, negatives: int, least_candidates: int = 5, seed: int = 0) -> DataFrame:
    """(qid, cid, u, v, extra, y): training pairs of the pair network.

    window: qid, cid, is_gold, slot. All gold of a query and up to `negatives`
    others in hash order; queries with fewer candidates, or without gold, are left
    out, as are pairs without a vector (id, emb). Vectors have unit length; extra
    is log1p of the candidate's in- and out-degree.
    """
    from quillgraph.functions.vectors import norm, unit

    w = Window.partitionBy("qid")
    d = window.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_g", F.count_if("is_gold").over(w)).filter((F.col("_n") >= least_candidates) & (F.col("_g") >= 1))
    r = F.row_number().over(Window.partitionBy("qid", "is_gold").orderBy(stable_hash("qid", "cid", seed), "cid"))
    d = d.withColumn("_r", r).filter(F.col("is_gold") | (F.col("_r") <= negatives)).select("qid", "cid", "is_gold")
    one = vectors.select("id", F.when(norm(F.col("emb")) > 1e-9, unit(F.col("emb"))).otherwise(F.col("emb")).alias("emb"))
    d = d.join(one.select(F.col("id").alias("qid"), F.col("emb").alias("u")), "qid").join(one.select(F.col("id").alias("cid"), F.col("emb").alias("v")), "cid")
    deg = degrees(edges).select(F.col("id").alias("cid"), "indeg", "outdeg")
    extra = F.array(*[F.log1p(F.coalesce(c, F.lit(0))) for c in ("indeg", "outdeg")])
    return d.join(deg, "cid", "left").select("qid", "cid", "u", "v", extra.alias("extra"), F.col("is_gold").cast("int").alias("y"))


def adapter_dataset(pools: DataFrame, papers: DataFrame, gold: DataFrame, parts: dict[str, DataFrame], pool_n: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, evaluation rows, counts (name, n)) of the pools' sources; raises where a source is in a part (id) that must not be seen."""
    sources = pools.select(F.col("source_id").alias("id")).distinct()
    shared = splits.leaks({"train": sources, **parts}).filter("n > 0 and pair like 'train%'").collect()
    if shared:
        raise ValueError("; ".join(f"{r['pair']}: {r['n']} ids" for r in shared))
    rows = citation_eval_rows(pools, papers, gold, pool_n)
    made = tasks(rows.filter(F.size("gold_ids") > 0).select("source_id", "gold_ids"), seed=seed)
    counts = made.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(rows.agg(F.lit("rows").alias("name"), F.count(F.lit(1)).alias("n"))).unionByName(sources.join(papers.select("id"), "id", "left_anti").agg(F.lit("skipped").alias("name"), F.count(F.lit(1)).alias("n")))
    return made, rows, counts


def comparison_contract(rows: DataFrame, gold: DataFrame, months: DataFrame, first_test_month: int) -> tuple[DataFrame, DataFrame]:
    """(queries, counts (name, n)): each query once, with its eligible gold, dated before the first test month.

    rows: qid, gold_ids, pos; gold: qid, gid.
    """
    own = adapted_queries(rows)
    good = splits.eligible_gold(gold, months).groupBy("qid").agg(F.array_sort(F.collect_set("gid")).alias("eligible"))
    kept = own.join(months.select(F.col("id").alias("qid"), "month"), "qid").filter(F.col("month") < first_test_month).join(good, "qid")
    count = lambda d, n: d.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return kept.select("qid", "month", "raw_gold_count", "eligible"), count(rows, "rows").unionByName(count(own, "queries")).unionByName(count(kept, "kept"))
