"""Admission, temporal splits, gold eligibility, shuffles and leak checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.graph import sentence_coverage


def admit_and_split(edges: DataFrame, months: DataFrame, k: int = 10, coverage: float = 0.95, quantiles: tuple[float, float] = (0.1, 0.99), frontier_months: int = 1, test_share: float = 0.1, allowed: DataFrame | None = None) -> DataFrame:
    """(source_id, split).

    Sources with k references, on the allow-list, with enough sentences, and an
    out-degree between the survivors' quantiles; the newest months are the
    frontier, then the newest test_share, by month and id, the test.
    """
    c = sentence_coverage(edges).filter(F.col("n") >= k)
    if allowed is not None:
        c = c.join(allowed.select(F.col("id").alias("src")), "src", "left_semi")
    c = c.filter(F.col("coverage") >= coverage)
    q = c.agg(F.percentile("n", F.lit(quantiles[0])).alias("lo"), F.percentile("n", F.lit(quantiles[1])).alias("hi"))
    a = c.crossJoin(F.broadcast(q)).filter("n between lo and hi").join(months.filter("month is not null").withColumnRenamed("id", "src"), "src").select("src", "month")
    # as many rows as months
    newest = a.groupBy("month").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(F.col("month").desc())
    per_month = newest.withColumn("place", F.row_number().over(w)).withColumn("frontier", F.col("place") <= frontier_months)
    rest = per_month.filter("not frontier")
    total = F.sum("c").over(Window.partitionBy())
    newer = rest.withColumn("newer", F.sum("c").over(w) - F.col("c")).withColumn("wanted", F.ceil(total * test_share)).select("month", "newer", "wanted")
    tagged = a.join(F.broadcast(per_month.select("month", "frontier")), "month").join(F.broadcast(newer), "month", "left")
    # ids count inside one month only, where the cut falls
    inside = F.row_number().over(Window.partitionBy("month").orderBy(F.col("src").desc()))
    split = F.when(F.col("frontier"), "frontier").when(F.col("newer") + inside <= F.col("wanted"), "test").otherwise("train")
    return tagged.select(F.col("src").alias("source_id"), split.alias("split"))


def month_split(dated: DataFrame, ratio: float) -> DataFrame:
    """(id, split): whole months, the newest, are dev until they hold ratio of all ids (rounded half to even)."""
    w = Window.orderBy(F.col("month").desc())
    m = dated.groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("newer", F.sum("n").over(w) - F.col("n")).withColumn("want", F.bround(F.sum("n").over(Window.partitionBy()) * ratio))
    return dated.join(F.broadcast(m.select("month", "newer", "want")), "month").select("id", F.when(F.col("newer") < F.col("want"), "dev").otherwise("train").alias("split"))


def eligible_gold(gold: DataFrame, months: DataFrame) -> DataFrame:
    """gold (qid, gid) of which both are dated and the gold is older."""
    q, c = months.select(F.col("id").alias("qid"), F.col("month").alias("qm")), months.select(F.col("id").alias("gid"), F.col("month").alias("gm"))
    return gold.join(q, "qid").join(c, "gid").filter("gm < qm").select("qid", "gid")


def stable_shuffle(ids: DataFrame, salt: str) -> DataFrame:
    """(id, ord): the ids in the order of a salted SHA-1, numbered inside the digests' first byte."""
    d = ids.select("id", F.sha1(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary")).alias("_s")).withColumn("_b", F.substring("_s", 1, 2))
    first = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    i = F.row_number().over(Window.partitionBy("_b").orderBy("_s", "id"))
    return d.withColumn("_i", i).join(F.broadcast(first), "_b").select("id", (F.col("_first") + F.col("_i")).alias("ord"))


def leaks(parts: dict[str, DataFrame]) -> DataFrame:
    """(pair, n): how many ids each two parts share; all must be 0."""
    out = None
    for (a, x), (b, y) in combinations(parts.items(), 2):
        n = x.select("id").distinct().join(y.select("id").distinct(), "id", "left_semi").agg(F.lit(f"{a}_{b}").alias("pair"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out
