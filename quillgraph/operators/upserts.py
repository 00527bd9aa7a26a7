"""Merges, upserts and incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_snapshot(old: DataFrame, new: DataFrame, key: str = "id", version: str = "update_date", order: str = "seq") -> DataFrame:
    """old with new rows whose version isn't older; of several new rows of a key the last that may replace wins.

    As versions only grow along accepted rows, that row is the one of the
    greatest version, and among equal ones the last.
    """
    cols = [c for c in old.columns]
    both = old.withColumn("_g", F.lit(0)).withColumn(order, F.lit(-1).cast("bigint")).unionByName(new.select(*cols, F.col(order).cast("bigint")).withColumn("_g", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_g").desc(), F.col(order).desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*cols)


def merge_counts(old: DataFrame, new: DataFrame, key: str = "id", version: str = "update_date") -> DataFrame:
    """One row: keys added, keys whose row is replaced."""
    n = new.groupBy(key).agg(F.max(version).alias("v"))
    j = n.join(old.select(key, F.col(version).alias("o")), key, "left")
    return j.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("v") >= F.col("o")).alias("updated"))


def bulk_upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All columns of new win; rows only in old stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merged_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (id, title, topic), new (id, topic): topics overwrite; ids only in new get a stub."""
    n = new.select("id", F.col("topic").alias("_t"))
    return old.join(n, "id", "full").select("id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("_t", "topic").alias("topic"))


def merged_fields(old: DataFrame, new: DataFrame, fields: tuple[str, ...], version: str = "update_date") -> DataFrame:
    """Non-empty new fields overwrite unless the new row is older; `origin` names where a row comes from."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in (*fields, version)])
    stale = F.col(f"_{version}") < F.col(version)
    j = old.join(n, "id", "full")
    take = lambda c: F.when(F.coalesce(stale, F.lit(False)), F.col(c)).otherwise(F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c), F.lit("")))
    origin = F.when(F.col(f"_{version}").isNull(), "old").when(F.col(version).isNull(), "new").when(stale, "old").otherwise("both")
    return j.select("id", *[take(c).alias(c) for c in fields], F.greatest(version, f"_{version}").alias(version), origin.alias("origin"))


def missing_from(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def not_failed(rows: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """rows whose key is not in failed, neither as it is nor as the storage key without slashes."""
    f = failed.select(F.col(key).alias("_failed")).distinct()
    keys = rows.withColumn("_stored", F.replace(key, F.lit("/"), F.lit("")))
    return keys.join(f, F.col(key) == F.col("_failed"), "left_anti").join(f, F.col("_stored") == F.col("_failed"), "left_anti").drop("_stored")


def overridden(base: DataFrame, supplement: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """The union of both, the supplement's values first."""
    s = supplement.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return base.join(s, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def first_of(ladder: list[DataFrame], value: str, key: str = "id") -> DataFrame:
    """(key, value, step): each key's value from the first table of the ladder that has one."""
    tagged = [d.filter(F.col(value).isNotNull()).select(key, value, F.lit(i).alias("step")) for i, d in enumerate(ladder)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.min_by(F.struct(value, "step"), "step").alias("s")).select(key, f"s.{value}", "s.step")


def put_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value state after changes (key, value, seq): the last change of a key wins."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return state.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last)


def corpus_update(metadata: DataFrame, topics: DataFrame, vectors: DataFrame, label, encode, since: str) -> tuple[DataFrame, DataFrame]:
    """(new topics, new vectors) of papers (id, ..., update_date) from `since` on that lack them.

    label(papers) returns (id, topic), encode(papers) returns (id, embedding):
    the models, as functions of tables.
    """
    fresh = metadata.filter(F.col("update_date") >= since)
    return label(missing_from(fresh, topics)), encode(missing_from(fresh, vectors))
