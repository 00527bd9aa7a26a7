"""Models as data: linear, MLP and logistic scorers, whitening, losses. Weights come in as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def network_scores(u: np.ndarray, v: np.ndarray, x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> np.ndarray:
    """A tanh network over [u, v, u * v, |u - v|, x]."""
    return np.tanh(np.hstack([u, v, u * v, np.abs(u - v), x]) @ w1 + b1) @ w2 + b2


def pair_scores(pairs: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> DataFrame:
    """(qid, cid, score): a tanh network over [u, v, u * v, |u - v|, extra]; a missing vector gives a null score.

    pairs: qid, cid, u, v, extra (arrays of doubles).
    """
    types = dict(pairs.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full(len(b), np.nan)
            full = (b["u"].notna() & b["v"].notna()).to_numpy()
            if full.any():
                u, v, x = (np.stack(b.loc[full, c].to_numpy()) for c in ("u", "v", "extra"))
                out[full] = network_scores(u, v, x, w1, b1, w2, b2)
            yield pd.DataFrame({"qid": b["qid"], "cid": b["cid"], "score": pd.Series(out).where(full, None).astype("Float64")})

    return pairs.select("qid", "cid", "u", "v", "extra").mapInPandas(score, f"qid {types['qid']}, cid {types['cid']}, score double")


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with n - 1) of emb, from one row of sums per partition; dim squared numbers reach the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b["emb"].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"i": np.arange(1 + dim + dim * dim), "x": np.concatenate([[n], s, q.ravel()])})

    parts = vectors.select("emb").mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    n, s, q = int(parts[0]), parts[1 : 1 + dim], parts[1 + dim :].reshape(dim, dim)
    mean = s / max(1, n)
    return n, mean, (q - n * np.outer(mean, mean)) / max(1, n - 1)


def whitening(vectors: DataFrame, dim: int, keep: int | None = None, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): ZCA, or with `keep` the first principal components scaled to unit variance."""
    _, mean, cov = moments(vectors, dim)
    value, basis = np.linalg.eigh(cov)
    value = np.maximum(value, least)
    if keep is None:
        return mean, basis / np.sqrt(value) @ basis.T
    top = np.argsort(value)[::-1][:keep]
    return mean, basis[:, top] / np.sqrt(value[top])


def whitened(vectors: DataFrame, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """vectors (id, emb) times the matrix."""
    kind = dict(vectors.dtypes)["id"]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "emb": list((np.stack(b["emb"].to_numpy()).astype(float) - mean) @ matrix)})

    return vectors.select("id", "emb").mapInPandas(apply, f"id {kind}, emb array<double>")


def fit_statistics(rows: DataFrame, features: tuple[str, ...], count: str | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """(mean, sd) by feature, population sd, below 1e-6 as 1; `count` names the column with how many equal rows a row stands for."""
    if count is None:
        stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    else:
        of = lambda x: F.sum(x * F.col(count)) / F.sum(count)
        m = rows.agg(*[of(F.col(c)).alias(c) for c in features]).first()
        s = rows.agg(*[F.sqrt(of((F.col(c) - F.lit(m[c])) ** 2)).alias(c) for c in features]).first()
        stats = {f"m_{c}": m[c] for c in features} | {f"s_{c}": s[c] for c in features}
    mean = {c: stats[f"m_{c}"] for c in features}
    return mean, {c: stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) >= 1e-6 else 1.0 for c in features}


def logistic_fit(rows: DataFrame, features: tuple[str, ...], label: str = "y", weight: str | None = None, count: str | None = None):
    """A pyspark.ml logistic regression: (weights by feature, bias, mean, sd), standardised as fit_statistics says."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    mean, sd = fit_statistics(rows, features, count)
    by = [F.col(c).cast("double") for c in (weight, count) if c]
    z = rows.select(*[((F.col(c) - mean[c]) / sd[c]).alias(c) for c in features], F.col(label).cast("double").alias("label"), *([reduce(lambda a, b: a * b, by).alias("_weight")] if by else []))
    x = VectorAssembler(inputCols=list(features), outputCol="features").transform(z)
    model = LogisticRegression(standardization=False, regParam=1e-3, **({"weightCol": "_weight"} if by else {})).fit(x)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True)), model.intercept, mean, sd


def ranknet_pairs(rows: DataFrame, features: tuple[str, ...], most: int = 20) -> DataFrame:
    """Difference rows for a pairwise fit: each positive of a query with the query's first `most` negatives in hash order, once each way."""
    from pyspark.sql import Window

    from quillgraph.functions.hashing import stable_hash

    w = Window.partitionBy("qid").orderBy(stable_hash("qid", "cid"), "cid")
    p = rows.filter("y = 1").select("qid", *[F.col(c).alias(f"p_{c}") for c in features])
    n = rows.filter("y = 0").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).select("qid", *[F.col(c).alias(f"n_{c}") for c in features])
    up = p.join(n, "qid").select("qid", *[(F.col(f"p_{c}") - F.col(f"n_{c}")).alias(c) for c in features], F.lit(1).alias("y"))
    return up.unionByName(up.select("qid", *[(-F.col(c)).alias(c) for c in features], F.lit(0).alias("y")))


def listwise_loss(score: Column, gold: Column, qid: str = "qid") -> list[Column]:
    """Columns for groupBy(qid): the softmax cross-entropy with uniform mass on gold."""
    z = F.log(F.sum(F.exp(score)))
    return [(z - F.avg(F.when(gold, score))).alias("loss")]


def pairwise_loss(rows: DataFrame) -> DataFrame:
    """(qid, loss): mean of log(1 + exp(negative - positive)) over pairs; rows (qid, score, is_gold) of a window."""
    p, n = rows.filter("is_gold").select("qid", F.col("score").alias("p")), rows.filter("not is_gold").select("qid", F.col("score").alias("n"))
    return p.join(n, "qid").groupBy("qid").agg(F.avg(F.log1p(F.exp(F.col("n") - F.col("p")))).alias("loss"))


def multi_positive_ntxent(rows: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(qid, loss): -log of the positives' share of the softmax mass."""
    e = F.exp(F.col("score") / temperature)
    return rows.groupBy("qid").agg((-F.log(F.sum(F.when(F.col("is_gold"), e)) / F.sum(e))).alias("loss"))
