"""Sampling, folds, weights and embeddings for the path model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffled(*keys: str):
    """A fixed pseudo-random order of rows, by arithmetic on their integer keys."""
    total = sum(((F.col(k) * F.lit(m)) for k, m in zip(keys, (7919, 104729, 1299709), strict=False)), F.lit(0))
    return total % F.lit(1000003)


def balanced(rows: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """All positive rows and as many negative ones, drawn in a fixed pseudo-random order.

    The draw takes the rows below the n-th smallest order value, found by counting per value, so that no single task
    sorts all negative rows.
    """
    need = rows.where(F.col(flag) == 1).count()
    negative = rows.where(F.col(flag) == 0).withColumn("__order", shuffled(*keys))
    counts = negative.groupBy("__order").agg(F.count("*").alias("n"))  # at most as many rows as order values
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("__order")))
    edge = upto.where(F.col("upto") >= need).agg(F.min("__order")).first()[0]
    if edge is None:
        return rows
    before = upto.where(F.col("__order") < edge).agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    rest = negative.where(F.col("__order") == edge).withColumn("__place", F.row_number().over(Window.orderBy(*keys))).where(F.col("__place") <= need - before).drop("__place")
    return rows.where(F.col(flag) == 1).unionByName(negative.where(F.col("__order") < edge).unionByName(rest).drop("__order"))


def folds(rows: DataFrame, k: int, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with fold: k contiguous parts of the given order, the first ones one longer where they don't divide.

    Places come from per-range counts: rows are range-sorted, numbered inside their range, and offset by what is before. parts: the number of ranges, if not the session's.
    """
    ranged = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect())  # one row per partition
    total, at, starts = sum(n for _, n in counts), 0, []
    for p, n in counts:
        starts.append((p, at))
        at += n
    before = F.coalesce(*[F.when(F.col("__part") == p, F.lit(s)) for p, s in starts], F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + before
    size, more = divmod(total, k)
    cut = more * (size + 1)
    fold = F.when(F.col("__at") < cut, F.floor(F.col("__at") / (size + 1))).otherwise(more + F.floor((F.col("__at") - cut) / max(1, size)))
    return ranged.withColumn("__at", place).withColumn("fold", fold.cast("int")).drop("__at", "__part")


def every_kth(rows: DataFrame, k: int, key: str, order: list[str]) -> DataFrame:
    """Rows 1, k + 1, 2 k + 1 ... of each key."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where((F.col("__at") - 1) % k == 0).drop("__at")


Rows = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def sums(rows: Rows, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a step needs of rows (features, labels 0 and 1, folds): for each fold, over the rows outside of it, the loss at
    the fold's weights, its gradient and the upper half of its second derivatives, in one list."""
    k, c = weights.shape
    upper = np.triu_indices(c)
    total = np.zeros((k, 1 + c + len(upper[0])))
    for x, y, fold in rows:
        z = x @ weights.T
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = np.logaddexp(0, np.where(y[:, None] > 0, -z, z))
        for f in range(k):
            out = fold != f
            own = x[out]
            total[f, 0] += loss[out, f].sum()
            total[f, 1 : 1 + c] += (p[out, f] - y[out]) @ own
            total[f, 1 + c :] += (own.T @ (own * (p[out, f] * (1 - p[out, f]))[:, None]))[upper]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["fold", "sums"])


SUMS = "fold int, sums array<double>"


def minimised(passed: Callable[[np.ndarray], DataFrame], k: int, c: int, most: int = 60) -> np.ndarray:
    """The weights (k, c) of each fold that make the loss plus half their squares least. passed: sums() of all rows.

    Newton's steps, each one pass for all folds, halved where the loss would rise; nothing is kept between passes.
    """
    upper = np.triu_indices(c)
    w, base, best, moved = np.zeros((k, c)), np.zeros((k, c)), np.full(k, np.inf), np.full(k, np.inf)
    step = np.zeros((k, c))
    for _ in range(most):
        total = np.zeros((k, 1 + c + len(upper[0])))
        for r in passed(w).select("fold", F.posexplode("sums")).groupBy("fold", "pos").agg(F.sum("col")).collect():
            total[r[0], r[1]] = r[2]
        for f in np.flatnonzero(moved > 0):
            loss = total[f, 0] + w[f] @ w[f] / 2
            if loss > best[f] + 1e-12 * abs(best[f]):
                step[f] /= 2
            else:
                h = np.zeros((c, c))
                h[upper] = total[f, 1 + c :]
                h = h + np.triu(h, 1).T + np.eye(c)
                best[f], base[f] = loss, w[f]
                step[f] = np.linalg.solve(h, -(total[f, 1 : 1 + c] + w[f]))
            w[f] = base[f] + step[f]
            if np.abs(step[f]).max(initial=0) <= 1e-10 * (1 + np.abs(w[f]).max(initial=0)):
                moved[f] = 0
        if not moved.any():
            return w
    raise RuntimeError("the weights don't converge")


def named(spark: SparkSession, weights: np.ndarray, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, c, float(x)) for f, row in enumerate(weights) for c, x in zip(columns, row, strict=True)], "fold int, column string, weight double")


def logistic_weights(rows: DataFrame, columns: list[str], flag: str, k: int = 4) -> DataFrame:
    """fold, column, weight: a logistic regression without intercept for each fold's complement, with an L2 penalty."""
    kept = rows.select(F.col("fold").cast("int"), F.col(flag).cast("int"), *(F.col(c).cast("double") for c in columns))

    def passed(weights: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain = ([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches)
            return sums(((np.column_stack(x), y, fold) for fold, y, *x in plain), weights)

        return kept.mapInArrow(run, SUMS)

    return named(rows.sparkSession, minimised(passed, k, len(columns)), columns)


def averaged(weights: DataFrame) -> DataFrame:
    """column, mean, least of the folds' weights, those whose least is positive."""
    return weights.groupBy("column").agg(F.avg("weight").alias("mean"), F.min("weight").alias("least")).where("least > 0")


def embeddings(sentences: DataFrame, column: str, size: int = 100, window: int = 10) -> DataFrame:
    """word, vector by skip-gram; the model that this stands for predicts a word from its context instead."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=1, inputCol=column, outputCol="__v").fit(sentences).getVectors()
