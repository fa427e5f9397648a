"""Accuracy of readings and reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """sent_id, accuracy: the share of gold lemmas, with repeats, that the prediction has, in percent."""
    have = predicted.select("sent_id", "lemma").distinct().withColumn("hit", F.lit(1))
    return gold.join(have, ["sent_id", "lemma"], "left").groupBy("sent_id").agg((F.sum(F.coalesce("hit", F.lit(0))) * F.lit(100.0) / F.count("*")).alias("accuracy"))


def precision(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """sent_id, accuracy: the share of predicted lemmas that are gold, in percent."""
    return recall(gold, predicted)


def results(predicted: DataFrame, gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """sent_id, matched, in_gold, predicted, n_nodes, n_lemmas."""
    have = predicted.select("sent_id", "lemma").distinct().withColumn("hit", F.lit(1))
    g = gold.join(have, ["sent_id", "lemma"], "left").groupBy("sent_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("matched"), F.count("*").alias("in_gold"))
    p = predicted.groupBy("sent_id").agg(F.count("*").alias("predicted"))
    n = nodes.groupBy("sent_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("lemma").alias("n_lemmas"))
    return g.join(p, "sent_id").join(n, "sent_id")


def report(accuracy: DataFrame) -> DataFrame:
    """One row: mean, minimum, quartiles, maximum, and the percentages of sentences from 95 and from 100 on."""
    cut = F.percentile("accuracy", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    over = lambda x: (F.avg((F.col("accuracy") >= x).cast("double")) * 100).alias(f"from_{x}")
    one = accuracy.agg(F.avg("accuracy").alias("mean"), cut.alias("q"), over(95), over(100))
    return one.select("mean", *(F.col("q")[k].alias(f"q{k}") for k in range(5)), "from_95", "from_100")


def histogram(values: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, n of equal widths from low to high; the last bin holds its upper end."""
    slot = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def band(column: str) -> Column:
    """low up to 40, middle from 45 to 60, high from 80 to 100; what lies between belongs to none."""
    c = F.col(column)
    return F.when(c <= 40, "low").when(c.between(45, 60), "middle").when(c.between(80, 100), "high")


def banded(accuracy: DataFrame) -> DataFrame:
    return accuracy.withColumn("band", band("accuracy")).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.avg("accuracy").alias("mean"))


def suspicious(found: DataFrame) -> DataFrame:
    """Sentences with full accuracy but another number of words than gold."""
    return found.where("matched = in_gold and predicted <> in_gold")


def merged_shards(shards: list[DataFrame], key: str, once: bool) -> DataFrame:
    """All shards' rows; once: the last shard's row for each key."""
    every = None
    for k, s in enumerate(shards):
        s = s.withColumn("shard", F.lit(k))
        every = s if every is None else every.unionByName(s)
    if not once:
        return every
    last = Window.partitionBy(key).orderBy(F.desc("shard"))
    return every.withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place")


def scaled(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """rows with scaled (value by its range) and share (weight by the sum of all)."""
    ends = rows.agg((F.max(value) - F.min(value)).alias("__range"), F.sum(weight).alias("__sum"))
    return rows.join(F.broadcast(ends)).withColumns({"scaled": F.col(value) / F.col("__range"), "share": F.col(weight) / F.col("__sum")}).drop("__range", "__sum")
