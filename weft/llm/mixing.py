"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document, once for each pass that its source may need, gets a virtual finish time: the words of its source up to
and including it, in a keyed shuffle, over the source's target. All sources end their targets at time 1, so cutting the
global order by finish time where the word budget ends mixes them by weight.

Running sums are never taken over a whole source or the whole mix in one task: rows are dealt to buckets (of the shuffle
key in a source, of the finish time in the mix), the buckets' totals are summed up, and each bucket is summed by itself.

Null or empty texts have size 0 and are never taken; a null source is a source of its own, last in order. Documents with
equal ids and sizes are told apart by their place only, so their rows may trade places but the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import free_name, prepare, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Buckets of the shuffle key in a source, and of each unit of virtual time.
BUCKETS = 4096
#: Sources up to this number are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, total_share: float, epochs: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source, given source and source_size.

    The budget total_share * all sizes is shared by weight; a source stops at epochs * its size, and the excess goes to
    the others by weight. A source is capped if the share that is left when all sources with a smaller cap for their
    weight have stopped would reach its cap.
    """
    one = F.lit(1)
    by_code = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy(one)
    level = F.col("budget") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_code))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(total_share)))
        .withColumn("left", level)
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("open"))
    )
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("budget") - spent) * F.col("weight") / free).alias("target"))


def mix(documents: DataFrame, total_share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, source of each document; taken = passes * size, passes <= epochs."""
    spark = documents.sparkSession
    prepare(spark)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = documents.select("doc_id", "source", size_of("text").alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")).checkpoint()
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total_share, epochs, weights).checkpoint()
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    parts = parts.alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source")).select("p.source", "bucket", "before", "source_size", "target")

    shuffled = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    local = rows.withColumn("place", F.row_number().over(shuffled)).withColumn("upto", F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source and r.bucket = p.bucket"))
    local = local.select("r.source", "r.bucket", "place", "doc_id", "size", "source_size", "target", (F.col("upto") + F.col("before")).alias("upto"))

    passes = local.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target")
    passes = passes.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)))
    slot = F.when(F.col("finish") < 2, F.floor(F.col("finish") * BUCKETS)).otherwise(2 * BUCKETS + F.floor(F.log2("finish") * 512))
    passes = passes.withColumn("slot", slot)
    ahead = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = passes.groupBy("slot").agg(F.sum("size").alias("slot_size")).withColumn("ahead", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0))).drop("slot_size")
    queue = Window.partitionBy("slot").orderBy("finish", "source", "pass", "bucket", "place").rowsBetween(Window.unboundedPreceding, 0)
    budget = rows.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(total_share))).alias("budget"))
    queued = passes.withColumn("queued", F.sum("size").over(queue)).join(slots, "slot").join(F.broadcast(budget))
    kept = (F.col("queued") + F.col("ahead") <= F.col("budget")) & (F.col("size") > 0)
    taken = queued.groupBy("source", "bucket", "place").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum(kept.cast("int")).alias("passes"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"), "passes", "source")


def corpus(documents: DataFrame, total_share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The given rows with all their columns, and size, source_size, target, taken and passes: how often the mix has each.

    Rows with equal doc_id, source and size are interchangeable: they get their passes in the order of their texts. A
    column of the input that has the name of an added one stays, and the added one is called with an underscore in front.
    """
    mixed = mix(documents, total_share, epochs, weights, seed)
    work = {c: free_name(documents, c) for c in ("__key", "__nth")}
    added = {c: free_name(documents, c) for c in ("size", "source_size", "target", "taken", "passes")}
    key, nth, size = F.col(work["__key"]), F.col(work["__nth"]), F.col(added["size"])
    alike = Window.partitionBy(key, "doc_id", "source", size)
    # Rows without a doc_id are dealt by what else tells them apart.
    rows = documents.withColumn(added["size"], size_of("text")).withColumn(work["__key"], F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("source", added["size"])))
    rows = rows.repartition(key).withColumn(work["__nth"], F.row_number().over(alike.orderBy(F.xxhash64("text"))))
    same = Window.partitionBy("k", "doc_id", "source", "size").orderBy("passes")
    mixed = mixed.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("source", "size"))).repartition("k").withColumn("n", F.row_number().over(same))
    mixed = mixed.select("k", "n", F.col("size").alias("s"), F.col("doc_id").alias("i"), F.col("source").alias("o"), *(F.col(c).alias(f"m_{c}") for c in list(added)[1:]))
    joined = rows.alias("r").join(mixed.alias("m"), (key == F.col("m.k")) & (nth == F.col("m.n")) & (size == F.col("m.s")) & F.col("r.doc_id").eqNullSafe(F.col("m.i")) & F.col("r.source").eqNullSafe(F.col("m.o")))
    return joined.select(*(F.col(f"r.{c}") for c in documents.columns), size, *(F.col(f"m.m_{c}").alias(name) for c, name in list(added.items())[1:]))


def size_of(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("passes", "source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM s),
c AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
k AS (SELECT *, left_over * weight >= cap * open AS capped FROM c),
t AS (
  SELECT source, source_size, budget, CASE WHEN capped THEN cap ELSE
         (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM k),
r AS (
  SELECT d.*, source_size, target, budget,
         row_number() OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS rn,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(upto + pass * source_size AS DOUBLE) / target ELSE 0 END AS finish
  FROM r, (VALUES (0), (1)) v(pass)),
q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS FIRST, pass, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS queued
  FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN queued <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q GROUP BY source, rn, doc_id, size, source_size, target
"""
