"""Inputs for the disambiguation operators, projected from order tables: an order is a sentence, a line item a candidate.

Everything about a sentence is dealt by sent_id once; the group, the windows and the self-joins that follow keep that
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import blocks
from weft.plans.session import checkpointed, copartitioned

#: Junction rules (end of the left word, start of the right word, length of the result).
RULES = [("g", "b", 1), ("n", "r", 1), ("d", "h", 1), ("g", "s", 2), ("od", "b", 2), ("ng", "r", 2), ("ar", "c", 2), ("t", "sm", 2), ("g", "bl", 3), ("t", "h", 1)]
VERB = "RF"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    copartitioned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts up to this number are sent to all executors; more of them are joined by a shuffle.
BROADCAST_PARTS = 100_000
#: Rows that one part of a table of sentences aims at.
ROWS = 150_000


def parts(spark: SparkSession, rows: int) -> int:
    """Into how many parts so many rows go: as the session deals them out, and more where parts would grow beyond ROWS."""
    return max(-(-rows // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (ROWS // 30))), 1)


def dealt(spark: SparkSession, sf_dir: str) -> int:
    """Parts of the line items; their number is in the files' footers."""
    return parts(spark, read(spark, sf_dir, "lineitem").count())


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "left string, right string, length int")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, chunk_id, pos, lemma, cng, surface, price, quantity, part: one row per line item."""
    n = dealt(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    if part.count() <= BROADCAST_PARTS:
        part = F.broadcast(part)
    else:
        line = line.repartition(n, "l_partkey")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("sent_id"),
        (F.col("l_suppkey") % 3).cast("int").alias("chunk_id"),
        (F.col("l_linenumber") * 6).cast("int").alias("pos"),
        F.col("p_brand").alias("lemma"),
        F.concat("l_returnflag", "l_linestatus").alias("cng"),
        F.col("p_name").alias("surface"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_partkey").alias("part"),
    ).repartition(n, "sent_id")


def sentences(spark: SparkSession, sf_dir: str) -> blocks.Sentences | None:
    """The candidates in blocks, with their conflicts, query nodes and which lemmas are gold; None if they can't be packed."""
    checkpointed(spark)
    return blocks.pack(candidates(spark, sf_dir), rules(spark))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate table: one row per sentence, chunk, position, lemma and class, numbered in reading order."""
    found = candidates(spark, sf_dir).groupBy("sent_id", "chunk_id", "pos", "lemma", "cng").agg(F.min("surface").alias("surface"))
    reading = Window.partitionBy("sent_id").orderBy("chunk_id", "pos", "lemma", "cng")
    sets = Window.partitionBy("sent_id").orderBy("chunk_id", "pos")
    return found.select(
        "sent_id",
        (F.row_number().over(reading) - 1).cast("int").alias("node_id"),
        "chunk_id",
        "pos",
        (F.dense_rank().over(sets) - 1).cast("int").alias("set_id"),
        "surface",
        "lemma",
        "cng",
        (F.col("cng") == VERB).alias("is_verb"),
    )


def best(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """sent_id, chunk_id, lemma, cng of the line item with the highest value in each chunk; ties go to the lower part."""
    first = Window.partitionBy("sent_id", "chunk_id").orderBy(F.desc(by), "part", "lemma", "cng", "pos")
    return candidates(spark, sf_dir).withColumn("place", F.row_number().over(first)).where("place = 1").select("sent_id", "chunk_id", "lemma", "cng")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, "price")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, "quantity")
