"""Relations between the candidates of a sentence: which exclude each other, which may stand together, which are certain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(first_pos, first_surface, second_pos):
    """Characters that the earlier word shares with the later one."""
    return F.greatest(first_pos + F.length(first_surface) - second_pos, F.lit(0))


def pairs(nodes: DataFrame, condition: str) -> DataFrame:
    """Pairs of a sentence's nodes (columns of the first and, with the suffix 2, of the second)."""
    other = nodes.select("sent_id", *(F.col(c).alias(f"{c}2") for c in nodes.columns if c != "sent_id"))
    return nodes.join(other, "sent_id").where(condition)


#: Junction rules up to this number are sent to all executors; more of them are joined by a shuffle.
BROADCAST_RULES = 1_000_000


def spans(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of one chunk in reading order with their overlap and whether they can stand together.

    Overlaps of one or two characters are allowed where a junction rule shortens the joint: either on the overlap of the
    first word and the first letter of the second, or on the last letter of the first and the overlap of the second.
    Words at one position never stand together.
    """
    near = pairs(nodes, "chunk_id = chunk_id2 and node_id < node_id2").withColumn("overlap", overlap(F.col("pos"), F.col("surface"), F.col("pos2")))
    tail = F.expr("right(surface, greatest(overlap, 1))")
    head = F.expr("left(surface2, greatest(overlap, 1))")
    one = rules.select(F.col("left").alias("tail"), F.col("right").alias("first"), F.col("length").alias("by_tail"))
    two = rules.select(F.col("left").alias("last"), F.col("right").alias("head"), F.col("length").alias("by_head"))
    keyed = near.select("*", tail.alias("tail"), F.expr("left(surface2, 1)").alias("first"), F.expr("right(surface, 1)").alias("last"), head.alias("head"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        one, two = F.broadcast(one), F.broadcast(two)
    ruled = keyed.join(one, ["tail", "first"], "left").join(two, ["last", "head"], "left")
    short = F.coalesce(F.col("by_tail") < F.col("overlap") + 1, F.lit(False)) | F.coalesce(F.col("by_head") < F.col("overlap") + 1, F.lit(False))
    stands = (F.col("pos") < F.col("pos2")) & ((F.col("overlap") == 0) | F.col("overlap").isin(1, 2) & short)
    return ruled.withColumn("together", stands)


def conflicts(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """sent_id, n1, n2: nodes of one chunk that exclude each other, in both orders."""
    both = F.explode(F.array(F.struct(F.col("node_id").alias("n1"), F.col("node_id2").alias("n2")), F.struct(F.col("node_id2").alias("n1"), F.col("node_id").alias("n2"))))
    return spans(nodes, rules).where("not together").select("sent_id", both.alias("p")).select("sent_id", "p.n1", "p.n2")


def simple_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of one chunk where the first word ends before the second starts."""
    return pairs(nodes, "chunk_id = chunk_id2 and pos + length(surface) - 1 < pos2").select("sent_id", F.col("node_id").alias("n1"), F.col("node_id2").alias("n2"))


def touching_pairs(nodes: DataFrame) -> DataFrame:
    """The older rule: what a word of a chunk rules out, among earlier and among later words."""
    gone = "(pos2 < pos and pos2 + length(surface2) - 1 > pos) or (pos2 > pos and pos2 < pos + length(surface) - 1)"
    return pairs(nodes, f"chunk_id = chunk_id2 and ({gone})").select("sent_id", F.col("node_id").alias("n1"), F.col("node_id2").alias("n2"))


def compatible(nodes: DataFrame, conflict: DataFrame) -> DataFrame:
    """sent_id, n1, n2: all ordered pairs of a sentence that don't exclude each other."""
    every = pairs(nodes.select("sent_id", "node_id"), "node_id <> node_id2").select("sent_id", F.col("node_id").alias("n1"), F.col("node_id2").alias("n2"))
    return every.join(conflict, ["sent_id", "n1", "n2"], "left_anti")


def certain(nodes: DataFrame, conflict: DataFrame) -> DataFrame:
    """Nodes that nothing excludes: the first query nodes."""
    return nodes.join(conflict.select("sent_id", F.col("n1").alias("node_id")), ["sent_id", "node_id"], "left_anti")


def forced(nodes: DataFrame, conflict: DataFrame) -> DataFrame:
    """For sentences without certain nodes: the longest word, of these the one with fewest partners, then the lowest id."""
    left = nodes.join(certain(nodes, conflict).select("sent_id"), "sent_id", "left_anti")
    partners = conflict.groupBy("sent_id", F.col("n1").alias("node_id")).agg(F.count("*").alias("against"))
    ranked = left.join(partners, ["sent_id", "node_id"]).withColumn("size", F.length("surface"))
    # All nodes of a sentence have the same number of others, so fewest partners means most conflicts.
    order = Window.partitionBy("sent_id").orderBy(F.desc("size"), F.desc("against"), "node_id")
    return ranked.withColumn("place", F.row_number().over(order)).where("place = 1").select("sent_id", "node_id", "surface", "against")


def queries(nodes: DataFrame, conflict: DataFrame) -> DataFrame:
    """sent_id, node_id of the nodes that a sentence starts from."""
    return certain(nodes, conflict).select("sent_id", "node_id").unionByName(forced(nodes, conflict).select("sent_id", "node_id"))


def single(nodes: DataFrame) -> DataFrame:
    """Chunks with one candidate only, the older rule for query nodes."""
    return nodes.groupBy("sent_id", "chunk_id").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1").select("sent_id", "chunk_id", "node_id")


def deactivated(conflict: DataFrame, winners: DataFrame, query: DataFrame) -> DataFrame:
    """Nodes that a winner rules out and that aren't query nodes."""
    hit = conflict.join(winners.select("sent_id", F.col("node_id").alias("n1")), ["sent_id", "n1"]).select("sent_id", F.col("n2").alias("node_id")).distinct()
    return hit.join(query.select("sent_id", "node_id"), ["sent_id", "node_id"], "left_anti")


def promoted(nodes: DataFrame, conflict: DataFrame, winners: DataFrame, query: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes of the winner's chunk that are left and that nothing that is left excludes."""
    keys = ["sent_id", "node_id"]
    taken = query.select(keys).unionByName(winners.select(keys)).unionByName(gone.select(keys)).distinct()
    chunk = nodes.join(winners.select(keys), keys).select("sent_id", "chunk_id").distinct()
    left = nodes.join(chunk, ["sent_id", "chunk_id"], "left_semi").join(taken, keys, "left_anti").select(keys)
    against = conflict.join(left.withColumnRenamed("node_id", "n2"), ["sent_id", "n2"]).select("sent_id", F.col("n1").alias("node_id"))
    return left.join(against, keys, "left_anti")
