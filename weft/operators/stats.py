"""Co-occurrence counts, their margins, smoothed transition probabilities and the edges of a sentence's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.session import checkpointed


def cooccurrences(nodes: DataFrame, key: str, same: str | None = None, left: str = "true") -> DataFrame:
    """a, b, n: how often two places of a sentence hold a and b; same: only where this column agrees too."""
    first = nodes.where(left).select("sent_id", F.col("node_id").alias("i"), F.col(key).alias("a"), *([F.col(same).alias("s")] if same else []))
    second = nodes.select("sent_id", F.col("node_id").alias("j"), F.col(key).alias("b"), *([F.col(same).alias("s")] if same else []))
    return first.join(second, ["sent_id", *(["s"] if same else [])]).where("i <> j").groupBy("a", "b").agg(F.count("*").alias("n"))


def verb_classes(nodes: DataFrame) -> DataFrame:
    """verb, cng, n: classes beside each verb."""
    verbs = nodes.where("is_verb").select("sent_id", F.col("node_id").alias("i"), F.col("lemma").alias("verb"))
    return verbs.join(nodes.select("sent_id", F.col("node_id").alias("j"), "cng"), "sent_id").where("i <> j").groupBy("verb", "cng").agg(F.count("*").alias("n"))


def added(base: DataFrame, more: DataFrame) -> DataFrame:
    """Counts with further counts added."""
    return base.unionByName(more).groupBy("a", "b").agg(F.sum("n").alias("n"))


def margins(counts: DataFrame) -> DataFrame:
    """a, partners, total of each key."""
    return counts.groupBy("a").agg(F.count("*").alias("partners"), F.sum("n").alias("total"))


def contexts(counts: DataFrame, halve: bool = False) -> DataFrame:
    """One row: the number of distinct pairs; halved and cut to an integer where pairs count once."""
    n = F.count("*")
    return counts.agg((F.floor(n / 2) if halve else n).cast("bigint").alias("contexts"))


#: Counts of pairs up to this number are sent to all executors; more of them are joined by a shuffle.
BROADCAST_COUNTS = 500_000


def sized(counts: DataFrame) -> tuple:
    """counts, computed once, and how to join with them: by broadcast only if they are few."""
    checkpointed(counts.sparkSession)
    counts = counts.checkpoint()
    return counts, F.broadcast if counts.count() <= BROADCAST_COUNTS else lambda df: df


def smoothed(pairs: DataFrame, counts: DataFrame, halve: bool = False, unseen: float | None = None) -> DataFrame:
    """pairs (a, b) with p: absolute discounting by 0.5, what is left goes to b by its distinct partners.

    unseen: the probability where a or b was never counted; None leaves it at the formula's value with zero counts.
    """
    counts, sent = sized(counts)
    m = margins(counts)
    total = contexts(counts, halve)
    first = m.select("a", F.col("partners").alias("pa"), F.col("total").alias("ta"))
    second = m.select(F.col("a").alias("b"), F.col("partners").alias("pb"))
    out = pairs.join(sent(counts), ["a", "b"], "left").join(sent(first), "a", "left").join(sent(second), "b", "left").join(F.broadcast(total))
    return with_probability(out, unseen)


def mass(counts: DataFrame) -> DataFrame:
    """a, mass: the smoothed probabilities of all keys after a, added up without making the pairs."""
    m = margins(counts)
    whole = m.agg(F.sum(F.greatest("partners", F.lit(1))).alias("all"))
    seen = counts.groupBy("a").agg(F.sum(F.greatest(F.col("n") - F.lit(0.5), F.lit(0.0))).alias("seen"))
    rows = m.join(seen, "a").join(F.broadcast(whole)).join(F.broadcast(contexts(counts)))
    rest = F.lit(0.5) * F.greatest(F.col("partners"), F.lit(1)) / (F.col("total") + 1.0)
    return rows.select("a", (F.col("seen") / (F.col("total") + 1.0) + rest * F.col("all") / F.col("contexts")).alias("mass"))


def joint_mass(counts: DataFrame) -> DataFrame:
    """One row, mass: the joint form of the smoothed probabilities over all pairs of keys; what the discount takes from
    seen pairs goes to all by the product of their shares of contexts, so the pairs needn't be made."""
    one = counts.agg(F.sum("n").cast("double").alias("n"), F.count("*").cast("double").alias("contexts"), F.sum(F.col("n") - F.lit(0.5)).alias("seen"))
    shares = margins(counts).agg(F.sum("partners").cast("double").alias("partners"))
    ratio = F.col("partners") / F.col("contexts")
    return one.join(F.broadcast(shares)).select((F.col("seen") / F.col("n") + F.lit(0.5) * F.col("contexts") / F.col("n") * ratio * ratio).alias("mass"))


def with_probability(joined: DataFrame, unseen: float | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    half = F.lit(0.5)
    rest = half * F.greatest(zero("pa"), F.lit(1.0)) / (zero("ta") + 1.0)
    seen = F.greatest(zero("n") - half, F.lit(0.0)) / (zero("ta") + 1.0) + rest * zero("pb") / F.col("contexts")
    p = F.when(zero("n") > 0, seen).otherwise(rest * F.greatest(zero("pb"), F.lit(1.0)) / F.col("contexts"))
    if unseen is not None:
        p = F.when(F.col("pa").isNull() | F.col("pb").isNull(), F.lit(unseen)).otherwise(p)
    return joined.withColumn("p", p).drop("pa", "ta", "pb", "contexts")


def node_pairs(nodes: DataFrame, key: str) -> DataFrame:
    """Ordered pairs of a sentence's nodes in different sets, with their keys as a and b."""
    first = nodes.select("sent_id", F.col("node_id").alias("src"), F.col("set_id").alias("s1"), F.col(key).alias("a"))
    second = nodes.select("sent_id", F.col("node_id").alias("dst"), F.col("set_id").alias("s2"), F.col(key).alias("b"))
    return first.join(second, "sent_id").where("s1 <> s2").select("sent_id", "src", "dst", "a", "b")


def normalised(edges: DataFrame) -> DataFrame:
    """Rows that sum to one; rows of zeros stay away."""
    row = Window.partitionBy("sent_id", "src")
    return edges.withColumn("sum", F.sum("p").over(row)).where("sum > 0").select("sent_id", "src", "dst", (F.col("p") / F.col("sum")).alias("p"))


def vector_edges(nodes: DataFrame, similar: DataFrame, discount: float = 0.1) -> DataFrame:
    """sent_id, src, dst, p between all nodes of a sentence, from similarities (a, b, s) of their lemmas.

    p is the sigmoid of s, 0 where a lemma has no vector. A row with zeros gives a discount of each other entry to them;
    a row of zeros alone is even.
    """
    first = nodes.select("sent_id", F.col("node_id").alias("src"), F.col("lemma").alias("a"))
    second = nodes.select("sent_id", F.col("node_id").alias("dst"), F.col("lemma").alias("b"))
    rows = first.join(second, "sent_id").where("src <> dst").join(similar, ["a", "b"], "left")
    rows = rows.withColumn("v", F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("s"))), F.lit(0.0)))
    row = Window.partitionBy("sent_id", "src")
    rows = rows.withColumns({"sum": F.sum("v").over(row), "full": F.sum((F.col("v") > 0).cast("int")).over(row), "all": F.count("*").over(row)})
    less = F.greatest(F.col("v") - F.lit(discount), F.lit(0.0)) / F.col("sum")
    filler = F.lit(discount) * F.col("full") / (F.col("sum") * (F.col("all") - F.col("full")))
    p = F.when(F.col("sum") == 0, F.lit(1.0) / F.col("all")).when(F.col("full") == F.col("all"), F.col("v") / F.col("sum")).when(less == 0, filler).otherwise(less)
    return rows.select("sent_id", "src", "dst", p.alias("p"))


def edges_smoothed(nodes: DataFrame, key: str, counts: DataFrame, conflict: DataFrame, halve: bool = False, unseen: float | None = None) -> DataFrame:
    """sent_id, src, dst, p: smoothed transition probabilities between nodes that don't exclude each other."""
    open_pairs = node_pairs(nodes, key).join(conflict.select("sent_id", F.col("n1").alias("src"), F.col("n2").alias("dst")), ["sent_id", "src", "dst"], "left_anti")
    return normalised(smoothed(open_pairs, counts, halve, unseen).select("sent_id", "src", "dst", "p"))


def edges_raw(nodes: DataFrame, key: str, counts: DataFrame, conflict: DataFrame) -> DataFrame:
    """Transition probabilities from plain counts; a node without any goes to all others of the sentence alike."""
    open_pairs = node_pairs(nodes, key).join(conflict.select("sent_id", F.col("n1").alias("src"), F.col("n2").alias("dst")), ["sent_id", "src", "dst"], "left_anti")
    counts, sent = sized(counts)
    counted = open_pairs.join(sent(counts), ["a", "b"], "left").select("sent_id", "src", "dst", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("p"))
    known = normalised(counted)
    bare = nodes.select("sent_id", F.col("node_id").alias("src")).join(known.select("sent_id", "src").distinct(), ["sent_id", "src"], "left_anti")
    size = nodes.groupBy("sent_id").agg(F.count("*").alias("n_nodes"))
    even = bare.join(nodes.select("sent_id", F.col("node_id").alias("dst")), "sent_id").where("src <> dst").join(size, "sent_id")
    return known.unionByName(even.select("sent_id", "src", "dst", (F.lit(1.0) / (F.col("n_nodes") - 1)).alias("p")))


def verb_ranking(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """sent_id, node_id, score: the largest count of a verb of the sentence with the node's class, as a share."""
    verbs = nodes.where("is_verb").select("sent_id", F.col("lemma").alias("verb")).distinct()
    other = nodes.where("not is_verb").select("sent_id", "node_id", "cng")
    most = other.join(verbs, "sent_id").join(counts, ["verb", "cng"], "left").groupBy("sent_id", "node_id").agg(F.max(F.coalesce("n", F.lit(0))).alias("most"))
    whole = F.sum("most").over(Window.partitionBy("sent_id"))
    return most.withColumn("whole", whole).where("whole > 0").select("sent_id", "node_id", (F.col("most") / F.col("whole")).alias("score"))


def class_evidence(nodes: DataFrame) -> DataFrame:
    """lemma, cls, sentences: in how many sentences a lemma stands in each class, "verbs" being all verb classes."""
    kinds = F.filter(F.array("cls", F.when(F.col("is_verb"), "verbs")), lambda c: c.isNotNull())
    return nodes.select("lemma", "sent_id", F.explode(kinds).alias("cls")).groupBy("lemma", "cls").agg(F.countDistinct("sent_id").alias("sentences"))


def rekeyed(counts: DataFrame, renamed, compat_mode: bool = False) -> DataFrame:
    """a, b, n under renamed keys: counts whose keys fall together are added. compat_mode: the last of them holds."""
    rows = counts.select(renamed(F.col("a")).alias("x"), renamed(F.col("b")).alias("y"), "a", "b", "n").groupBy(F.col("x").alias("ka"), F.col("y").alias("kb"))
    n = F.max_by("n", F.concat("a", F.lit("\x01"), "b")) if compat_mode else F.sum("n")
    return rows.agg(n.alias("n")).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "n")
