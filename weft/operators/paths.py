"""Path features of compatible pairs and the ranking by path weights.

Kinds of a node's context: 1 its lemma, 2 its class, 3 both. A feature abc of a pair (left, right) adds up, over the verbs
compatible with right, P(left as a -> verb as b) * P(verb as b -> right as c), each a share of sentences; a path with more
than one 3 isn't used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"1": "lemma", "2": "cng", "3": "both"}
PATHS = [a + b + c for a in "123" for b in "123" for c in "123" if (a + b + c).count("3") < 2]


#: Steps of paths up to this number are sent to all executors; more of them are joined by a shuffle.
BROADCAST_HOPS = 500_000


def keyed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("both", F.concat_ws("_", "lemma", "cng"))


def evidence(nodes: DataFrame) -> DataFrame:
    """kind, key, sent_id: in which sentences each lemma, class and pair of both stands."""
    rows = keyed(nodes)
    return rows.select("sent_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in KINDS.items()))).alias("e")).select("e.kind", "e.key", "sent_id").distinct()


def cardinalities(found: DataFrame) -> DataFrame:
    """kind, key, sentences."""
    return found.groupBy("kind", "key").agg(F.count("*").alias("sentences"))


def transitions(found: DataFrame) -> DataFrame:
    """k1, x, k2, y, p: the share of x's sentences that y stands in, too."""
    both = found.select(F.col("kind").alias("k1"), F.col("key").alias("x"), "sent_id").join(found.select(F.col("kind").alias("k2"), F.col("key").alias("y"), "sent_id"), "sent_id")
    counted = both.groupBy("k1", "x", "k2", "y").agg(F.count("*").alias("n"))
    one = cardinalities(found).select(F.col("kind").alias("k1"), F.col("key").alias("x"), "sentences")
    return counted.join(one, ["k1", "x"]).select("k1", "x", "k2", "y", (F.col("n") / F.col("sentences")).alias("p"))


def features(nodes: DataFrame, compatible: DataFrame, codes: list[str], compat_mode: bool = False) -> DataFrame:
    """sent_id, li, ri and one column per path code for all compatible pairs with li < ri.

    compat_mode: paths that go from a class to a lemma by a class (x21) stay 0, as where their lookup never hits.
    """
    rows = keyed(nodes)
    pairs = compatible.where("n1 < n2").select("sent_id", F.col("n1").alias("li"), F.col("n2").alias("ri"))
    verbs = rows.where("is_verb").select("sent_id", F.col("node_id").alias("m"), *(F.col(c).alias(f"m{k}") for k, c in KINDS.items()))
    beside = compatible.select("sent_id", F.col("n1").alias("ri"), F.col("n2").alias("m")).join(verbs, ["sent_id", "m"])
    left = rows.select("sent_id", F.col("node_id").alias("li"), *(F.col(c).alias(f"l{k}") for k, c in KINDS.items()))
    right = rows.select("sent_id", F.col("node_id").alias("ri"), *(F.col(c).alias(f"r{k}") for k, c in KINDS.items()))
    triples = pairs.join(beside, ["sent_id", "ri"]).where("m <> li").join(left, ["sent_id", "li"]).join(right, ["sent_id", "ri"])
    p = transitions(evidence(nodes))
    p = p.checkpoint()  # read once for every kind of step
    small = F.broadcast if p.count() <= BROADCAST_HOPS else lambda df: df
    hops = sorted({(f"l{c[0]}", f"m{c[1]}") for c in codes} | {(f"m{c[1]}", f"r{c[2]}") for c in codes})
    for a, b in hops:
        own = p.where((F.col("k1") == a[1]) & (F.col("k2") == b[1])).select(F.col("x").alias(a), F.col("y").alias(b), F.col("p").alias(f"{a}_{b}"))
        triples = triples.join(small(own), [a, b], "left")
    hop = lambda a, b: F.coalesce(F.col(f"{a}_{b}"), F.lit(0.0))

    def value(c: str):
        if compat_mode and c[1:] == "21":
            return F.lit(0.0)
        return hop(f"l{c[0]}", f"m{c[1]}") * hop(f"m{c[1]}", f"r{c[2]}")

    summed = triples.groupBy("sent_id", "li", "ri").agg(*(F.sum(value(c)).alias(f"f{c}") for c in codes))
    return pairs.join(summed, ["sent_id", "li", "ri"], "left").na.fill(0.0, [f"f{c}" for c in codes])


def noun_pairs(nodes: DataFrame, same: DataFrame, counts: DataFrame, compatible: DataFrame) -> DataFrame:
    """sent_id, li, ri, f400: for pairs without verbs, the share of their lemmas' co-occurrences that agree in class."""
    left = nodes.where("not is_verb").select("sent_id", F.col("node_id").alias("li"), F.col("lemma").alias("a"))
    right = nodes.where("not is_verb").select("sent_id", F.col("node_id").alias("ri"), F.col("lemma").alias("b"))
    pairs = compatible.where("n1 < n2").select("sent_id", F.col("n1").alias("li"), F.col("n2").alias("ri")).join(left, ["sent_id", "li"]).join(right, ["sent_id", "ri"])
    joined = pairs.join(counts, ["a", "b"], "left").join(same.select("a", "b", F.col("n").alias("s")), ["a", "b"], "left")
    return joined.select("sent_id", "li", "ri", F.when(F.col("n") > 0, F.coalesce(F.col("s"), F.lit(0)) / F.col("n")).otherwise(0.0).alias("f400"))


def class_shares(nodes: DataFrame, verb: str, cls: str, column: str = "cng") -> DataFrame:
    """a, b, f: of the sentences of lemma a with a verb but without the class cls, the share in which b has the class.

    verb is a value of cng, cls of the given column.
    """
    verbs = nodes.where(F.col("cng") == verb).select("lemma", "sent_id").distinct()
    classed = nodes.where(F.col(column) == cls).select("lemma", "sent_id").distinct()
    rest = verbs.join(classed, ["lemma", "sent_id"], "left_anti").withColumnRenamed("lemma", "a")
    size = rest.groupBy("a").agg(F.count("*").alias("whole"))
    both = rest.join(classed.withColumnRenamed("lemma", "b"), "sent_id").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.join(size, "a").select("a", "b", (F.col("n") / F.col("whole")).alias("f"))


def path_ranking(nodes: DataFrame, query: DataFrame, feature: DataFrame, weights: dict[str, float]) -> DataFrame:
    """sent_id, node_id, score: weighted sums of the features of all query nodes left of each candidate."""
    asked = query.select("sent_id", F.col("node_id").alias("li"))
    rows = feature.join(asked, ["sent_id", "li"], "left_semi")
    total = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    summed = rows.groupBy("sent_id", F.col("ri").alias("node_id")).agg(F.sum(total).alias("score"))
    open_nodes = nodes.select("sent_id", "node_id").join(query.select("sent_id", "node_id"), ["sent_id", "node_id"], "left_anti")
    return open_nodes.join(summed, ["sent_id", "node_id"], "left").na.fill(0.0, ["score"])


def class_pairs(nodes: DataFrame, compatible: DataFrame, verb: str, classes: dict[str, str]) -> DataFrame:
    """sent_id, li, ri and one column per code of classes (code: value of the column cls): where li is a verb not of the
    class and ri is of it, class_shares() of their lemmas, else 0."""
    left = nodes.select("sent_id", F.col("node_id").alias("li"), F.col("lemma").alias("a"), "is_verb", F.col("cls").alias("lc"))
    right = nodes.select("sent_id", F.col("node_id").alias("ri"), F.col("lemma").alias("b"), F.col("cls").alias("rc"))
    rows = compatible.where("n1 < n2").select("sent_id", F.col("n1").alias("li"), F.col("n2").alias("ri")).join(left, ["sent_id", "li"]).join(right, ["sent_id", "ri"])
    shares = None
    for code, cls in classes.items():
        own = class_shares(nodes, verb, cls, "cls").select("a", "b", F.lit(cls).alias("rc"), "f")
        shares = own if shares is None else shares.unionByName(own)
    rows = rows.join(shares, ["a", "b", "rc"], "left")
    value = lambda cls: F.when(F.col("is_verb") & (F.col("rc") == cls) & ~F.col("lc").eqNullSafe(F.lit(cls)), F.coalesce("f", F.lit(0.0))).otherwise(0.0)
    return rows.select("sent_id", "li", "ri", *(value(cls).alias(f"f{code}") for code, cls in classes.items()))


def compounds(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pairs (a, b) with f999: the share of a's compounds that go on with b."""
    whole = counts.groupBy("a").agg(F.sum("n").alias("whole"))
    return pairs.join(counts, ["a", "b"], "left").join(whole, "a", "left").withColumn("f999", F.coalesce(F.col("n") / F.col("whole"), F.lit(0.0))).drop("n", "whole")


def live_columns(feature: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, live: a column whose minimum and maximum are both 0 says nothing; one pass over the rows."""
    ends = feature.agg(*(F.min(c).alias(f"{c}_low") for c in columns), *(F.max(c).alias(f"{c}_high") for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high")) for c in columns)))
    return ends.select(rows.alias("r")).select("r.*").withColumn("live", ~((F.col("low") == 0) & (F.col("high") == 0)))
