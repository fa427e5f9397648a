"""The path model as queries: its whole feature table, the ranking by its live columns, and the greedy loop by paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import block_paths, lattice, learn, paths, stats, walk
from weft.plans import surrogate as s
from weft.plans.catalog import CODES, FEATURE, UNSEEN, answer, base, cut, kn_sql, query, rounded

#: Classes of the surrogate candidates by feature code.
CLASSES = {"500": "ger", "600": "absol", "700": "ppp", "800": "inf", "900": "ppa"}
#: The columns that the ranking uses, and their weights.
LIVE = "111 112 113 122 123 131 132 211 212 213 222 223 231 232 311 312 322 400 500 600 700 800 011 022 033".split()
VALUES = [
    -2.30184849, 0.15205544, 11.37284794, 2.22866016, 2.5926891, 27.34128227, -2.72856657, -15.95316347, -4.30608648,
    9.95769945, -3.72684989, 5.79208033, 2.16235142, 13.69485912, 6.77834282, 0.43567416, 1.20300337, 2.95172869,
    0.24279471, 0.30121553, 1.29004227, 0.27179539, 30.28146594, -0.21266843, 9.93318708,
]
WEIGHTS = {f"f{c}": w for c, w in zip(LIVE, VALUES, strict=True)}
#: What typed() makes of a class and of a set's number being odd.
KINDS = {("AF", False): "ger", ("AF", True): "ger", ("NF", True): "ppa", ("NF", False): "absol", ("NO", True): "inf", ("NO", False): "ppp"}
COLUMNS = [f"f{c}" for c in [*CODES, "400", *CLASSES, "011", "022", "033"]]


def typed(nodes: DataFrame) -> DataFrame:
    """nodes with cls, what stands for the participle classes of verbs here."""
    odd = F.col("set_id") % 2 == 1
    cng = F.col("cng")
    return nodes.withColumn("cls", F.when(cng == "AF", "ger").when((cng == "NF") & odd, "ppa").when(cng == "NF", "absol").when((cng == "NO") & odd, "inf").when(cng == "NO", "ppp"))


TYPED = "typed AS (SELECT *, CASE WHEN cng = 'AF' THEN 'ger' WHEN cng = 'NF' AND set_id % 2 = 1 THEN 'ppa' WHEN cng = 'NF' THEN 'absol' WHEN cng = 'NO' AND set_id % 2 = 1 THEN 'inf' WHEN cng = 'NO' THEN 'ppp' END AS cls FROM nodes),\nvs AS (SELECT DISTINCT lemma, sent_id FROM nodes WHERE is_verb),\n"
ENDS = "compat p JOIN typed l ON l.sent_id = p.sent_id AND l.node_id = p.n1 JOIN typed r ON r.sent_id = p.sent_id AND r.node_id = p.n2"


def table_sql() -> str:
    out = FEATURE + TYPED
    for cls in CLASSES.values():
        out += f"cl_{cls} AS (SELECT DISTINCT lemma, sent_id FROM typed WHERE cls = '{cls}'), rest_{cls} AS (SELECT * FROM vs EXCEPT SELECT * FROM cl_{cls}),\n"
        out += f"sh_{cls} AS (SELECT v.lemma AS a, c.lemma AS b, count(*)::DOUBLE / any_value(w.n) AS f FROM rest_{cls} v JOIN cl_{cls} c ON c.sent_id = v.sent_id JOIN (SELECT lemma, count(*) AS n FROM rest_{cls} GROUP BY lemma) w ON w.lemma = v.lemma GROUP BY v.lemma, c.lemma),\n"
    words = f"(SELECT DISTINCT l.lemma AS a, r.lemma AS b FROM {ENDS})"
    kinds = f"(SELECT DISTINCT l.cng AS a, r.cng AS b FROM {ENDS})"
    out += kn_sql("k11", "cooc", pairs=words) + kn_sql("k22", "cngcooc", unseen="1.0::DOUBLE / 440000", pairs=kinds) + kn_sql("k33", "samecooc", halve=True, pairs=words)
    classes = ", ".join(f"CASE WHEN l.is_verb AND r.cls = '{c}' AND l.cls IS DISTINCT FROM '{c}' THEN coalesce(x{k}.f, 0) ELSE 0 END AS f{k}" for k, c in CLASSES.items())
    joins = " ".join(f"LEFT JOIN sh_{c} x{k} ON x{k}.a = l.lemma AND x{k}.b = r.lemma" for k, c in CLASSES.items())
    known = "(SELECT DISTINCT sent_id, lemma FROM gold)"
    out += f"""whole AS MATERIALIZED (SELECT f.*, CASE WHEN NOT l.is_verb AND NOT r.is_verb AND n.n > 0 THEN coalesce(e.n, 0)::DOUBLE / n.n ELSE 0 END AS f400,
  {classes}, k11.p AS f011, k22.p AS f022, CASE WHEN l.cng = r.cng THEN k33.p ELSE 0 END AS f033,
  CASE WHEN g1.lemma IS NOT NULL AND g2.lemma IS NOT NULL THEN 1 ELSE 0 END AS flag
  FROM feature f JOIN typed l ON l.sent_id = f.sent_id AND l.node_id = f.li JOIN typed r ON r.sent_id = f.sent_id AND r.node_id = f.ri
  LEFT JOIN cooc n ON n.a = l.lemma AND n.b = r.lemma LEFT JOIN samecooc e ON e.a = l.lemma AND e.b = r.lemma {joins}
  JOIN k11 ON k11.a = l.lemma AND k11.b = r.lemma JOIN k22 ON k22.a = l.cng AND k22.b = r.cng JOIN k33 ON k33.a = l.lemma AND k33.b = r.lemma
  LEFT JOIN {known} g1 ON g1.sent_id = f.sent_id AND g1.lemma = l.lemma LEFT JOIN {known} g2 ON g2.sent_id = f.sent_id AND g2.lemma = r.lemma),
"""
    return out


WHOLE = table_sql()


def fitted(spark: SparkSession, sf: str) -> tuple:
    """The sentences in blocks and the model's tables; None, None where blocks can't hold them."""
    found = s.sentences(spark, sf)
    return (found, block_paths.fit(found, s.VERB, KINDS, CLASSES, UNSEEN)) if found else (None, None)


def table(spark: SparkSession, sf: str) -> DataFrame:
    """sent_id, li, ri, all columns and flag of all compatible pairs."""
    found, model = fitted(spark, sf)
    return block_paths.feature_rows(found, model, CODES, COLUMNS) if found else feature_table(spark, sf)[3]


def feature_table(spark: SparkSession, sf: str) -> tuple:
    """nodes, conflict, query nodes, and the feature table of all compatible pairs, by joins."""
    nodes, conflict, q = base(spark, sf)
    nodes = typed(nodes)
    (compatible,) = cut(spark, lattice.compatible(nodes, conflict))
    words, same, kinds = cut(spark, *(stats.cooccurrences(nodes, *k) for k in (("lemma",), ("lemma", "cng"), ("cng",))))
    left = nodes.select("sent_id", F.col("node_id").alias("li"), F.col("lemma").alias("la"), F.col("cng").alias("lc"))
    right = nodes.select("sent_id", F.col("node_id").alias("ri"), F.col("lemma").alias("ra"), F.col("cng").alias("rc"))
    key = ["sent_id", "li", "ri"]
    rows = paths.features(nodes, compatible, CODES).join(paths.noun_pairs(nodes, same, words, compatible), key, "left").na.fill(0.0, ["f400"])
    rows = rows.join(paths.class_pairs(nodes, compatible, s.VERB, CLASSES), key).join(left, ["sent_id", "li"]).join(right, ["sent_id", "ri"])
    for name, a, b, counts, halve, unseen in (("f011", "la", "ra", words, False, None), ("f022", "lc", "rc", kinds, False, UNSEEN), ("f033", "la", "ra", same, True, None)):
        pairs = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
        p = stats.smoothed(pairs, counts, halve, unseen).select(F.col("a").alias(a), F.col("b").alias(b), F.col("p").alias(name))
        rows = rows.join(p, [a, b])
    rows = rows.withColumn("f033", F.when(F.col("lc") == F.col("rc"), F.col("f033")).otherwise(0.0))
    known = s.gold(spark, sf).select("sent_id", "lemma").distinct()
    for side in ("la", "ra"):
        rows = rows.join(known.select("sent_id", F.col("lemma").alias(side), F.lit(1).alias(f"g{side}")), ["sent_id", side], "left")
    flag = F.when(F.col("gla").isNotNull() & F.col("gra").isNotNull(), 1).otherwise(0).alias("flag")
    return nodes, conflict, q, *cut(spark, rows.select(*key, *COLUMNS, flag))


@query("path_feature_table", answer(f"SELECT sent_id, li, ri, {', '.join(f'round({c}, 8) AS {c}' for c in COLUMNS)}, flag FROM whole"), WHOLE)
def path_feature_table(spark, sf):
    return rounded(table(spark, sf), *COLUMNS, digits=8)


TOTAL = " + ".join(f"{w}::DOUBLE * {c}" for c, w in WEIGHTS.items())


@query("pcrw_rank", answer(f"SELECT n.sent_id, n.node_id, round(coalesce(sum({TOTAL}), 0), 6) AS score FROM nodes n LEFT JOIN (SELECT w.* FROM whole w JOIN query q ON q.sent_id = w.sent_id AND q.node_id = w.li) f ON f.sent_id = n.sent_id AND f.ri = n.node_id WHERE NOT EXISTS (SELECT 1 FROM query q WHERE q.sent_id = n.sent_id AND q.node_id = n.node_id) GROUP BY n.sent_id, n.node_id"), WHOLE)
def pcrw_rank(spark, sf):
    found, model = fitted(spark, sf)
    if found:
        return rounded(block_paths.ranking(found, model, CODES, WEIGHTS), "score", digits=6)
    nodes, _, q, feature = feature_table(spark, sf)
    return rounded(paths.path_ranking(nodes, q, feature, WEIGHTS), "score", digits=6)


@query("constant_columns", answer(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(min({c}), 8) AS low, round(max({c}), 8) AS high, NOT (min({c}) = 0 AND max({c}) = 0) AS live FROM whole" for c in COLUMNS)), WHOLE)
def constant_columns(spark, sf):
    return rounded(paths.live_columns(table(spark, sf), COLUMNS), "low", "high", digits=8)


@query("logreg_weights")
def logreg_weights(spark, sf):
    found, model = fitted(spark, sf)
    if found:
        return block_paths.logistic_weights(found, model, CODES, COLUMNS)
    rows = feature_table(spark, sf)[3]
    return learn.logistic_weights(learn.folds(rows, 4, ["sent_id", "li", "ri"]), COLUMNS, "flag")


@query("fold_weights")
def fold_weights(spark, sf):
    return learn.averaged(logreg_weights(spark, sf))


@query("greedy_path")
def greedy_path(spark, sf):
    found, model = fitted(spark, sf)
    if found:
        return block_paths.greedy(found, model, CODES, WEIGHTS)
    nodes, conflict, q, feature = feature_table(spark, sf)
    total = sum((F.lit(float(w)) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return walk.predict(nodes, conflict, q, [feature.select("sent_id", F.col("li").alias("src"), F.col("ri").alias("dst"), total.alias("p"))], [1.0], by="path")
