"""Further operators as queries, with SQL: scans and sinks, filters, words, matrices and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import morph, text
from weft.operators import metrics, quality, stats
from weft.plans import surrogate as s
from weft.plans.catalog import FORMS, LISTS, NOUN_SQL, OPEN, RESULTS, answer, cng_cooc, cooc_counts, cooc_samecng, cut, kn_sql, listing, query, relations, replaces, rounded
from weft.plans.path_model import TYPED, typed
from weft.plans.session import checkpointed
from weft.sources import readers


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that is written and read again."""
    checkpointed(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"


# ---- scans and sinks, each written and read again


@query("csv_columns", "SELECT n_name, n_regionkey FROM nation")
def csv_columns(spark, sf):
    path = scratch(spark, "csv")
    readers.write_csv(s.read(spark, sf, "nation"), path)
    return readers.csv_columns(spark, path, ["n_name", "n_regionkey"]).withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@query("csv_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_rows(spark, sf):
    path = scratch(spark, "csv")
    lines = s.read(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", F.concat(F.col("n_regionkey").cast("string"), F.lit("\r"))).alias("value"))
    lines.write.text(path)
    return readers.csv_rows(spark, path, "n_nationkey int, n_name string, n_regionkey string").withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@query("sharded_result", answer("SELECT sent_id, node_id, lemma FROM nodes"))
def sharded_result(spark, sf):
    path = scratch(spark, "shards")
    readers.write_sharded(s.nodes(spark, sf).select("sent_id", "node_id", "lemma"), path, 10_000)
    return spark.read.parquet(path)


@query("trace_sink", "SELECT o_orderkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def trace_sink(spark, sf):
    path = scratch(spark, "trace")
    rows = s.read(spark, sf, "orders").groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"))
    readers.write_trace(rows.select("o_orderkey", F.struct("o_orderstatus", "n").alias("run")), path)
    return spark.read.schema("o_orderkey bigint, run struct<o_orderstatus:string,n:bigint>").json(path).select("o_orderkey", "run.*")


RULE_LINES = "r AS (SELECT DISTINCT left(p_name, 2) AS l, right(p_type, 1) AS r, split_part(p_name, ' ', 1) AS d FROM part)"


@query("rule_table", f"WITH {RULE_LINES} SELECT l AS \"left\", r AS \"right\", CAST(min(length(d)) AS INTEGER) AS length FROM r GROUP BY l, r HAVING min(length(d)) = max(length(d))")
def rule_table(spark, sf):
    p = s.read(spark, sf, "part").select(F.expr("left(p_name, 2)").alias("l"), F.expr("right(p_type, 1)").alias("r"), F.substring_index("p_name", " ", 1).alias("d")).distinct()
    lines = p.select(F.concat_ws(", ", F.lit("7"), "l", "r", "d", F.lit("end")).alias("value"))
    return readers.rule_lengths(readers.rule_lines(lines))


@query("finished_log", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
def finished_log(spark, sf):
    place, end = F.when(F.col("o_orderkey") % 3 == 0, "out/a").otherwise("out/b"), F.when(F.col("o_orderstatus") == "F", "Process Finished").otherwise("Process started")
    lines = s.read(spark, sf, "orders").select(F.concat_ws(" ", place, end, F.col("o_orderkey").cast("string")).alias("value"))
    return readers.finished(lines, "out/a").select(F.substring_index("value", " ", -1).cast("bigint").alias("o_orderkey"))


@query("sorted_listing", "WITH " + LISTS + answer("SELECT file FROM a ORDER BY file"))
def sorted_listing(spark, sf):
    return listing(spark, sf, "o_orderkey % 2 = 0", "").select("file").orderBy("file")


@query("rows_of_files", answer("SELECT sent_id, node_id FROM nodes WHERE sent_id % 4 = 1"))
def rows_of_files(spark, sf):
    rows = s.nodes(spark, sf).select("sent_id", "node_id", F.concat(F.col("sent_id").cast("string"), F.lit(".p2")).alias("f"))
    wanted = s.read(spark, sf, "orders").where("o_orderkey % 4 = 1").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".p2")).alias("f"))
    return rows.join(wanted, "f", "left_semi").select("sent_id", "node_id")


# ---- filters


@query("good_manifest", answer("SELECT DISTINCT sent_id FROM nodes WHERE sent_id NOT IN (SELECT sent_id FROM nodes WHERE length(lemma) > 0 AND pos % 7 = 0)"))
def good_manifest(spark, sf):
    nodes = s.nodes(spark, sf)
    bad = quality.bad_sentences(nodes.select("sent_id", F.length("lemma").alias("n_lemmas"), (F.col("pos") % 7).alias("n_forms")))
    return quality.undone(nodes, bad, "sent_id")


@query("keys_as_integers", "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, n FROM (SELECT CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 50 END AS a, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 9 END AS b, count(*) AS n FROM lineitem GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL")
def keys_as_integers(spark, sf):
    a = F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") % 50).cast("double"))
    b = F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 9).cast("double")).otherwise(float("nan"))
    return quality.whole_keys(s.read(spark, sf, "lineitem").groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")), ["a", "b"])


@query("flag_filters", answer("SELECT sent_id, n_missing, CASE WHEN n_missing = '0' THEN 'Good' WHEN n_missing = 'Incomplete chunk' THEN 'Length Mismatch' ELSE 'Bad' END AS status FROM audit WHERE n_missing <> 'Incomplete chunk'"), """lost AS (SELECT g.sent_id, count(*) AS n FROM (SELECT DISTINCT sent_id, chunk_id, lemma FROM guess) g WHERE NOT EXISTS (SELECT 1 FROM gold n WHERE n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND n.lemma = g.lemma) GROUP BY g.sent_id),
sizes AS (SELECT sent_id, count(*) AS n, max(chunk_id) AS last FROM guess GROUP BY sent_id), limits AS (SELECT sent_id, count(DISTINCT chunk_id) AS n FROM nodes WHERE pos % 4 < 2 GROUP BY sent_id),
audit AS (SELECT s.sent_id, CASE WHEN coalesce(m.n, 0) < s.n THEN 'Incomplete chunk' ELSE CAST(coalesce(l.n, 0) AS VARCHAR) END AS n_missing FROM sizes s LEFT JOIN lost l ON l.sent_id = s.sent_id LEFT JOIN limits m ON m.sent_id = s.sent_id),
""")
def flag_filters(spark, sf):
    found = quality.missing_report(s.gold(spark, sf), s.predicted(spark, sf), s.nodes(spark, sf).where("pos % 4 < 2"))
    status = F.when(F.col("n_missing") == "0", "Good").when(F.col("n_missing") == quality.INCOMPLETE, "Length Mismatch").otherwise("Bad")
    return found.withColumn("status", status).where(F.col("status") != "Length Mismatch")


@query("stop_lemmas", answer("SELECT sent_id, node_id, lemma FROM nodes WHERE lemma <> 'Brand#11' AND lemma <> 'Brand#23'"))
def stop_lemmas(spark, sf):
    return quality.without_lemmas(s.nodes(spark, sf).select("sent_id", "node_id", "lemma"), ["Brand#11", "Brand#23"])


@query("live_rows", "SELECT l_orderkey, l_discount, l_tax, count(*) AS n FROM lineitem WHERE (l_discount <> 0 OR l_tax <> 0) AND l_discount <= 0.08 AND l_tax <= 0.06 GROUP BY ALL")
def live_rows(spark, sf):
    rows = quality.live_rows(s.read(spark, sf, "lineitem"), ["l_discount", "l_tax"])
    return quality.in_ranges(rows, {"l_discount": (None, 0.08), "l_tax": (None, 0.06)}).groupBy("l_orderkey", "l_discount", "l_tax").agg(F.count("*").alias("n"))


CNG = {"AF": -200, "NF": -230, "NO": 30, "RF": -190}
SPLIT = "SELECT lemma, sum(CASE WHEN c > 3 THEN 1 ELSE 0 END) AS nouns, sum(CASE WHEN c < 0 THEN 1 ELSE 0 END) AS verbs, sum(CASE WHEN c = -210 THEN 1 ELSE 0 END) AS gerund, sum(CASE WHEN c = -190 THEN 1 ELSE 0 END) AS ppp, sum(CASE WHEN c = -200 THEN 1 ELSE 0 END) AS ppa, sum(CASE WHEN c = -220 THEN 1 ELSE 0 END) AS inf, sum(CASE WHEN c = -230 THEN 1 ELSE 0 END) AS absol, sum(CASE WHEN c IN (-190, -200) THEN 1 ELSE 0 END) AS ppp_compat FROM (SELECT lemma, CASE cng " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in CNG.items()) + " END - CASE WHEN set_id % 4 = 1 AND cng <> 'NO' THEN 10 ELSE 0 END AS c FROM nodes) GROUP BY lemma"


@query("class_split", answer("SELECT lemma, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("nouns", "verbs", "gerund", "ppp", "ppa", "inf", "absol", "ppp_compat")) + f" FROM ({SPLIT})"))
def class_split(spark, sf):
    base = F.create_map(*(F.lit(x) for pair in CNG.items() for x in pair))[F.col("cng")]
    rows = s.nodes(spark, sf).withColumn("c", base - F.when((F.col("set_id") % 4 == 1) & (F.col("cng") != "NO"), 10).otherwise(0))
    kinds, compat = quality.class_flags(F.col("c")), quality.class_flags(F.col("c"), compat_mode=True)
    return rows.groupBy("lemma").agg(*(F.sum(v.cast("bigint")).alias(k) for k, v in kinds.items()), F.sum(compat["ppp"].cast("bigint")).alias("ppp_compat"))


@query("single_lemma_chunks", answer("SELECT sent_id, chunk_id FROM nodes GROUP BY ALL HAVING count(CASE WHEN lemma <> '' THEN 1 END) = 1"))
def single_lemma_chunks(spark, sf):
    return quality.single_lemma(s.nodes(spark, sf))


@query("suspicious", answer("SELECT sent_id, in_gold, predicted FROM (SELECT sent_id, matched, in_gold, predicted + sent_id % 2 AS predicted FROM results) WHERE matched = in_gold AND predicted <> in_gold"), RESULTS)
def suspicious(spark, sf):
    found = metrics.results(s.predicted(spark, sf), s.gold(spark, sf), s.nodes(spark, sf)).withColumn("predicted", F.col("predicted") + F.col("sent_id") % 2)
    return metrics.suspicious(found).select("sent_id", "in_gold", "predicted")


@query("marker_parts", answer("SELECT sent_id, node_id, part FROM (SELECT sent_id, node_id, pos, CAST(sum(CASE WHEN pos % 18 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY node_id) AS BIGINT) AS part FROM nodes) WHERE pos % 18 <> 0"))
def marker_parts(spark, sf):
    rows = s.nodes(spark, sf).select("sent_id", "node_id", F.when(F.col("pos") % 18 != 0, F.col("pos")).alias("value"))
    return quality.parts_between(rows, "value", ["sent_id"], ["node_id"]).select("sent_id", "node_id", "part")


# ---- words


@query("class_sets", f"WITH t AS (SELECT row_number() OVER (ORDER BY cng, config) AS at, config, cng FROM ({NOUN_SQL})), x AS (SELECT a.config, list_sort(list_distinct([a.cng, b.cng, 3])) AS c FROM t a JOIN t b ON b.config = a.config) SELECT config, array_to_string(c, ',') AS classes, CAST(a.cng AS INTEGER) AS first FROM x JOIN t a USING (config)")
def class_sets(spark, sf):
    rows = spark.createDataFrame([(c,) for _, c in FORMS], "config string")
    forms = F.create_map(F.lit("noun"), F.array("config", "config"), F.lit("compound"), F.array(F.lit("iic.")), F.lit("verbform"), F.array(F.lit("pp.")))
    return rows.select("config", F.array_join(F.sort_array(morph.class_set(forms)), ",").alias("classes"), morph.first_class(F.lit("noun"), F.array("config", F.lit("iic."))).alias("first"))


@query("solutions", answer("SELECT sent_id, lemma FROM gold UNION ALL SELECT sent_id, CASE WHEN starts_with(lemma, 'Brand#') THEN split_part(lemma, 'Brand#', 2) ELSE lemma END FROM gold"))
def solutions(spark, sf):
    return quality.solutions(s.gold(spark, sf), lambda c: text.without_prefix(c, ["Brand#"]))


@query("scaled", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 9) AS scaled, round(p_size::DOUBLE / (SELECT sum(p_size) FROM part), 12) AS share FROM part")
def scaled(spark, sf):
    rows = metrics.scaled(s.read(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")
    return rows.select("p_partkey", F.round("scaled", 9).alias("scaled"), F.round("share", 12).alias("share"))


NAMES = "names AS (SELECT sent_id, chunk_id, string_agg(surface, '' ORDER BY node_id) AS name FROM nodes GROUP BY ALL), places AS (SELECT sent_id, chunk_id, lemma, min(pos) AS pos FROM nodes GROUP BY ALL),\n"
SLICE = "CASE WHEN sent_id % 4 = 0 THEN substr(name, p + 1) WHEN q IS NULL THEN CASE WHEN length(name) - 1 > p THEN substr(name, p + 1, length(name) - 1 - p) ELSE '' END WHEN q > p THEN substr(name, p + 1, q - p) ELSE '' END"


@query("surface_slice", answer(f"SELECT sent_id, chunk_id, p, {SLICE} AS surface FROM (SELECT g.sent_id, g.chunk_id, CAST(g.sent_id % 6 AS INTEGER) AS p, n.name, a.pos AS q FROM gold g JOIN names n ON n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id LEFT JOIN places a ON a.sent_id = g.sent_id AND a.chunk_id = g.chunk_id AND a.lemma = g.lemma || CASE WHEN g.sent_id % 5 = 0 THEN 'x' ELSE '' END)"), NAMES)
def surface_slice(spark, sf):
    nodes = s.nodes(spark, sf)
    wanted = s.gold(spark, sf).select("sent_id", "chunk_id", (F.col("sent_id") % 6).cast("int").alias("p"), F.when(F.col("sent_id") % 4 != 0, F.concat("lemma", F.when(F.col("sent_id") % 5 == 0, "x").otherwise(""))).alias("next"))
    return quality.sliced(nodes, wanted).select("sent_id", "chunk_id", "p", "surface")


TYPES = "t AS (SELECT lower(p_type) AS a, lower(left(p_name, 3)) AS b, count(*) AS n FROM part GROUP BY ALL)"


@query("rekeyed", f"WITH {TYPES} SELECT {replaces('a')} AS a, {replaces('b')} AS b, CAST(sum(n) AS BIGINT) AS n, arg_max(n, a || chr(1) || b) AS last FROM t GROUP BY 1, 2")
def rekeyed(spark, sf):
    counts = s.read(spark, sf, "part").groupBy(F.lower("p_type").alias("a"), F.lower(F.expr("left(p_name, 3)")).alias("b")).agg(F.count("*").alias("n"))
    return stats.rekeyed(counts, text.transliterate).join(stats.rekeyed(counts, text.transliterate, compat_mode=True).withColumnRenamed("n", "last"), ["a", "b"])


@query("sentence_text", answer("SELECT sent_id, string_agg(chunk_id || ':' || pos || ':' || lemma, ' ' ORDER BY node_id) AS shown FROM nodes GROUP BY sent_id"))
def sentence_text(spark, sf):
    return quality.shown(s.nodes(spark, sf))


@query("words_at", answer("SELECT sent_id, node_id, surface, lemma FROM nodes WHERE chunk_id = 1 AND pos = 12"))
def words_at(spark, sf):
    return quality.words_at(s.nodes(spark, sf), 1, 12).select("sent_id", "node_id", "surface", "lemma")


# ---- counts and matrices


@query("class_evidence", answer("SELECT lemma, cls, count(DISTINCT sent_id) AS sentences FROM (SELECT lemma, sent_id, cls FROM typed WHERE cls IS NOT NULL UNION ALL SELECT lemma, sent_id, 'verbs' FROM typed WHERE is_verb) GROUP BY ALL"), TYPED)
def class_evidence(spark, sf):
    return stats.class_evidence(typed(s.nodes(spark, sf)))


def raw_sql(key: str, counts: str) -> str:
    return f"""raw0 AS (SELECT q.sent_id, src, dst, coalesce(n, 0)::DOUBLE AS p FROM {OPEN.format(k=key)} q LEFT JOIN {counts} c ON c.a = q.a AND c.b = q.b),
raw1 AS (SELECT *, sum(p) OVER (PARTITION BY sent_id, src) AS total FROM raw0),
raw AS (SELECT sent_id, src, dst, p / total AS p FROM raw1 WHERE total > 0 UNION ALL
  SELECT n.sent_id, n.node_id, m.node_id, 1.0::DOUBLE / (k.n - 1) FROM nodes n JOIN nodes m ON m.sent_id = n.sent_id AND m.node_id <> n.node_id
  JOIN (SELECT sent_id, count(*) AS n FROM nodes GROUP BY sent_id) k ON k.sent_id = n.sent_id
  WHERE NOT EXISTS (SELECT 1 FROM raw1 r WHERE r.total > 0 AND r.sent_id = n.sent_id AND r.src = n.node_id)),
"""


def raw_edges(spark, sf, key: str, same: str | None) -> DataFrame:
    nodes, conflict = relations(spark, sf)
    return rounded(stats.edges_raw(nodes, key, stats.cooccurrences(nodes, key, same=same), conflict), "p")


@query("edges_raw_cng", answer("SELECT sent_id, src, dst, round(p + 3e-16, 9) AS p FROM raw"), raw_sql("cng", "cngcooc"))
def edges_raw_cng(spark, sf):
    return raw_edges(spark, sf, "cng", None)


@query("edges_raw_same", answer("SELECT sent_id, src, dst, round(p + 3e-16, 9) AS p FROM raw"), raw_sql("lemma", "samecooc"))
def edges_raw_same(spark, sf):
    return raw_edges(spark, sf, "lemma", "cng")


@query("edges_same", answer("SELECT sent_id, src, dst, round(p / sum(p) OVER (PARTITION BY sent_id, src) + 3e-16, 9) AS p FROM open_same"), kn_sql("open_same", "samecooc", halve=True, pairs=OPEN.format(k="lemma")))
def edges_same(spark, sf):
    nodes, conflict = relations(spark, sf)
    return rounded(stats.edges_smoothed(nodes, "lemma", stats.cooccurrences(nodes, "lemma", same="cng"), conflict, halve=True), "p")


@query("kn_joint_mass", answer("SELECT round(sum(CASE WHEN c.n IS NULL THEN 0 ELSE (c.n - 0.5::DOUBLE) / t.total END + 0.5::DOUBLE * t.contexts / t.total * (x.partners / t.contexts::DOUBLE) * (y.partners / t.contexts::DOUBLE)), 9) AS mass FROM (SELECT a, count(*) AS partners FROM cooc GROUP BY a) x CROSS JOIN (SELECT a, count(*) AS partners FROM cooc GROUP BY a) y CROSS JOIN (SELECT sum(n)::DOUBLE AS total, count(*) AS contexts FROM cooc) t LEFT JOIN cooc c ON c.a = x.a AND c.b = y.a"))
def kn_joint_mass(spark, sf):
    return rounded(stats.joint_mass(*cut(spark, cooc_counts(spark, sf))), "mass")


VECTORS = "v AS (SELECT 'Brand#' || vec_id AS lemma, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id BETWEEN 11 AND 55 AND vec_id % 7 <> 0), sims AS (SELECT x.lemma AS a, y.lemma AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x, v y),\n"


def similarities(spark, sf) -> DataFrame:
    """a, b, s: cosines of the lemmas' vectors, which the embeddings of the lemmas' numbers stand for; some have none."""
    v = s.read(spark, sf, "embeddings").where("vec_id between 11 and 55 and vec_id % 7 <> 0").select(F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("a"), "embedding")
    other = v.select(F.col("a").alias("b"), F.col("embedding").alias("e"))  # a vocabulary of at most 45 lemmas
    return v.crossJoin(F.broadcast(other)).select("a", "b", text.cosine(F.col("embedding"), F.col("e")).alias("s"))


@query("vector_pairs", answer("SELECT c.a, c.b, round(CASE WHEN s.s IS NULL THEN 1 / (1 + exp(1.0::DOUBLE)) ELSE 1 / (1 + exp(-s.s)) END, 6) AS older, round(CASE WHEN s.s IS NULL THEN 0 ELSE 1 / (1 + exp(-s.s)) END, 6) AS p, round(coalesce(s.s, -1), 6) AS similarity FROM cooc c LEFT JOIN sims s ON s.a = c.a AND s.b = c.b"), VECTORS)
def vector_pairs(spark, sf):
    known = cooc_counts(spark, sf).select("a", "b").join(similarities(spark, sf), ["a", "b"], "left")
    value = text.sigmoid(F.col("s"))
    return known.select("a", "b", F.round(text.sigmoid(F.coalesce("s", F.lit(-1.0))), 6).alias("older"), F.round(F.coalesce(value, F.lit(0.0)), 6).alias("p"), F.round(F.coalesce("s", F.lit(-1.0)), 6).alias("similarity"))


EDGES_VECTORS = """pairs AS (SELECT a.sent_id, a.node_id AS src, b.node_id AS dst, coalesce(1 / (1 + exp(-s.s)), 0) AS v FROM nodes a JOIN nodes b ON b.sent_id = a.sent_id AND b.node_id <> a.node_id LEFT JOIN sims s ON s.a = a.lemma AND s.b = b.lemma),
sums AS (SELECT *, sum(v) OVER w AS total, count(CASE WHEN v > 0 THEN 1 END) OVER w AS nz, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY sent_id, src)),
less AS (SELECT *, CASE WHEN total > 0 THEN greatest(v - 0.1::DOUBLE, 0) / total END AS l FROM sums),
"""


@query("edges_vectors", answer("SELECT sent_id, src, dst, round(CASE WHEN total = 0 THEN 1.0::DOUBLE / n WHEN nz = n THEN v / total WHEN l = 0 THEN 0.1::DOUBLE * nz / (total * (n - nz)) ELSE l END, 6) AS p FROM less"), VECTORS + EDGES_VECTORS)
def edges_vectors(spark, sf):
    return rounded(stats.vector_edges(s.nodes(spark, sf), similarities(spark, sf)), "p", digits=6)


@query("count_tables", answer("SELECT 'lemma' AS name, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS n FROM cooc UNION ALL SELECT 'cng', count(*), CAST(sum(n) AS BIGINT) FROM cngcooc UNION ALL SELECT 'same', count(*), CAST(sum(n) AS BIGINT) FROM samecooc"))
def count_tables(spark, sf):
    """The registry of the counts that the models read, each under its name in the session's catalog."""
    for name, counts in (("lemma", cooc_counts), ("cng", cng_cooc), ("same", cooc_samecng)):
        cut(spark, counts(spark, sf))[0].createOrReplaceTempView(f"counts_{name}")
    each = [spark.table(f"counts_{name}").agg(F.lit(name).alias("name"), F.count("*").alias("pairs"), F.sum("n").alias("n")) for name in ("lemma", "cng", "same")]
    return each[0].unionByName(each[1]).unionByName(each[2])
