"""Every operator as a query over the order tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import morph, text
from weft.operators import audits, block_paths, block_walks, lattice, learn, metrics, paths, quality, stats, walk
from weft.plans import surrogate as s
from weft.plans.session import checkpointed
from weft.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}

RULE_ROWS = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in s.RULES)
BASE = f"""WITH rules(l, r, length) AS (VALUES {RULE_ROWS}),
cand AS (SELECT l_orderkey AS sent_id, CAST(l_suppkey % 3 AS INTEGER) AS chunk_id, CAST(l_linenumber * 6 AS INTEGER) AS pos, p_brand AS lemma,
  l_returnflag || l_linestatus AS cng, p_name AS surface, l_extendedprice AS price, l_quantity AS quantity, l_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey),
grouped AS (SELECT sent_id, chunk_id, pos, lemma, cng, min(surface) AS surface FROM cand GROUP BY ALL),
nodes AS MATERIALIZED (SELECT sent_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY chunk_id, pos, lemma, cng) - 1 AS INTEGER) AS node_id, chunk_id, pos,
  CAST(dense_rank() OVER (PARTITION BY sent_id ORDER BY chunk_id, pos) - 1 AS INTEGER) AS set_id, surface, lemma, cng, cng = 'RF' AS is_verb FROM grouped),
near AS (SELECT a.sent_id, a.node_id AS n1, b.node_id AS n2, a.pos AS p1, b.pos AS p2, a.surface AS s1, b.surface AS s2, greatest(a.pos + length(a.surface) - b.pos, 0) AS o
  FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.chunk_id = b.chunk_id AND a.node_id < b.node_id),
judged AS (SELECT sent_id, n1, n2, CAST(o AS INTEGER) AS o, p1 < p2 AND (o = 0 OR (o IN (1, 2) AND (coalesce(x.length < o + 1, false) OR coalesce(y.length < o + 1, false)))) AS together
  FROM near LEFT JOIN rules x ON x.l = right(s1, CAST(greatest(o, 1) AS INTEGER)) AND x.r = left(s2, 1) LEFT JOIN rules y ON y.l = right(s1, 1) AND y.r = left(s2, CAST(greatest(o, 1) AS INTEGER))),
conflict AS MATERIALIZED (SELECT sent_id, n1, n2 FROM judged WHERE NOT together UNION ALL SELECT sent_id, n2, n1 FROM judged WHERE NOT together),
certain AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM conflict c WHERE c.sent_id = n.sent_id AND c.n1 = n.node_id)),
forced AS (SELECT sent_id, node_id, surface, against FROM (
  SELECT n.*, c.against, row_number() OVER (PARTITION BY n.sent_id ORDER BY length(surface) DESC, against DESC, node_id) AS place
  FROM nodes n JOIN (SELECT sent_id, n1, count(*) AS against FROM conflict GROUP BY ALL) c ON c.sent_id = n.sent_id AND c.n1 = n.node_id
  WHERE n.sent_id NOT IN (SELECT sent_id FROM certain)) WHERE place = 1),
query AS MATERIALIZED (SELECT sent_id, node_id FROM certain UNION ALL SELECT sent_id, node_id FROM forced),
compat AS MATERIALIZED (SELECT a.sent_id, a.node_id AS n1, b.node_id AS n2 FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.node_id <> b.node_id
  WHERE NOT EXISTS (SELECT 1 FROM conflict c WHERE c.sent_id = a.sent_id AND c.n1 = a.node_id AND c.n2 = b.node_id)),
cooc AS (SELECT a.lemma AS a, b.lemma AS b, count(*) AS n FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.node_id <> b.node_id GROUP BY ALL),
samecooc AS (SELECT a.lemma AS a, b.lemma AS b, count(*) AS n FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.node_id <> b.node_id AND a.cng = b.cng GROUP BY ALL),
cngcooc AS (SELECT a.cng AS a, b.cng AS b, count(*) AS n FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.node_id <> b.node_id GROUP BY ALL),
verbcng AS (SELECT a.lemma AS verb, b.cng AS cng, count(*) AS n FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.node_id <> b.node_id WHERE a.is_verb GROUP BY ALL),
gold AS (SELECT sent_id, chunk_id, lemma, cng FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, chunk_id ORDER BY price DESC, part, lemma, cng, pos) AS place FROM cand) WHERE place = 1),
guess AS (SELECT sent_id, chunk_id, lemma, cng FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, chunk_id ORDER BY quantity DESC, part, lemma, cng, pos) AS place FROM cand) WHERE place = 1),
recall AS (SELECT g.sent_id, sum(CASE WHEN p.lemma IS NULL THEN 0 ELSE 1 END) * 100.0::DOUBLE / count(*) AS accuracy FROM gold g LEFT JOIN (SELECT DISTINCT sent_id, lemma FROM guess) p ON p.sent_id = g.sent_id AND p.lemma = g.lemma GROUP BY g.sent_id),
"""


def kn_sql(name: str, counts: str, halve: bool = False, unseen: str = "", pairs: str = "") -> str:
    """CTE of smoothed probabilities of all pairs of keys."""
    t = f"(SELECT CAST(floor(count(*) / {2 if halve else 1}) AS BIGINT) FROM {counts})"
    pairs = pairs or f"(SELECT x.a, y.a AS b FROM (SELECT DISTINCT a FROM {counts}) x, (SELECT DISTINCT a FROM {counts}) y)"
    rest = "(0.5::DOUBLE * greatest(coalesce(ma.partners, 0), 1)::DOUBLE / (coalesce(ma.total, 0) + 1.0::DOUBLE))"
    p = f"CASE WHEN coalesce(c.n, 0) > 0 THEN greatest(c.n - 0.5::DOUBLE, 0) / (coalesce(ma.total, 0) + 1.0::DOUBLE) + {rest} * coalesce(mb.partners, 0)::DOUBLE / {t} ELSE {rest} * greatest(coalesce(mb.partners, 0), 1)::DOUBLE / {t} END"
    if unseen:
        p = f"CASE WHEN ma.partners IS NULL OR mb.partners IS NULL THEN {unseen} ELSE {p} END"
    m = f"(SELECT a, count(*) AS partners, sum(n) AS total FROM {counts} GROUP BY a)"
    return f"{name} AS (SELECT q.*, {p} AS p FROM {pairs} q LEFT JOIN {counts} c ON c.a = q.a AND c.b = q.b LEFT JOIN {m} ma ON ma.a = q.a LEFT JOIN {m} mb ON mb.a = q.b),\n"


OPEN = "(SELECT a.sent_id, a.node_id AS src, b.node_id AS dst, a.{k} AS a, b.{k} AS b FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.set_id <> b.set_id WHERE NOT EXISTS (SELECT 1 FROM conflict c WHERE c.sent_id = a.sent_id AND c.n1 = a.node_id AND c.n2 = b.node_id))"
EDGES = kn_sql("open_edges", "cooc", pairs=OPEN.format(k="lemma")) + "edges AS MATERIALIZED (SELECT sent_id, src, dst, p / sum(p) OVER (PARTITION BY sent_id, src) AS p FROM open_edges),\n"
EDGES_CNG = kn_sql("open_cng", "cngcooc", unseen="1.0::DOUBLE / 440000", pairs=OPEN.format(k="cng")) + "edges_cng AS MATERIALIZED (SELECT sent_id, src, dst, p / sum(p) OVER (PARTITION BY sent_id, src) AS p FROM open_cng),\n"
RAW = f"""raw0 AS (SELECT q.sent_id, src, dst, coalesce(n, 0)::DOUBLE AS p FROM {OPEN.format(k="lemma")} q LEFT JOIN cooc c ON c.a = q.a AND c.b = q.b),
raw1 AS (SELECT *, sum(p) OVER (PARTITION BY sent_id, src) AS total FROM raw0),
raw AS (SELECT sent_id, src, dst, p / total AS p FROM raw1 WHERE total > 0 UNION ALL
  SELECT n.sent_id, n.node_id, m.node_id, 1.0::DOUBLE / (k.n - 1) FROM nodes n JOIN nodes m ON m.sent_id = n.sent_id AND m.node_id <> n.node_id
  JOIN (SELECT sent_id, count(*) AS n FROM nodes GROUP BY sent_id) k ON k.sent_id = n.sent_id
  WHERE NOT EXISTS (SELECT 1 FROM raw1 r WHERE r.total > 0 AND r.sent_id = n.sent_id AND r.src = n.node_id)),
"""
STEPS = 5
#: The probability of classes that were never counted.
UNSEEN = 1 / 440000


def rwr_sql(edges: str = "edges", name: str = "x") -> str:
    out = f"{name}r AS (SELECT n.sent_id, n.node_id, CASE WHEN q.node_id IS NULL THEN 0 ELSE 1.0::DOUBLE / k.n END AS r FROM nodes n LEFT JOIN (SELECT DISTINCT * FROM query) q ON q.sent_id = n.sent_id AND q.node_id = n.node_id JOIN (SELECT sent_id, count(DISTINCT node_id) AS n FROM query GROUP BY sent_id) k ON k.sent_id = n.sent_id),\n{name}0 AS (SELECT sent_id, node_id, r AS x FROM {name}r),\n"
    for k in range(1, STEPS + 1):
        out += f"{name}{k} AS MATERIALIZED (SELECT r.sent_id, r.node_id, 0.6::DOUBLE * coalesce(m.m, 0) + 0.4::DOUBLE * r.r AS x FROM {name}r r LEFT JOIN (SELECT e.sent_id, e.dst, sum(v.x * e.p) AS m FROM {edges} e JOIN {name}{k - 1} v ON v.sent_id = e.sent_id AND v.node_id = e.src GROUP BY ALL) m ON m.sent_id = r.sent_id AND m.dst = r.node_id),\n"
    return out + f"{name}s AS MATERIALIZED (SELECT sent_id, node_id, x AS score FROM {name}{STEPS}),\n"


WALK = EDGES + rwr_sql()
WINNER = "winner AS MATERIALIZED (SELECT s.sent_id, arg_max(node_id, (round(score, 9), node_id)) AS node_id FROM xs s WHERE NOT EXISTS (SELECT 1 FROM query q WHERE q.sent_id = s.sent_id AND q.node_id = s.node_id) GROUP BY s.sent_id),\n"
GONE = "gone AS MATERIALIZED (SELECT DISTINCT c.sent_id, c.n2 AS node_id FROM conflict c JOIN winner w ON w.sent_id = c.sent_id AND w.node_id = c.n1 WHERE NOT EXISTS (SELECT 1 FROM query q WHERE q.sent_id = c.sent_id AND q.node_id = c.n2)),\n"


def query(name: str, sql: str | None = None, base: str = ""):
    """Registers a query; sql is what follows the common tables (ended by a comma), or all of it if it starts with SELECT or WITH."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = BASE + base + sql if not sql.lstrip().startswith(("SELECT", "WITH")) else sql
        return f

    return put


def answer(sql: str) -> str:
    return f"answer AS ({sql}) SELECT * FROM answer"


def of(spark, sf):
    nodes = s.nodes(spark, sf)
    return nodes, lattice.conflicts(nodes, s.rules(spark))


def cut(spark, *frames):
    """Frames that several steps read, computed once."""
    checkpointed(spark)
    return tuple(f.checkpoint() for f in frames)


def base(spark, sf):
    """nodes, conflict and query, computed once."""
    nodes, conflict = relations(spark, sf)
    return nodes, conflict, *cut(spark, lattice.queries(nodes, conflict))


# ---- candidates and their relations


@query("node_lattice", answer("SELECT * FROM nodes"))
def node_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return s.nodes(spark, sf)


@query("first_lemma_nodes", answer("SELECT sent_id, chunk_id, pos, min(lemma) AS lemma, count(*) AS n FROM nodes GROUP BY ALL"))
def first_lemma_nodes(spark, sf):
    return s.nodes(spark, sf).groupBy("sent_id", "chunk_id", "pos").agg(F.min("lemma").alias("lemma"), F.count("*").alias("n"))


@query("span_pairs", answer("SELECT sent_id, n1, n2, o AS overlap, together FROM judged"))
def span_pairs(spark, sf):
    return lattice.spans(s.nodes(spark, sf), s.rules(spark)).select("sent_id", F.col("node_id").alias("n1"), F.col("node_id2").alias("n2"), F.col("overlap").cast("int").alias("overlap"), "together")


@query("conflict_pairs", answer("SELECT * FROM conflict"))
def conflict_pairs(spark, sf):
    return of(spark, sf)[1]


@query("simple_coexist", answer("SELECT a.sent_id, a.node_id AS n1, b.node_id AS n2 FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.chunk_id = b.chunk_id WHERE a.pos + length(a.surface) - 1 < b.pos"))
def simple_coexist(spark, sf):
    return lattice.simple_pairs(s.nodes(spark, sf))


@query("legacy_overlap", answer("SELECT a.sent_id, a.node_id AS n1, b.node_id AS n2 FROM nodes a JOIN nodes b ON a.sent_id = b.sent_id AND a.chunk_id = b.chunk_id WHERE (b.pos < a.pos AND b.pos + length(b.surface) - 1 > a.pos) OR (b.pos > a.pos AND b.pos < a.pos + length(a.surface) - 1)"))
def legacy_overlap(spark, sf):
    return lattice.touching_pairs(s.nodes(spark, sf))


@query("compat_pairs", answer("SELECT * FROM compat"))
def compat_pairs(spark, sf):
    return lattice.compatible(*of(spark, sf))


@query("query_nodes", answer("SELECT sent_id, node_id, lemma, cng FROM certain"))
def query_nodes(spark, sf):
    return lattice.certain(*of(spark, sf)).select("sent_id", "node_id", "lemma", "cng")


@query("forced_query", answer("SELECT * FROM forced"))
def forced_query(spark, sf):
    return lattice.forced(*of(spark, sf))


@query("legacy_query", answer("SELECT sent_id, chunk_id, min(node_id) AS node_id FROM nodes GROUP BY ALL HAVING count(*) = 1"))
def legacy_query(spark, sf):
    return lattice.single(s.nodes(spark, sf))


# ---- counts and probabilities


@query("unigrams", answer("SELECT lemma, count(*) AS n FROM nodes GROUP BY lemma"))
def unigrams(spark, sf):
    return s.nodes(spark, sf).groupBy("lemma").agg(F.count("*").alias("n"))


@query("cooc_counts", answer("SELECT * FROM cooc"))
def cooc_counts(spark, sf):
    return stats.cooccurrences(s.nodes(spark, sf), "lemma")


@query("cooc_samecng", answer("SELECT * FROM samecooc"))
def cooc_samecng(spark, sf):
    return stats.cooccurrences(s.nodes(spark, sf), "lemma", same="cng")


@query("cng_cooc", answer("SELECT * FROM cngcooc"))
def cng_cooc(spark, sf):
    return stats.cooccurrences(s.nodes(spark, sf), "cng")


@query("verb_cng", answer("SELECT * FROM verbcng"))
def verb_cng(spark, sf):
    return stats.verb_classes(s.nodes(spark, sf))


@query("cooc_update", answer("SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM cooc UNION ALL SELECT * FROM samecooc) GROUP BY a, b"))
def cooc_update(spark, sf):
    return stats.added(cooc_counts(spark, sf), cooc_samecng(spark, sf))


@query("margins", answer("SELECT a, count(*) AS partners, CAST(sum(n) AS BIGINT) AS total FROM cooc GROUP BY a"))
def margins(spark, sf):
    return stats.margins(cooc_counts(spark, sf))


@query("context_totals", answer("SELECT (SELECT count(*) FROM cooc) AS lemma, (SELECT count(*) FROM cngcooc) AS cng, (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM samecooc) AS same"))
def context_totals(spark, sf):
    one = lambda df, name, halve=False: stats.contexts(df, halve).withColumnRenamed("contexts", name)
    return one(cooc_counts(spark, sf), "lemma").join(one(cng_cooc(spark, sf), "cng")).join(one(cooc_samecng(spark, sf), "same", True))


#: Keys up to this number are sent to all executors for the table of all their pairs; more of them are joined in blocks.
BROADCAST_KEYS = 100_000


def all_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of the distinct keys (a): the table of a whole vocabulary, which is what the query returns."""
    keys = keys.select("a").distinct()
    other = keys.withColumnRenamed("a", "b")
    return keys.crossJoin(F.broadcast(other) if other.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else other)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Columns rounded for comparison; values that lie on an edge but for the order of a sum go up."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(3e-16), digits) for c in columns})


@query("kn_w2w", answer("SELECT a, b, round(p + 3e-16, 9) AS p FROM kn"), kn_sql("kn", "cooc"))
def kn_w2w(spark, sf):
    (c,) = cut(spark, cooc_counts(spark, sf))
    return rounded(stats.smoothed(all_pairs(c), c).select("a", "b", "p"), "p")


@query("kn_cng", answer("SELECT a, b, round(p + 3e-16, 9) AS p FROM kn"), kn_sql("kn", "cngcooc", unseen="1.0::DOUBLE / 440000", pairs="(SELECT x.a, y.a AS b FROM (SELECT DISTINCT a FROM cngcooc UNION SELECT 'none') x, (SELECT DISTINCT a FROM cngcooc UNION SELECT 'none') y)"))
def kn_cng(spark, sf):
    (c,) = cut(spark, cng_cooc(spark, sf))
    keys = c.select("a").distinct().unionByName(spark.createDataFrame([("none",)], "a string"))
    return rounded(stats.smoothed(all_pairs(keys), c, unseen=1 / 440000).select("a", "b", "p"), "p")


@query("kn_samecng", answer("SELECT a, b, round(p + 3e-16, 9) AS p FROM kn"), kn_sql("kn", "samecooc", halve=True))
def kn_samecng(spark, sf):
    (c,) = cut(spark, cooc_samecng(spark, sf))
    return rounded(stats.smoothed(all_pairs(c), c, halve=True).select("a", "b", "p"), "p")


@query("kn_mass", answer("SELECT a, round(sum(p), 9) AS mass FROM kn GROUP BY a"), kn_sql("kn", "cooc"))
def kn_mass(spark, sf):
    return rounded(stats.mass(*cut(spark, cooc_counts(spark, sf))), "mass")


def relations(spark, sf):
    """nodes and conflict, computed once."""
    (nodes,) = cut(spark, s.nodes(spark, sf))
    return nodes, *cut(spark, lattice.conflicts(nodes, s.rules(spark)))


def edges_of(spark, sf):
    nodes, conflict = relations(spark, sf)
    return nodes, conflict, stats.edges_smoothed(nodes, "lemma", stats.cooccurrences(nodes, "lemma"), conflict)


@query("edges_w2w", answer("SELECT sent_id, src, dst, round(p + 3e-16, 9) AS p FROM edges"), EDGES)
def edges_w2w(spark, sf):
    return rounded(edges_of(spark, sf)[2], "p")


@query("edges_cng", answer("SELECT sent_id, src, dst, round(p + 3e-16, 9) AS p FROM edges_cng"), EDGES_CNG)
def edges_cng(spark, sf):
    nodes, conflict = relations(spark, sf)
    return rounded(stats.edges_smoothed(nodes, "cng", stats.cooccurrences(nodes, "cng"), conflict, unseen=1 / 440000), "p")


@query("edges_raw", answer("SELECT sent_id, src, dst, round(p + 3e-16, 9) AS p FROM raw"), RAW)
def edges_raw(spark, sf):
    nodes, conflict = relations(spark, sf)
    return rounded(stats.edges_raw(nodes, "lemma", stats.cooccurrences(nodes, "lemma"), conflict), "p")


@query("edges_competing_removed", answer("SELECT sent_id, count(*) AS n FROM open_edges GROUP BY sent_id"), EDGES)
def edges_competing_removed(spark, sf):
    nodes, conflict = relations(spark, sf)
    open_pairs = stats.node_pairs(nodes, "lemma").join(conflict.select("sent_id", F.col("n1").alias("src"), F.col("n2").alias("dst")), ["sent_id", "src", "dst"], "left_anti")
    return open_pairs.groupBy("sent_id").agg(F.count("*").alias("n"))


@query("row_stochastic", answer("SELECT sent_id, src, round(sum(p), 6) AS total FROM edges GROUP BY ALL"), EDGES)
def row_stochastic(spark, sf):
    return rounded(edges_of(spark, sf)[2].groupBy("sent_id", "src").agg(F.sum("p").alias("total")), "total", digits=6)


@query("v2c_rank", answer("SELECT sent_id, node_id, round(most / total, 9) AS score FROM (SELECT *, sum(most) OVER (PARTITION BY sent_id) AS total FROM (SELECT n.sent_id, n.node_id, max(coalesce(c.n, 0)) AS most FROM nodes n JOIN (SELECT DISTINCT sent_id, lemma AS verb FROM nodes WHERE is_verb) v ON v.sent_id = n.sent_id LEFT JOIN verbcng c ON c.verb = v.verb AND c.cng = n.cng WHERE NOT n.is_verb GROUP BY ALL)) WHERE total > 0"))
def v2c_rank(spark, sf):
    nodes = s.nodes(spark, sf)
    return rounded(stats.verb_ranking(nodes, stats.verb_classes(nodes)), "score")


# ---- walks, ranking and one round of the choice


def walked(spark, sf):
    nodes, conflict, q = base(spark, sf)
    (edges,) = cut(spark, stats.edges_smoothed(nodes, "lemma", stats.cooccurrences(nodes, "lemma"), conflict))
    return nodes, conflict, q, walk.walk_steps(nodes, edges, q, STEPS)


@query("rwr_k_steps", answer("SELECT sent_id, node_id, round(score, 8) AS score FROM xs"), WALK)
def rwr_k_steps(spark, sf):
    return rounded(walked(spark, sf)[3], "score", digits=8)


@query("rank_nodes", answer("SELECT sent_id, node_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY round(score, 9) DESC, node_id DESC) AS INTEGER) AS rank FROM xs"), WALK)
def rank_nodes(spark, sf):
    return walk.ranked(walked(spark, sf)[3]).select("sent_id", "node_id", "rank")


@query("winner", answer("SELECT * FROM winner"), WALK + WINNER)
def winner(spark, sf):
    _, _, q, scores = walked(spark, sf)
    return walk.winners(scores, q)


@query("deactivate_round", answer("SELECT * FROM gone"), WALK + WINNER + GONE)
def deactivate_round(spark, sf):
    _, conflict, q, scores = walked(spark, sf)
    return lattice.deactivated(conflict, walk.winners(scores, q), q)


@query("expand_query", answer("SELECT l.sent_id, l.node_id FROM left_over l WHERE NOT EXISTS (SELECT 1 FROM conflict c JOIN left_over m ON m.sent_id = c.sent_id AND m.node_id = c.n2 WHERE c.sent_id = l.sent_id AND c.n1 = l.node_id)"), WALK + WINNER + GONE + """left_over AS (SELECT n.sent_id, n.node_id FROM nodes n JOIN winner w ON w.sent_id = n.sent_id JOIN nodes wn ON wn.sent_id = w.sent_id AND wn.node_id = w.node_id AND wn.chunk_id = n.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM query UNION ALL SELECT * FROM winner UNION ALL SELECT * FROM gone) t WHERE t.sent_id = n.sent_id AND t.node_id = n.node_id)),
""")
def expand_query(spark, sf):
    nodes, conflict, q, scores = walked(spark, sf)
    (won,) = cut(spark, walk.winners(scores, q))
    return lattice.promoted(nodes, conflict, won, q, lattice.deactivated(conflict, won, q))


@query("blend_rank", answer("SELECT sent_id, node_id, round(0.5::DOUBLE * a / ta + 0.5::DOUBLE * b / tb, 8) AS score FROM (SELECT x.sent_id, x.node_id, x.score AS a, y.score AS b, sum(x.score) OVER (PARTITION BY x.sent_id) AS ta, sum(y.score) OVER (PARTITION BY x.sent_id) AS tb FROM xs x JOIN ys y ON x.sent_id = y.sent_id AND x.node_id = y.node_id)"), WALK + EDGES_CNG + rwr_sql("edges_cng", "y"))
def blend_rank(spark, sf):
    if found := s.sentences(spark, sf):
        return rounded(block_walks.blended(found, block_walks.fit(found, ["lemma", "cng"], UNSEEN), [0.5, 0.5], STEPS), "score", digits=8)
    nodes, conflict, q = base(spark, sf)
    one = stats.edges_smoothed(nodes, "lemma", stats.cooccurrences(nodes, "lemma"), conflict)
    two = stats.edges_smoothed(nodes, "cng", stats.cooccurrences(nodes, "cng"), conflict, unseen=1 / 440000)
    return rounded(walk.blended([walk.walk_steps(nodes, e, q, STEPS) for e in cut(spark, one, two)], [0.5, 0.5]), "score", digits=8)


@query("shortest_paths", answer("SELECT sent_id, src, dst, round(ln(min(d)), 6) AS log_d FROM d2 GROUP BY ALL"), EDGES + """d0 AS (SELECT sent_id, src, dst, 1.0::DOUBLE / p AS d FROM edges),
d1 AS (SELECT sent_id, src, dst, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT a.sent_id, a.src, b.dst, a.d + b.d FROM d0 a JOIN d0 b ON a.sent_id = b.sent_id AND a.dst = b.src AND a.src <> b.dst) GROUP BY ALL),
d2 AS (SELECT sent_id, src, dst, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT a.sent_id, a.src, b.dst, a.d + b.d FROM d1 a JOIN d1 b ON a.sent_id = b.sent_id AND a.dst = b.src AND a.src <> b.dst) GROUP BY ALL),
""")
def shortest_paths(spark, sf):
    found = s.sentences(spark, sf)
    d = block_walks.closure(found, block_walks.fit(found, ["lemma"], UNSEEN), 2) if found else walk.closure(*cut(spark, edges_of(spark, sf)[2]), 2)
    return d.select("sent_id", "src", "dst", F.round(F.log("d"), 6).alias("log_d"))


#: The models of the greedy loop and their weights.
LOOP, SHARES = ["lemma", "cng", "same"], [1 / 3] * 3


def looped(spark, sf, made, *more):
    """made(sentences, models, shares, *more) of block_walks; None where blocks can't hold the sentences."""
    found = s.sentences(spark, sf)
    return made(found, block_walks.fit(found, LOOP, UNSEEN), SHARES, *more) if found else None


@query("greedy_trace")
def greedy_trace(spark, sf):
    return looped(spark, sf, block_walks.trace) or joined_trace(spark, sf)


def joined_trace(spark, sf):
    """The trace by joins."""
    nodes, conflict, q = base(spark, sf)
    counts, same, cng = stats.cooccurrences(nodes, "lemma"), stats.cooccurrences(nodes, "lemma", same="cng"), stats.cooccurrences(nodes, "cng")
    edges = [stats.edges_smoothed(nodes, "lemma", counts, conflict), stats.edges_smoothed(nodes, "cng", cng, conflict, unseen=1 / 440000), stats.edges_smoothed(nodes, "lemma", same, conflict, halve=True)]
    return walk.trace(nodes, conflict, q, edges, SHARES)


def greedy_predict(spark, sf):
    return looped(spark, sf, block_walks.predict) or walk.chosen(joined_trace(spark, sf))


query("greedy_predict")(greedy_predict)


@query("greedy_accuracy")
def greedy_accuracy(spark, sf):
    return metrics.report(metrics.recall(greedy_predict(spark, sf), s.gold(spark, sf)))


# ---- words


WORDS = "documents"


def words(spark, sf):
    return s.read(spark, sf, WORDS).select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where("word <> ''").distinct()


WORDS_SQL = "w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) WHERE word <> ''),\n"


def replaces(column: str) -> str:
    for a, b in text.PAIRS.items():
        column = f"replace({column}, '{a}', '{b}')"
    return f"translate({column}, '{''.join(text.SINGLE)}', '{''.join(text.SINGLE.values())}')"


@query("translit", "WITH " + WORDS_SQL + answer(f"SELECT word, {replaces('word')} AS slp FROM w"))
def translit(spark, sf):
    return words(spark, sf).select("word", text.transliterate(F.col("word")).alias("slp"))


CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SYNONYMS.items())


@query("normalise_lemma", "WITH " + WORDS_SQL + f"""b AS (SELECT word, split_part({replaces("word")}, '_', 1) AS base FROM w),
n AS (SELECT word, CASE base {CASES} ELSE base END AS lemma FROM b),
""" + answer("SELECT word, CASE WHEN lemma = 'yad' AND word = 'yadi' THEN 'yadi' ELSE lemma END AS lemma FROM n"))
def normalise_lemma(spark, sf):
    return words(spark, sf).select("word", text.normal_lemma(F.col("word"), F.col("word")).alias("lemma"))


PREFIXES = ["en", "th", "re", "an", "pa"]


@query("strip_prefix", "WITH " + WORDS_SQL + answer("SELECT word, CASE WHEN p = '' THEN word ELSE split_part(word, p, 2) END AS bare, CASE WHEN p = '' THEN word ELSE substr(word, length(p) + 1) END AS rest FROM (SELECT word, regexp_extract(word, '^(en|th|re|an|pa)') AS p FROM w)"))
def strip_prefix(spark, sf):
    return words(spark, sf).select("word", text.without_prefix(F.col("word"), PREFIXES).alias("bare"), text.after_prefix(F.col("word"), PREFIXES).alias("rest"))


@query("suffix_strip", answer("SELECT DISTINCT split_part(key, '_', 1) AS lemma, split_part(key, '_', 2) AS cng FROM (SELECT lemma || '_' || cng AS key FROM nodes)"))
def suffix_strip(spark, sf):
    key = F.concat_ws("_", "lemma", "cng")
    return s.nodes(spark, sf).select(text.before_underscore(key).alias("lemma"), F.substring_index(key, "_", -1).alias("cng")).distinct()


FORMS = [("noun", f"{c}.{n}.{g}.") for c in ("nom", "voc", "acc", "i", "dat", "abl", "g", "loc") for n in ("sg", "du", "pl") for g in ("m", "f", "n", "*")]
NOUN_SQL = "SELECT 'noun' AS form, c.x || '.' || n.x || '.' || g.x || '.' AS config, CAST(29 + 20 * c.k + 5 * n.k + g.k AS INTEGER) AS cng, CAST(29 + 20 * CASE WHEN c.x = 'loc' THEN 1 ELSE c.k END + 5 * n.k + g.k AS INTEGER) AS compat FROM (VALUES ('nom', 0), ('voc', 1), ('acc', 2), ('i', 3), ('dat', 4), ('abl', 5), ('g', 6), ('loc', 7)) c(x, k), (VALUES ('sg', 0), ('du', 1), ('pl', 2)) n(x, k), (VALUES ('m', 0), ('f', 1), ('n', 2), ('*', 3)) g(x, k)"
OTHERS = [("indeclinable", "part.", 2), ("indeclinable", "ca. abs.", -230), ("compound", "iic.", 3), ("undetermined", "adv.", 2), ("undetermined", "und.", 1), ("verb", "pr. [1] ac. sg. 3", None), ("verb", "pp.", -190), ("verb", "ca. abs.", -230), ("verb", "aor. [4] ac. pl. 2", -118), ("verb", "pr. ps. du. 1", -244), ("verb", "fut. ac. sg. 1", -51), ("unknown", "x.", None)]
OTHERS[5] = ("verb", "pr. ac. sg. 3", -13)


@query("morph_class", f"WITH {answer(NOUN_SQL + ' UNION ALL SELECT * FROM (VALUES ' + ', '.join(f'({f!r}, {c!r}, {v or chr(78) + "ULL"}, {v or chr(78) + "ULL"})' for f, c, v in OTHERS) + ')')}")
def morph_class(spark, sf):
    forms = spark.createDataFrame(FORMS + [(f, c) for f, c, _ in OTHERS], "form string, config string")
    f, c = F.col("form"), F.col("config")
    return forms.select("form", "config", morph.word_class(f, c).alias("cng"), morph.word_class(f, c, compat_mode=True).alias("compat"))


@query("scalar_features", answer("SELECT sent_id, node_id, round(1 / (1 + exp(-pos::DOUBLE / 10)), 9) AS sigmoid, round(1.0::DOUBLE / (1 + node_id), 9) AS reciprocal, round((pos / 100.0::DOUBLE + 1) / 2, 9) AS rescaled, round(CASE WHEN pos >= 20 THEN pos - 20 + 0.01::DOUBLE ELSE pos - 20 - 0.01::DOUBLE END, 9) AS pushed FROM nodes"))
def scalar_features(spark, sf):
    pos = F.col("pos").cast("double")
    return s.nodes(spark, sf).select("sent_id", "node_id", F.round(text.sigmoid(pos / 10), 9).alias("sigmoid"), F.round(text.reciprocal_rank(F.col("node_id")), 9).alias("reciprocal"), F.round(text.rescaled(pos / 100), 9).alias("rescaled"), F.round(text.pushed(pos - 20), 9).alias("pushed"))


@query("path_names", "SELECT a || b || c AS code, ['lemma', 'cng', 'tup'][CAST(a AS INTEGER)] || '-' || ['lemma', 'cng', 'tup'][CAST(b AS INTEGER)] || '-' || ['lemma', 'cng', 'tup'][CAST(c AS INTEGER)] AS name FROM (VALUES ('1'), ('2'), ('3')) x(a), (VALUES ('1'), ('2'), ('3')) y(b), (VALUES ('1'), ('2'), ('3')) z(c) WHERE (CASE WHEN a = '3' THEN 1 ELSE 0 END + CASE WHEN b = '3' THEN 1 ELSE 0 END + CASE WHEN c = '3' THEN 1 ELSE 0 END) < 2")
def path_names(spark, sf):
    return spark.createDataFrame([(c,) for c in paths.PATHS], "code string").select("code", text.path_name(F.col("code")).alias("name"))


@query("dictionary", answer("SELECT lemma, CAST(dense_rank() OVER (ORDER BY lemma) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT lemma FROM nodes)"))
def dictionary(spark, sf):
    # The distinct lemmas are the vocabulary; it is what one task numbers.
    return s.nodes(spark, sf).select("lemma").distinct().select("lemma", (F.dense_rank().over(Window.orderBy("lemma")) - 1).cast("int").alias("id"))


# ---- checks, corrections and bookkeeping


@query("coverage_full", answer("SELECT g.sent_id, count(*) = sum(CASE WHEN n.lemma IS NULL THEN 0 ELSE 1 END) AS covered FROM guess g LEFT JOIN (SELECT DISTINCT sent_id, chunk_id, lemma FROM gold) n ON n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND n.lemma = g.lemma GROUP BY g.sent_id"))
def coverage_full(spark, sf):
    return quality.full_coverage(s.gold(spark, sf), s.predicted(spark, sf))


@query("eligibility_code", answer("""SELECT t.sent_id, CASE WHEN t.n <> g.n OR c.n <> g.n THEN 1 WHEN m.missing = 1 THEN 2 ELSE 0 END AS code
  FROM (SELECT sent_id, count(DISTINCT pos % 4) AS n FROM nodes GROUP BY sent_id) t JOIN (SELECT sent_id, count(DISTINCT chunk_id) AS n FROM guess GROUP BY sent_id) g ON g.sent_id = t.sent_id
  JOIN (SELECT sent_id, count(DISTINCT chunk_id) AS n FROM gold GROUP BY sent_id) c ON c.sent_id = t.sent_id
  JOIN (SELECT g.sent_id, max(CASE WHEN EXISTS (SELECT 1 FROM gold n WHERE n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND (n.lemma = g.lemma OR n.lemma = CASE WHEN starts_with(g.lemma, 'Brand#') THEN split_part(g.lemma, 'Brand#', 2) ELSE g.lemma END)) THEN 0 ELSE 1 END) AS missing FROM guess g GROUP BY g.sent_id) m ON m.sent_id = t.sent_id"""))
def eligibility_code(spark, sf):
    tokens = s.nodes(spark, sf).groupBy("sent_id").agg(F.countDistinct(F.col("pos") % 4).alias("n_tokens"))
    return quality.eligibility(s.gold(spark, sf), s.predicted(spark, sf), tokens, lambda c: text.without_prefix(c, ["Brand#"]))


@query("presence_audit", answer("""SELECT sent_id, chunk_id, lemma, cng, presence, CASE WHEN min(abs(presence)) OVER (PARTITION BY sent_id) = 0 THEN 'Bad' ELSE 'Good' END AS status FROM (
  SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM gold n WHERE n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND n.lemma = g.lemma AND n.cng = g.cng) THEN 1
  WHEN EXISTS (SELECT 1 FROM gold n WHERE n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND n.lemma = g.lemma) THEN -1 ELSE 0 END AS presence FROM guess g)"""))
def presence_audit(spark, sf):
    return quality.presence(s.gold(spark, sf), s.predicted(spark, sf))


@query("missing_count", answer("SELECT g.sent_id, count(*) AS n_missing FROM (SELECT DISTINCT sent_id, chunk_id, lemma FROM guess) g WHERE NOT EXISTS (SELECT 1 FROM gold n WHERE n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id AND n.lemma = g.lemma) GROUP BY g.sent_id"))
def missing_count(spark, sf):
    return quality.missing(s.gold(spark, sf), s.predicted(spark, sf))


@query("bad_sentences", answer("SELECT DISTINCT sent_id FROM nodes WHERE length(lemma) > 0 AND pos % 7 = 0"))
def bad_sentences(spark, sf):
    return quality.bad_sentences(s.nodes(spark, sf).select("sent_id", F.length("lemma").alias("n_lemmas"), (F.col("pos") % 7).alias("n_forms")))


FIXES = "fixes AS (SELECT DISTINCT sent_id, chunk_id, lemma, lemma || 'x' || (sent_id % 5) AS new, sent_id % 5 AS ord FROM gold WHERE sent_id % 3 = 0),\n"


@query("apply_replacements", answer("SELECT g.sent_id, g.chunk_id, coalesce(f.new, g.lemma) AS lemma, g.cng FROM gold g LEFT JOIN fixes f ON f.sent_id = g.sent_id AND f.chunk_id = g.chunk_id AND f.lemma = g.lemma"), FIXES)
def apply_replacements(spark, sf):
    gold = s.gold(spark, sf)
    last, older = (gold.where("sent_id % 3 = 0").select("sent_id", "chunk_id", "lemma", F.concat("lemma", F.lit("x"), (F.col("sent_id") % 5 - k).cast("string")).alias("new"), (F.col("sent_id") % 5 - k).alias("ord")) for k in (0, 1))
    return quality.replaced(gold, older.unionByName(last)).select("sent_id", "chunk_id", "lemma", "cng")


NAMES = "names AS (SELECT sent_id, chunk_id, string_agg(surface, '' ORDER BY node_id) AS name FROM nodes GROUP BY ALL), places AS (SELECT sent_id, chunk_id, lemma, min(pos) AS pos FROM nodes GROUP BY ALL),\n"


@query("insert_missing", answer("""SELECT sent_id, chunk_id, pos, surface, lemma, cng FROM nodes UNION ALL
  SELECT g.sent_id, g.chunk_id, 0, substr(m.name, 1, a.pos), g.lemma, g.cng FROM guess g JOIN names m ON m.sent_id = g.sent_id AND m.chunk_id = g.chunk_id JOIN gold n ON n.sent_id = g.sent_id AND n.chunk_id = g.chunk_id JOIN places a ON a.sent_id = g.sent_id AND a.chunk_id = g.chunk_id AND a.lemma = n.lemma WHERE n.lemma <> g.lemma"""), NAMES)
def insert_missing(spark, sf):
    nodes, gold = s.nodes(spark, sf), s.gold(spark, sf).select("sent_id", "chunk_id", F.col("lemma").alias("next"))
    lacking = s.predicted(spark, sf).join(gold, ["sent_id", "chunk_id"]).where("lemma <> next").withColumn("p", F.lit(0))
    return quality.inserted(nodes, quality.sliced(nodes, lacking).withColumn("pos", F.col("p")))


def listing(spark, sf, condition: str, place: str):
    return s.read(spark, sf, "orders").where(condition).select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".p")).alias("file")).distinct().withColumn("path", F.concat(F.lit(place), "file"))


LISTS = "a AS (SELECT DISTINCT o_orderkey || '.p' AS file FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_orderkey || '.p' AS file FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT DISTINCT o_orderkey || '.p' AS file FROM orders WHERE o_orderkey % 5 = 0),\n"


@query("manifest_priority", "WITH " + LISTS + answer("SELECT file, arg_max(path, source) AS path, max(source) AS source FROM (SELECT file, 'A/' || file AS path, 0 AS source FROM a UNION ALL SELECT file, 'B/' || file, 1 FROM b UNION ALL SELECT file, 'C/' || file, 2 FROM c) GROUP BY file"))
def manifest_priority(spark, sf):
    return quality.manifest([listing(spark, sf, f"o_orderkey % {k} = 0", p) for k, p in ((2, "A/"), (3, "B/"), (5, "C/"))])


@query("common_files", "WITH " + LISTS + answer("SELECT file FROM a INTERSECT SELECT file FROM b"))
def common_files(spark, sf):
    return readers.common(listing(spark, sf, "o_orderkey % 2 = 0", ""), listing(spark, sf, "o_orderkey % 3 = 0", ""))


@query("union_files", "WITH " + LISTS + answer("SELECT file FROM a UNION SELECT file FROM b"))
def union_files(spark, sf):
    return listing(spark, sf, "o_orderkey % 2 = 0", "").unionByName(listing(spark, sf, "o_orderkey % 3 = 0", "")).select("file").distinct()


@query("undone", "WITH " + LISTS + answer("SELECT file FROM a EXCEPT SELECT file FROM b"))
def undone(spark, sf):
    return quality.undone(listing(spark, sf, "o_orderkey % 2 = 0", ""), listing(spark, sf, "o_orderkey % 3 = 0", ""), "file")


@query("paired_scan", "WITH " + LISTS + answer("SELECT x.file, y.file IS NOT NULL AS has_gold FROM (SELECT file || '2' AS file FROM a) x LEFT JOIN b y ON y.file = regexp_replace(x.file, '2$', '')"))
def paired_scan(spark, sf):
    lattices = listing(spark, sf, "o_orderkey % 2 = 0", "").select(F.concat("file", F.lit("2")).alias("file"))
    gold = listing(spark, sf, "o_orderkey % 3 = 0", "").select("file", F.lit(True).alias("has_gold"))
    return readers.paired(lattices, gold).select("file", F.coalesce("has_gold", F.lit(False)).alias("has_gold"))


@query("paired_scan_strict", "WITH " + LISTS + answer("SELECT x.file FROM (SELECT file || '2' AS file FROM a) x JOIN b y ON y.file = regexp_replace(x.file, '2$', '')"))
def paired_scan_strict(spark, sf):
    lattices = listing(spark, sf, "o_orderkey % 2 = 0", "").select(F.concat("file", F.lit("2")).alias("file"))
    return readers.paired(lattices, listing(spark, sf, "o_orderkey % 3 = 0", ""), required=True).select("file")


@query("valid_names", "WITH n AS (SELECT DISTINCT p_name AS file FROM part UNION SELECT DISTINCT p_brand || '.p' FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR) || '.p' FROM part), " + answer("SELECT file, regexp_matches(file, '^\\w*.p$') AS valid FROM n"))
def valid_names(spark, sf):
    p = s.read(spark, sf, "part")
    names = p.select(F.col("p_name").alias("file")).union(p.select(F.concat("p_brand", F.lit(".p")))).union(p.select(F.concat(F.col("p_size").cast("string"), F.lit(".p")))).distinct()
    return names.select("file", readers.valid_name(F.col("file")).alias("valid"))


@query("corpus_tokens", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents), " + answer("SELECT tokens[1] AS first, len(tokens) AS n_tokens, count(*) AS n FROM (SELECT string_split(replace(trim(split_part(value, '=>', 1), ' '), chr(9), ''), ' ') AS tokens FROM l) GROUP BY ALL"))
def corpus_tokens(spark, sf):
    lines = s.read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return readers.corpus_tokens(lines).groupBy(F.col("tokens")[0].alias("first"), F.size("tokens").cast("bigint").alias("n_tokens")).agg(F.count("*").alias("n"))


@query("nested_counts", "WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL) SELECT a, b, n FROM c")
def nested_counts(spark, sf):
    counted = s.read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    inner = counted.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"))  # one entry per type
    outer = inner.select(F.to_json(F.create_map("p_brand", "m")).alias("json"))
    return readers.nested_counts(outer, "json")


@query("corpus_snapshot", answer("SELECT * FROM nodes ORDER BY sent_id, node_id LIMIT 1000"))
def corpus_snapshot(spark, sf):
    return readers.snapshot(s.nodes(spark, sf), ["sent_id", "node_id"], 1000)


@query("dedup_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS place FROM orders) WHERE place = 1")
def dedup_first(spark, sf):
    return quality.first_of(s.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey", "o_totalprice"])


# ---- accuracy


@query("recall", answer("SELECT sent_id, round(accuracy, 6) AS accuracy FROM recall"))
def recall(spark, sf):
    return rounded(metrics.recall(s.predicted(spark, sf), s.gold(spark, sf)), "accuracy", digits=6)


@query("precision", answer("SELECT p.sent_id, round(sum(CASE WHEN g.lemma IS NULL THEN 0 ELSE 1 END) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM guess p LEFT JOIN (SELECT DISTINCT sent_id, lemma FROM gold) g ON g.sent_id = p.sent_id AND g.lemma = p.lemma GROUP BY p.sent_id"))
def precision(spark, sf):
    return rounded(metrics.precision(s.predicted(spark, sf), s.gold(spark, sf)), "accuracy", digits=6)


@query("accuracy_report", answer("SELECT round(avg(accuracy), 6) AS mean, round(quantile_cont(accuracy, 0), 6) AS q0, round(quantile_cont(accuracy, 0.25), 6) AS q1, round(quantile_cont(accuracy, 0.5), 6) AS q2, round(quantile_cont(accuracy, 0.75), 6) AS q3, round(quantile_cont(accuracy, 1), 6) AS q4, round(avg(CASE WHEN accuracy >= 95 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS from_95, round(avg(CASE WHEN accuracy >= 100 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS from_100 FROM recall"))
def accuracy_report(spark, sf):
    one = metrics.report(metrics.recall(s.predicted(spark, sf), s.gold(spark, sf)))
    return rounded(one, *one.columns, digits=6)


@query("histogram", answer("SELECT CAST(least(floor(accuracy / (100.0::DOUBLE / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM recall GROUP BY ALL"))
def histogram(spark, sf):
    return metrics.histogram(metrics.recall(s.predicted(spark, sf), s.gold(spark, sf)), "accuracy", 50, 0.0, 100.0)


@query("banding", answer("SELECT band, count(*) AS n, round(avg(accuracy), 6) AS mean FROM (SELECT *, CASE WHEN accuracy <= 40 THEN 'low' WHEN accuracy BETWEEN 45 AND 60 THEN 'middle' WHEN accuracy BETWEEN 80 AND 100 THEN 'high' END AS band FROM recall) WHERE band IS NOT NULL GROUP BY band"))
def banding(spark, sf):
    return rounded(metrics.banded(metrics.recall(s.predicted(spark, sf), s.gold(spark, sf))), "mean", digits=6)


RESULTS = """results AS (SELECT g.sent_id, CAST(g.matched AS BIGINT) AS matched, g.in_gold, p.predicted, n.n_nodes, n.n_lemmas FROM
  (SELECT g.sent_id, sum(CASE WHEN p.lemma IS NULL THEN 0 ELSE 1 END) AS matched, count(*) AS in_gold FROM gold g LEFT JOIN (SELECT DISTINCT sent_id, lemma FROM guess) p ON p.sent_id = g.sent_id AND p.lemma = g.lemma GROUP BY g.sent_id) g
  JOIN (SELECT sent_id, count(*) AS predicted FROM guess GROUP BY sent_id) p ON p.sent_id = g.sent_id
  JOIN (SELECT sent_id, count(*) AS n_nodes, count(DISTINCT lemma) AS n_lemmas FROM nodes GROUP BY sent_id) n ON n.sent_id = g.sent_id),
"""


@query("result_table", answer("SELECT * FROM results"), RESULTS)
def result_table(spark, sf):
    return metrics.results(s.predicted(spark, sf), s.gold(spark, sf), s.nodes(spark, sf))


@query("merge_last_wins", answer("SELECT sent_id, CAST(1 AS INTEGER) AS shard, lemma FROM (SELECT sent_id, min(lemma) AS lemma FROM guess GROUP BY sent_id) UNION ALL SELECT sent_id, 0, lemma FROM (SELECT sent_id, min(lemma) AS lemma FROM gold GROUP BY sent_id) g WHERE sent_id NOT IN (SELECT sent_id FROM guess)"))
def merge_last_wins(spark, sf):
    one, two = (df.groupBy("sent_id").agg(F.min("lemma").alias("lemma")) for df in (s.gold(spark, sf), s.predicted(spark, sf)))
    return metrics.merged_shards([one, two], "sent_id", once=True).select("sent_id", "shard", "lemma")


@query("merge_all", answer("SELECT sent_id, 0 AS shard, lemma FROM gold UNION ALL SELECT sent_id, 1, lemma FROM guess"))
def merge_all(spark, sf):
    return metrics.merged_shards([s.gold(spark, sf).select("sent_id", "lemma"), s.predicted(spark, sf).select("sent_id", "lemma")], "sent_id", once=False).select("sent_id", "shard", "lemma")


@query("value_counts", answer("SELECT lemma, cng, count(*) AS n FROM gold GROUP BY ALL HAVING count(*) > 1"))
def value_counts(spark, sf):
    return s.gold(spark, sf).groupBy("lemma", "cng").agg(F.count("*").alias("n")).where("n > 1")


@query("describe", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS deviation, min(l_quantity) AS low, max(l_quantity) AS high, quantile_cont(l_quantity, 0.5) AS middle, count(DISTINCT l_partkey) AS parts FROM lineitem")
def describe(spark, sf):
    q = F.col("l_quantity")
    return s.read(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("deviation"), F.min(q).alias("low"), F.max(q).alias("high"), F.percentile(q, F.lit(0.5)).alias("middle"), F.countDistinct("l_partkey").alias("parts"))


# ---- path model


HOPS = "ev AS (SELECT DISTINCT kind, key, sent_id FROM (SELECT '1' AS kind, lemma AS key, sent_id FROM nodes UNION ALL SELECT '2', cng, sent_id FROM nodes UNION ALL SELECT '3', lemma || '_' || cng, sent_id FROM nodes)),\nhop AS MATERIALIZED (SELECT x.kind AS k1, x.key AS x, y.kind AS k2, y.key AS y, count(*)::DOUBLE / any_value(c.n) AS p FROM ev x JOIN ev y ON x.sent_id = y.sent_id JOIN (SELECT kind, key, count(*) AS n FROM ev GROUP BY ALL) c ON c.kind = x.kind AND c.key = x.key GROUP BY x.kind, x.key, y.kind, y.key),\n"
CODES = paths.PATHS


def feature_sql(codes: list[str]) -> str:
    key = {"1": "{t}.lemma", "2": "{t}.cng", "3": "{t}.lemma || '_' || {t}.cng"}
    joins = ""
    for first, second in (("l", "m"), ("m", "r")):
        at = (0, 1) if first == "l" else (1, 2)
        for a, b in sorted({(c[at[0]], c[at[1]]) for c in codes}):
            t = f"h{first}{a}{second}{b}"
            joins += f" LEFT JOIN hop {t} ON {t}.k1 = '{a}' AND {t}.x = {key[a].format(t=first)} AND {t}.k2 = '{b}' AND {t}.y = {key[b].format(t=second)}"
    values = [f"sum(coalesce(hl{c[0]}m{c[1]}.p, 0) * coalesce(hm{c[1]}r{c[2]}.p, 0)) AS f{c}" for c in codes]
    triples = "compat p JOIN compat q ON q.sent_id = p.sent_id AND q.n1 = p.n2 AND q.n2 <> p.n1 JOIN nodes m ON m.sent_id = p.sent_id AND m.node_id = q.n2 AND m.is_verb"
    ends = "JOIN nodes l ON l.sent_id = p.sent_id AND l.node_id = p.n1 JOIN nodes r ON r.sent_id = p.sent_id AND r.node_id = p.n2"
    sums = f"SELECT p.sent_id, p.n1 AS li, p.n2 AS ri, {', '.join(values)} FROM {triples} {ends}{joins} WHERE p.n1 < p.n2 GROUP BY ALL"
    shown = ", ".join(f"coalesce(s.f{c}, 0) AS f{c}" for c in codes)
    return f"sums AS ({sums}),\nfeature AS MATERIALIZED (SELECT p.sent_id, p.n1 AS li, p.n2 AS ri, {shown} FROM compat p LEFT JOIN sums s ON s.sent_id = p.sent_id AND s.li = p.n1 AND s.ri = p.n2 WHERE p.n1 < p.n2),\n"


FEATURE = HOPS + feature_sql(CODES)


@query("evidence_counts", answer("SELECT kind, key, count(*) AS sentences FROM ev GROUP BY ALL"), HOPS)
def evidence_counts(spark, sf):
    return paths.cardinalities(paths.evidence(s.nodes(spark, sf)))


@query("path_steps", answer("SELECT k1, x, k2, y, round(p + 3e-16, 9) AS p FROM hop"), HOPS)
def path_steps(spark, sf):
    found = s.sentences(spark, sf)
    p = block_paths.transitions(found) if found else None
    return rounded(paths.transitions(paths.evidence(s.nodes(spark, sf))) if p is None else p, "p")


@query("path_features", answer("SELECT sent_id, li, ri, " + ", ".join(f"round(f{c}, 8) AS f{c}" for c in CODES) + " FROM feature"), FEATURE)
def path_features(spark, sf):
    if found := s.sentences(spark, sf):
        model = block_paths.fit(found, s.VERB, {}, {}, UNSEEN)
        return rounded(block_paths.feature_rows(found, model, CODES, [f"f{c}" for c in CODES], flag=False), *(f"f{c}" for c in CODES), digits=8)
    nodes, conflict, q = base(spark, sf)
    return rounded(paths.features(nodes, lattice.compatible(nodes, conflict), CODES), *(f"f{c}" for c in CODES), digits=8)


@query("short_scores_nouns", answer("SELECT p.sent_id, p.n1 AS li, p.n2 AS ri, round(coalesce(x.n, 0)::DOUBLE / c.n, 9) AS f400 FROM compat p JOIN nodes a ON a.sent_id = p.sent_id AND a.node_id = p.n1 AND NOT a.is_verb JOIN nodes b ON b.sent_id = p.sent_id AND b.node_id = p.n2 AND NOT b.is_verb JOIN cooc c ON c.a = a.lemma AND c.b = b.lemma LEFT JOIN samecooc x ON x.a = a.lemma AND x.b = b.lemma WHERE p.n1 < p.n2"))
def short_scores_nouns(spark, sf):
    nodes, conflict = of(spark, sf)
    return rounded(paths.noun_pairs(nodes, stats.cooccurrences(nodes, "lemma", same="cng"), stats.cooccurrences(nodes, "lemma"), lattice.compatible(nodes, conflict)), "f400")


@query("short_scores_classes", answer("SELECT r.lemma AS a, c.lemma AS b, round(count(*)::DOUBLE / any_value(w.n), 9) AS f FROM rest r JOIN classed c ON c.sent_id = r.sent_id JOIN (SELECT lemma, count(*) AS n FROM rest GROUP BY lemma) w ON w.lemma = r.lemma GROUP BY r.lemma, c.lemma"), "classed AS (SELECT DISTINCT lemma, sent_id FROM nodes WHERE cng = 'NO'), rest AS (SELECT DISTINCT lemma, sent_id FROM nodes WHERE cng = 'RF' EXCEPT SELECT lemma, sent_id FROM classed),\n")
def short_scores_classes(spark, sf):
    return rounded(paths.class_shares(s.nodes(spark, sf), s.VERB, "NO"), "f")


@query("compound_feature", answer("SELECT c.a, c.b, round(coalesce(x.n::DOUBLE / w.n, 0), 9) AS f999 FROM (SELECT DISTINCT a, b FROM cooc) c LEFT JOIN samecooc x ON x.a = c.a AND x.b = c.b LEFT JOIN (SELECT a, sum(n) AS n FROM samecooc GROUP BY a) w ON w.a = c.a"))
def compound_feature(spark, sf):
    nodes = s.nodes(spark, sf)
    return rounded(paths.compounds(stats.cooccurrences(nodes, "lemma").select("a", "b"), stats.cooccurrences(nodes, "lemma", same="cng")), "f999")


FLAGGED = "flagged AS (SELECT n.sent_id, n.node_id, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.sent_id = n.sent_id AND g.chunk_id = n.chunk_id AND g.lemma = n.lemma AND g.cng = n.cng) THEN 1 ELSE 0 END AS flag FROM nodes n),\n"


def flagged(spark, sf):
    nodes = s.nodes(spark, sf)
    g = s.gold(spark, sf).distinct().withColumn("hit", F.lit(1))
    return nodes.join(g, [*quality.LEMMA, "cng"], "left").select("sent_id", "node_id", F.coalesce("hit", F.lit(0)).alias("flag"))


@query("balanced_sample", answer("SELECT sent_id, node_id, flag FROM flagged WHERE flag = 1 UNION ALL SELECT sent_id, node_id, flag FROM (SELECT *, row_number() OVER (ORDER BY (sent_id * 7919 + node_id * 104729) % 1000003, sent_id, node_id) AS place FROM flagged WHERE flag = 0) WHERE place <= (SELECT count(*) FROM flagged WHERE flag = 1)"), FLAGGED)
def balanced_sample(spark, sf):
    return learn.balanced(flagged(spark, sf), "flag", ["sent_id", "node_id"])


@query("kfold", answer("SELECT sent_id, node_id, CAST(ntile(4) OVER (ORDER BY sent_id, node_id) - 1 AS INTEGER) AS fold FROM nodes"))
def kfold(spark, sf):
    checkpointed(spark)
    return learn.folds(s.nodes(spark, sf).select("sent_id", "node_id"), 4, ["sent_id", "node_id"], s.dealt(spark, sf))


@query("every_second", answer("SELECT sent_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY node_id) AS place FROM nodes) WHERE (place - 1) % 2 = 0"))
def every_second(spark, sf):
    return learn.every_kth(s.nodes(spark, sf).select("sent_id", "node_id"), 2, "sent_id", ["node_id"])


@query("cosine_pairs", "SELECT a.vec_id AS v1, b.vec_id AS v2, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    e = s.read(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("v2"), F.col("embedding").alias("e2"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("v1"), "v2", F.round(text.cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine"))


@query("word2vec")
def word2vec(spark, sf):
    sentences = s.gold(spark, sf).groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "lemma"))), lambda x: x["lemma"]).alias("words"))
    return learn.embeddings(sentences, "words")


# ---- audits and learning that go in order


@query("validate_elimination")
def validate_elimination(spark, sf):
    return audits.eliminated(s.nodes(spark, sf), s.gold(spark, sf), s.RULES)


@query("fill_missing")
def fill_missing(spark, sf):
    sets = s.nodes(spark, sf).groupBy("sent_id", "chunk_id", "pos").agg(F.sort_array(F.collect_list(F.struct("lemma", "cng"))).alias("all"))
    senses = sets.select("sent_id", "chunk_id", F.col("pos").alias("ord"), F.transform("all", lambda x: x["lemma"]).alias("lemmas"), F.array().cast("array<string>").alias("forms"))
    gold = s.gold(spark, sf).groupBy("sent_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("lemma", "cng"))).alias("all"))
    return audits.filled(senses, gold.select("sent_id", "chunk_id", F.transform("all", lambda x: x["lemma"]).alias("lemmas"), F.transform("all", lambda x: x["cng"]).alias("forms")))


@query("training_rows")
def training_rows(spark, sf):
    names = ["w2w", "t2t", "scng"]
    return looped(spark, sf, block_walks.training_steps, names) or audits.training_steps(joined_trace(spark, sf), s.gold(spark, sf), names)


@query("learned_shares")
def learned_shares(spark, sf):
    moves = looped(spark, sf, block_walks.step_moves) or audits.step_moves(joined_trace(spark, sf), s.gold(spark, sf), 3)
    return audits.learned_shares(moves, 3, 0.1, s.dealt(spark, sf))


@query("selection_export")
def selection_export(spark, sf):
    return looped(spark, sf, block_walks.exported) or audits.exported(walk.chosen(joined_trace(spark, sf)), s.nodes(spark, sf))
