"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pandas as pd
import pytest

from weft.plans import catalog, more, path_model  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = ["greedy_trace", "greedy_predict", "greedy_accuracy", "greedy_path", "logreg_weights", "fold_weights", "word2vec", "validate_elimination", "fill_missing", "training_rows", "learned_shares", "selection_export"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if not isinstance(v, list) and pd.isna(v) else v for v in r) for r in df.itertuples(index=False)), key=repr)


def normal(values):
    return [tuple(float(v) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiub" else float(v) if isinstance(v, int) else v for v in r) for r in values]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(name, spark, sf, duck):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(normal(rows(ours)), key=repr) == sorted(normal(rows(theirs)), key=repr)


def test_queries_without_sql_are_listed():
    assert set(catalog.QUERIES) - set(catalog.SQL) == set(WITHOUT_SQL)


def test_greedy_choice_is_compatible_and_complete(spark, sf):
    from weft.operators import lattice
    from weft.plans import surrogate

    nodes = surrogate.nodes(spark, sf)
    conflict = lattice.conflicts(nodes, surrogate.rules(spark))
    chosen = catalog.QUERIES["greedy_predict"](spark, sf).checkpoint()
    pairs = chosen.select("sent_id", chosen.node_id.alias("n1")).join(chosen.select("sent_id", chosen.node_id.alias("n2")), "sent_id").where("n1 <> n2")
    assert pairs.join(conflict, ["sent_id", "n1", "n2"], "left_semi").isEmpty()
    assert chosen.groupBy("sent_id", "node_id").count().where("count > 1").isEmpty()
    # Every node is chosen or excluded by a chosen one.
    many = nodes.groupBy("sent_id").count().where("count > 1").select("sent_id")
    left = nodes.join(many, "sent_id").join(chosen, ["sent_id", "node_id"], "left_anti").select("sent_id", nodes.node_id.alias("n2"))
    excluded = conflict.join(chosen.select("sent_id", chosen.node_id.alias("n1")), ["sent_id", "n1"], "left_semi").select("sent_id", "n2")
    assert left.join(excluded, ["sent_id", "n2"], "left_anti").isEmpty()


def test_elimination_and_filling(spark):
    from weft.operators import audits

    nodes = spark.createDataFrame([(1, 0, 0, 0, 0, "abc", "x", "n"), (1, 1, 1, 0, 2, "cd", "y", "n"), (1, 2, 2, 0, 9, "q", "z", "n"), (1, 3, 3, 1, 0, "w", "v", "n")], "sent_id long, node_id int, set_id int, chunk_id int, pos int, surface string, lemma string, cng string")
    gold = spark.createDataFrame([(1, 0, "x", "other")], "sent_id long, chunk_id int, lemma string, cng string")
    assert audits.eliminated(nodes, gold, []).first().live == 2
    assert audits.eliminated(nodes, gold, [("c", "c", 1)]).first().live == 3
    senses = spark.createDataFrame([(1, 0, 0, ["a", "b"], ["7"]), (1, 0, 1, ["c"], []), (1, 0, 2, ["a"], [])], "sent_id long, chunk_id int, ord int, lemmas array<string>, forms array<string>")
    known = spark.createDataFrame([(1, 0, ["a", "b", "a"], ["1", "2", "3"])], "sent_id long, chunk_id int, lemmas array<string>, forms array<string>")
    got = {r.ord: r.forms for r in audits.filled(senses, known).collect()}
    assert got == {0: ["7", "2"], 1: [], 2: ["3"]}


def test_shares_are_learned_in_order(spark):
    from weft.operators import audits

    rows = [(1, 1, "x", [0.9, 0.1], 1, "winner"), (1, 1, "y", [0.1, 0.9], 2, "open"), (1, 1, "z", [5.0, 5.0], 3, "gone"), (2, 1, "x", [0.2, 0.8], 2, "open"), (2, 1, "y", [0.8, 0.2], 1, "winner"), (2, 2, "y", [0.5, 0.5], 1, "winner"), (2, 0, "q", None, None, "initial_query")]
    steps = spark.createDataFrame(rows, "sent_id long, step int, lemma string, scores array<double>, rank int, source string")
    gold = spark.createDataFrame([(1, "x"), (2, "x"), (1, "z")], "sent_id long, lemma string")
    got = audits.learned_shares(audits.step_moves(steps, gold, 2), 2, 0.1).orderBy("sent_id", "step").collect()
    assert [(r.sent_id, r.step) for r in got] == [(1, 1), (2, 1), (2, 2)]
    assert got[0].before == [0.5, 0.5] and got[0].shares == pytest.approx([0.58, 0.42]) == got[1].before
    assert got[1].moves == pytest.approx([-0.6, 0.6]) and got[1].shares == pytest.approx([0.52, 0.48]) == got[2].shares


def one_by_one(n, matrices, rivals, chunk, query, shares, by="walk"):
    """The greedy loop of one sentence by walk.walk(), round by round."""
    import numpy as np

    from weft.operators import walk

    first, query = list(query), list(query)
    gone = set().union(*(rivals[q] for q in query)) - set(query)
    out, step = [(0, q, "initial_query") for q in query], 0
    while len(query) + len(gone) < n:
        step += 1
        total = np.zeros(n)
        for m, share in zip(matrices, shares, strict=True):
            x = m[query].sum(axis=0) if by == "path" else walk.walk(np.ones(n), m, query, sorted(gone), first)
            total += share * (x if by == "path" else x / x.sum())
        total = np.round(total, 9)
        win = max((k for k in range(n) if k not in query and k not in gone), key=lambda k: (total[k], k))
        query.append(win)
        out.append((step, win, "winner"))
        gone |= rivals[win] - set(query)
        rest = [k for k in range(n) if chunk[k] == chunk[win] and k not in gone and k not in query]
        for k in [k for k in rest if not rivals[k] & set(rest)]:
            query.append(k)
            out.append((step, k, "expanded"))
    return sorted(out)


@pytest.mark.parametrize("by", ["walk", "path"])
def test_rounds_of_many_sentences_are_those_of_each(by):
    import numpy as np

    from weft.operators import walk

    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 9):
        b = 40
        against = np.triu(rng.random((b, n, n)) < 0.35, 1)
        chunk = rng.integers(0, 2, (b, n))
        against = (against | against.transpose(0, 2, 1)) & (chunk[:, :, None] == chunk[:, None, :])
        matrices = [np.where(against | np.eye(n, dtype=bool), 0, rng.random((b, n, n))) for _ in range(2)]
        first = ~against.any(axis=2)
        first[~first.any(axis=1), 0] = True
        want = [one_by_one(n, [m[k] for m in matrices], [set(np.flatnonzero(against[k, i]).tolist()) for i in range(n)], chunk[k], np.flatnonzero(first[k]).tolist(), [0.4, 0.6], by) for k in range(b)]
        got = [[(0, int(k), "initial_query") for k in np.flatnonzero(f)] for f in first]
        for live, step, _, blend, rank, source in walk.greedy(matrices, against, chunk, first, [0.4, 0.6], by):
            assert all(sorted(r) == list(range(1, n + 1)) for r in rank.tolist())
            for k, names in zip(live.tolist(), walk.SOURCES[source].tolist(), strict=True):
                got[k] += [(step, i, name) for i, name in enumerate(names) if name in ("winner", "expanded")]
        assert [sorted(g) for g in got] == want


def test_greedy_query_agrees_with_one_sentence_at_a_time(spark, sf):
    import numpy as np

    from weft.operators import stats

    nodes, conflict, q = catalog.base(spark, sf)
    counts, same, cng = stats.cooccurrences(nodes, "lemma"), stats.cooccurrences(nodes, "lemma", same="cng"), stats.cooccurrences(nodes, "cng")
    edges = [stats.edges_smoothed(nodes, "lemma", counts, conflict), stats.edges_smoothed(nodes, "cng", cng, conflict, unseen=1 / 440000), stats.edges_smoothed(nodes, "lemma", same, conflict, halve=True)]
    sample = "sent_id % 7 = 0"
    size, chunk, lists = {}, {}, {"q": {}, "c": {}, "e": [{}, {}, {}]}
    for r in nodes.where(sample).orderBy("sent_id", "node_id").collect():
        chunk.setdefault(r.sent_id, []).append(r.chunk_id)
    for r in q.where(sample).orderBy("sent_id", "node_id").collect():
        lists["q"].setdefault(r.sent_id, []).append(r.node_id)
    for r in conflict.where(sample).collect():
        lists["c"].setdefault(r.sent_id, []).append((r.n1, r.n2))
    for k, e in enumerate(edges):
        for r in e.where(sample).collect():
            lists["e"][k].setdefault(r.sent_id, []).append((r.src, r.dst, r.p))
    got = {}
    for r in catalog.greedy_predict(spark, sf).where(sample).collect():
        got.setdefault(r.sent_id, []).append((r.step, r.node_id, r.source))
    many = [i for i in chunk if len(chunk[i]) > 1]
    assert len(many) > 50 and sorted(got) == sorted(many)
    for i in many:
        n = len(chunk[i])
        rivals = [set() for _ in range(n)]
        for a, b in lists["c"].get(i, ()):
            rivals[a].add(b)
        matrices = []
        for k in range(3):
            m = np.zeros((n, n))
            for a, b, p in lists["e"][k].get(i, ()):
                m[a, b] = p
            matrices.append(m)
        assert sorted(got[i]) == one_by_one(n, matrices, rivals, chunk[i], lists["q"][i], [1 / 3] * 3)


def test_training_rows_of_a_trace(spark):
    from weft.operators import audits

    rows = [(1, 1, 0, "a", [0.5], 1, "query"), (1, 1, 1, "b", [0.4], 2, "winner"), (1, 1, 2, "c", [0.1], 3, "open"), (1, 0, 0, "a", None, None, "initial_query")]
    steps = spark.createDataFrame(rows, "sent_id long, step int, node_id int, lemma string, scores array<double>, rank int, source string")
    gold = spark.createDataFrame([(1, "b")], "sent_id long, lemma string")
    assert sorted(map(tuple, audits.training_steps(steps, gold, ["w"]).collect())) == [(1, 1, 1, 0.4, 1), (1, 1, 2, 0.1, 0)]


def test_pickles_are_read_and_never_run(spark, tmp_path):
    import json
    import os
    import pickle

    from weft.sources import readers

    (tmp_path / "a.p").write_bytes(pickle.dumps({"x": [1, (2, "ā")], "s": {3}}))
    (tmp_path / "b.p").write_bytes(b"cos\nsystem\n(S'touch %b'\ntR." % str(tmp_path / "ran").encode())
    (tmp_path / "c.p").write_bytes(b"broken")
    got = {r.file: r.json for r in readers.pickles(spark, str(tmp_path / "*.p")).collect()}
    assert json.loads(got["a.p"]) == {"x": [1, [2, "ā"]], "s": [3]} and got["b.p"] is None and got["c.p"] is None and not os.path.exists(tmp_path / "ran")


def test_learning_queries_have_all_columns(spark, sf):
    weights = catalog.QUERIES["logreg_weights"](spark, sf).collect()
    assert len(path_model.LIVE) == 25 and len(path_model.COLUMNS) == 29 and set(path_model.WEIGHTS) < set(path_model.COLUMNS)
    assert {(r.fold, r.column) for r in weights} == {(k, c) for k in range(4) for c in path_model.COLUMNS}
    assert {len(r.vector) for r in catalog.QUERIES["word2vec"](spark, sf).collect()} == {100}


def test_all_queries_are_registered():
    assert len(catalog.QUERIES) > 120 and more.scratch
