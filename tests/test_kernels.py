"""The numeric kernels and column functions on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import morph, text
from weft.operators import paths, walk
from weft.sources import readers

T = np.array([[0, 0.3, 0.5, 0, 0.2], [0.25, 0, 0, 0, 0.75], [0, 0, 0, 0, 0], [0.5, 0.4, 0, 0, 0.1], [0.9, 0, 0.1, 0, 0]])


def test_walk_with_one_query_node_solves_the_linear_system():
    x = walk.walk(np.full(5, 0.2), T, [4], restart=0.1)
    r = np.eye(5)[4]
    assert np.allclose(x, np.linalg.solve(np.eye(5) - 0.9 * walk.stochastic(T).T, 0.1 * r), atol=1e-8)


def test_merged_query_nodes_leak_their_restart_mass():
    x = walk.walk(np.full(5, 0.2), T, [1, 4], first=[1], restart=0.1)
    assert x.sum() < 1 and x[4] == pytest.approx(0.05)


def test_deactivated_nodes_get_nothing():
    assert walk.walk(np.full(5, 0.2), T, [4], gone=[0])[0] == 0


def test_shortest_paths():
    m = np.array([[0, 0.2, 0.1, 0.8], [0.9, 0, 0.05, 0.05], [0.2, 0.2, 0, 0.6], [0.25, 0.25, 0.5, 0]])
    d = walk.shortest(m, [0, 2, 3])
    assert d[0, 1] == pytest.approx(1 / 0.8 + 1 / 0.5) and d[0, 2] == pytest.approx(1 / 0.8) and d[1, 2] == pytest.approx(1 / 0.6)
    assert 0 < walk.diameter_restart(d.max()) < 1 and walk.diameter_restart(float("inf")) == 0


def test_live_path_columns():
    live = [c for c in paths.PATHS if c[1:] != "21"]
    assert len(paths.PATHS) == 20 and len(live) == 17 and len(live) + 5 + 3 == 25


def test_words(spark):
    df = spark.createDataFrame([("khānai", ""), ("yad_x", "yadi"), ("va", "va"), (None, None), ("", "")], "w string, s string")
    got = df.select(text.transliterate(F.col("w")), text.normal_lemma(F.col("w"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("KAnE", "KAnE"), ("yad_x", "yadi"), ("va", "iva"), (None, None), ("", "")]


def test_prefixes_are_tried_in_order(spark):
    df = spark.createDataFrame([("abcab",), ("xbc",), ("a",)], "w string")
    got = df.select(text.without_prefix(F.col("w"), ["ab", "a"]), text.after_prefix(F.col("w"), ["ab", "a"])).collect()
    assert [tuple(r) for r in got] == [("c", "cab"), ("xbc", "xbc"), ("", "")]


def test_locatives_in_compat_mode(spark):
    df = spark.createDataFrame([("noun", "loc. sg. m.")], "f string, c string")
    assert tuple(df.select(morph.word_class(F.col("f"), F.col("c")), morph.word_class(F.col("f"), F.col("c"), True)).first()) == (169, 49)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rpu,ripu,14374,1\r\nx,y,2,3\r\n")
    rows = readers.csv_rows(spark, str(tmp_path / "a.csv"), "skt string, dcs string, file int, chunk int").collect()
    assert [tuple(r) for r in rows] == [("rpu", "ripu", 14374, 1), ("x", "y", 2, 3)]
    lines = spark.createDataFrame([('1, "a", "b", "c"',), ("1, a, b, c d",), ("short",), ("1,x,y,z,w",)], "value string")
    assert [tuple(r) for r in readers.rule_lines(lines).collect()] == [("a", "b", 'c"'), ("x", "y", "z")]
    nested = spark.createDataFrame([('{"a": {"b": 2, "c": 3}}',)], "j string")
    assert sorted(map(tuple, readers.nested_counts(nested, "j").collect())) == [("a", "b", 2), ("a", "c", 3)]
    df = spark.range(250)
    readers.write_sharded(df.coalesce(1), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 250


def test_merging_by_the_largest():
    t = T.copy()
    x = walk.walk(np.full(5, 0.2), t, [1, 4], restart=0.1, most=True)
    merged = t.copy()
    merged[:, 1], merged[:, 4] = t[:, [1, 4]].max(axis=1), 0
    merged[1], merged[4] = merged[[1, 4]].max(axis=0), 0
    merged = walk.stochastic(merged)
    r = np.array([0, 0.5, 0, 0, 0.5])
    assert np.allclose(x, np.linalg.solve(np.eye(5) - 0.9 * merged.T, 0.1 * r), atol=1e-8) and (t == T).all()
