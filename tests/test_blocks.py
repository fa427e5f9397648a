"""Steps on blocks of sentences give what the joins give, and keep little."""

import os

import numpy as np
import pytest

from weft.operators import audits, block_walks, blocks, learn, walk
from weft.plans import catalog, more, path_model, surrogate  # noqa: F401


def kept(spark):
    """Bytes in the checkpoint folder."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)


def values(df):
    return sorted((tuple(tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["constant_columns", "greedy_path", "path_feature_table", "pcrw_rank", "shortest_paths"])
def test_tables_of_pairs_are_not_kept(name, spark, sf):
    catalog.cut(spark, spark.range(1))
    before = kept(spark)
    catalog.QUERIES[name](spark, sf).count()
    assert kept(spark) - before < 60 * 6_000  # bytes of a node of the candidate table


@pytest.mark.parametrize("name", ["greedy_path", "pcrw_rank", "path_feature_table", "path_steps"])
def test_paths_by_blocks_and_by_joins(name, spark, sf, monkeypatch):
    by_blocks = values(catalog.QUERIES[name](spark, sf))
    monkeypatch.setattr(blocks, "TABLE", 0)
    assert surrogate.sentences(spark, sf) is None
    assert values(catalog.QUERIES[name](spark, sf)) == by_blocks


def test_loop_by_blocks_and_by_joins(spark, sf):
    trace, gold = catalog.joined_trace(spark, sf).checkpoint(), surrogate.gold(spark, sf).checkpoint()
    assert values(catalog.greedy_trace(spark, sf)) == values(trace)
    assert values(catalog.greedy_predict(spark, sf)) == values(walk.chosen(trace))
    assert values(catalog.training_rows(spark, sf)) == values(audits.training_steps(trace, gold, ["w2w", "t2t", "scng"]))
    assert values(catalog.selection_export(spark, sf)) == values(audits.exported(walk.chosen(trace), surrogate.nodes(spark, sf)))
    assert values(catalog.looped(spark, sf, block_walks.step_moves)) == values(audits.step_moves(trace, gold, 3))


@pytest.mark.parametrize("odd", [False, True])
def test_shares_are_learned_in_ranges(spark, odd):
    rng = np.random.default_rng(5)
    rows = [(k // 3, k % 3, rng.uniform(-0.3, 0.32, 3).tolist()) for k in range(3000)]
    if odd:
        rows[1500] = (500, 0, [-10.0, 0.0, 0.0])  # the weights sum to zero
    moves = spark.createDataFrame(rows, "sent_id long, step int, moves array<double>").repartition(5)
    one, many = (audits.learned_shares(moves, 3, 0.1, parts) for parts in (1, 6))
    assert (many.rdd.getNumPartitions() > 3) != odd
    one, many = ([(r.sent_id, r.step, *r.before, *r.shares) for r in df.orderBy("sent_id", "step").collect()] for df in (one, many))
    assert len(one) == 3000 and np.allclose(one, many, rtol=1e-9, atol=1e-12)


def test_odd_candidates_are_not_packed(spark):
    rows = [(1, 0, 6, "a", "RF", "xy", 1.0, 1), (1, 0, 12, "b", "NO", "z", 2.0, 2), (2, 0, 6, "c", "NO", "z", 2.0, 2)]
    schema = "sent_id long, chunk_id int, pos int, lemma string, cng string, surface string, price double, part long"
    catalog.cut(spark, spark.range(1))
    rules = surrogate.rules(spark)
    make = lambda rows: blocks.pack(spark.createDataFrame(rows, schema).repartition(2, "sent_id"), rules)
    got = make(rows)
    assert (got.lemmas, got.cngs) == (["a", "b", "c"], ["NO", "RF"])
    assert make([]).lemmas == []
    for k in range(8):
        assert make([*rows, tuple(None if at == k else v for at, v in enumerate(rows[0]))]) is None
    assert make([(1, 0, k, "a", "NO", "x", 1.0, k) for k in range(blocks.LONG + 1)]) is None
    assert make([(1, 0, k, "a", "NO", "x", 1.0, k) for k in range(blocks.LONG)]) is not None


def test_sentences_stay_whole_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "ROWS", 4)
    ids = np.repeat([1, 2, 3, 4], [1, 11, 2, 3])
    parts = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 3])], ["sent_id"]) for k in range(0, len(ids), 3)]
    got = [t.column(0).to_pylist() for t in blocks.whole(iter(parts))]
    assert sum(got, []) == ids.tolist() and len(got) > 1
    assert all(set(a).isdisjoint(b) for k, a in enumerate(got) for b in got[:k])


def test_weights_are_the_minimum(spark, sf):
    """No penalised loss is less: its gradient at the weights is zero for each fold."""
    got = {(r.fold, r.column): r.weight for r in catalog.QUERIES["logreg_weights"](spark, sf).collect()}
    rows = learn.folds(path_model.table(spark, sf), 4, ["sent_id", "li", "ri"]).toPandas()
    x, y, fold = rows[path_model.COLUMNS].to_numpy(), rows["flag"].to_numpy(), rows["fold"].to_numpy()
    for f in range(4):
        w, own = np.array([got[f, c] for c in path_model.COLUMNS]), fold != f
        gradient = x[own].T @ (1 / (1 + np.exp(-x[own] @ w)) - y[own]) + w
        assert np.abs(gradient).max() < 1e-6
