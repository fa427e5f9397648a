"""Tables of sentences are dealt to parts of a bounded number of rows."""

import pytest

from weft.plans import catalog, more, path_model, surrogate  # noqa: F401


def values(df):
    return sorted((tuple(tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_parts_grow_with_the_rows(spark):
    assert surrogate.parts(spark, 0) == surrogate.parts(spark, 1) == 1
    assert surrogate.parts(spark, 100 * surrogate.ROWS) == 100
    assert surrogate.parts(spark, surrogate.ROWS) == 8  # the session's


@pytest.mark.parametrize("name", ["class_evidence", "evidence_counts", "kfold", "marker_parts", "path_steps"])
def test_nodes_are_dealt_by_their_number(name, spark, sf, monkeypatch):
    monkeypatch.setattr(surrogate, "ROWS", 200)
    assert surrogate.nodes(spark, sf).rdd.getNumPartitions() == 30 == surrogate.dealt(spark, sf)
    monkeypatch.setattr(surrogate, "BROADCAST_PARTS", 0)  # parts join by a shuffle
    split = values(catalog.QUERIES[name](spark, sf))
    monkeypatch.undo()
    assert split == values(catalog.QUERIES[name](spark, sf))
