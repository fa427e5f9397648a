"""Audits and learning that go through a sentence, or all sentences, in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stands(p1: int, p2: int, first: str, second: str, rules: dict[tuple[str, str], int]) -> bool:
    """Whether a word at p1 and a later one at p2 can stand together under the junction rules."""
    o = max(p1 + len(first) - p2, 0)
    if p1 >= p2 or o > 2:
        return False
    if o == 0:
        return True
    keys = (first[-o:], second[:1]), (first[-1:], second[:o])
    return any(k in rules and rules[k] < o + 1 for k in keys)


def eliminated(nodes: DataFrame, gold: DataFrame, rules: list[tuple[str, str, int]], compat_mode: bool = False) -> DataFrame:
    """sent_id, live: sets of candidates that are left when every gold word has taken its set and ruled out others.

    A gold word takes the first live set of its chunk with its lemma and class, else with its lemma. compat_mode: a
    competitor is judged by its lemma instead of its surface.
    """
    table = {(a, b): n for a, b, n in rules}
    own = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "set_id", "chunk_id", "pos", "surface", "lemma", "cng"))).alias("nodes"))
    want = gold.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "lemma", "cng"))).alias("gold"))

    def live(r: dict) -> int:
        sets: dict[int, list[dict]] = {}
        for n in r["nodes"]:
            sets.setdefault(n["set_id"], []).append(n)
        left = dict.fromkeys(sets)  # in reading order
        for g in r["gold"] or ():
            here = [k for k in left if sets[k][0]["chunk_id"] == g["chunk_id"]]
            hit = next((k for k in here if any(n["lemma"] == g["lemma"] and n["cng"] == g["cng"] for n in sets[k])), None)
            if hit is None:
                hit = next((k for k in here if any(n["lemma"] == g["lemma"] for n in sets[k])), None)
            if hit is None:
                continue
            won = sets[hit][0]
            for k in here:
                n = sets[k][0]
                word = n["lemma"] if compat_mode else n["surface"]
                pair = (n["pos"], won["pos"], word, won["surface"]) if n["pos"] < won["pos"] else (won["pos"], n["pos"], won["surface"], word)
                if n["pos"] == won["pos"] or not stands(*pair, table):
                    del left[k]
        return len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["sent_id"] for r in rows], pa.int64()), pa.array([live(r) for r in rows], pa.int32())], ["sent_id", "live"])

    return own.join(want, "sent_id", "left").mapInArrow(run, "sent_id bigint, live int")


def filled(senses: DataFrame, gold: DataFrame) -> DataFrame:
    """senses (sent_id, chunk_id, ord, lemmas, forms) with forms that gold knows.

    A cursor goes over the chunk's gold lemmas (gold: sent_id, chunk_id, lemmas, forms) while the senses are read in
    order; where it meets its lemma and the sense has no form at that place, the forms are padded and gold's is set.
    """
    kinds = {f.name: f.dataType.simpleString() for f in senses.schema}
    schema = f"sent_id {kinds['sent_id']}, chunk_id {kinds['chunk_id']}, ord {kinds['ord']}, lemmas array<string>, forms array<string>"
    chunks = senses.groupBy("sent_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("ord", "lemmas", "forms"))).alias("senses"))
    known = gold.select("sent_id", "chunk_id", F.col("lemmas").alias("gold_lemmas"), F.col("forms").alias("gold_forms"))

    def fill(r: dict) -> list[dict]:
        want, forms, at = r["gold_lemmas"] or [], r["gold_forms"] or [], 0
        for s in r["senses"]:
            own = list(s["forms"] or ())
            for k, lemma in enumerate(s["lemmas"] or ()):
                if at < len(want) and lemma == want[at]:
                    if k >= len(own):
                        own += [""] * (k + 1 - len(own))
                        own[k] = forms[at]
                    at += 1
            s["forms"] = own
        return r["senses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"sent_id": r["sent_id"], "chunk_id": r["chunk_id"], **s} for r in batch.to_pylist() for s in fill(r)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field("sent_id"), batch.schema.field("chunk_id"), ("ord", pa.int32()), ("lemmas", pa.list_(pa.string())), ("forms", pa.list_(pa.string()))]))

    return chunks.join(known, ["sent_id", "chunk_id"], "left").mapInArrow(run, schema)


def step_moves(steps: DataFrame, gold: DataFrame, models: int) -> DataFrame:
    """sent_id, step, moves: for each model, the score of the step's best gold node less that of its best other node, of
    the nodes that were open; 0 where it has no node of one kind. steps: a trace of the greedy loop."""
    known = gold.select("sent_id", "lemma").distinct().withColumn("hit", F.lit(1))
    rows = steps.where(F.col("rank").isNotNull() & ~F.col("source").isin("query", "gone")).join(known, ["sent_id", "lemma"], "left")
    best = lambda k, hit: F.max(F.when(F.coalesce("hit", F.lit(0)) == hit, F.col("scores")[k]))
    return rows.groupBy("sent_id", "step").agg(F.array(*(F.coalesce(best(k, 1) - best(k, 0), F.lit(0.0)) for k in range(models))).alias("moves"))


def learned_shares(moves: DataFrame, models: int, rate: float, parts: int = 1) -> DataFrame:
    """sent_id, step, before, moves, shares: the weights of the rankings before and after each step of each sentence.

    A step moves each weight by rate * its move, then all are made to sum to one. But for the scale that is a linear map
    (the sum of the weights before is one), and maps of runs of steps multiply. So steps are dealt to ranges in order of
    sentence and step, each range's map is made where it is, the weights at its start follow from the maps before, and
    each range goes through its steps from there. Where a step's weights would sum to zero, one range holds all.
    """
    rows = moves.select("sent_id", "step", "moves")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, bad, n, at = np.eye(models), False, 0, -1
        for batch in batches:
            move = rate * batch.column("moves").flatten().to_numpy().reshape(-1, models)
            bad |= bool((np.abs(1 + move.sum(axis=1)) < 1e-9).any())
            maps = np.eye(models) + move[:, :, None]
            while len(maps) > 1:  # products of neighbours, later ones on the left
                even = np.matmul(maps[1::2], maps[: len(maps) // 2 * 2 : 2])
                maps = np.concatenate([even, maps[len(maps) // 2 * 2 :]])
                maps /= np.abs(maps).max(axis=(1, 2), keepdims=True)
            n += batch.num_rows
            at = batch.column("part")[0].as_py() if batch.num_rows else at
            for m in maps:
                whole = m @ whole
                whole /= np.abs(whole).max()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bad]), pa.array([whole.ravel()], pa.list_(pa.float64()))], ["part", "bad", "map"])

    if parts > 1:
        rows = rows.repartitionByRange(parts, "sent_id", "step").sortWithinPartitions("sent_id", "step").withColumn("part", F.spark_partition_id()).checkpoint()
        found = rows.mapInArrow(mapped, "part int, bad boolean, map array<double>").orderBy("part").collect()
        if any(r.bad for r in found):
            return learned_shares(rows, models, rate)
    else:
        rows, found = rows.repartition(1).sortWithinPartitions("sent_id", "step").withColumn("part", F.lit(0)), []
    start, starts = np.full(models, 1 / models), {}
    for r in found:
        starts[r.part] = start.tolist()
        start = np.array(r.map).reshape(models, models) @ start
        start = start / start.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = None
        for batch in batches:
            before, after = [], []
            if share is None and batch.num_rows:
                share = starts.get(batch.column("part")[0].as_py(), [1 / models] * models)
            for move in batch.column("moves").to_pylist():
                before.append(share)
                share = [s + rate * m for s, m in zip(share, move, strict=True)]
                total = sum(share)
                share = [s / total for s in share] if total else share
                after.append(share)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, kind), batch.column(2), pa.array(after, kind)], ["sent_id", "step", "before", "moves", "shares"])

    return rows.mapInArrow(run, "sent_id bigint, step int, before array<double>, moves array<double>, shares array<double>")


def training_steps(steps: DataFrame, gold: DataFrame, models: list[str]) -> DataFrame:
    """sent_id, step, node_id, the models' scores, flag: for each step of a trace, the nodes that rank at or after its
    winner, and whether their lemma is gold."""
    won = steps.where("source = 'winner'").select("sent_id", "step", F.col("rank").alias("won"))
    known = gold.select("sent_id", "lemma").distinct().withColumn("hit", F.lit(1))
    rows = steps.join(won, ["sent_id", "step"]).where("rank >= won").join(known, ["sent_id", "lemma"], "left")
    return rows.select("sent_id", "step", "node_id", *(F.col("scores")[k].alias(m) for k, m in enumerate(models)), F.coalesce("hit", F.lit(0)).alias("flag"))


def exported(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """The chosen nodes with their words: first query nodes and one winner a step; promoted nodes aren't exported."""
    return chosen.where("source <> 'expanded'").join(nodes.select("sent_id", "node_id", "surface", "cng", "pos"), ["sent_id", "node_id"]).select("sent_id", "step", "lemma", "surface", "cng", "pos", "source")
