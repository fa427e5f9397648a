"""Random walks with restart, ranking and the greedy choice of a compatible reading.

Single rounds are relational. The loop, in which each round depends on the one before, runs on one row per sentence
(arrays of its nodes and matrices, built by Spark) in Arrow batches; sentences don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESTART, ROUNDS, CLOSE, AT_LEAST = 0.4, 500, 1e-10, 25


def walk_steps(nodes: DataFrame, edges: DataFrame, query: DataFrame, steps: int, restart: float = RESTART) -> DataFrame:
    """sent_id, node_id, score after a fixed number of steps, each a join and a sum; restarts go to the query nodes."""
    starts = query.select("sent_id", "node_id").distinct()
    share = F.count("*").over(Window.partitionBy("sent_id"))
    r = nodes.select("sent_id", "node_id").join(starts.withColumn("r", F.lit(1.0) / share), ["sent_id", "node_id"], "left").select("sent_id", "node_id", F.coalesce("r", F.lit(0.0)).alias("r"))
    x = r.select("sent_id", "node_id", F.col("r").alias("x"))
    for _ in range(steps):
        moved = edges.join(x.select("sent_id", F.col("node_id").alias("src"), "x"), ["sent_id", "src"]).groupBy("sent_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("x") * F.col("p")).alias("m"))
        x = r.join(moved, ["sent_id", "node_id"], "left").select("sent_id", "node_id", (F.lit(1 - restart) * F.coalesce("m", F.lit(0.0)) + F.lit(restart) * F.col("r")).alias("x"))
    return x.select("sent_id", "node_id", F.col("x").alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """Nodes by score, the higher node first among equals; scores are rounded so that engines agree on ties."""
    order = Window.partitionBy("sent_id").orderBy(F.round("score", 9).desc(), F.desc("node_id"))
    return scores.withColumn("rank", F.row_number().over(order).cast("int"))


def winners(scores: DataFrame, query: DataFrame) -> DataFrame:
    """The first node of each sentence that isn't a query node."""
    open_nodes = scores.join(query.select("sent_id", "node_id"), ["sent_id", "node_id"], "left_anti")
    return open_nodes.groupBy("sent_id").agg(F.max_by("node_id", F.struct(F.round("score", 9).alias("s"), F.col("node_id").alias("k"))).alias("node_id"))


def blended(scores: list[DataFrame], shares: list[float]) -> DataFrame:
    """Several scores of the same nodes, each made to sum to one in its sentence, by weight."""
    whole = Window.partitionBy("sent_id")
    out = None
    for k, (df, share) in enumerate(zip(scores, shares, strict=True)):
        one = df.withColumn("whole", F.sum("score").over(whole)).select("sent_id", "node_id", (F.lit(share) * F.when(F.col("whole") > 0, F.col("score") / F.col("whole")).otherwise(0.0)).alias(f"s{k}"))
        out = one if out is None else out.join(one, ["sent_id", "node_id"])
    total: Column = sum((F.col(f"s{k}") for k in range(1, len(scores))), F.col("s0"))
    return out.select("sent_id", "node_id", total.alias("score"))


def stochastic(m: np.ndarray) -> np.ndarray:
    total = m.sum(axis=1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total > 0)


def stochastic_rows(m: np.ndarray) -> np.ndarray:
    """m with its last axis made to sum to one; zeros stay."""
    total = m.sum(axis=-1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total > 0)


def walk(prior: np.ndarray, matrix: np.ndarray, query: list[int], gone: list[int] = (), first: list[int] = (), restart: float = RESTART, rounds: int = ROUNDS, most: bool = False) -> np.ndarray:
    """Stationary scores of a walk that restarts at the query nodes.

    Several query nodes are merged into the first one. Without nodes of an earlier query the columns add up and the
    merged row follows from column and prior; else nodes that have joined since count a tenth, columns before rows. The
    restart mass of merged nodes has no way on and leaks. most: merge by the maximum instead of the sum.
    """
    t = matrix.copy()
    t[list(gone)] = 0
    t[:, list(gone)] = 0
    if len(query) > 1:
        to, others = query[0], query[1:]
        old = [q for q in query if q in set(first)]
        new = [q for q in query if q not in set(first)]
        if most:
            t[:, to] = t[:, query].max(axis=1)
            t[:, others] = 0
            t[to] = t[query].max(axis=0)
        elif not len(first):
            t[:, to] = t[:, query].sum(axis=1)
            t[:, others] = 0
            row = t[:, to] * prior
            t[to] = row / row.sum() if row.sum() > 0 else 0
        else:
            t[:, to] = t[:, old].sum(axis=1) + 0.1 * t[:, new].sum(axis=1)
            t[:, others] = 0
            t[to] = t[old].sum(axis=0) + 0.1 * t[new].sum(axis=0)
        t[others] = 0
    t = stochastic(t)
    r = np.zeros(len(t))
    r[list(query)] = 1 / len(query)
    x = r.copy()
    for i in range(rounds):
        now = (1 - restart) * x @ t + restart * r
        done = np.abs(now - x).max() < CLOSE and i > AT_LEAST
        x = now
        if done:
            break
    return x


def diameter_restart(diameter: float) -> float:
    """The restart probability with which a walk still reaches over the graph's diameter."""
    return 1 - 0.045 ** (1 / diameter) if 0 < diameter < float("inf") else 0.0


def shortest(matrix: np.ndarray, keep: list[int], more: float = 0.0) -> np.ndarray:
    """All shortest paths between some nodes, an edge of probability p being 1 / (p + more) long."""
    p = matrix[np.ix_(keep, keep)]
    with np.errstate(divide="ignore"):
        d = np.where((p > 0) | (more > 0), 1 / (p + more), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def limits(t: np.ndarray, query: np.ndarray, first: np.ndarray, gone: np.ndarray, restart: float = RESTART) -> np.ndarray:
    """What walk() converges to, for many sentences of one size at once.

    t: matrices (b, n, n); query, first, gone: masks (b, n), the first node of `first` being the one others merge into.
    """
    b, n = query.shape
    t = t * ~gone[:, :, None] * ~gone[:, None, :]
    every, to = np.arange(b), first.argmax(axis=1)
    weight = (query & first) + 0.1 * (query & ~first)
    one = t * ~query[:, None, :]
    one[every, :, to] = (t @ weight[:, :, None])[:, :, 0]
    row = (weight[:, None, :] @ one)[:, 0]
    one *= ~query[:, :, None]
    one[every, to] = row
    t = np.where((query.sum(axis=1) > 1)[:, None, None], one, t)
    total = t.sum(axis=2, keepdims=True)
    t = np.divide(t, total, out=np.zeros_like(t), where=total > 0)
    r = query / query.sum(axis=1, keepdims=True)
    return np.linalg.solve(np.eye(n) - (1 - restart) * t.transpose(0, 2, 1), restart * r[:, :, None])[:, :, 0]


SOURCES = np.array(["open", "query", "gone", "winner", "removed", "expanded"])


def greedy(matrices: list[np.ndarray], against: np.ndarray, chunk: np.ndarray, first: np.ndarray, shares: list[float], by: str = "walk", compat_mode: bool = False) -> Iterator[tuple]:
    """The rounds of many sentences of one size: sentences, step, scores (models, b, n), blend, rank, source (b, n).

    matrices (b, n, n) and shares are those of the models; against (b, n, n): which nodes exclude each other; first: the
    initial query. by: "walk" ranks by walks from the query nodes, "path" by the sum of their rows. compat_mode: nodes
    that an initial query node excludes stay open, so that a reading may hold both.
    """
    n = first.shape[1]
    query, gone = first.copy(), np.zeros_like(first)
    if not compat_mode:
        gone = (against & query[:, :, None]).any(axis=1) & ~query
    live, step = np.flatnonzero((query | gone).sum(axis=1) < n), 0
    while len(live):
        step += 1
        q, g, rows = query[live], gone[live], np.arange(len(live))
        if by == "path":
            scores = np.stack([(q[:, None, :] @ m[live])[:, 0] for m in matrices])
        else:
            x = np.stack([limits(m[live], q, first[live], g) for m in matrices])
            total = x.sum(axis=2, keepdims=True)
            scores = np.divide(x, total, out=np.zeros_like(x), where=total > 0)
        blend = np.round(np.tensordot(np.array(shares), scores, 1), 9)
        order = n - 1 - np.argsort(-blend[:, ::-1], axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(1, n + 1)[None, :], axis=1)
        win = np.where(q | g, n + 1, rank).argmin(axis=1)
        source = np.where(q, 1, np.where(g, 2, 0))
        q[rows, win] = True
        removed = against[live, win] & ~q & ~g
        g |= removed
        rest = (chunk[live] == chunk[live, win][:, None]) & ~g & ~q
        lone = rest & ~(against[live] & rest[:, None, :]).any(axis=2)
        source[removed], source[lone] = 4, 5
        source[rows, win] = 3
        yield live, step, scores, blend, rank, source
        query[live], gone[live] = q | lone, g
        live = live[(query[live] | gone[live]).sum(axis=1) < n]


@dataclass
class Step:
    """A step of some sentences of a block: their nodes (sentences, n), scores (models, sentences, n) and the rest (sentences, n)."""

    step: int
    nodes: np.ndarray
    source: np.ndarray
    scores: np.ndarray | None = None
    blend: np.ndarray | None = None
    rank: np.ndarray | None = None


def steps(block, nodes: np.ndarray, matrices: list[np.ndarray], shares: list[float], by: str = "walk", compat_mode: bool = False) -> Iterator[Step]:
    """The greedy loop of sentences of one size in a block; step 0 has the initial query nodes as source 1."""
    first = block.query[nodes]
    yield Step(0, nodes, first.astype(int))
    for live, at, scores, blend, rank, source in greedy(matrices, block.squares(nodes), block.chunk[nodes], first, shares, by, compat_mode):
        yield Step(at, nodes[live], source, scores, blend, rank)


CHOSEN = "sent_id bigint, step int, node_id int, lemma string, source string"


def chosen_rows(block, part: Step, own: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Some nodes of a step, as in CHOSEN."""
    nodes = part.nodes[own]
    source = np.full(len(nodes), "initial_query", object) if part.step == 0 else SOURCES[part.source[own]].astype(object)
    return pa.RecordBatch.from_arrays([pa.array(block.sent[nodes], pa.int64()), pa.array(np.full(len(nodes), part.step, np.int32)), pa.array((nodes - block.start[nodes]).astype(np.int32)), pa.array(names[block.lemma[nodes]], pa.string()), pa.array(source, pa.string())], CHOSEN.replace(" bigint", "").replace(" int", "").replace(" string", "").split(", "))


TRACE = "sent_id bigint, step int, node_id int, lemma string, source string, scores array<double>, score double, rank int"


def trace(nodes: DataFrame, conflict: DataFrame, query: DataFrame, edges: list[DataFrame], shares: list[float], by: str = "walk", compat_mode: bool = False) -> DataFrame:
    """Every step of the greedy loop: step 0 has the initial query nodes; each further step all nodes of the sentence with
    the scores of the models, their blend, the rank, and what the step makes of the node (source).

    Sentences of one node are left out, as there is nothing to choose. edges: what models make of (nodes, counts), each as
    sent_id, src, dst, p.
    """
    keyed = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "chunk_id", "lemma"))).alias("__n"))
    rows = keyed.where(F.size("__n") > 1).select("sent_id", F.col("__n.chunk_id").alias("chunk_id"), F.col("__n.lemma").alias("lemma"))
    rows = rows.join(query.groupBy("sent_id").agg(F.sort_array(F.collect_list("node_id")).alias("query")), "sent_id")
    rows = rows.join(conflict.groupBy("sent_id").agg(*(F.collect_list(c).alias(c) for c in ("n1", "n2"))), "sent_id", "left")
    for k, e in enumerate(edges):
        rows = rows.join(e.groupBy("sent_id").agg(*(F.collect_list(c).alias(f"{c}{k}") for c in ("src", "dst", "p"))), "sent_id", "left")
    rows = rows.select("sent_id", "chunk_id", "lemma", "query", "n1", "n2", *(f"{c}{k}" for k in range(len(edges)) for c in ("src", "dst", "p")))
    n_edges = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {f.name: (c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name not in ("sent_id", "lemma")}
            words = batch.column("lemma").to_pylist()
            sent = batch.column("sent_id").to_numpy()
            size = np.diff(flat["chunk_id"][0])

            def lists(name: str, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The entries of some sentences' lists, and which of them each belongs to."""
                at, values = flat[name]
                length = at[own + 1] - at[own]
                places = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(at[own], length)
                return values[places], np.repeat(np.arange(len(own)), length)

            for n in np.unique(size).tolist():
                every = np.flatnonzero(size == n)
                step = max(1, (1 << 20) // (n * n))
                for own in (every[k : k + step] for k in range(0, len(every), step)):
                    b = len(own)
                    first, against = np.zeros((b, n), bool), np.zeros((b, n, n), bool)
                    value, of = lists("query", own)
                    first[of, value] = True
                    (n1, of), (n2, _) = lists("n1", own), lists("n2", own)
                    against[of, n1, n2] = True
                    matrices = [np.zeros((b, n, n)) for _ in range(n_edges)]
                    for k, m in enumerate(matrices):
                        (src, of), (dst, _), (p, _) = (lists(f"{c}{k}", own) for c in ("src", "dst", "p"))
                        m[of, src, dst] = p
                    chunk = lists("chunk_id", own)[0].reshape(b, n)
                    s, k = np.nonzero(first)
                    yield rows_of(sent[own[s]], np.zeros(len(s)), k, [words[own[x]][y] for x, y in zip(s.tolist(), k.tolist(), strict=True)], np.full(len(s), "initial_query"), None)
                    for live, at, scores, blend, rank, source in greedy(matrices, against, chunk, first, shares, by, compat_mode):
                        c = len(live)
                        yield rows_of(np.repeat(sent[own[live]], n), np.full(c * n, at), np.tile(np.arange(n), c), [w for x in live.tolist() for w in words[own[x]]], SOURCES[source.ravel()], (scores.reshape(n_edges, -1).T, blend.ravel(), rank.ravel()))

    return rows.mapInArrow(run, TRACE)


def rows_of(sent, step, node, words, source, ranked) -> pa.RecordBatch:
    n = len(sent)
    if ranked is None:
        more = [pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32())]
    else:
        scores, blend, rank = ranked
        more = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel())), pa.array(blend), pa.array(rank.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(sent, pa.int64()), pa.array(step.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(words, pa.string()), pa.array(source, pa.string()), *more], ["sent_id", "step", "node_id", "lemma", "source", "scores", "score", "rank"])


def predict(nodes: DataFrame, conflict: DataFrame, query: DataFrame, edges: list[DataFrame], shares: list[float], by: str = "walk", compat_mode: bool = False) -> DataFrame:
    """sent_id, step, node_id, lemma, source: the compatible reading that the greedy loop chooses for every sentence."""
    return chosen(trace(nodes, conflict, query, edges, shares, by, compat_mode))


def chosen(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("source").isin("initial_query", "winner", "expanded")).select("sent_id", "step", "node_id", "lemma", "source")


def closure(edges: DataFrame, rounds: int) -> DataFrame:
    """sent_id, src, dst, d: shortest paths of up to 2 ** rounds edges, an edge of probability p being 1 / p long."""
    d = edges.where("p > 0").select("sent_id", "src", "dst", (F.lit(1.0) / F.col("p")).alias("d"))
    for _ in range(rounds):
        on = d.select("sent_id", F.col("dst").alias("via"), "src", F.col("d").alias("d1")).join(d.select("sent_id", F.col("src").alias("via"), "dst", F.col("d").alias("d2")), ["sent_id", "via"]).where("src <> dst")
        d = d.unionByName(on.select("sent_id", "src", "dst", (F.col("d1") + F.col("d2")).alias("d"))).groupBy("sent_id", "src", "dst").agg(F.min("d").alias("d"))
    return d
