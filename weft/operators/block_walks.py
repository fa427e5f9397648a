"""Walks, the greedy loop and shortest paths on blocks of sentences: a model's edges are a dense table over its keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weft.operators import blocks, walk
from weft.operators.blocks import Block, Sentences

#: Models by name: whether they go by classes.
MODELS = {"lemma": False, "cng": True, "same": False}


def fit(sentences: Sentences, names: list[str], unseen: float) -> dict[str, np.ndarray]:
    """Smoothed probabilities of all pairs of keys for some of MODELS; same counts pairs that agree in class."""
    size = {name: len(sentences.cngs if by else sentences.lemmas) for name, by in MODELS.items()}

    def tables(block: Block) -> dict[str, np.ndarray]:
        i, j, _, _ = block.pairs()
        out = {}
        for name in names:
            key = block.cng if MODELS[name] else block.lemma
            own = (i != j) & (block.cng[i] == block.cng[j]) if name == "same" else i != j
            out[name] = key[i[own]] * size[name] + key[j[own]]
        return out

    found = blocks.counted(sentences, tables)
    return {name: blocks.smoothed(blocks.dense(found.get(name), size[name], size[name]), name == "same", unseen if name == "cng" else None) for name in names}


def edges(block: Block, nodes: np.ndarray, models: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Transition probabilities (sentences, n, n) of each model between nodes of different sets that don't exclude each other."""
    sets = block.sets[nodes]
    fits = (sets[:, :, None] != sets[:, None, :]) & ~block.squares(nodes)
    key = lambda name: (block.cng if MODELS[name] else block.lemma)[nodes]
    return [walk.stochastic_rows(np.where(fits, p[key(name)[:, :, None], key(name)[:, None, :]], 0.0)) for name, p in models.items()]


def numbers(block: Block, nodes: np.ndarray) -> list[pa.Array]:
    return [pa.array(block.sent[nodes], pa.int64()), pa.array((nodes - block.start[nodes]).astype(np.int32))]


def blended(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float], steps: int, restart: float = walk.RESTART) -> DataFrame:
    """walk.blended() of each model's walk.walk_steps()."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            for _, nodes in block.sizes():
                r = block.query[nodes] / block.query[nodes].sum(axis=1, keepdims=True)
                total = np.zeros(nodes.shape)
                for m, share in zip(edges(block, nodes, models), shares, strict=True):
                    x = r
                    for _ in range(steps):
                        x = (1 - restart) * (x[:, None, :] @ m)[:, 0] + restart * r
                    total += share * walk.stochastic_rows(x)
                yield pa.RecordBatch.from_arrays([*numbers(block, nodes.ravel()), pa.array(total.ravel())], ["sent_id", "node_id", "score"])

    return sentences.map(run, "sent_id bigint, node_id int, score double")


def closure(sentences: Sentences, model: dict[str, np.ndarray], rounds: int) -> DataFrame:
    """walk.closure() of a model's edges."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            for n, nodes in block.sizes(2):
                (p,) = edges(block, nodes, model)
                with np.errstate(divide="ignore"):
                    d = 1 / p
                for _ in range(rounds):
                    old = d.copy()
                    for k in range(n):
                        np.minimum(d, old[:, :, k : k + 1] + old[:, k : k + 1, :], out=d)
                    d[:, np.arange(n), np.arange(n)] = np.inf
                b, i, j = np.nonzero(np.isfinite(d))
                src, dst = nodes[b, i], nodes[b, j]
                yield pa.RecordBatch.from_arrays([*numbers(block, src), numbers(block, dst)[1], pa.array(d[b, i, j])], ["sent_id", "src", "dst", "d"])

    return sentences.map(run, "sent_id bigint, src int, dst int, d double")


def looped(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float], made: Callable[[Block, walk.Step], pa.RecordBatch], schema: str) -> DataFrame:
    """What `made` makes of every step of the greedy loop."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            for _, nodes in block.sizes(2):
                for part in walk.steps(block, nodes, edges(block, nodes, models), shares):
                    yield made(block, part)

    return sentences.map(run, schema)


def trace(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float]) -> DataFrame:
    """walk.trace()."""
    names = np.array(sentences.lemmas, object)

    def made(block: Block, part: walk.Step) -> pa.RecordBatch:
        own = part.source == 1 if part.step == 0 else np.ones(part.nodes.shape, bool)
        nodes = part.nodes[own]
        source = np.full(len(nodes), "initial_query", object) if part.step == 0 else walk.SOURCES[part.source[own]]
        ranked = None if part.step == 0 else (part.scores.reshape(len(part.scores), -1).T, part.blend.ravel(), part.rank.ravel())
        return walk.rows_of(block.sent[nodes], np.full(len(nodes), part.step), nodes - block.start[nodes], names[block.lemma[nodes]], source, ranked)

    return looped(sentences, models, shares, made, walk.TRACE)


def is_chosen(part: walk.Step) -> np.ndarray:
    return part.source == 1 if part.step == 0 else (part.source == 3) | (part.source == 5)


def predict(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float]) -> DataFrame:
    """walk.predict()."""
    names = np.array(sentences.lemmas, object)
    return looped(sentences, models, shares, lambda block, part: walk.chosen_rows(block, part, is_chosen(part), names), walk.CHOSEN)


def exported(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float]) -> DataFrame:
    """audits.exported() of the chosen nodes."""
    names, kinds = np.array(sentences.lemmas, object), np.array(sentences.cngs, object)

    def made(block: Block, part: walk.Step) -> pa.RecordBatch:
        own = is_chosen(part) & (part.source != 5)
        nodes, rows = part.nodes[own], walk.chosen_rows(block, part, own, names)
        surface = pc.cast(block.surface.take(pa.array(nodes)), pa.string())
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), surface, pa.array(kinds[block.cng[nodes]], pa.string()), pa.array(block.pos[nodes]), rows.column(4)], ["sent_id", "step", "lemma", "surface", "cng", "pos", "source"])

    return looped(sentences, models, shares, made, "sent_id bigint, step int, lemma string, surface string, cng string, pos int, source string")


def training_steps(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float], names: list[str]) -> DataFrame:
    """audits.training_steps() of the trace."""

    def made(block: Block, part: walk.Step) -> pa.RecordBatch:
        none = part.step == 0
        own = np.zeros(part.nodes.shape, bool) if none else part.rank >= np.where(part.source == 3, part.rank, 0).max(axis=1, keepdims=True)
        nodes = part.nodes[own]
        scores = [pa.array(np.empty(0) if none else x[own]) for x in (names if none else part.scores)]
        sent, node = numbers(block, nodes)
        return pa.RecordBatch.from_arrays([sent, pa.array(np.full(len(nodes), part.step, np.int32)), node, *scores, pa.array(block.known[nodes].astype(np.int32))], ["sent_id", "step", "node_id", *names, "flag"])

    return looped(sentences, models, shares, made, "sent_id bigint, step int, node_id int, " + "".join(f"{m} double, " for m in names) + "flag int")


def step_moves(sentences: Sentences, models: dict[str, np.ndarray], shares: list[float]) -> DataFrame:
    """audits.step_moves() of the trace."""

    def made(block: Block, part: walk.Step) -> pa.RecordBatch:
        if part.step == 0:
            sent, moves = np.empty(0, np.int64), np.empty((0, len(models)))
        else:
            free, known = (part.source != 1) & (part.source != 2), block.known[part.nodes]
            best = lambda own: np.where(own, part.scores, -np.inf).max(axis=2)
            hit, other = best(free & known), best(free & ~known)
            both = np.isfinite(hit) & np.isfinite(other)
            sent, moves = block.sent[part.nodes[:, 0]], np.where(both, np.where(both, hit, 0) - np.where(both, other, 0), 0.0).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sent) + 1, dtype=np.int32) * len(models)), pa.array(moves.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(sent), pa.array(np.full(len(sent), part.step, np.int32)), lists], ["sent_id", "step", "moves"])

    return looped(sentences, models, shares, made, "sent_id bigint, step int, moves array<double>")
