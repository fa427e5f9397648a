"""Sentences packed in blocks: a row holds the nodes of some thousand whole sentences, compressed.

Steps that look at all pairs of a sentence's nodes read the blocks again and again and shuffle nothing; their lookup
tables are dense over the vocabulary. pack() says what can't be packed: rows with nulls, sentences of more than LONG
nodes, vocabularies beyond TABLE. Callers then take the relational steps, which have no such bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes that a block aims at, nodes of the longest sentence, entries of the largest dense table, junction rules.
ROWS, LONG, TABLE, RULES = 20_000, 1_000, 500_000, 100_000
#: Pairs and triples of nodes that are looked at together.
PAIRS, TRIPLES = 200_000, 1_000_000
CANDIDATE = ["sent_id", "chunk_id", "pos", "lemma", "cng", "surface", "price", "part"]


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole sentences, from batches in order of sentence (the first column)."""
    held, n, limit = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0)
        last = pc.index(ids, ids[-1]).as_py() if ids[-1].is_valid else 0
        if last:
            yield table.slice(0, last)
            table = table.slice(last)
        held, n = table.to_batches(), table.num_rows
        limit = max(ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Codes of a string column in the order of its distinct values, and these."""
    found = column.combine_chunks().dictionary_encode()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    names = found.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return place[found.indices.to_numpy()], [names[k] for k in order]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def sides(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j) of nodes of one sentence, i = j too, and where i's pairs start. n, start: of each node's sentence."""
    at = np.cumsum(n) - n
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - at[i] + start[i], at


class Joints:
    """Junction rules (left, right, length) for surfaces by their codes."""

    def __init__(self, rules: list[tuple[str, str, int]]):
        least: dict[tuple[str, str], int] = {}
        for a, b, n in rules:
            if a is not None and b is not None and n is not None:
                least[a, b] = min(n, least.get((a, b), n))
        self.left, self.right = ({s: k for k, s in enumerate(sorted({r[x] for r in least}))} for x in (0, 1))
        code = np.array([self.left[a] * max(1, len(self.right)) + self.right[b] for a, b in least], np.int64)
        order = np.argsort(code)
        self.codes, self.lengths = code[order], np.array(list(least.values()), np.int64)[order]

    def ends(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each surface the numbers of its last one or two characters as a left side, its first as a right one."""
        tail = np.array([[self.left.get(s[-k:], -1) for s in names] for k in (1, 2)], np.int64)
        head = np.array([[self.right.get(s[:k], -1) for s in names] for k in (1, 2)], np.int64)
        return tail, head

    def shorten(self, tail: np.ndarray, head: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a rule for the sides has a length of less than most."""
        if not len(self.codes):
            return np.zeros(len(tail), bool)
        code = tail * len(self.right) + head
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return (tail >= 0) & (head >= 0) & (self.codes[at] == code) & (self.lengths[at] < most)


SCHEMA = "block binary, odd boolean, longest int, lemmas array<string>, cngs array<string>"


def packed(table: pa.Table, joints: Joints) -> dict:
    """A block of a table of candidates; odd where it holds what a block can't."""
    none = {"block": b"", "odd": True, "longest": 0, "lemmas": [], "cngs": []}
    if any(table.column(c).null_count for c in CANDIDATE) or pc.any(pc.is_nan(table.column("price"))).as_py():
        return none
    sent, chunk, pos, price, part = (table.column(c).to_numpy() for c in ("sent_id", "chunk_id", "pos", "price", "part"))
    (lemma, lemmas), (cng, cngs), (surface, surfaces) = (coded(table.column(c)) for c in ("lemma", "cng", "surface"))
    order = np.lexsort((pos, cng, lemma, part, -price, chunk, sent))
    order = order[changes(sent[order], chunk[order])]
    gold_sent, gold_lemma = sent[order], lemma[order]
    order = np.lexsort((surface, cng, lemma, pos, chunk, sent))
    order = order[changes(*(c[order] for c in (sent, chunk, pos, lemma, cng)))]
    sent, chunk, pos, lemma, cng, surface = (c[order] for c in (sent, chunk, pos, lemma, cng, surface))
    new = changes(sent)
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    n, start = np.diff(np.append(first, len(sent)))[of], first[of]
    if n.max() > LONG:
        return none
    sets = np.cumsum(changes(sent, chunk, pos)) - 1
    sets -= sets[start]
    known = np.isin(of * len(lemmas) + lemma, np.searchsorted(sent[first], gold_sent) * len(lemmas) + gold_lemma)
    length = np.array([len(s) for s in surfaces], np.int64)[surface]
    i, j, _ = sides(n, start)
    near = (i < j) & (chunk[i] == chunk[j])
    i, j = i[near], j[near]
    over = np.maximum(pos[i].astype(np.int64) + length[i] - pos[j], 0)
    stands = over == 0
    few = np.flatnonzero((over == 1) | (over == 2))
    if len(few):
        tail, head = joints.ends(surfaces)
        o, a, b = over[few], surface[i[few]], surface[j[few]]
        stands[few] = joints.shorten(tail[o - 1, a], head[0, b], o + 1) | joints.shorten(tail[0, a], head[o - 1, b], o + 1)
    rivals = ~(stands & (pos[i] < pos[j]))
    i, j = np.concatenate([i[rivals], j[rivals]]), np.concatenate([j[rivals], i[rivals]])
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    against = np.bincount(i, minlength=len(sent))
    query = against == 0
    forced = np.flatnonzero(~np.bincount(of, query, minlength=len(first)).astype(bool)[of])
    forced = forced[np.lexsort((forced, -against[forced], -length[forced], of[forced]))]
    query[forced[changes(of[forced])] if len(forced) else forced] = True
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(against)).astype(np.int32)), pa.array((j - start[j]).astype(np.int32)))
    names = lambda codes, values: pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), pa.array(values, pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(sent, pa.int64()), pa.array(chunk.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(sets.astype(np.int32)), names(lemma, lemmas), names(cng, cngs), names(surface, surfaces), pa.array(known), pa.array(query), lists], ["sent_id", "chunk", "pos", "set", "lemma", "cng", "surface", "known", "query", "against"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return {"block": sink.getvalue().to_pybytes(), "odd": False, "longest": int(n.max()), "lemmas": lemmas, "cngs": cngs}


@dataclass
class Sentences:
    """Blocks and the vocabulary that they use."""

    rows: DataFrame
    lemmas: list[str]
    cngs: list[str]

    def map(self, run: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        lemmas, cngs = ({s: k for k, s in enumerate(names)} for names in (self.lemmas, self.cngs))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(Block.read(x, lemmas, cngs) for batch in batches for x in batch.column(0))

        return self.rows.select("block").mapInArrow(each, schema)


@dataclass
class Block:
    """The nodes of some sentences: numbers of lemmas and classes, size and start of each node's sentence, rivals."""

    sent: np.ndarray
    chunk: np.ndarray
    pos: np.ndarray
    sets: np.ndarray
    lemma: np.ndarray
    cng: np.ndarray
    known: np.ndarray
    query: np.ndarray
    n: np.ndarray
    start: np.ndarray
    rival: np.ndarray
    other: np.ndarray
    surface: pa.Array = field(repr=False)

    @staticmethod
    def read(value: pa.BinaryScalar, lemmas: dict, cngs: dict) -> Block:
        with pa.ipc.open_stream(value.as_buffer()) as stream:
            batch = stream.read_next_batch()
        numbers = lambda c, known: np.array([known[s] for s in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()]
        plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        sent, lists = plain("sent_id"), batch.column("against")
        new = changes(sent)
        of, first = np.cumsum(new) - 1, np.flatnonzero(new)
        n, start = np.diff(np.append(first, len(sent)))[of], first[of]
        rival = np.repeat(np.arange(len(sent)), np.diff(lists.offsets.to_numpy()))
        return Block(sent, plain("chunk"), plain("pos"), plain("set"), numbers(batch.column("lemma"), lemmas), numbers(batch.column("cng"), cngs), plain("known"), plain("query"), n, start, rival, lists.values.to_numpy() + start[rival], batch.column("surface"))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """i, j of all pairs of one sentence, whether they can stand together (i <> j), and where i's pairs start."""
        i, j, at = sides(self.n, self.start)
        fits = i != j
        fits[at[self.rival] + self.other - self.start[self.rival]] = False
        return i, j, fits, at

    def once(self, key: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """The first node with each key in each sentence, of those that count."""
        rows = np.arange(len(key)) if among is None else np.flatnonzero(among)
        order = rows[np.lexsort((rows, key[rows], self.start[rows]))]
        out = np.zeros(len(key), bool)
        if len(order):
            out[order[changes(self.start[order], key[order])]] = True
        return out

    def sizes(self, least: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """n and the nodes (sentences, n) of sentences of n nodes, a bounded number at a time."""
        heads = np.unique(self.start)
        for n in np.unique(self.n[heads]).tolist():
            if n >= least:
                own = heads[self.n[heads] == n]
                step = max(1, PAIRS * 2 // (n * n))
                for k in range(0, len(own), step):
                    yield n, own[k : k + step, None] + np.arange(n)

    def squares(self, nodes: np.ndarray) -> np.ndarray:
        """Which nodes of the given sentences exclude each other (sentences, n, n)."""
        b, n = nodes.shape
        place = np.full(len(self.sent), -1)
        place[nodes[:, 0]] = np.arange(b)
        of = place[self.start[self.rival]]
        own = of >= 0
        out = np.zeros((b, n, n), bool)
        out[of[own], self.rival[own] - self.start[self.rival[own]], self.other[own] - self.start[self.rival[own]]] = True
        return out


def pack(candidates: DataFrame, rules: DataFrame) -> Sentences | None:
    """candidates (CANDIDATE, rows of a sentence in one partition) as blocks; None if they can't be packed."""
    known = [tuple(r) for r in rules.select("left", "right", "length").limit(RULES + 1).collect()]
    if len(known) > RULES:
        return None
    joints = Joints(known)
    kinds = dict(candidates.dtypes)
    ordered = candidates.select("sent_id", *(F.col(c) for c in CANDIDATE[1:6]), F.col("price").cast("double").alias("price"), "part")
    assert kinds["sent_id"] == "bigint", "sentences are numbered"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.binary()), ("odd", pa.bool_()), ("longest", pa.int32()), ("lemmas", pa.list_(pa.string())), ("cngs", pa.list_(pa.string()))])
        for table in whole(batches):
            yield pa.RecordBatch.from_pylist([packed(table, joints)], schema)

    rows = ordered.sortWithinPartitions("sent_id").mapInArrow(run, SCHEMA).checkpoint()
    found = rows.agg(F.max("odd"), F.max("longest")).first()
    if found[0] or (found[1] or 0) > LONG:
        return None
    names = []
    for column in ("lemmas", "cngs"):
        values = sorted(r[0] for r in rows.select(F.explode(column)).distinct().limit(TABLE + 1).collect())
        names.append(values)
    a, b = map(len, names)
    return Sentences(rows, *names) if a * b * max(a, b) <= TABLE else None


def counted(sentences: Sentences, tables: Callable[[Block], dict[str, np.ndarray]]) -> dict[str, dict[int, int]]:
    """Numbers of each code of each table, added up over all blocks."""

    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in blocks:
            for name, codes in tables(block).items():
                own = np.bincount(codes)
                old = total.get(name, own[:0])
                if len(old) < len(own):
                    old = np.pad(old, (0, len(own) - len(old)))
                old[: len(own)] += own
                total[name] = old
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["name", "code", "n"])

    out: dict[str, dict[int, int]] = {}
    for r in sentences.map(run, "name string, code bigint, n bigint").groupBy("name", "code").agg(F.sum("n")).collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def dense(found: dict[int, int] | None, *shape: int) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)), np.int64)
    if found:
        out[np.fromiter(found, np.int64)] = np.fromiter(found.values(), np.int64)
    return out.reshape(shape)


def smoothed(counts: np.ndarray, halve: bool = False, unseen: float | None = None) -> np.ndarray:
    """stats.smoothed() of all pairs of keys."""
    partners, total = (counts > 0).sum(axis=1).astype(float), counts.sum(axis=1).astype(float)
    contexts = float(np.count_nonzero(counts) // (2 if halve else 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (0.5 * np.maximum(partners, 1.0) / (total + 1.0))[:, None]
        p = np.where(counts > 0, np.maximum(counts - 0.5, 0.0) / (total + 1.0)[:, None] + rest * partners / contexts, rest * np.maximum(partners, 1.0) / contexts)
    if unseen is not None:
        p = np.where((partners == 0)[:, None] | (partners == 0)[None, :], unseen, p)
    return p
