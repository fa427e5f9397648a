"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Vectors of one pivot and one ring of distances form
an annulus; annuli become blocks of bounded size, whatever they hold. A query sorts the annuli by the best score that
they can hold and goes through them in rounds of growing size, from its own block on; with each round its k-th score
rises, and it stops where no annulus that is left can reach it. For an annulus of pivot p with distances from low to high,

    q.x <= q.p + |q| high                                (Cauchy-Schwarz)
    q.x <= (|q|^2 + max|x|^2 - gap^2) / 2                (triangle inequality)

where gap is how far the query's distance to p lies outside low..high. Pivots are fitted on a bounded sample; the index
holds every row, and the bounds hold for any pivots, so the result is exact. How much of the index was visited depends on
the vectors: clusters are left out, independent random components leave nothing out; search_with_visits() tells.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null vec_id. A query
is compared with vectors of its own length. Of rows with equal vec_id none is the query's candidate. Copies of a vector
are all candidates, ties go to the smaller vec_id. Scores are exact 64-bit integers. Query rows with equal vec_id are
queries of their own: each has its k results under their common query_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import mix64, prepare, table

#: Rows that pivots are fitted on at most; vectors of a block at most (about); pivots and rings of a vector length at most.
SAMPLE, BLOCK, PIVOTS, RINGS = 20_000, 2048, 256, 8
OUTER = 4 * RINGS
#: Annuli that all executors know at most: (OUTER + 1) * PIVOTS for each vector length, so enough for 100 lengths.
ANNULI = 1_000_000
#: Each round goes through so many times as many annuli as the one before.
GROWTH = 3

KEYED = "vec_id bigint, asks boolean, dim int, pivot int, distance double, norm double, vector binary"
PACKED = "block bigint, dim int, pivot int, ring int, part int, low double, high double, norm double, ids binary, asks binary, vectors binary"
#: Queries of one home block and, for each, its k best so far (best first), and how many annuli they have left to visit.
STATE = "home bigint, dim int, places binary, queries binary, vectors binary, ids binary, scores binary, visited bigint, left bigint"
ASKED = "block bigint, home bigint, rows binary, own binary, floors binary, asked binary"
HITS = "home bigint, rows binary, ids binary, scores binary"


def usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the rows that take part, by vector length: vec_id, whether each asks, and the integer vectors."""
    column = batch.column(2)
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    lengths = np.diff(offsets)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    asks = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    for dim in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == dim))
        x = np.floor(scale * flat[offsets[rows][:, None] + np.arange(dim)])
        fine = np.isfinite(x).all(axis=1)
        yield ids[rows][fine], asks[rows][fine], x[fine]


class Pivots:
    """Pivots for each vector length."""

    def __init__(self, sample: list[np.ndarray], n_pivots: int):
        self.of = {}
        for dim in {x.shape[1] for x in sample if len(x)}:
            x = np.unique(np.concatenate([v for v in sample if v.shape[1] == dim]), axis=0)
            chosen = x[np.argsort(mix64(np.arange(len(x), dtype=np.uint64)))[:n_pivots]].copy()
            for _ in range(5):
                near = self.distances(x, chosen).argmin(axis=1)
                for k in np.unique(near):
                    chosen[k] = x[near == k].mean(axis=0)
            self.of[dim] = chosen
            d = self.distances(x, chosen).min(axis=1)
            self.of[dim, "ring"] = max(1e-9, float(np.ptp(np.quantile(d, [0.01, 0.99]))) / RINGS)

    @staticmethod
    def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T))

    def get(self, dim: int) -> np.ndarray:
        return self.of.get(dim, np.zeros((1, dim)))


NAMES = ["vec_id", "asks", "dim", "pivot", "distance", "norm", "vector"]


def key_rows(vectors: DataFrame, pivots: Pivots, scale: float) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, asks, x in usable(batch, scale):
                d = Pivots.distances(x, sent.value.get(x.shape[1]))
                near = d.argmin(axis=1)
                data, width = x.astype("<i8").tobytes(), 8 * x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(asks), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array((x * x).sum(axis=1)), pa.array([data[k : k + width] for k in range(0, len(data), width)], pa.binary())], NAMES)

    return vectors.mapInArrow(run, KEYED)


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split(" ") for x in schema.split(",")]
    data = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, TYPES[t]) for v, (_, t) in zip(data, fields, strict=True)], [n for n, _ in fields])


def pack_blocks(keyed: DataFrame, pivots: Pivots) -> DataFrame:
    """Blocks of about BLOCK vectors at most, each of one annulus; large annuli are dealt to several blocks."""
    ring = F.coalesce(*[F.when(F.col("dim") == dim, F.floor(F.col("distance") / pivots.of[dim, "ring"])) for dim in pivots.of if isinstance(dim, int)], F.lit(0))
    # Equal rows of one input partition are dealt alike, those of different ones apart.
    ringed = keyed.withColumn("deal", F.xxhash64("vec_id", "vector", F.spark_partition_id())).withColumn("ring", F.least(ring, F.lit(OUTER)).cast("int"))
    parts = ringed.groupBy("dim", "pivot", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = ringed.join(parts, ["dim", "pivot", "ring"]).withColumn("part", F.pmod("deal", F.col("parts")).cast("int"))

    def run(found: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(found["vector"].to_pylist()), "<i8")
        d = found["distance"].to_numpy()
        first = [found[c][0].as_py() for c in ("dim", "pivot", "ring", "part")]
        row = (block_of(*first), *first, float(d.min()), float(d.max()), float(found["norm"].to_numpy().max()), found["vec_id"].to_numpy().astype("<i8").tobytes(), found["asks"].to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), narrow(x))
        return pa.Table.from_batches([columns([row], PACKED)])

    return dealt.select("vec_id", "asks", "dim", "pivot", "distance", "norm", "vector", "ring", "part").groupBy("dim", "pivot", "ring", "part").applyInArrow(run, PACKED)


def block_of(dim: int, pivot: int, ring: int, part: int) -> int:
    """A number of its own for each block: 17 bits of length (a longer one is mixed), 8, 6 and 32 bits."""
    return ((dim if dim < 1 << 16 else (1 << 16) | dim * 0x9E37 % (1 << 16)) << 46) | (pivot << 38) | (ring << 32) | part


def narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold all of them; the first byte tells how many."""
    top = int(np.abs(x).max()) if len(x) else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def wide(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where they hold them exactly, else by 64-bit integers."""
    q, x = q.astype(np.int64), x.astype(np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


LEAST = np.iinfo(np.int64).min


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vec_id, score) of each query's k best of a block that reach its floor, by row and from the best on."""
    rows, found, got = [], [], []
    for r in range(len(own)):
        at = np.flatnonzero((ids != own[r]) & (scores[r] >= floors[r]))
        if len(at) > k:
            kth = np.partition(scores[r][at], len(at) - k)[len(at) - k]
            at = at[scores[r][at] >= kth]
        at = at[np.lexsort((ids[at], -scores[r][at]))][:k]
        rows.append(np.full(len(at), r))
        found.append(ids[at])
        got.append(scores[r][at])
    return tuple(np.concatenate([*x, np.empty(0, np.int64)]) for x in (rows, found, got))


def merged(n: int, k: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables (n, k) of the best ids and scores of each row, LEAST where there are fewer."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    best, top = np.zeros((n, k), np.int64), np.full((n, k), LEAST)
    best[rows[keep], place[keep]], top[rows[keep], place[keep]] = ids[keep], scores[keep]
    return best, top


class Annuli:
    """What all executors know of the index: of each annulus its bounds and its number of blocks."""

    def __init__(self, rows: list, pivots: Pivots):
        self.pivots = pivots
        self.dim, self.pivot, self.ring, self.parts = (np.array([r[c] for r in rows], np.int64) for c in ("dim", "pivot", "ring", "parts"))
        self.low, self.high, self.norm = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high", "norm"))

    def order(self, q: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The annuli of the queries' length; for each query the place of each in its order, and whether it can reach the floor."""
        own = np.flatnonzero(self.dim == q.shape[1])
        p, pivot = self.pivots.get(q.shape[1]), self.pivot[own]
        d, dots, size = Pivots.distances(q, p)[:, pivot], (q @ p.T)[:, pivot], (q * q).sum(axis=1)[:, None]
        gap = np.maximum(0, np.maximum(d - self.high[own], self.low[own] - d) - 1e-6)
        most = np.minimum(dots + np.sqrt(size) * self.high[own], (size + self.norm[own] - gap * gap) / 2)
        reach = most * (1 + 1e-9) + 1e-3 * (1 + np.abs(most) * 1e-6) >= floors[:, None].astype(np.float64)
        place = np.empty(most.shape, np.int64)
        np.put_along_axis(place, np.argsort(-most, axis=1, kind="stable"), np.arange(len(own))[None, :], axis=1)
        return own, place, reach


def search_with_visits(vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """search()'s rows, and the share of all pairs of a query and a block of its length that were visited."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), "embedding")
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("vec_id")).limit(sample).toArrow()
    pivots = Pivots([x for b in chosen.to_batches() for *_, x in usable(b, scale)], max(4, min(PIVOTS, n // (4 * BLOCK))))
    index = pack_blocks(key_rows(rows, pivots, scale), pivots).checkpoint()
    listed = index.groupBy("dim", "pivot", "ring").agg((F.max("part") + 1).alias("parts"), F.count("*").alias("blocks"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).limit(ANNULI + 1).collect()
    if len(listed) > ANNULI:
        raise ValueError(f"vectors of so many lengths have more than {ANNULI} annuli")
    annuli = Annuli(listed, pivots)
    sent = spark.sparkContext.broadcast(annuli)

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(b["asks"], np.uint8))
                if len(at):
                    ids, x = np.frombuffer(b["ids"], "<i8"), wide(b["vectors"], b["dim"])
                    best, top = merged(len(at), k, *best_of(products(x[at], x), ids, ids[at], k, np.full(len(at), LEAST)))
                    rows.append((b["block"], b["dim"], at.astype("<i8").tobytes(), ids[at].tobytes(), narrow(x[at].ravel()), best.tobytes(), top.tobytes(), len(at), 1))
            yield columns(rows, STATE)

    state, low, high = index.mapInArrow(own_block, STATE).checkpoint(), 0, GROWTH
    while low < len(listed) and (state.agg(F.sum("left")).first()[0] or 0) > 0:
        state = one_round(index, state, sent, k, low, high).checkpoint()
        low, high = high, high * GROWTH

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                queries, best, top = np.frombuffer(s["queries"], "<i8"), *(np.frombuffer(s[c], np.int64).reshape(-1, k) for c in ("ids", "scores"))
                r, place = np.nonzero(top > LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(queries[r]), pa.array((place + 1).astype(np.int32)), pa.array(best[r, place]), pa.array(top[r, place])], ["query_id", "rank", "vec_id", "score"])

    blocks = {d: sum(r["blocks"] for r in listed if r["dim"] == d) for d in {r["dim"] for r in listed}}
    work = state.groupBy("dim").agg(F.sum("visited").alias("visited"), F.sum(F.octet_length("queries") / 8).alias("queries")).collect()
    every = sum(r["queries"] * blocks[r["dim"]] for r in work)
    return state.mapInArrow(results, "query_id bigint, rank int, vec_id bigint, score bigint"), sum(r["visited"] for r in work) / every if every else 0.0


def search(vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of vec_id, embedding for which asks is true."""
    return search_with_visits(vectors, asks, k, scale, sample)[0]


def one_round(index: DataFrame, state: DataFrame, sent, k: int, low: int, high: int) -> DataFrame:
    """state after each query has gone through the annuli that stand from low to high in its order and reach its floor."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = sent.value
        for batch in batches:
            for s in batch.to_pylist():
                q = wide(s["vectors"], s["dim"])
                ids, floors = np.frombuffer(s["queries"], "<i8"), np.frombuffer(s["scores"], np.int64).reshape(-1, k)[:, k - 1]
                own, place, reach = annuli.order(q.astype(np.float64), floors)
                go = reach & (place >= low) & (place < high)
                for j in np.flatnonzero(go.any(axis=0)).tolist():
                    r = np.flatnonzero(go[:, j])
                    data = (r.astype("<i8").tobytes(), ids[r].tobytes(), floors[r].tobytes(), narrow(q[r].astype(np.int64).ravel()))
                    a = own[j]
                    for part in range(int(annuli.parts[a])):
                        block = block_of(s["dim"], int(annuli.pivot[a]), int(annuli.ring[a]), part)
                        if block != s["home"]:
                            yield columns([(block, s["home"], *data)], ASKED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                rows, own, floors = (np.frombuffer(b[c], "<i8") for c in ("rows", "own", "floors"))
                r, ids, scores = best_of(products(wide(b["asked"], b["dim"]), wide(b["vectors"], b["dim"])), np.frombuffer(b["ids"], "<i8"), own, k, floors)
                out.append((b["home"], np.concatenate([rows, rows[r]]).tobytes(), np.concatenate([np.zeros(len(rows), np.int64), ids]).tobytes(), np.concatenate([np.full(len(rows), LEAST), scores]).tobytes()))
            yield columns(out, HITS)

    def merge(state: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        for s in state.to_pylist():
            ids, scores = (np.frombuffer(s[c], np.int64).reshape(-1, k) for c in ("ids", "scores"))
            n = len(ids)
            more = [np.concatenate([np.frombuffer(x, np.int64) for x in hits[c].to_pylist()] or [np.empty(0, np.int64)]) for c in ("rows", "ids", "scores")]
            visited = int((more[2] == LEAST).sum())  # one mark for each visit of a query
            real = more[2] > LEAST
            own = scores.ravel() > LEAST
            rows = np.concatenate([np.repeat(np.arange(n), k)[own], more[0][real]])
            best, top = merged(n, k, rows, np.concatenate([ids.ravel()[own], more[1][real]]), np.concatenate([scores.ravel()[own], more[2][real]]))
            _, place, reach = sent.value.order(wide(s["vectors"], s["dim"]).astype(np.float64), top[:, k - 1])
            out.append((s["home"], s["dim"], s["places"], s["queries"], s["vectors"], best.tobytes(), top.tobytes(), s["visited"] + visited, int((reach & (place >= high)).sum())))
        return pa.Table.from_batches([columns(out, STATE)])

    asked = state.mapInArrow(visits, ASKED)
    hits = asked.join(index.select("block", "dim", "ids", "vectors"), "block").mapInArrow(scan, HITS)
    return state.groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(merge, STATE)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
