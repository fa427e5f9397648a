"""Removal of repeated passages: every window of words that also starts earlier in the corpus.

Documents are dealt to shards of some megabytes by a hash of doc_id; the text moves once, and all passes read that same
shuffle. Windows of a shard are hashed in one vector operation; within a shard the first occurrence of a window is found
at once, so that only one occurrence per shard takes part in what follows, however common the passage.

1. Every shard makes a partial count-min sketch of its distinct windows, ROWS rows of counters. The counters are cut into
   slices of fixed width whose number grows with the corpus; a shard sends each slice the sorted counters that it hits.
2. Merging a slice sums the partial counts. It sends back to each shard those of its counters that reach 2: counts are
   never too low, so a window of two shards has all its counters there.
3. Every shard sends the windows all of whose counters came back, now with 128-bit hashes, to be grouped exactly; the
   earliest occurrence stays and the others are reported to their shards.
4. Every shard removes the words that its reported windows and its own repeats cover.

Sketch slices, buckets of windows and shards have bounded size at any corpus size, and nothing is sent to all tasks or
to the driver.

Null and empty texts have no words and remove nothing. Texts of fewer words than a window never repeat. Rows with equal
doc_id are ordered by their text, equal rows arbitrarily (their results are then the same but for which of them is
first). A null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SHARD_BYTES, as_bytes, mix64, pack, prepare, table, unpack, windows

WINDOW = 20
#: Rows of the sketch, counters in a slice, and counters of a row for each byte of text (a word has about six bytes).
ROWS, SLICE, PER_BYTE = 2, 1 << 24, 0.6
#: Bytes of text whose windows one bucket groups.
BUCKET_BYTES = 16 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NONE = np.iinfo(np.int64).min

CELLS = "shard int, slice int, cells binary"
CLAIMS = "shard int, bucket int, hashes binary, docs binary, starts binary"
LATE = "shard int, late binary"
CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after the other, and how many each has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, ends = split.flatten(), split.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(words), 0)  # white space at an edge leaves an empty word
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), np.diff(before[ends - ends[0]])


class Shard:
    """Words of some documents, in order of doc_id and text, and the hashes of their windows."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        whole = as_bytes(texts)
        order = sorted(range(len(ids)), key=lambda k: (NONE if ids[k] is None else ids[k], whole[k] or b""))
        self.ids = [ids[k] for k in order]
        self.texts = [whole[k] or b"" for k in order]
        words, lengths = words_of(texts.take(pa.array(order, pa.int64())))
        number = words.dictionary_encode()
        self.window, self.lengths = window, lengths
        seen = number.indices.to_numpy()
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, as_bytes(number.dictionary))), "<u8").reshape(-1, 2)
        self.hash = [mix64(windows(names[:, k][seen], window, base)) for k, base in enumerate(BASES)]
        starts = np.cumsum(lengths) - lengths
        self.starts = starts
        # Windows that lie in one document: where they start in the shard, and in which document.
        count = np.maximum(lengths - window + 1, 0)
        self.doc = np.repeat(np.arange(len(order)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[self.doc]
        self.hash = [h[self.at] for h in self.hash]
        # The first of each kind of window in the shard; windows are in order, so the smallest index is the earliest.
        if len(self.at):
            by = np.argsort(self.hash[0])
            new, clash = self.changes(by)
            if clash:  # windows that share the first half of the hash must stand by the second
                by = np.lexsort((self.hash[1], self.hash[0]))
                new, _ = self.changes(by)
            first = np.zeros(len(by), bool)
            first[np.minimum.reduceat(by, np.flatnonzero(new))] = True
            self.first = np.flatnonzero(first)
        else:
            self.first = np.empty(0, np.int64)

    def changes(self, by: np.ndarray) -> tuple[np.ndarray, bool]:
        """Where another window begins in this order, and whether two share the first half of the hash but not the second."""
        a, b = self.hash[0][by], self.hash[1][by]
        first, second = a[1:] != a[:-1], b[1:] != b[:-1]
        return np.concatenate([[True], first | second]), bool((second & ~first).any())

    def cells(self, slices: int) -> list[np.ndarray]:
        """Counters of the first windows in each row of the sketch."""
        size = np.uint64(slices * SLICE)
        h = self.hash[0][self.first]
        return [mix64(h + np.uint64(r * 0x9E3779B9)) % size for r in range(ROWS)]

    def covered(self, late: np.ndarray) -> np.ndarray:
        """Words inside the given windows and inside the shard's own repeats."""
        bad = np.ones(len(self.at), bool)
        bad[self.first] = False
        bad[late] = True
        edge = np.zeros(int(self.lengths.sum()) + 1, np.int64)
        np.add.at(edge, self.at[bad], 1)
        np.add.at(edge, self.at[bad] + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def of_table(found: pa.Table, window: int) -> Shard:
    return Shard(found["doc_id"].to_pylist(), found["text"].combine_chunks(), window)


def rows(data: dict, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table([pa.array(data[n], kinds[t]) for n, t in (x.split(" ") for x in schema.split(", "))], [x.split(" ")[0] for x in schema.split(", ")])


def remove_repeats(documents: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space; null unless texts), kept_sha256 of every document."""
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_shards, n_buckets = -(-total // SHARD_BYTES) or 1, -(-total // BUCKET_BYTES) or 1
    slices = max(1, -(-int(total * PER_BYTE) // SLICE))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(n_shards)).cast("int"))

    def sketch(found: pa.Table) -> pa.Table:
        shard, out = found["shard"][0].as_py(), {"shard": [], "slice": [], "cells": []}
        for row, cells in enumerate(of_table(found, window).cells(slices)):
            cells = np.sort(cells)
            part = (cells // np.uint64(SLICE)).astype(np.int64)
            for k in np.unique(part).tolist():
                own = cells[np.searchsorted(part, k) : np.searchsorted(part, k, "right")] - np.uint64(k * SLICE)
                out["shard"].append(shard)
                out["slice"].append(k * ROWS + row)
                out["cells"].append(pack(np.diff(own, prepend=np.uint64(0))))
        return rows(out, CELLS)

    def merge(found: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpack(x)).astype(np.int64) for x in found["cells"].to_pylist()]
        counts = np.zeros(SLICE, np.uint8)
        for cells in lists:
            own, n = np.unique(cells, return_counts=True)
            counts[own] = np.minimum(counts[own] + np.minimum(n, 2), 2)
        out = {"shard": [], "slice": [], "cells": []}
        for shard, k, cells in zip(found["shard"].to_pylist(), found["slice"].to_pylist(), lists, strict=True):
            often = np.unique(cells[counts[cells] >= 2])
            if len(often):
                out["shard"].append(shard)
                out["slice"].append(k)
                out["cells"].append(pack(np.diff(often, prepend=0)))
        return rows(out, CELLS)

    def claim(found: pa.Table, often: pa.Table) -> pa.Table:
        out = {n: [] for n in ("shard", "bucket", "hashes", "docs", "starts")}
        if not len(found) or not len(often):
            return rows(out, CLAIMS)
        s = of_table(found, window)
        maybe = np.ones(len(s.first), bool)
        for row, cells in enumerate(s.cells(slices)):
            kept = [np.cumsum(unpack(x)) + np.uint64(k // ROWS * SLICE) for x, k in zip(often["cells"].to_pylist(), often["slice"].to_pylist(), strict=True) if k % ROWS == row]
            kept = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
            at = np.searchsorted(kept, cells)
            maybe &= (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == cells) if len(kept) else False
        index = s.first[maybe]
        a, b = s.hash[0][index], s.hash[1][index]
        bucket = (a % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ids = np.array([NONE if i is None else i for i in s.ids], np.int64)
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            docs, n = np.unique(s.doc[index[part]], return_counts=True)
            out["shard"].append(found["shard"][0].as_py())
            out["bucket"].append(int(bucket[part[0]]))
            out["hashes"].append(a[part].tobytes() + (b[part] >> np.uint64(32)).astype(np.uint32).tobytes())
            out["docs"].append(ids[docs].tobytes() + n.astype(np.int64).tobytes())
            out["starts"].append(pack(np.diff(index[part], prepend=0)))
        return rows(out, CLAIMS)

    def settle(found: pa.Table) -> pa.Table:
        a, b, doc, start, shard = [], [], [], [], []
        for k, (hashes, docs, starts) in enumerate(zip(found["hashes"].to_pylist(), found["docs"].to_pylist(), found["starts"].to_pylist(), strict=True)):
            n = len(hashes) // 12
            a.append(np.frombuffer(hashes, np.uint64, n))
            b.append(np.frombuffer(hashes, np.uint32, n, offset=8 * n))
            ids, each = np.frombuffer(docs, np.int64).reshape(2, -1)
            doc.append(np.repeat(ids, each))
            start.append(np.cumsum(unpack(starts)).astype(np.int64))
            shard.append(np.full(n, k))
        a, b, doc, start, shard = map(np.concatenate, (a, b, doc, start, shard))
        # Equal doc_ids share a shard, so (doc, place in the shard) is the order of the corpus.
        order = np.lexsort((start, doc, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        late = order[1:][same]
        out = {"shard": [], "late": []}
        for k, name in enumerate(found["shard"].to_pylist()):
            own = np.sort(start[late[shard[late] == k]])
            if len(own):
                out["shard"].append(name)
                out["late"].append(pack(np.diff(own, prepend=0)))
        return rows(out, LATE)

    def clean(found: pa.Table, late: pa.Table) -> pa.Table:
        out = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept", "kept_sha256")}
        if not len(found):
            return rows(out, CLEANED)
        s = of_table(found, window)
        lists = [np.cumsum(unpack(x)).astype(np.int64) for x in late["late"].to_pylist()]
        gone = s.covered(np.concatenate(lists) if lists else np.empty(0, np.int64))
        for i, text, at, n in zip(s.ids, s.texts, s.starts.tolist(), s.lengths.tolist(), strict=True):
            words, own = text.split(), gone[at : at + n]
            removed = int(own.sum())
            kept = b" ".join(words if not removed else [w for w, g in zip(words, own.tolist(), strict=True) if not g])
            for name, value in zip(out, (i, n, removed, kept.decode() if texts else None, hashlib.sha256(kept).hexdigest()), strict=True):
                out[name].append(value)
        return rows(out, CLEANED)

    cells = dealt.groupBy("shard").applyInArrow(sketch, CELLS)
    often = cells.groupBy("slice").applyInArrow(merge, CELLS)
    claims = dealt.groupBy("shard").cogroup(often.groupBy("shard")).applyInArrow(claim, CLAIMS)
    late = claims.groupBy("bucket").applyInArrow(settle, LATE)
    return dealt.groupBy("shard").cogroup(late.groupBy("shard")).applyInArrow(clean, CLEANED)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM d, unnest(range(1, len(w) - 18)) u(i)),
late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS nth FROM t) WHERE nth > 1),
gone AS (SELECT DISTINCT r, p FROM late, unnest(range(i, i + 20)) u(p)),
word AS (SELECT r, p, w[p] AS t, gone.p IS NOT NULL AS out FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN gone USING (r, p)),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, string_agg(t, ' ' ORDER BY p) FILTER (WHERE NOT out) AS kept FROM word GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
