"""Benchmark decontamination by a distributed positional inverted index.

Training texts become index segments: one row holds the postings (term, positions) of some megabytes of text, packed as
gaps. Segments partition the documents, so no term's postings meet in one task, however common the term, and phrase
queries need no shuffle. Test items are the queries: each window of an item starts from its rarest term in the segment;
the term's positions, adjusted by its offset, are intersected with the other terms' lists from rare to common.

Positions are counted through a segment with a free position between documents, so that no phrase crosses from one
document to the next.

Nulls and texts without words have no words, no hits and no items; they still return a row. Repeated rows each return
their row. An item with a null item_id or without words is no query. Items that share an item_id count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SHARD_BYTES, as_bytes, pack, prepare, unpack

#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes of other alphabets stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 13
#: Words of test items in one broadcast; more items are searched block by block.
BLOCK_WORDS = 1_000_000
#: Candidate positions that are tested at once.
STEP = 1 << 20
#: Windows whose proximity matches are looked for at once.
WINDOWS = 1 << 16
#: Words that proximity matches may have between them besides the window's, in the query and in the pipeline.
SLOP = 3

SEGMENT = "doc_id array<bigint>, n_words array<int>, terms binary, counts binary, sizes binary, postings binary"
FOUND = "doc_id bigint, part bigint, ord int, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, near array<string>, near_spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def segment(ids: list, texts: list[list[bytes]]) -> dict:
    """Postings of some documents, given as lists of words."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    total = int(lengths.sum())
    terms = np.fromiter((number[w] for t in texts for w in t), np.uint64, total)
    at = np.arange(total, dtype=np.uint64) + np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    key = np.sort((terms << np.uint64(32)) | at)
    term, at = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
    gaps = at.copy()
    gaps[1:] -= np.where(term[1:] == term[:-1], at[:-1], 0).astype(np.uint64)
    counts = np.bincount(term, minlength=len(number))
    widths = np.ones(total, np.int64)
    for k in (7, 14, 21, 28):
        widths += gaps >= np.uint64(1 << k)
    ends = np.concatenate([[0], np.cumsum(widths)])[np.cumsum(counts)] if total else np.empty(0, np.int64)
    return {
        "doc_id": ids,
        "n_words": lengths.tolist(),
        "terms": b" ".join(number),
        "counts": pack(counts),
        "sizes": pack(np.diff(ends, prepend=0)),
        "postings": pack(gaps),
    }


def build_index(documents: DataFrame) -> DataFrame:
    """Index segments of `documents` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("terms", "counts", "sizes", "postings"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if ids and held + len(text or b"") > SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words_of(text))
                held += len(text or b"")
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(build, SEGMENT)


class Phrases:
    """Windows of some test items, as numbers of test terms."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.names = [name for name, _ in items]
        self.words = np.array([number[w] for _, words in items for w in words], np.int64)
        self.term = dict(number)
        start, length, item, at = [], [], [], 0
        for k, (_, words) in enumerate(items):
            for s in range(max(1, len(words) - window + 1)):
                start.append(at + s)
                length.append(min(window, len(words)))
                item.append(k)
            at += len(words)
        self.start, self.length, self.item = (np.array(x, np.int64) for x in (start, length, item))
        self.widest = int(self.length.max()) if start else 0

    def postings(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (test term << 32 | position) of a segment, and the number of positions of each test term."""
        sizes = unpack(row["sizes"]).astype(np.int64)
        ends = np.cumsum(sizes)
        found = sorted((n, k) for k, t in enumerate(row["terms"].split()) if (n := self.term.get(t)) is not None)
        cf = np.zeros(len(self.term), np.int64)
        if not found:
            return np.empty(0, np.int64), cf
        which, own = np.array(found, np.int64).T
        counts = unpack(row["counts"]).astype(np.int64)[own]
        cf[which] = counts
        raw = np.frombuffer(row["postings"], np.uint8)
        gaps = unpack(np.concatenate([raw[ends[k] - sizes[k] : ends[k]] for k in own])).astype(np.int64)
        total = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        at = total - np.repeat(total[first] - gaps[first], counts)
        return (np.repeat(which, counts) << 32) | at, cf

    def match(self, keys: np.ndarray, cf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which they occur as phrases."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(keys) or not len(self.start):
            return none
        offsets = np.arange(self.widest)
        inside = offsets < self.length[:, None]
        at = np.minimum(self.start[:, None] + offsets, len(self.words) - 1)
        counts = np.where(inside, cf[self.words[at]], np.iinfo(np.int64).max)
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(alive):
            return none
        # Windows with one rarest term share its candidates: (anchor, position) pairs are tested on the words common to them.
        anchor = self.start[alive] + counts[alive].argmin(axis=1)
        order = np.lexsort((self.start[alive], anchor))
        alive, anchor = alive[order], anchor[order]
        anchors, first, members = np.unique(anchor, return_index=True, return_counts=True)
        low = np.maximum.reduceat(self.start[alive], first)
        high = np.minimum.reduceat((self.start + self.length)[alive], first)
        around = anchors[:, None] + np.arange(-self.widest + 1, self.widest)
        shared = (around >= low[:, None]) & (around < high[:, None]) & (around != anchors[:, None])
        rarity = np.where(shared, cf[self.words[np.clip(around, 0, len(self.words) - 1)]], np.iinfo(np.int64).max)
        by_rarity = np.take_along_axis(around, rarity.argsort(axis=1, kind="stable"), axis=1)
        n_shared = shared.sum(axis=1)
        lo = np.searchsorted(keys, self.words[anchors] << 32)
        n = cf[self.words[anchors]]
        out_w, out_p = [], []
        for a, b in steps(n):
            g = np.repeat(np.arange(a, b), n[a:b])
            p = keys[np.arange(len(g)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + lo[g]] & 0xFFFFFFFF
            for r in range(by_rarity.shape[1]):
                live = n_shared[g] > r
                if not live.any():
                    break
                w = by_rarity[g, r]
                keep = ~live
                keep[live] = held(keys, self.words[w[live]], p[live] + (w - anchors[g])[live])
                g, p = g[keep], p[keep]
            if not len(g):
                continue
            w = np.repeat(first[g], members[g]) + np.arange(members[g].sum()) - np.repeat(np.cumsum(members[g]) - members[g], members[g])
            q = np.repeat(p, members[g]) - (anchor[w] - self.start[alive[w]])
            w = alive[w]
            for k in range(self.widest):
                live = self.length[w] > k
                keep = ~live
                keep[live] = held(keys, self.words[self.start[w[live]] + k], q[live] + k)
                w, q = w[keep], q[keep]
            out_w.append(w)
            out_p.append(q)
        return (np.concatenate(out_w), np.concatenate(out_p)) if out_w else none

    def near(self, keys: np.ndarray, cf: np.ndarray, slop: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proximity matches: a window and a document of which some length + slop consecutive words hold every word of the
        window, in any order. Returns their windows, a position inside each, and the places of the windows' words in all
        such runs of words. Documents by start and length.

        Each such run holds the window's rarest term, so that looking around its positions finds all of them, whichever
        term is the rarest in a segment.
        """
        found, at, places = ([np.empty(0, np.int64)] for _ in range(3))
        for s in range(0, len(self.start) if len(keys) else 0, WINDOWS):
            start, length = self.start[s : s + WINDOWS], self.length[s : s + WINDOWS]
            offsets = np.arange(self.widest)
            terms = self.words[np.minimum(start[:, None] + offsets, len(self.words) - 1)]
            counts = np.where(offsets < length[:, None], cf[terms], np.iinfo(np.int64).max)
            alive = np.flatnonzero(counts.min(axis=1) > 0)
            terms = np.take_along_axis(terms[alive], counts[alive].argsort(axis=1, kind="stable"), axis=1)
            length = length[alive]
            n, lo = cf[terms[:, 0]], np.searchsorted(keys, terms[:, 0] << 32)
            for a, b in steps(n):
                g = np.repeat(np.arange(a, b), n[a:b])
                p = keys[np.arange(len(g)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + lo[g]] & 0xFFFFFFFF
                d = np.searchsorted(starts, p, "right") - 1
                reach = length[g] + slop - 1
                low, high = np.maximum(p - reach, starts[d]), np.minimum(p + reach, starts[d] + lengths[d] - 1)
                for r in range(1, self.widest):
                    t = terms[g, r] << 32
                    i = np.minimum(np.searchsorted(keys, t | low), len(keys) - 1)
                    keep = (length[g] <= r) | (keys[i] >= t | low) & (keys[i] <= t | high)
                    g, p, low, high = g[keep], p[keep], low[keep], high[keep]
                # runs[k, j]: the run that starts j words before p[k] has every word so far.
                reach = length[g] + slop - 1
                runs = np.arange(self.widest + slop) <= reach[:, None]
                for r in range(self.widest):
                    has = (length[g] <= r)[:, None] & runs
                    for k, _, own in self.inside(keys, terms, length, g, p, low, high, reach, r, runs.shape[1]):
                        has[k] |= own
                    runs &= has
                good = runs.any(axis=1)
                g, p, low, high, reach, runs = (x[good] for x in (g, p, low, high, reach, runs))
                for r in range(self.widest):
                    places += [o[(own & runs[k]).any(axis=1)] for k, o, own in self.inside(keys, terms, length, g, p, low, high, reach, r, runs.shape[1])]
                found.append(s + alive[g])
                at.append(p)
        return np.concatenate(found), np.concatenate(at), np.unique(np.concatenate(places))

    @staticmethod
    def inside(keys, terms, length, g, p, low, high, reach, r, width) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences of the r-th term of some candidates from low to high, the first of each, then the second, and so on:
        candidates, positions, and which runs (by how many words before p they start) hold them."""
        k, j = np.flatnonzero(length[g] > r), np.arange(width)
        i = np.searchsorted(keys, terms[g[k], r] << 32 | low[k])
        while len(k):
            t = terms[g[k], r] << 32
            here = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= t | high[k])
            k, i = k[here], i[here]
            o = keys[i] - t[here]
            ahead = (p[k] - o)[:, None]
            yield k, o, (j >= ahead) & (j <= ahead + reach[k][:, None])
            i = i + 1


def steps(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups with about STEP candidates together."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right")))
        yield a, b
        a = b


def held(keys: np.ndarray, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each term stands at its position."""
    wanted = (terms << 32) | np.maximum(at, 0)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return (keys[i] == wanted) & (at >= 0)


def search(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    """One row per document: merged spans of words (start, end) inside phrase matches, and the items that match."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(phrases)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("ord", pa.int32()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())), ("near_spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["n_words"], np.int64)
                starts = np.cumsum(lengths + 1) - lengths - 1
                keys, cf = ph.postings(row)
                w, q = ph.match(keys, cf)
                doc = np.searchsorted(starts, q, "right") - 1
                spans, items, near, near_spans = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(list)
                for d, s, e in merged(doc, q - starts[doc], ph.length[w]):
                    spans[d].append({"start": s, "end": e})
                for d, i in np.unique(np.stack([doc, ph.item[w]], axis=1), axis=0).tolist():
                    items[d].add(ph.names[i])
                if slop is not None:
                    w, q, places = ph.near(keys, cf, slop, starts, lengths)
                    for d, i in np.unique(np.stack([np.searchsorted(starts, q, "right") - 1, ph.item[w]], axis=1), axis=0).tolist():
                        near[d].add(ph.names[i])
                    doc = np.searchsorted(starts, places, "right") - 1
                    for d, s, e in merged(doc, places - starts[doc], np.ones(len(places), np.int64)):
                        near_spans[d].append({"start": s, "end": e})
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array([row["part"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lengths), pa.array([spans.get(d, []) for d in range(n)], span), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array([sorted(near.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array([near_spans.get(d, []) for d in range(n)], span)], schema=schema)

    return index.mapInArrow(run, FOUND)


def merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Joins spans of a document that touch or overlap."""
    order = np.lexsort((start, doc))
    now = None
    for d, s, n in zip(doc[order].tolist(), start[order].tolist(), length[order].tolist(), strict=True):
        if now and now[0] == d and s <= now[2]:
            now[2] = max(now[2], s + n)
        else:
            if now:
                yield tuple(now)
            now = [d, s, s + n]
    if now:
        yield tuple(now)


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """Test items in blocks of bounded size, streamed to the driver a partition at a time."""
    items, held_words = [], 0
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text"))
    for name, text in rows.toLocalIterator():
        words = words_of((text or "").encode())
        if not words:
            continue
        if items and held_words + len(words) > block_words:
            yield Phrases(items, window)
            items, held_words = [], 0
        items.append((name, words))
        held_words += len(words)
    yield Phrases(items, window)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Finds test items in training documents.

    Returns for each document doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted
    item_ids as strings), spans (word ranges that are hit), near (items with a window whose distinct words all
    stand, in any order, in a run of the window's length + slop consecutive words of the document), near_spans (where the
    window's words stand in all such runs), n_near (how many stand there), all empty unless slop is given, and contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    spark = documents.sparkSession
    prepare(spark)
    index = build_index(documents).withColumn("part", F.monotonically_increasing_id()).checkpoint()
    found, n = None, 0
    for phrases in blocks(benchmark, window, block_words):
        if n:
            found = found.checkpoint()
        got = search(index, phrases, slop)
        found, n = (got if found is None else found.unionByName(got)), n + 1
    if n > 1:
        found = merge_blocks(found)
    hit, near = (F.aggregate(c, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]) for c in ("spans", "near_spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", "near", "near_spans", near.alias("n_near")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document out of a row per block and document."""
    empty = F.lit(None).cast("array<struct<start:int,end:int>>")

    def join(done, s):
        last = F.element_at(done, -1)
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), grown)).otherwise(F.concat(done, F.array(s)))

    every = found.groupBy("part", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.array_sort(F.flatten(F.collect_list("near_spans"))).alias("all_near"))
    none = F.coalesce(empty, F.array().cast("array<struct<start:int,end:int>>"))
    united = lambda every: F.aggregate(every, none, lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(join(a, s)))
    return every.withColumn("spans", united("all")).withColumn("near_spans", united("all_near")).drop("all", "all_near")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("bigint").alias("n_near_items"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"), "n_near")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
x AS (
  SELECT DISTINCT item, least(13, len(w)) AS l, w[i:i + least(13, len(w)) - 1] AS v
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) u(i) WHERE len(w) > 0),
word AS (SELECT r, p, w[p] AS t FROM d, unnest(range(1, len(w) + 1)) u(p)),
exact AS (
  SELECT r, i, x.l, item FROM (SELECT r, i, l, md5(array_to_string(w[i:i + l - 1], ' ')) AS k FROM d, (SELECT DISTINCT l FROM x) z, unnest(range(1, len(w) - l + 2)) u(i)) o
  JOIN x ON x.l = o.l AND md5(array_to_string(x.v, ' ')) = o.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, l FROM exact), unnest(range(i, i + l)) u(p) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM exact) GROUP BY r),
freq AS (SELECT t, count(*) AS n FROM word GROUP BY t),
y AS (SELECT row_number() OVER (ORDER BY item, v) AS x, item, l + 3 AS l, list_distinct(v) AS v FROM x),
rare AS (
  SELECT x, arg_min(t, struct_pack(n := n, t := t)) AS t FROM (SELECT x, e.t, coalesce(n, 0) AS n FROM (SELECT x, unnest(v) AS t FROM y) e LEFT JOIN freq USING (t)) GROUP BY x HAVING min(n) > 0),
wide AS (
  SELECT y.x, item, l, v, d.r, w, p FROM rare JOIN y USING (x) JOIN word ON word.t = rare.t JOIN d ON d.r = word.r
  WHERE list_has_all(w[greatest(p - l + 1, 1):p + l - 1], v)),
run AS (SELECT DISTINCT x, item, l, v, r, w, i FROM wide, unnest(range(greatest(p - l + 1, 1), p + 1)) u(i) WHERE list_has_all(w[i:i + l - 1], v)),
near AS (SELECT r, count(DISTINCT p) AS n_near FROM run, unnest(range(i, least(i + l, len(w) + 1))) u(p) WHERE list_contains(v, w[p]) GROUP BY r),
close AS (SELECT r, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM run) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(item.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items, sha256(coalesce(close.items, '')) AS near_sha256, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r) LEFT JOIN near USING (r) LEFT JOIN close USING (r)
"""
