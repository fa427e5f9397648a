"""Exact similarity join of documents by the Jaccard similarity of their word n-grams.

1. Documents with equal shingle sets are one class, found by a 128-bit hash of the set; what follows sees classes only
   and knows each by half of its hash (by the other half where two classes share the first).
2. Each class hashes its shingles into groups. Two sets whose similarity reaches the threshold differ in at most T
   shingles, and each of these spoils one group; of more than T groups at least one holds the same shingles in both. The
   keys of the groups' contents deal the classes to runs, the leaves in which partners can meet. (An R-tree over count
   vectors alone can't serve here: in the dimensions that tell random texts apart its boxes overlap, and a search visits
   nearly every leaf.)
3. A class is also a point: the counts of its shingles in DIMS groups. Summed coordinate minima bound the overlap of two
   sets from above; pairs whose bound is too low are dropped. In long runs the points form an R-tree, whose boxes are
   bounded the same way. Points move only to pairs and open runs, not with the keys.
4. Surviving pairs are verified on the whole texts.

Short runs give all their pairs. Long runs first give the pairs of one member with all others; once the links found so
far have joined most members to components, they give only pairs across components. So copies aren't expanded into all
pairs, and no link between different components is missed. Runs with the same members are one run, and each is dealt by
itself.

The number of groups depends on a set's size: sizes fall into bands such that partners are in the same or in adjacent
bands, and a class takes part in its own band and in the one below. Groups that are empty for both of a pair would also
count as equal; there are so many spare groups that a pair has a non-empty equal one, unless both have more empty groups
than spares, and such classes send their empty groups too.

Null texts and texts without words have an empty set, no links and are their own component. Rows with equal doc_id are
one node of the graph. A null doc_id has no links and a null component. Repeated rows each return their row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SHARD_BYTES, as_bytes, mix64, pack, prepare, remove, stored, table, unpack, windows

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DIMS = 32
#: Members of a run that gives all its pairs; bytes of text whose keys one bucket holds; partners of one member in one
#: row (about); members of a long run in one row.
SHORT, BUCKET_BYTES, HUB, CHUNK = 8, 48 << 20, 1024, 1 << 20
LEAF = 16
#: Classes whose texts are asked for are sent to all executors up to this number (24 bytes each); beyond it texts are
#: joined by a shuffle.
BROADCAST_ASKED = 1_000_000
#: Members of open runs that one task looks at (a longer run has its own); cells that a search of one run tests at once.
OPEN, TABLE = 1 << 18, 1 << 24
#: Pairs of open runs that a task tells apart before it sends them on, and how many it takes up or sends at once.
HELD, FRESH = 1 << 22, 1 << 20
#: Halves of hashes that several classes may share (at 1e12 classes about 27,000 do).
SHARED = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SIGNED = "doc_id bigint, t bigint, n bigint, k1 bigint, k2 bigint, points binary"
KEYS = "bucket int, keys binary, each binary, docs binary"
PAIRS = "a bigint, salt int, bs binary"
MET = f"{PAIRS}, run bigint, chunk int, members array<bigint>"


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and how many each has."""
    words = [(t or b"").translate(LOWER).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    seen = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[seen]
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    hashes = mix64(windows(own, width, BASES[0]))[at]
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[k]), 1) for k in short], np.uint64)
    del words, number, own, at  # the sort needs room
    doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(lengths))


def sets_by_portion(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What shingle_sets() gives for a column of any length, of which only a portion is held as words."""
    done = [shingle_sets(as_bytes(part.column(0)), width) for batch in pa.table([texts], ["text"]).to_batches() for part in portions(batch, 0)]
    return np.concatenate([np.empty(0, np.uint64), *(h for h, _ in done)]), np.concatenate([np.empty(0, np.int64), *(n for _, n in done)])


def least_linked(percent: int) -> int:
    """Sets of fewer shingles have no partner but an equal one: the nearest other set has one more shingle."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else np.iinfo(np.int64).max


def spares(size: int, most: int) -> int:
    """Spare groups, somewhat more than the groups that the smallest sets of a band leave empty on average."""
    empty = 0.0
    for _ in range(20):
        m = most + 1 + 1.6 * empty
        empty = m * np.exp(-size / m)
    return min(int(np.ceil(1.6 * empty)), most) + 2


class Bands:
    """Sizes by band; for each band the number of groups and of spare ones among them."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges, self.groups, self.spare = [min(2, least_linked(percent))], [], []

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles in which linked sets of these sizes differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while len(sizes) and self.edges[-1] <= sizes.max():
            top = self.edges[-1] * 100 // self.percent  # the band's largest size
            most = int(self.differ(np.int64(top), np.int64(top * 100 // self.percent)))
            spare = spares(self.edges[-1], most)
            self.edges.append(top + 1)
            self.groups.append(most + 1 + spare)
            self.spare.append(spare)
        return np.searchsorted(self.edges, sizes, "right") - 1


def group_keys(hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the groups of each set, and the number of the set that each belongs to."""
    band = bands.of(sizes)
    keys, owners = [], []
    for below in (0, 1):
        use = np.flatnonzero(band - below >= 0)
        if not len(use):
            continue
        scheme = band[use] - below
        m = np.array(bands.groups)[scheme]
        base = np.cumsum(m) - m
        at = np.full(len(sizes), -1)
        at[use] = np.arange(len(use))
        owner = at[np.repeat(np.arange(len(sizes)), sizes)]
        h, owner = hashes[owner >= 0], owner[owner >= 0]
        slot = base[owner] + (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % m[owner].astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(m.sum()), np.uint64)
        np.add.at(content, slot, mix64(h))
        filled = np.bincount(slot, minlength=len(content)) > 0
        whose = np.repeat(np.arange(len(use)), m)
        empty = np.bincount(whose[~filled], minlength=len(use))
        send = filled | (empty > np.array(bands.spare)[scheme])[whose]
        number = np.arange(len(content)) - base[whose]
        keys.append(mix64(content[send] ^ mix64((scheme[whose[send]].astype(np.uint64) << np.uint64(32)) + number[send].astype(np.uint64))))
        owners.append(use[whose[send]])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def points_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(owner * DIMS + (hashes >> np.uint64(59)).astype(np.int64), minlength=len(sizes) * DIMS).reshape(-1, DIMS).astype(np.uint32)


def packed(points: np.ndarray) -> list[bytes]:
    """Each point in one byte a coordinate, or four where a count needs them."""
    small, large = points.astype(np.uint8).tobytes(), points.astype("<u4").tobytes()
    few = points.max(axis=1, initial=0) < 256
    return [small[DIMS * k : DIMS * (k + 1)] if f else large[4 * DIMS * k : 4 * DIMS * (k + 1)] for k, f in enumerate(few.tolist())]


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    out = np.empty((len(data), DIMS), np.uint32)
    wide = np.array([len(x) > DIMS for x in data], bool)
    for which, kind in ((~wide, np.uint8), (wide, "<u4")):
        at = np.flatnonzero(which)
        out[at] = np.frombuffer(b"".join([data[k] for k in at]), kind).reshape(-1, DIMS)
    return out


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sum of coordinate minima leaves room for the overlap that a link needs."""
    ok = np.empty(len(a), bool)
    for s in range(0, len(a), 1 << 18):
        x, y = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
        ok[s : s + (1 << 18)] = np.minimum(points[x], points[y]).sum(axis=1) >= needed(sizes[x], sizes[y], percent)
    return ok


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving the members along their widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.nodes: list[tuple] = []
        self.build(np.arange(len(points)))

    def build(self, members: np.ndarray) -> int:
        own = self.points[members]
        k = len(self.nodes)
        self.nodes.append(())
        low, high = own.min(axis=0), own.max(axis=0)
        if len(members) <= LEAF:
            kids = None
        else:
            order = members[np.argsort(own[:, (high - low).argmax()], kind="stable")]
            kids = self.build(order[: len(order) // 2]), self.build(order[len(order) // 2 :])
        self.nodes[k] = high, int(self.sizes[members].min()), members, kids
        return k

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs whose overlap may reach what a link needs."""
        none = np.empty(0, np.int64)
        out = [(none, none), *self.leaves(queries)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def leaves(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """These pairs leaf by leaf; the queries go down the tree together."""
        todo = [(0, np.asarray(queries))]
        while todo:
            node, q = todo.pop()
            high, least, members, kids = self.nodes[node]
            q = q[np.minimum(self.points[q], high).sum(axis=1) >= needed(self.sizes[q], least, self.percent)]
            if not len(q):
                continue
            if kids:
                todo += [(k, q) for k in kids]
                continue
            a, b = np.repeat(q, len(members)), np.tile(members, len(q))
            ok = may_link(self.points, self.sizes, a, b, self.percent)
            yield a[ok], b[ok]


def pairs_in(lengths: np.ndarray, starts: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of short runs, and the first member of long runs with all others."""
    a, b = [], []
    for n in range(2, SHORT + 1):
        rows = starts[lengths == n]
        if len(rows):
            own = members[rows[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            a.append(own[:, i].ravel())
            b.append(own[:, j].ravel())
    for s, n in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
        a.append(np.full(n - 1, members[s]))
        b.append(members[s + 1 : s + n])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def runs_of(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run starts, and the members of the runs, each once, in order; keys: five bytes each; owner: below n."""
    code = np.zeros((len(keys), 8), np.uint8)
    if n <= 1 << 24:  # key and owner fit one number, which is sorted where it is
        code[:, 3:] = keys
        code = code.view("<u8").ravel()
        code |= owner
        code.sort()
        code = code[np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])]
        owner = (code & np.uint64((1 << 24) - 1)).astype(np.int64)
        code >>= np.uint64(24)
    else:
        code[:, :5] = keys
        code = code.view("<u8").ravel()
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order].astype(np.int64)
        new = np.concatenate([np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
        code, owner = code[new], owner[new]
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])), owner


def make(data: dict, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    n = max(map(len, data.values()), default=0)
    return pa.table([pa.array(data[c], kinds[t]) if c in data else pa.nulls(n, kinds[t]) for c, t in fields], [c for c, _ in fields])


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by alternating large and small stars until nothing changes."""

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        # A node and its neighbours (all of them, or the smaller ones) hang on the smallest of them.
        near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if both:
            near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = near.join(least, "u")
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if both else hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    state, pairs = None, links.select("a", "b").where("a <> b").distinct()
    while True:
        pairs = star(star(pairs, True), False).checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def class_names(hashes: np.ndarray, sizes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The first half of each set's hash, or the second where the first is shared by several classes."""
    names = set_hash(hashes, sizes, BASES[0])
    twice = np.isin(names, shared) if len(shared) else np.zeros(len(names), bool)
    return np.where(twice, set_hash(hashes, sizes, BASES[1]), names) if twice.any() else names


def join(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link from a similarity of percent / 100 on."""
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_buckets = -(-total // BUCKET_BYTES) or 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                hashes, sizes = shingle_sets(as_bytes(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), *(pa.array(set_hash(hashes, sizes, base)) for base in BASES), pa.array(packed(points_of(hashes, sizes)), pa.binary())], ["doc_id", "t", "n", "k1", "k2", "points"])

    signed = docs.mapInArrow(sign, SIGNED).checkpoint()
    valid = signed.where("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "t")).alias("least")
    classes = valid.groupBy("k1", "k2").agg(least, F.first("n").alias("n"), F.first("points").alias("points")).select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.t").alias("t"), "n", "points").checkpoint()
    halves = [r[0] for r in classes.groupBy("k1").count().where("count > 1").select("k1").limit(SHARED + 1).collect()]
    if len(halves) > SHARED:
        raise RuntimeError(f"more than {SHARED} halves of hashes are shared by several classes")
    node = F.when(F.col("k1").isin(halves), F.col("k2")).otherwise(F.col("k1")) if halves else F.col("k1")
    classes = classes.withColumn("node", node)
    shared = spark.sparkContext.broadcast(np.array(halves, np.int64))
    # Rows that share a doc_id: usually none.
    repeated = valid.groupBy("doc_id").agg(F.count("*").alias("rows"), *(f(F.xxhash64("k1", "k2")).alias(f.__name__) for f in (F.min, F.max))).where("rows > 1").checkpoint()
    once = repeated.isEmpty()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, least = Bands(percent), least_linked(percent)
        for batch in batches:
            for part in portions(batch):
                hashes, sizes = shingle_sets(as_bytes(part.column(1)), width)
                names = class_names(hashes, sizes, shared.value)
                may = np.flatnonzero((sizes >= least) & part.column(0).is_valid().to_numpy(zero_copy_only=False))
                use = np.zeros(len(names), bool)  # copies inside a portion go once; rows without links don't stand for others
                use[may[np.unique(names[may], return_index=True)[1]]] = True
                hashes, names, sizes = hashes[np.repeat(use, sizes)], names[use], sizes[use]
                key, owner = group_keys(hashes, sizes, bands)
                bucket = (key % np.uint64(n_buckets)).astype(np.int64)
                short = (key >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                order = np.lexsort((owner, bucket))
                out = {n: [] for n in ("bucket", "keys", "each", "docs")}
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                    members, each = np.unique(owner[own], return_counts=True)
                    for name, value in (("bucket", int(bucket[own[0]])), ("keys", short[own].tobytes()), ("each", pack(each)), ("docs", names[members].tobytes())):
                        out[name].append(value)
                yield from make(out, KEYS).to_batches()

    def meet(found: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(found["docs"].to_pylist()), np.int64)
        ids, owner = np.unique(every, return_inverse=True)  # copies of other portions fall together
        owner = np.repeat(owner.astype(np.uint32), np.concatenate([unpack(x) for x in found["each"].to_pylist()]).astype(np.int64))
        starts, owner = runs_of(np.frombuffer(b"".join(found["keys"].to_pylist()), np.uint8).reshape(-1, 5), owner, len(ids))
        lengths = np.diff(np.append(starts, len(owner)))
        a, b = pairs_in(lengths, starts, owner)
        code = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        pairs = make(hubs(ids[code // max(1, len(ids))], ids[code % max(1, len(ids))]), MET)
        # Long runs go along for the second round, each once.
        runs: dict[int, np.ndarray] = {}
        for s, n in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
            members = ids[owner[s : s + n]]
            runs.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63), members)
        chunks = [(run, c, members[c * CHUNK : (c + 1) * CHUNK]) for run, members in runs.items() for c in range(-(-len(members) // CHUNK))]
        return pa.concat_tables([pairs, make({"run": [x for x, _, _ in chunks], "chunk": [x for _, x, _ in chunks], "members": [x for _, _, x in chunks]}, MET)])

    def fetch(nodes: DataFrame) -> DataFrame:
        """node, text: one text of each class, moved from the documents and written in the shared folder for both rounds."""
        asked = nodes.join(classes.select("node", "rep", F.col("t").alias("own")), "node").checkpoint()
        if asked.count() <= BROADCAST_ASKED:
            asked = F.broadcast(asked)
        found = docs.join(asked, (F.col("doc_id") == F.col("rep")) & (F.col("t") == F.col("own"))).select("node", "text")
        rows, path = stored(found if once else found.groupBy("node").agg(F.first("text").alias("text")))
        written.append(path)
        return rows

    written: list[str] = []

    parts = parts_of(total)
    points = classes.select("node", F.col("n").alias("size"), "points")
    met = docs.mapInArrow(keys, KEYS).groupBy("bucket").applyInArrow(meet, MET).checkpoint()
    pairs = bounded(points, met.where("bs is not null").select("a", "salt", "bs"), parts, percent)
    pairs = neighbours(pairs.checkpoint()).checkpoint()
    texts = fetch(spread(placed(pairs, parts)).select("node").distinct())
    links = verify(texts, pairs, parts, width, percent).checkpoint()
    roots = components(links)

    # Long runs whose members the links so far leave in several components.
    runs = met.where("members is not null").dropDuplicates(["run", "chunk"]).select("run", F.explode("members").alias("node"))
    rooted = runs.join(roots, "node", "left").select("run", "node", F.coalesce("root", "node").alias("root")).checkpoint()
    is_open = rooted.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").checkpoint()

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return across(batches, percent)

    n_open = is_open.agg(F.sum("n")).first()[0] or 0
    if n_open:
        part = F.pmod(F.xxhash64("run"), F.lit(-(-n_open // OPEN))).alias("part")
        asked = rooted.join(is_open.select("run"), "run").join(points, "node").select(part, "run", "node", "root", "size", "points")
        more = asked.groupBy("part").applyInArrow(crossing, PAIRS).checkpoint()
        more = neighbours(more).checkpoint()
        lacking = spread(placed(more, parts)).select("node").distinct().join(texts.select("node"), "node", "left_anti")
        both = texts.unionByName(fetch(lacking))
        roots = components(links.unionByName(verify(both, more, parts, width, percent).checkpoint()))

    for path in written:
        remove(spark, path)
    roots = classes.join(roots, "node", "left").select("k1", "k2", "rep", F.coalesce("root", "node").alias("root"))
    # Rows with equal doc_id are one node of the graph, and the smallest doc_id names a component.
    named = one_per_id(signed, roots, None if once else repeated.where("min <> max").select("doc_id"))
    return signed.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, bs) of open runs: members outside a run's largest component with all members of other components.

    The runs of a family give the same pairs again and again. They are told apart while they come, so that a task holds
    some HELD pairs; if it finds more, it sends those that it has and starts anew, and some go out twice.
    """
    found = pa.Table.from_batches(batches)
    run, node, root, sizes = (found[c].to_numpy() for c in ("run", "node", "root", "size"))
    points = unpacked(found["points"])
    names, number = np.unique(node, return_inverse=True)
    held, fresh, n = np.empty(0, np.int64), [], 0

    def sent(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), FRESH):
            part = codes[at : at + FRESH]
            yield from make(hubs(names[part // len(names)], names[part % len(names)]), PAIRS).to_batches()

    order = np.lexsort((node, run))
    for r in np.split(order, np.flatnonzero(np.diff(run[order])) + 1):
        for q, near in open_pairs(points[r], sizes[r], root[r], percent):
            q, near = number[r[q]], number[r[near]]
            fresh.append(np.minimum(q, near) * len(names) + np.maximum(q, near))
            n += len(q)
            if n >= FRESH:
                held, fresh, n = merged(held, fresh), [], 0
                if len(held) >= HELD:
                    yield from sent(held)
                    held = held[:0].copy()
    yield from sent(merged(held, fresh))


def open_pairs(points: np.ndarray, sizes: np.ndarray, root: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one open run that may link, some at a time."""
    own, which, count = np.unique(root, return_inverse=True, return_counts=True)
    minor = np.flatnonzero(which != count.argmax())
    tree = CountTree(points, sizes, percent) if len(root) > 4 * LEAF else None
    step = max(1, TABLE // len(root))
    for at in range(0, len(minor), step):
        block = minor[at : at + step]
        if tree:
            near = tree.leaves(block)
        else:
            a, b = np.repeat(block, len(root)), np.tile(np.arange(len(root)), len(block))
            ok = may_link(points, sizes, a, b, percent)
            near = [(a[ok], b[ok])]
        for a, b in near:
            keep = root[a] != root[b]
            if keep.any():
                yield a[keep], b[keep]


def merged(held: np.ndarray, fresh: list[np.ndarray]) -> np.ndarray:
    """The sorted, distinct members of all."""
    every = np.concatenate([held, *fresh])
    every.sort()
    return every[np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]])]


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def one_per_id(signed: DataFrame, roots: DataFrame, several: DataFrame | None) -> DataFrame:
    """k1, k2, component: the smallest doc_id of each root's classes, roots that share one of several doc_ids being one."""
    least = roots.groupBy("root").agg(F.min("rep").alias("component"))
    named = roots.join(least, "root").select("k1", "k2", "component")
    if several is None or several.isEmpty():
        return named
    # A doc_id may have many rows: each hangs on the least of its components, which map-side minima find.
    shared = signed.where("n > 0").select("doc_id", "k1", "k2").distinct().join(several, "doc_id").join(named, ["k1", "k2"]).select("doc_id", "component").distinct()
    first = shared.groupBy("doc_id").agg(F.min("component").alias("a"))
    links = shared.join(first, "doc_id").select("a", F.col("component").alias("b"))
    joined = components(links).select(F.col("node").alias("component"), F.col("root").alias("first"))
    return named.join(joined, "component", "left").select("k1", "k2", F.coalesce("first", "component").alias("component"))


def portions(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SHARD_BYTES of text, which is in the given column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SHARD_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def set_hash(hashes: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """One number for each set, whatever the order of its members."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(base)))])
    ends = np.cumsum(sizes)
    return mix64(total[ends] - total[ends - sizes]).view(np.int64)


def hubs(a: np.ndarray, b: np.ndarray) -> dict:
    """Pairs by their first member, whose partners go in one row; those of a busy member are dealt to several rows, which
    its salts tell apart."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    out: dict[str, list] = {"a": [], "salt": [], "bs": []}
    for first, own in zip(a[edges].tolist(), np.split(b, edges[1:]) if len(a) else (), strict=True):
        pieces = 1
        while pieces * HUB < len(own):
            pieces *= 2
        deal = (mix64(own.view(np.uint64)) & np.uint64(pieces - 1)).astype(np.int64)
        for k in range(pieces):
            out["a"].append(first)
            out["salt"].append(0 if pieces == 1 else pieces + k)
            out["bs"].append((own if pieces == 1 else own[deal == k]).tobytes())
    return out


def pairs_of(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of rows made by hubs()."""
    each = [np.frombuffer(x, np.int64) for x in found["bs"].to_pylist()]
    return distinct(np.repeat(found["a"].to_numpy(), [len(x) for x in each]), np.concatenate([*each, np.empty(0, np.int64)]))


def parts_of(total: int) -> int:
    return max(1, -(-total // SHARD_BYTES))


def neighbours(pairs: DataFrame) -> DataFrame:
    """Pairs with by: the smallest member that a is paired with, or a itself. Members of a group that are all paired with
    each other have it in common, so that its texts move to one part. Where many pairs have one, by is a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = pairs_of(pa.Table.from_batches([batch]))
            order = np.lexsort((a, b))
            new = np.concatenate([np.ones(min(1, len(b)), bool), b[order][1:] != b[order][:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(b[order][new]), pa.array(a[order][new])], ["a", "by"])

    least = pairs.mapInArrow(run, "a bigint, by bigint").groupBy("a").agg(F.min("by").alias("by"))
    named = pairs.join(least, "a", "left").withColumn("by", F.coalesce("by", "a"))
    many = named.groupBy("by").agg(F.sum(F.octet_length("bs")).alias("bytes")).where(F.col("bytes") > 8 * HUB).select("by", F.lit(True).alias("many"))
    return named.join(many, "by", "left").select("a", "salt", "bs", F.when(F.col("many"), F.col("a")).otherwise(F.col("by")).alias("by"))


def placed(pairs: DataFrame, parts: int) -> DataFrame:
    """Pairs with the part, v, in which they are looked at; the rows of a busy member each by itself."""
    by = "by" if "by" in pairs.columns else "a"
    return pairs.select("a", "salt", "bs", F.pmod(F.xxhash64(by, "salt"), F.lit(parts)).cast("int").alias("v"))


def spread(placed: DataFrame) -> DataFrame:
    """v, node: the members of the pairs of each part, each once."""

    def run(found: pa.Table) -> pa.Table:
        nodes = np.unique(np.concatenate([found["a"].to_numpy(), *(np.frombuffer(x, np.int64) for x in found["bs"].to_pylist())]))
        return make({"v": [found["v"][0].as_py()] * len(nodes), "node": nodes}, "v int, node bigint")

    return placed.groupBy("v").applyInArrow(run, "v int, node bigint")


def bounded(points: DataFrame, pairs: DataFrame, parts: int, percent: int) -> DataFrame:
    """The pairs (a, bs) whose summed coordinate minima leave room for a link, each once in its part."""
    dealt = placed(pairs, parts)
    sent = spread(dealt).join(points, "node").select((F.col("v") + 0).alias("part"), "node", "size", "points")

    def check(pairs: pa.Table, members: pa.Table) -> pa.Table:
        nodes, sizes = members["node"].to_numpy(), members["size"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes, sizes, own = nodes[order], sizes[order], unpacked(members["points"])[order]
        a, b = pairs_of(pairs)
        x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        ok = may_link(own, sizes, x, y, percent)
        return make(hubs(a[ok], b[ok]), PAIRS)

    return dealt.groupBy("v").cogroup(sent.groupBy("part")).applyInArrow(check, PAIRS)


def verify(texts: DataFrame, pairs: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """The pairs (a, each of bs) that link, judged on whole texts."""
    dealt = placed(pairs, parts)
    sent = spread(dealt).join(texts, "node").select((F.col("v") + 0).alias("part"), "node", "text")

    def check(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        hashes, sizes = sets_by_portion(texts["text"], width)
        ends = np.cumsum(sizes)
        of = {i: hashes[s:e] for i, s, e in zip(texts["node"].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True)}
        a, b = pairs_of(pairs)
        ok = np.fromiter((linked(of[int(x)], of[int(y)], percent) for x, y in zip(a, b, strict=True)), bool, len(a))
        return make({"a": a[ok], "b": b[ok]}, "a bigint, b bigint")

    return dealt.groupBy("v").cogroup(sent.groupBy("part")).applyInArrow(check, "a bigint, b bigint")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes link."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or len(p) * 100 < percent * len(q):
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def op6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT step.b, reach.root FROM reach JOIN step ON step.a = reach.doc_id WHERE reach.root < step.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
