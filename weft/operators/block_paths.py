"""The path model on blocks of sentences: what paths.py does with joins, where the tables of a vocabulary are dense."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.operators import block_walks, blocks, learn, walk
from weft.operators.blocks import PAIRS, TRIPLES, Block, Sentences

STEPS = [a + b for a in "123" for b in "123" if a + b != "33"]


def keys(block: Block, cngs: int) -> dict[str, np.ndarray]:
    return {"1": block.lemma, "2": block.cng, "3": block.lemma * cngs + block.cng}


def transitions(sentences: Sentences) -> DataFrame | None:
    """paths.transitions() of paths.evidence(); None where pairs of keys of both kinds are too many for a dense table."""
    lemmas, cngs = len(sentences.lemmas), len(sentences.cngs)
    size = {"1": lemmas, "2": cngs, "3": lemmas * cngs}
    if size["3"] ** 2 > blocks.TABLE:
        return None

    def tables(block: Block) -> dict[str, np.ndarray]:
        key = keys(block, cngs)
        i, j, _, _ = block.pairs()
        first = {k: block.once(v) for k, v in key.items()}
        out = {}
        for a in key:
            for b in key:
                own = first[a][i] & first[b][j]
                out[a + b] = key[a][i[own]] * size[b] + key[b][j[own]]
        return out

    found = blocks.counted(sentences, tables)
    names = {"1": sentences.lemmas, "2": sentences.cngs, "3": [f"{a}_{b}" for a in sentences.lemmas for b in sentences.cngs]}
    whole = {k: {code // n: count for code, count in found.get(k + k, {}).items() if code // n == code % n} for k, n in size.items()}
    rows = [(s[0], names[s[0]][code // size[s[1]]], s[1], names[s[1]][code % size[s[1]]], n / whole[s[0]][code // size[s[1]]]) for s, codes in found.items() for code, n in codes.items()]
    return sentences.rows.sparkSession.createDataFrame(rows, "k1 string, x string, k2 string, y string, p double")


@dataclass
class Model:
    """Dense tables: hop[kinds][x, y] shares of sentences; the rest by lemmas or classes."""

    cngs: int
    verb: int
    classes: dict[str, int]  # feature code: number of its class
    typed: np.ndarray  # the class of a node by cng and whether its set is odd, -1 for none
    hop: dict[str, np.ndarray]
    f400: np.ndarray
    shares: list[np.ndarray]
    f011: np.ndarray
    f022: np.ndarray
    f033: np.ndarray


def fit(sentences: Sentences, verb: str, typed: dict[tuple[str, bool], str], classes: dict[str, str], unseen: float) -> Model:
    """One pass over all sentences counts what the tables need. typed: class by cng and whether the set is odd; classes:
    feature code: class."""
    lemmas, cngs = len(sentences.lemmas), len(sentences.cngs)
    names = list(classes.values())
    kind = np.array([[names.index(typed[c, odd]) if (c, odd) in typed else -1 for odd in (False, True)] for c in sentences.cngs], np.int64).reshape(-1, 2)
    at = sentences.cngs.index(verb) if verb in sentences.cngs else -1
    size = {"1": lemmas, "2": cngs, "3": lemmas * cngs}

    def tables(block: Block) -> dict[str, np.ndarray]:
        key, lemma, cng = keys(block, cngs), block.lemma, block.cng
        i, j, _, _ = block.pairs()
        first = {k: block.once(v) for k, v in key.items()}
        out = {f"sentences{k}": v[first[k]] for k, v in key.items()}
        for a, b in STEPS:
            own = first[a][i] & first[b][j]
            out[f"hop{a}{b}"] = key[a][i[own]] * size[b] + key[b][j[own]]
        other = i != j
        same = other & (cng[i] == cng[j])
        out |= {"cooc": lemma[i[other]] * lemmas + lemma[j[other]], "cng": cng[i[other]] * cngs + cng[j[other]], "same": lemma[i[same]] * lemmas + lemma[j[same]]}
        cls = kind[cng, block.sets % 2]
        verbs = block.once(lemma, cng == at)
        for k in range(len(names)):
            held = cls == k
            rest = verbs.copy()
            rest[i[(lemma[i] == lemma[j]) & held[j]]] = False
            once = block.once(lemma, held)
            own = rest[i] & once[j]
            out |= {f"rest{k}": lemma[rest], f"share{k}": lemma[i[own]] * lemmas + lemma[j[own]]}
        return out

    found = blocks.counted(sentences, tables)
    table = lambda name, *shape: blocks.dense(found.get(name), *shape)
    over = lambda n, whole: np.divide(n, whole, out=np.zeros(np.broadcast_shapes(n.shape, whole.shape)), where=whole > 0)
    cooc, same = table("cooc", lemmas, lemmas), table("same", lemmas, lemmas)
    hop = {s: over(table(f"hop{s}", size[s[0]], size[s[1]]), table(f"sentences{s[0]}", size[s[0]])[:, None]) for s in STEPS}
    shares = [over(table(f"share{k}", lemmas, lemmas), table(f"rest{k}", lemmas)[:, None]) for k in range(len(names))]
    return Model(cngs, at, {c: k for k, c in enumerate(classes)}, kind, hop, over(same, cooc), shares, blocks.smoothed(cooc), blocks.smoothed(table("cng", cngs, cngs), unseen=unseen), blocks.smoothed(same, halve=True))


def features(block: Block, model: Model, codes: list[str], short: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """li, ri (nodes of the block) and the columns by code of compatible pairs with li < ri, a bounded number at a time.

    short: with the columns besides the paths' codes, those of Model.
    """
    key, verb = keys(block, model.cngs), block.cng == model.verb
    i, j, fits, at = block.pairs()
    before = np.append(0, np.cumsum(verb))  # the verbs of a sentence are a run of all verbs
    verbs = np.flatnonzero(verb)
    own = np.flatnonzero(fits & (i < j))
    weight = np.cumsum(before[block.start[i[own]] + block.n[i[own]]] - before[block.start[i[own]]]) if len(own) else own
    cls = model.typed[block.cng, block.sets % 2]
    done = 0
    while done < len(own):
        base = weight[done - 1] if done else 0
        upto = max(done + 1, min(done + PAIRS, int(np.searchsorted(weight, base + TRIPLES, "right"))))
        a, b = i[own[done:upto]], j[own[done:upto]]
        first = before[block.start[a]]
        n = before[block.start[a] + block.n[a]] - first
        pair = np.repeat(np.arange(len(a)), n)
        m = verbs[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[pair]]
        good = fits[at[b[pair]] + m - block.start[m]] & (m != a[pair])
        pair, m = pair[good], m[good]
        left, right = a[pair], b[pair]
        on = {c: model.hop[c][key[c[0]][left], key[c[1]][m]] for c in {c[:2] for c in codes}}
        off = {c: model.hop[c][key[c[0]][m], key[c[1]][right]] for c in {c[1:] for c in codes}}
        out = {f"f{c}": np.bincount(pair, on[c[:2]] * off[c[1:]], len(a)) for c in codes}
        if short:
            x, y, p, q = block.lemma[a], block.lemma[b], block.cng[a], block.cng[b]
            out["f400"] = np.where(verb[a] | verb[b], 0.0, model.f400[x, y])
            for code, k in model.classes.items():
                out[f"f{code}"] = np.where(verb[a] & (cls[b] == k) & (cls[a] != k), model.shares[k][x, y], 0.0)
            out |= {"f011": model.f011[x, y], "f022": model.f022[p, q], "f033": np.where(p == q, model.f033[x, y], 0.0)}
        yield a, b, out
        done = upto


def feature_rows(sentences: Sentences, model: Model, codes: list[str], columns: list[str], flag: bool = True) -> DataFrame:
    """sent_id, li, ri, the columns, and flag: whether both lemmas are gold."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            for a, b, out in features(block, model, codes, flag):
                start = block.start[a]
                more = [pa.array((block.known[a] & block.known[b]).astype(np.int32))] if flag else []
                yield pa.RecordBatch.from_arrays([pa.array(block.sent[a]), pa.array((a - start).astype(np.int32)), pa.array((b - start).astype(np.int32)), *(pa.array(out[c]) for c in columns), *more], ["sent_id", "li", "ri", *columns, *(["flag"] if flag else [])])

    return sentences.map(run, "sent_id bigint, li int, ri int, " + ", ".join(f"{c} double" for c in columns) + (", flag int" if flag else ""))


def ranking(sentences: Sentences, model: Model, codes: list[str], weights: dict[str, float]) -> DataFrame:
    """paths.path_ranking(): sent_id, node_id, score of the nodes that aren't query nodes."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            score = np.zeros(len(block.sent))
            for a, b, out in features(block, model, codes):
                asked = block.query[a]
                score += np.bincount(b[asked], sum(w * out[c][asked] for c, w in weights.items()), len(score))
            own = np.flatnonzero(~block.query)
            yield pa.RecordBatch.from_arrays([pa.array(block.sent[own]), pa.array((own - block.start[own]).astype(np.int32)), pa.array(score[own])], ["sent_id", "node_id", "score"])

    return sentences.map(run, "sent_id bigint, node_id int, score double")


def greedy(sentences: Sentences, model: Model, codes: list[str], weights: dict[str, float]) -> DataFrame:
    """walk.predict() by paths: each sentence's matrix is the weighted sum of its pairs' columns."""
    names = np.array(sentences.lemmas, object)

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            *_, at = block.pairs()
            value = np.zeros(int(block.n.sum()))
            for a, b, out in features(block, model, codes):
                value[at[a] + b - block.start[b]] = sum(w * out[c] for c, w in weights.items())
            for n, nodes in block.sizes(2):
                matrix = value[at[nodes][:, :, None] + np.arange(n)]
                for part in walk.steps(block, nodes, [matrix], [1.0], "path"):
                    yield walk.chosen_rows(block, part, block_walks.is_chosen(part), names)

    return sentences.map(run, walk.CHOSEN)


def boundaries(sentences: Sentences, k: int) -> list[tuple[int, int, int]]:
    """The first pairs (sent_id, li, ri) of the second to the k-th of k even parts of all pairs in that order.

    Pairs are counted in ever smaller ranges of sentences; the ranges that hold a boundary are counted again.
    """

    def pairs_of(block: Block) -> np.ndarray:
        i, j, fits, _ = block.pairs()
        return i[fits & (i < j)]

    def ends(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            yield pa.RecordBatch.from_arrays([pa.array([int(block.sent.min())], pa.int64()), pa.array([int(block.sent.max())], pa.int64()), pa.array([len(pairs_of(block))], pa.int64())], ["low", "high", "n"])

    low, high, total = sentences.map(ends, "low bigint, high bigint, n bigint").selectExpr("min(low)", "max(high)", "sum(n)").first()
    size, more = divmod(total or 0, k)
    out = []
    for wanted in (f * size + min(f, more) for f in range(1, k)):
        if wanted >= (total or 0):
            break
        first, last, skip = low, high, wanted
        while first < last:
            width = -(-(last - first + 1) // 65_536)

            def bins(block: Block, first=first, last=last, width=width) -> dict[str, np.ndarray]:
                sent = block.sent[pairs_of(block)]
                return {"n": (sent[(sent >= first) & (sent <= last)] - first) // width}

            n = blocks.dense(blocks.counted(sentences, bins).get("n"), 65_536)
            upto = np.cumsum(n)
            at = int(np.searchsorted(upto, skip, "right"))
            skip -= int(upto[at - 1]) if at else 0
            first, last = first + at * width, min(last, first + at * width + width - 1)

        def those(found: Iterator[Block], sent_id=first) -> Iterator[pa.RecordBatch]:
            for block in found:
                i, j, fits, _ = block.pairs()
                own = fits & (i < j) & (block.sent[i] == sent_id)
                yield pa.RecordBatch.from_arrays([pa.array((x[own] - block.start[x[own]]).astype(np.int32)) for x in (i, j)], ["li", "ri"])

        out.append((first, *sorted(map(tuple, sentences.map(those, "li int, ri int").collect()))[skip]))
    return out


def fold_of(block: Block, a: np.ndarray, b: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """Into which part pairs fall, by the first pairs of the parts."""
    fold = np.zeros(len(a), np.int64)
    sent, li, ri = block.sent[a], a - block.start[a], b - block.start[b]
    for s, x, y in edges:
        fold += (sent > s) | (sent == s) & ((li > x) | (li == x) & (ri >= y))
    return fold


def logistic_weights(sentences: Sentences, model: Model, codes: list[str], columns: list[str], k: int = 4) -> DataFrame:
    """learn.logistic_weights() of the feature table in k parts. The columns are made anew in every pass, which takes less
    than to keep them: a table of all pairs is many times the size of the sentences."""
    edges = boundaries(sentences, k)

    def passed(weights: np.ndarray) -> DataFrame:
        def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            rows = ((block, *x) for block in found for x in features(block, model, codes))
            return learn.sums(((np.column_stack([out[c] for c in columns]), (block.known[a] & block.known[b]).astype(float), fold_of(block, a, b, edges)) for block, a, b, out in rows), weights)

        return sentences.map(run, learn.SUMS)

    return learn.named(sentences.rows.sparkSession, learn.minimised(passed, k, len(columns)), columns)
