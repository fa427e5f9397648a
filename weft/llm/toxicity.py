"""Toxic passages as maximal scoring segments of token log-odds.

1. Labelled documents give, for every token, the log-odds of toxic against clean documents under a Dirichlet prior whose
   mean is what the token's prefix (its first five characters) shows; tokens whose log-odds stand out by Z standard
   errors form the lexicon, all other tokens cost DRIFT.
2. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text.
3. Extreme-value theory says how many segments of a score clean text of that length has: E = K n exp(-lambda S), with
   lambda from the tokens' distribution in clean texts and K from the segments found there. Segments with E below
   ALPHA are the toxic passages.
4. A logistic curve over the best E, the number of significant passages and their density turns this into a
   probability.

Nulls and empty texts have no passage and get the score of such texts. Repeated rows each return their row. Several
labels of one document count as toxic if any is; null labels, and labels of documents that aren't there, are no labels.
Where the labelled documents aren't of both kinds there is nothing to learn: every score is 1 if all are toxic, else 0.
Texts of any length are scored whole; what a fit sends to the driver is the lexicon, sums by value and three numbers for
each text of the sample.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, prepare, remove, stored, table
from weft.llm.decontaminate import words_of

#: Labelled documents that the model is fitted on at most (those with the smallest hash of their ids).
SAMPLE = 20_000
#: How many standard errors the log-odds of the lexicon's tokens and prefixes stand out. The lexicon needs no limit of its
#: own: an entry stands in several toxic texts of the sample.
Z = 3.3
PREFIX, DRIFT, TOP = 5, 0.5, 6.0
ALPHA = 0.05
#: Scores of segments in clean text are counted by tenths up to here; higher ones count as this.
TALLEST = 60.0
#: Weight of the Dirichlet priors of prefixes and of tokens.
PRIOR_PREFIX, PRIOR_TOKEN = 4.0, 2.0
#: From this probability on a document is called toxic.
THRESHOLD = 0.3

SCORED = "doc_id bigint, score double, best double, passages array<struct<start:int,end:int,score:double,e_value:double>>"


def prefix(word: bytes) -> bytes:
    return word.decode("utf-8", "ignore")[:PREFIX].encode()


class Model:
    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float]):
        self.words, self.stems = words, stems
        self.rate, self.scale = 1.0, 1.0  # lambda and K
        self.mean, self.spread, self.weights = np.zeros(3), np.ones(3), np.array([-30.0, 0, 0, 0])

    def value(self, word: bytes) -> float:
        found = self.words.get(word)
        return self.stems.get(prefix(word), -DRIFT) if found is None else found

    def values(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The value of each word of each text; each distinct word is looked up once."""
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
        own = np.fromiter(map(self.value, number), np.float64, len(number))
        return [own[k] for k in ids]

    def e_value(self, score: float, n: int) -> float:
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def features(self, found: list[tuple[int, int, float]], n: int) -> list[float]:
        """Of the segments of a text of n words: -ln E of the best, count of significant ones, and these per word."""
        if not found:
            return [0.0, 0.0, 0.0]
        best = max(0.0, min(40.0, -math.log(max(self.e_value(max(s for *_, s in found), n), 1e-30))))
        good = sum(self.e_value(s, n) < ALPHA for *_, s in found)
        return [best, math.log1p(good), math.sqrt(good / n)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan over the positive values."""
    found: list[list] = []  # start, end, sum before, sum after
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(values)])
    for i in at.tolist():
        start, low, high = i, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append([start, i + 1, low, high])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(high - low)) for a, b, low, high in found]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def count_terms(train: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many documents of either kind each word is, counted in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                both[toxic].update(set(words_of(text)))
        words = list(both[0].keys() | both[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([prefix(w) for w in part], pa.binary()), pa.array([both[1][w] for w in part], pa.int64()), pa.array([both[0][w] for w in part], pa.int64())], ["word", "stem", "toxic", "clean"])

    counted = train.select("text", "toxic").mapInArrow(run, "word binary, stem binary, toxic bigint, clean bigint")
    return counted.groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(texts: DataFrame, share: float) -> Model:
    """The tokens and prefixes whose log-odds stand out; texts: text, toxic, each text once; share: of toxic ones."""
    words = count_terms(texts).checkpoint()
    base = math.log(share / (1 - share))

    def odds(toxic, clean, prior, weight):
        a, b = toxic + prior * weight, clean + (1 - prior) * weight
        value = F.log(a / b) - F.lit(base)
        return value, value / F.sqrt(1 / a + 1 / b)

    stems = words.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    own, z = odds(F.col("t"), F.col("c"), F.lit(share), F.lit(PRIOR_PREFIX))
    stems = stems.withColumn("prior", (F.col("t") + share * PRIOR_PREFIX) / (F.col("t") + F.col("c") + PRIOR_PREFIX)).withColumn("value", own).withColumn("z", z)
    value, z = odds(F.col("toxic"), F.col("clean"), F.col("prior"), F.lit(PRIOR_TOKEN))
    ranked = words.where("toxic > 0").join(stems.select("stem", "prior"), "stem").select("word", value.alias("value"), z.alias("z"))
    best = lambda df: {bytes(r[0]): min(TOP, r[1]) for r in df.where(F.col("z") >= Z).orderBy(df.columns[0]).collect()}
    return Model(best(ranked), best(stems.select("stem", "value", "z")))


def training(documents: DataFrame, labels: DataFrame, held_out, sample: int) -> tuple[DataFrame, str]:
    """text, toxic of the rows to learn from: those of at most `sample` labelled documents, found by a hash of their ids;
    and where this table is."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = known.where(~held_out).join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).checkpoint()
    return stored(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))


def fit(documents: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents for which held_out (a column of doc_id) is false."""
    spark = documents.sparkSession
    prepare(spark)
    train, path = training(documents, labels, held_out, sample)
    try:
        return learned(train)
    finally:
        remove(spark, path)


def learned(train: DataFrame) -> Model:
    """The model of the given texts (text, toxic)."""
    spark = train.sparkSession
    texts = train.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies would lend their words weight
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        model = Model({}, {})
        model.weights[0] = 30.0 if 1 in n else -30.0
        return model
    model = lexicon(texts, n[1] / (n[0] + n[1]))
    calibrate(model, train)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = [m.features(segments(v), len(v)) for v in m.values(as_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in x], pa.float64()) for k in range(3))], ["toxic", "a", "b", "c"])

    rows = np.array([tuple(r) for r in train.mapInArrow(run, "toxic int, a double, b double, c double").collect()])
    x = rows[:, 1:]
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = fit_logistic((x - model.mean) / model.spread, rows[:, 0])
    return model


def calibrate(model: Model, train: DataFrame) -> None:
    """Sets lambda and K from clean texts, whose values and segments every task sums first."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for values in sent.value.values(as_bytes(batch.column(0))):
                seen["words", 0.0] += len(values)
                seen.update(("hit", v) for v in np.round(values[values > 0], 1).tolist())
                seen.update(("segment", min(TALLEST, round(x, 1))) for *_, x in segments(values))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], ["kind", "value", "n"])

    sums = train.where("toxic = 0").select("text").mapInArrow(run, "kind string, value double, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in sums if r.kind == "words") + 1
    # Positive values in clean texts; half a token of the mean value stands for those not yet seen there.
    values = Counter({r.value: float(r.n) for r in sums if r.kind == "hit"})
    values[float(np.mean(list(model.words.values()) or [1.0]))] += 0.5
    v, c = np.array(list(values), float), np.array(list(values.values()), float)
    low, high = 1e-6, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        total = (c * np.exp(mid * v)).sum() / n + (1 - c.sum() / n) * math.exp(-mid * DRIFT)
        low, high = (mid, high) if total < 1 else (low, mid)
    model.rate = low
    at = round(float(np.median(v)), 1)
    seen = sum(r.n for r in sums if r.kind == "segment" and r.value >= at) + 0.5
    model.scale = seen / (n * math.exp(-low * at))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, best (-ln E of the best segment), passages (word ranges of significant segments) of every row."""
    prepare(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = m.values(as_bytes(batch.column(1)))
            features, passages = np.zeros((len(texts), 3)), []
            for i, values in enumerate(texts):
                found = segments(values)
                features[i] = m.features(found, len(values))
                passages.append([{"start": a, "end": b, "score": s, "e_value": e} for a, b, s in found if (e := m.e_value(s, len(values))) < ALPHA])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.probability(features)), pa.array(features[:, 0]), pa.array(passages, span)], ["doc_id", "score", "best", "passages"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCORED)


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    prepare(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            features = np.array([m.features(segments(v), len(v)) for v in m.values(as_bytes(batch.column(at)))]).reshape(-1, 3)
            yield batch.filter(pa.array(m.probability(features) < threshold))

    return documents.mapInArrow(run, documents.schema)


def is_held_out():
    """Rows that nothing is learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels"), is_held_out()))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
