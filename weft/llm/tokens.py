"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. Byte-level tokens are its bytes cut in pieces, so their lengths give their character spans.
Sections are character spans; sorted, they are joined with the sorted token spans by binary search. A token that reaches
over the edge of a section is allocated by a rule: to the section of its first character ("start"), of its last one
("end"), or to the one that holds most of its characters, the first of equals ("most").

By default the sections of a text are its lines, each with its line end, so that they cover the text and their counts
add up to the document's. Null and empty texts have no tokens and no sections. Repeated rows each return their row.
Characters that no section covers count for none; the operator returns their tokens as rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.chat import VOCABULARY, Encoder
from weft.llm.common import as_bytes, prepare, table

RULES = ("start", "end", "most")
COUNTED = "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, rest bigint, section_tokens array<bigint>"


def token_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; tokens may cut a character."""
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return character[starts], character[ends - 1] + 1


def lines(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines of a text."""
    before = np.cumsum((raw & 0xC0) != 0x80)
    stops = before[np.flatnonzero(raw == 10)]
    if not len(stops) or stops[-1] < before[-1]:
        stops = np.append(stops, before[-1])
    return np.concatenate([[0], stops[:-1]]), stops


def allocate(first: np.ndarray, last: np.ndarray, opens: np.ndarray, closes: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """The section of each token (-1: none), and how many tokens reach over an edge; sections are sorted and disjoint."""

    def of(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(opens, at, "right") - 1
        return np.where((k >= 0) & (at < closes[np.maximum(k, 0)]), k, -1)

    a, b = of(first), of(last - 1)
    crossing = np.flatnonzero((a != b) | ((a >= 0) & (last > closes[np.maximum(a, 0)])))
    owner = (b if rule == "end" else a).copy()
    if rule == "most":
        for t in crossing.tolist():
            lo = max(0, int(np.searchsorted(closes, first[t], "right")))
            hi = int(np.searchsorted(opens, last[t]))
            shared = np.minimum(last[t], closes[lo:hi]) - np.maximum(first[t], opens[lo:hi])
            owner[t] = lo + int(shared.argmax()) if len(shared) and shared.max() > 0 else -1
    return owner, len(crossing)


def count(documents: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, rest, section_tokens of every document.

    sections: a column of array<struct<start,end>> with sorted disjoint character spans; without it, the lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = documents.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(sent.value)
            given = batch.column(2).to_pylist() if sections else [None] * len(batch)
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), given, strict=True):
                if not text:
                    n = len(spans or ())
                    out.append((i, 0, n, 0, 0, [0] * n))
                    continue
                raw = np.frombuffer(text, np.uint8)
                _, ends = encoder.encode(text.decode())
                first, last = token_spans(raw, ends)
                opens, closes = (np.array([s[k] for s in spans or ()], np.int64) for k in ("start", "end")) if sections else lines(raw)
                if not len(opens):
                    out.append((i, len(ends), 0, 0, len(ends), []))
                    continue
                owner, crossing = allocate(first, last, opens, closes, rule)
                counts = np.bincount(owner[owner >= 0], minlength=len(opens))
                out.append((i, len(ends), len(opens), crossing, int((owner < 0).sum()), counts.tolist()))
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], [x.split(" ")[0] for x in COUNTED.split(", ")])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([sections] if sections else [])).mapInArrow(run, COUNTED)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
