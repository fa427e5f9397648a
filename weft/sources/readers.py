"""Reading the corpus' own file kinds, and writing results."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^\w*.p$"
STRICT_NAME = r"\.p$"


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A CSV file with the given columns; line ends of both kinds; rows that don't parse are null, not dropped."""
    rows = spark.read.schema(schema).csv(path, header=header)
    return rows.select(*(F.rtrim(F.regexp_replace(c, "\r$", "")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV file with a header; the others aren't parsed."""
    return spark.read.csv(path, header=True).select(*columns)


def nested_counts(rows: DataFrame, column: str) -> DataFrame:
    """a, b, n out of JSON objects of objects of counts."""
    outer = rows.select(F.explode(F.from_json(column, "map<string,map<string,bigint>>")).alias("a", "inner"))
    return outer.select("a", F.explode("inner").alias("b", "n"))


def rule_lines(lines: DataFrame) -> DataFrame:
    """left, right, result of junction rules; lines with fewer fields and results with a space are left out."""
    f = F.split("value", r'[ "]*,[ "]*')
    return lines.where(F.size(f) > 3).select(f[1].alias("left"), f[2].alias("right"), f[3].alias("result")).where(~F.col("result").contains(" "))


def rule_lengths(rules: DataFrame) -> DataFrame:
    """left, right, length of the pairs all of whose results are equally long."""
    return rules.groupBy("left", "right").agg(F.min(F.length("result")).alias("length"), F.max(F.length("result")).alias("longest")).where("length = longest").drop("longest")


def corpus_tokens(lines: DataFrame) -> DataFrame:
    """value, tokens: words left of "=>", tabs deleted, cut at spaces; an empty line has one empty token."""
    return lines.withColumn("tokens", F.split(F.replace(F.trim(F.substring_index("value", "=>", 1)), F.lit("\t"), F.lit("")), " "))


def valid_name(c: Column) -> Column:
    return c.rlike(NAME)


def paired(lattices: DataFrame, gold: DataFrame, required: bool = False) -> DataFrame:
    """lattices with their gold rows; a name that ends in 2 belongs to the gold of the name without it.

    required: lattices without gold are left out instead of kept with nulls.
    """
    return lattices.withColumn("gold_file", F.regexp_replace("file", "2$", "")).join(gold.withColumnRenamed("file", "gold_file"), "gold_file", "inner" if required else "left")


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """File names of valid form in both listings."""
    return left.select("file").intersect(right.select("file")).where(valid_name(F.col("file")))


def snapshot(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an explicit order (a top-n: no task sorts everything)."""
    return rows.orderBy(*order).limit(n)


def finished(lines: DataFrame, path: str) -> DataFrame:
    """Log lines that say that a path's process has finished."""
    return lines.where(F.col("value").contains(path) & F.col("value").contains("Process Finished"))


def write_sharded(rows: DataFrame, path: str, per_file: int = 100) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


class Plain(pickle.Unpickler):
    """Reads pickles of plain containers, strings and numbers; of objects it takes the attributes and runs nothing."""

    class Record(dict):
        def __init__(self, *values):
            super().__init__()
            if values:
                self["values"] = list(values)

        def __setstate__(self, state):
            self.update(state if isinstance(state, dict) else {"state": state})

    def find_class(self, module: str, name: str):
        if (module, name) in (("builtins", "set"), ("builtins", "frozenset"), ("__builtin__", "set")):
            return list
        if module in ("builtins", "__builtin__", "copyreg", "os", "posix", "sys", "subprocess", "importlib"):
            raise pickle.UnpicklingError(f"{module}.{name} is not read")
        return type(name, (Plain.Record,), {})


def pickles(spark: SparkSession, path: str) -> DataFrame:
    """file, json of pickled files: a file that doesn't hold plain data has a null json."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(json.dumps(Plain(io.BytesIO(data), encoding="utf-8").load(), ensure_ascii=False, default=list))
                except Exception:  # noqa: BLE001  a corrupt file is a null, whatever is wrong with it
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["file", "json"])

    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, json string")
