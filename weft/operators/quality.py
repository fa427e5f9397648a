"""Checks of candidates against gold, corrections, and the bookkeeping of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEMMA = ["sent_id", "chunk_id", "lemma"]


def full_coverage(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """sent_id, covered: whether every gold lemma is a candidate of its chunk."""
    have = nodes.select(*LEMMA).distinct().withColumn("there", F.lit(1))
    return gold.join(have, LEMMA, "left").groupBy("sent_id").agg((F.count("*") == F.sum(F.coalesce("there", F.lit(0)))).alias("covered"))


def eligibility(nodes: DataFrame, gold: DataFrame, tokens: DataFrame, stripped) -> DataFrame:
    """sent_id, code: 1 if the numbers of tokens or chunks differ, 2 if a gold lemma is missing (as it is and without its
    prefix), else 0. tokens: sent_id, n_tokens; stripped: a function that takes the prefix off a column.
    """
    chunks = lambda df, name: df.groupBy("sent_id").agg(F.countDistinct("chunk_id").alias(name))
    have = nodes.select(*LEMMA).distinct().withColumn("there", F.lit(1))
    bare = have.withColumnRenamed("lemma", "bare").withColumnRenamed("there", "there_bare")
    found = gold.withColumn("bare", stripped(F.col("lemma"))).join(have, LEMMA, "left").join(bare, ["sent_id", "chunk_id", "bare"], "left")
    missing = found.groupBy("sent_id").agg(F.max(F.when(F.col("there").isNull() & F.col("there_bare").isNull(), 1).otherwise(0)).alias("missing"))
    counts = tokens.join(chunks(nodes, "n_nodes"), "sent_id").join(chunks(gold, "n_gold"), "sent_id").join(missing, "sent_id")
    wrong = (F.col("n_tokens") != F.col("n_gold")) | (F.col("n_nodes") != F.col("n_gold"))
    return counts.select("sent_id", F.when(wrong, 1).when(F.col("missing") == 1, 2).otherwise(0).alias("code"))


def presence(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """gold rows with presence: 1 with lemma and class, -1 with the lemma only, else 0; and the sentence's status."""
    whole = nodes.select(*LEMMA, "cng").distinct().withColumn("whole", F.lit(1))
    part = nodes.select(*LEMMA).distinct().withColumn("part", F.lit(1))
    marked = gold.join(whole, [*LEMMA, "cng"], "left").join(part, LEMMA, "left").withColumn("presence", F.when(F.col("whole") == 1, 1).when(F.col("part") == 1, -1).otherwise(0))
    bad = F.max((F.col("presence") == 0).cast("int")).over(Window.partitionBy("sent_id"))
    return marked.select(*LEMMA, "cng", "presence", F.when(bad == 1, "Bad").otherwise("Good").alias("status"))


def missing(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """sent_id, n_missing of the sentences that lack distinct gold lemmas."""
    return gold.select(*LEMMA).distinct().join(nodes.select(*LEMMA), LEMMA, "left_anti").groupBy("sent_id").agg(F.count("*").alias("n_missing"))


def bad_sentences(senses: DataFrame) -> DataFrame:
    """Sentences with a sense that has lemmas but no forms; senses: sent_id, n_lemmas, n_forms."""
    return senses.where("n_lemmas > 0 and n_forms = 0").select("sent_id").distinct()


def replaced(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """gold with corrected lemmas; corrections: sent_id, chunk_id, lemma, new, ord; the last correction of a lemma holds."""
    last = corrections.groupBy(*LEMMA).agg(F.max_by("new", "ord").alias("new"))
    return gold.join(last, LEMMA, "left").withColumn("lemma", F.coalesce("new", "lemma")).drop("new")


def inserted(nodes: DataFrame, additions: DataFrame) -> DataFrame:
    """Candidates with missing ones added; additions have the columns of nodes except node_id and set_id."""
    columns = ["sent_id", "chunk_id", "pos", "surface", "lemma", "cng"]
    return nodes.select(*columns).unionByName(additions.select(*columns))


def manifest(sources: list[DataFrame]) -> DataFrame:
    """file, path, source out of several lists; a later list overrides an earlier one."""
    every = None
    for k, s in enumerate(sources):
        s = s.select("file", "path", F.lit(k).alias("source"))
        every = s if every is None else every.unionByName(s)
    return every.groupBy("file").agg(F.max_by("path", F.struct("source", "path")).alias("path"), F.max("source").alias("source"))


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__place = 1").drop("__place")


def undone(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return every.select(key).distinct().join(done.select(key), key, "left_anti")


def whole_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows all of whose keys are numbers, with integer keys."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double"))).withColumn(k, F.col(k).cast("int"))
    return rows


#: Fixed value: the status of sentences whose candidates have fewer chunks than gold.
INCOMPLETE = "Incomplete chunk"


def missing_report(nodes: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """sent_id, n_missing (text) of all sentences of gold: the number of missing lemmas, or that chunks lacks chunks."""
    have = chunks.groupBy("sent_id").agg(F.countDistinct("chunk_id").alias("have"))
    rows = gold.groupBy("sent_id").agg(F.countDistinct("chunk_id").alias("want")).join(have, "sent_id", "left").join(missing(nodes, gold), "sent_id", "left")
    return rows.select("sent_id", F.when(F.coalesce("have", F.lit(0)) < F.col("want"), INCOMPLETE).otherwise(F.coalesce("n_missing", F.lit(0)).cast("string")).alias("n_missing"))


def without_lemmas(rows: DataFrame, lemmas: list[str]) -> DataFrame:
    return rows.where(~F.col("lemma").isin(lemmas))


def live_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value other than 0 in one of the columns."""
    return rows.where(" or ".join(f"{c} <> 0" for c in columns))


def in_ranges(rows: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie in closed ranges; None leaves an end open."""
    for c, (low, high) in ranges.items():
        rows = rows.where((F.lit(True) if low is None else F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) <= high))
    return rows


def class_flags(cng, compat_mode: bool = False) -> dict:
    """Whether a class is a noun, a verb and one of its participles. compat_mode: ppa counts as ppp, and nothing as ppa."""
    ppp = (cng == -190) | (cng == -200) if compat_mode else cng == -190
    ppa = F.lit(False) if compat_mode else cng == -200
    return {"nouns": cng > 3, "verbs": cng < 0, "gerund": cng == -210, "ppp": ppp, "ppa": ppa, "inf": cng == -220, "absol": cng == -230}


def single_lemma(nodes: DataFrame) -> DataFrame:
    """Chunks with exactly one lemma that isn't empty."""
    return nodes.where("lemma <> ''").groupBy("sent_id", "chunk_id").agg(F.count("*").alias("n")).where("n = 1").select("sent_id", "chunk_id")


def parts_between(rows: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """The rows with a value, and part: how many rows without one stand before them."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum(F.col(value).isNull().cast("bigint")).over(before)).where(F.col(value).isNotNull())


def solutions(gold: DataFrame, stripped) -> DataFrame:
    """sent_id, lemma: every gold lemma and its twin without prefix, repeats kept."""
    return gold.select("sent_id", F.explode(F.array("lemma", stripped(F.col("lemma")))).alias("lemma"))


def sliced(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sent_id, chunk_id, p, next) with surface: the chunk's letters from p to where its lemma `next` stands first.

    Without a next lemma the letters go to the end; if it isn't a candidate, to the last but one.
    """
    named = nodes.groupBy("sent_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "surface"))), lambda x: x["surface"]), "").alias("name"))
    place = nodes.groupBy("sent_id", "chunk_id", F.col("lemma").alias("next")).agg(F.min("pos").alias("q"))
    rows = wanted.join(named, ["sent_id", "chunk_id"]).join(place, ["sent_id", "chunk_id", "next"], "left")
    end = F.when(F.col("next").isNull(), F.length("name")).otherwise(F.coalesce("q", F.length("name") - 1))
    return rows.withColumn("surface", F.substring("name", F.col("p") + 1, F.greatest(end - F.col("p"), F.lit(0)))).drop("name", "q")


def shown(nodes: DataFrame) -> DataFrame:
    """sent_id, shown: chunk, position and lemma of a sentence's candidates in one line."""
    word = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("pos").cast("string"), "lemma")
    return nodes.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", word.alias("word")))), lambda x: x["word"]), " ").alias("shown"))


def words_at(nodes: DataFrame, chunk: int, pos: int) -> DataFrame:
    return nodes.where((F.col("chunk_id") == chunk) & (F.col("pos") == pos))
