"""A corpus pipeline: language, near copies, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last give the columns of documents.
As each is written before the next begins, a stage first deletes what the one before it has left in
the shared folder: a result must be written, or read, before the next stage function is called.
Columns of any name come through. Null and empty texts go with the first stage, which can't tell their language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.llm import langid, mixing, ngram_join, packing, substring
from eavspark.llm.shared import drop, stage, step, unused

#: Folders that the stage before has left.
LEFT: list[str] = []


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (no letters, or unlike all of them) go; the others get it as their lang."""
    with step(spark, LEFT):
        names = [unused(docs, f"_{c}") for c in ("lang_pred", "score", "rejected")]
        found = langid.identify(docs, langid.fit(docs), names).where(~F.col(names[2]))
        return found.withColumn("lang", F.col(names[0])).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    with step(spark, LEFT):
        key = unused(docs, "_key")
        numbered = stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
        of = ngram_join.classes(numbered.select("doc_id", "text", key), keep=key)
        return numbered.join(of.where("kept").select(key), key, "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of long passages are cut from the texts; a document of which nothing is left goes."""
    with step(spark, LEFT):
        left = substring.remove(docs)
        return left.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes words of it: whole at each full taking, and its first words for the rest."""
    with step(spark, LEFT):
        key, copy = unused(docs, "_key"), unused(docs, "_copy")
        numbered = stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
        takes = mixing.mix(numbered.select(F.col(key).alias("doc_id"), "source", "text"))
        whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
        part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
        copies = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
        takes = takes.select(F.col("doc_id").alias(key), F.transform(copies, lambda n: F.struct(n.alias("words"), (n < F.col("size")).alias("cut"))).alias(copy))
        both = numbered.join(takes, key).withColumn(copy, F.explode(copy))
        words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        head = F.array_join(F.slice(words, F.lit(1), F.col(f"{copy}.words")), "")
        both = both.withColumn("text", F.when(F.col(f"{copy}.cut"), head).otherwise(F.col("text")))
        return both.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    with step(spark, LEFT):
        return packing.pack(docs)


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("packing", pack),
]

#: Hashed models and chains are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
