"""The corpus pipeline: documents to packed training sequences, in five stages of the operators in cairnfield.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import decontaminate, langid, line_dedup, packing, queries, simhash
from cairnfield.llm.common import remove, scratch, shared_dir

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language (no letter, or a posterior below 1/2).

    The language found replaces a missing lang; a given one stays.
    """
    model = langid.train(docs)
    found = langid.identify(spark, docs.select(*COLUMNS), model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand elsewhere before; n_chars follows the text. No document goes, even if it is empty now."""
    out = line_dedup.dedup_passages(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row per piece."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sequences", sequences),
]

#: SQL can't express hashed n-gram models, XXH64 fingerprints or a tokenizer: tests/llm/test_learned.py holds run()
#: against the five stages in plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is a table in the shared folder, gone once the next has read it;
    what the operators keep there goes with their stage."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
