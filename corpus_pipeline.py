"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.classifier import keep_good
from quire.llm.common import materialise, scratch_path
from quire.llm.decontam import drop_leaks
from quire.llm.mixing import mix_documents
from quire.llm.neardup import near_duplicates
from quire.llm.tokenbin import read_tokens, write_tokens

#: Near copies from this similarity on leave one document.
SIMILARITY = 80
#: Words of a block of the mix.
BLOCK_WORDS = 128
#: Pieces of text that a worker of the last stage remembers; fewer than alone, for four stages have run before.
PIECES = 150_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; of rows with one id and text, one.

    Null and empty texts and rows without an id have no copies but equal rows. An empty table gives no rows.
    """
    dropped = near_duplicates(docs, percent=SIMILARITY).filter(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("version"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(dropped.hint("shuffle_hash"), F.col("key") == F.col("doc_id"), "left_anti")
    again = F.row_number().over(Window.partitionBy("key", "version").orderBy(F.lit(0)))
    return rows.withColumn("again", again).filter((F.col("again") == 1) | F.col("key").isNull()).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that words of a document are taken."""
    mixed = mix_documents(docs, block_words=BLOCK_WORDS)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in mixed.columns else mixed


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row for each of its rows."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, pieces=PIECES)
    return read_tokens(spark, path)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_binary", token_binary),
]

#: A trained classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
