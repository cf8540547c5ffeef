"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.decontam import decontaminated
from lodestore.llm.linededup import drop_boilerplate
from lodestore.llm.mixing import mixed_documents
from lodestore.llm.neardup import drop_near_duplicates
from lodestore.llm.shared import cell, stash
from lodestore.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars, where there is one, follows the text; every document stays."""
    cut = drop_boilerplate(docs, host="source", counts=("_lines", "_dropped"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*map(cell, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a ten-word window of a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row each; ``copies`` (1 or 2) says how often, and is to be applied as a weight.

    Documents that it takes no copy of go. Nulls, empty texts and repeated rows: see ``mixed_documents``.
    """
    return mixed_documents(docs).where("copies > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the classifier and the dictionaries; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name.replace(" ", "-"))
    return docs
