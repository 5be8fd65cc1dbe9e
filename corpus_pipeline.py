"""The corpus pipeline: classify, drop repeated lines, drop near duplicates, mix sources, pack.

Each stage takes all its predecessor kept and returns the columns of ``documents``; the last returns the
pieces of packed sequences.  ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import drop_staged, new_path, staging
from gristmill.llm.linededup import dedup_lines
from gristmill.llm.minhash import one_per_class
from gristmill.llm.mixing import mix_documents
from gristmill.llm.packing import pack_documents
from gristmill.llm.quality import fit_quality, held_out, score_documents

#: Documents of a lower score go.
LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on labelled documents that aren't held out, and keeps documents it accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit_quality(docs, labels, ~held_out(F.col("doc_id"))), score_col="__gm_score")
    return scored.where(F.col("__gm_score") >= LEAST_SCORE).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of two and more documents stay in the first of them."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id."""
    return one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights, none beyond three passes; a row per document and pass."""
    return mix_documents(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 token ids."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_copies), ("mixing", mix), ("packing", pack)]

#: Model scores, samples and encoded texts are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again.  What a stage has staged, and
    what it has read, goes once its result is written; the tables of the last stage stay, as the result reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        with staging() as mine:
            path = new_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
        written = path.rsplit("/", 1)[1]
        drop_staged(spark, [*read, *(n for n in mine if n != written)])
        docs, read = spark.read.parquet(path), [written]
    return STAGES[-1][1](spark, docs, sf_dir)
