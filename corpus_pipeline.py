"""From raw documents to packed sequences, stage by stage.

Each stage takes all that the stage before it kept, is written as Parquet, and the
next one reads that. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.mixing import mix_sources
from lorekeep.llm.odd_sketch import link_documents
from lorekeep.llm.packing import pack_documents
from lorekeep.llm.suffix_dedup import remove_repeats
from lorekeep.llm.toxicity import SETTINGS as TOXICITY
from lorekeep.llm.toxicity import learnable, score_toxicity
from lorekeep.session import remove, settled, work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels only teach the scores."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = score_toxicity(docs, learnable(labels))
    return scored.where(F.col("toxicity") < TOXICITY.threshold).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    copies = link_documents(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur again anywhere.

    A character that a cut runs through goes as a whole; the document stays, even if empty.
    """
    done, cut = remove_repeats(docs), F.col("repeats.n_removed") > 0
    done = done.withColumn("text", F.when(cut, F.col("repeats.text")).otherwise(F.col("text")))
    return done.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source comes near its target."""
    return mix_sources(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    home = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        before = settled(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        for path in settled(spark) - before:  # the stage's own tables, now that it is written
            if not path.endswith(home.rpartition("/")[2]):
                remove(spark, path)
    return docs
