"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Rules drop bad documents, one document of each group of near copies stays, documents with benchmark items go,
personal data is replaced, and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import decontamination, jaccard_join, packing, pii, quality_rules
from gridlake.llm.graph import BATCH_BYTES, discard, release, shared_folder


def _lean(stage):
    """The stage, in a session that gives workers small batches, as its table is written after this returns; a limit that the session has stays.
    What the stage before it has left in the driver goes first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, judged where they stand."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id; of rows with that id, the first by text."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced and n_chars brought up to date."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each with its place in a sequence."""
    return packing.pack(docs)


STAGES = [(name, _lean(stage)) for name, stage in (("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("personal data", personal_data), ("best-fit packing", packed))]

#: The join, the field and the packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left after all stages. Each stage's table goes once the next one is written, so that the
    corpus stands there twice at most. Null and empty texts fail the rules; repeated rows count as copies; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            discard(spark, f"{top}/{k - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
