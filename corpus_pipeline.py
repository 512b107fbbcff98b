"""The corpus pipeline: documents in, encoded documents of the mix out. Each stage calls one operator of tidewater.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import language_id, mixing, secret_scan, sentencepieces, simhash
from tidewater.llm.common import new_path, table

STAGES = [
    ("language_id", language_id.stage),
    ("simhash", simhash.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("sentencepieces", sentencepieces.stage),
]

#: SQL can't express the first stage's network, nor the encoding of the last; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
