"""The usage log of model calls: an append-only sink and its summary, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = (
    "stage string, model string, base_url string, latency_ms double, prompt_chars bigint, response_chars bigint, "
    "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
)


def append_usage(rows: DataFrame, path: str) -> None:
    """Add rows to the log; concurrent writers add files of their own."""
    rows.write.mode("append").json(path)


def read_usage(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The log with a fixed schema, as a table or as a stream of the files that are added."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(USAGE).json(path)


def summarize_usage(log: DataFrame) -> DataFrame:
    """(``stage``, ``model``, calls, mean latency, tokens): the same plan for a table and a stream; null counts add nothing."""
    return log.groupBy("stage", "model").agg(
        F.count("*").alias("calls"), F.avg("latency_ms").alias("latency_ms"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
    )
