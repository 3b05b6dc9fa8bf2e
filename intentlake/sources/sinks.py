"""Writing tables, and the vector cache table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED: tuple[str, ...] = ("/etc", "/usr", "/bin", "/boot", "/proc", "/sys", "/dev")


def checked_path(path: str, reserved: tuple[str, ...] = RESERVED) -> str:
    """The path, or an error if it lies below a reserved folder."""
    full = Path(path).expanduser().resolve() if "://" not in path else path
    if "://" not in path and any(full == Path(r) or Path(r) in full.parents for r in reserved):
        raise ValueError(f"{path} lies below a reserved folder")
    return str(path)


def write_json_object(df: DataFrame, path: str, field: str, order: str) -> None:
    """One JSON file ``{field: [...]}``, a row a line, in the order of ``order``; rows pass the driver one by one, whatever their number."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(checked_path(path))
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        held = ["{" + json.dumps(field, ensure_ascii=False) + ": ["]
        first = True
        for row in df.orderBy(order).drop(order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            held.append(("\n  " if first else ",\n  ") + row.j)
            first = False
            if len(held) > 4096:
                out.write(bytearray("".join(held).encode()))
                held = []
        out.write(bytearray("".join([*held, "\n]}\n"]).encode()))
    finally:
        out.close()


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, a folder with a file for each partition."""
    df.write.mode(mode).json(checked_path(path))


def scaled_rows(pools: DataFrame, samples: DataFrame, tools: DataFrame) -> DataFrame:
    """Lines of a scaled benchmark: ``id`` = sample and size, ``original_id``, size, nested question, functions in pool order, gold."""
    detailed = pools.join(tools.select("name", "description", "parameters"), "name")
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "description", "parameters")))
    function = F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["description"].alias("description"), x["parameters"].alias("parameters")))
    gold = F.array_sort(F.collect_set(F.when(F.col("is_gold"), F.col("name"))))
    grouped = detailed.groupBy("ord", "pool_size").agg(function.alias("function"), gold.alias("correct_tools"))
    question = F.array(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))))
    return grouped.join(samples.select("ord", "query"), "ord").select(
        F.concat(F.col("ord").cast("string"), F.lit("_n"), F.col("pool_size").cast("string")).alias("id"), F.col("ord").cast("string").alias("original_id"),
        F.col("pool_size").alias("candidate_size"), question.alias("question"), "function", "correct_tools",
    )


def augmented_bodies(skills: DataFrame, generated: DataFrame) -> DataFrame:
    """Skills whose ``body`` has their generated queries appended."""
    lists = generated.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: F.concat(F.lit("- "), x["query"])).alias("_q"))
    joined = skills.join(lists, skills["skill_id"] == lists["name"], "left").drop(lists["name"])
    extra = F.concat(F.lit("\n\nGENERATED_QUERIES:\n"), F.array_join("_q", "\n"))
    return joined.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.coalesce(extra, F.lit("")))).drop("_q")


class VectorCache:
    """A table of vectors by embedder signature and document digest.

    ``vectors`` computes only what is missing: an anti-join on the digest, each document once however
    often it occurs. New rows are appended under the signature's partition, so a run that ends early
    goes on where it stopped, and another signature never matches.
    """

    def __init__(self, spark: SparkSession, path: str, signature: str):
        self.spark, self.path, self.signature = spark, checked_path(path), signature

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        return self.spark.read.parquet(self.path).where(F.col("signature") == self.signature).select("digest", "vector")

    def vectors(self, docs: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch_size: int = 256) -> DataFrame:
        """``docs`` with ``digest`` and ``vector``; null texts have null vectors."""
        keyed = docs.withColumn("digest", F.sha2(F.col(text), 256))
        missing = keyed.where("digest is not null").groupBy("digest").agg(F.min(text).alias("_t")).join(self.read(), "digest", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, batch_size):
                    part = batch.slice(a, batch_size)
                    out = pa.array(embed(part.column(1).to_pylist()), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), out], ["digest", "vector"])

        new = missing.select("digest", "_t").mapInArrow(run, "digest string, vector array<double>")
        new.withColumn("signature", F.lit(self.signature)).write.mode("append").partitionBy("signature").parquet(self.path)
        return keyed.join(self.read().dropDuplicates(["digest"]), "digest", "left")
