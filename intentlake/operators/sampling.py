"""Deterministic distractor sampling and candidate pools without a cross join.

The catalogue gets a dense index; a request draws its distractors at the places (a * j + b) mod p for
j = 0, 1, 2, ..., where p is the least prime not under the catalogue's size and a, b come from a hash
of the seed and the request. These places never repeat, so a pool of n tools costs about n rows and
one equi-join, whatever the catalogue's size. The draw depends on the seed and the request alone,
not on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentlake.functions.text import hash_bucket
from intentlake.session import cut_lineage


def unique_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order; null keys are left out."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """``df`` with places 0, 1, 2, ... in the given order (which must be total).

    Sorted by range partitions; only the partitions' sizes come to the driver.
    """
    parted = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in parted.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(sizes):
        base[p] = total
        total += sizes[p]
    # One row for each partition; the rows of a partition are numbered from its offset.
    offsets = df.sparkSession.createDataFrame(sorted(base.items()), "_p int, _offset bigint")
    place = Window.partitionBy("_p").orderBy(*order)
    numbered = parted.withColumn(out, F.row_number().over(place).cast("bigint") - 1)
    return numbered.join(F.broadcast(offsets), "_p").withColumn(out, F.col(out) + F.col("_offset")).drop("_p", "_offset")


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def pools(samples: DataFrame, sample_key: Sequence[str], gold: str, catalogue: DataFrame, sizes: Sequence[int], seed: int = 7) -> DataFrame:
    """(sample key, ``pool_size``, ``name``, ``pos``, ``is_gold``): a candidate pool of each size for every sample.

    ``gold`` is an array of names, ``catalogue`` has ``idx`` (dense) and ``name`` (unique). A pool holds the
    sample's known gold names and distractors up to the size; if there are fewer others it holds them
    all, and never leaves gold out. Places are shuffled by a hash of sample and name. Samples without a
    known gold name have no pool.
    """
    n = catalogue.count()
    prime = next_prime(n)
    names = catalogue.select("idx", "name")
    asked = samples.select(*sample_key, F.coalesce(F.array_distinct(gold), F.array().cast("array<string>")).alias("_gold"))
    golds = asked.select(*sample_key, F.explode("_gold").alias("name")).join(names, "name").select(*sample_key, "name")
    known = golds.groupBy(*sample_key).agg(F.count("*").alias("_n_gold"))
    wanted = asked.join(known, list(sample_key)).withColumn("pool_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("pool_size"), *[F.col(k).cast("string") for k in sample_key])
    a = hash_bucket(F.concat(text, F.lit("|a")), max(prime - 1, 1)) + 1
    b = hash_bucket(F.concat(text, F.lit("|b")), prime)
    # Places that may be lost: past the catalogue's end or gold.
    draws = F.least(F.lit(prime), F.col("pool_size") + (prime - n) + F.size("_gold"))
    drawn = wanted.select(*sample_key, "pool_size", "_gold", "_n_gold", a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.lit(0), draws.cast("int") - 1)).alias("_j"))
    drawn = drawn.withColumn("idx", F.pmod(F.col("_a") * F.col("_j") + F.col("_b"), F.lit(prime))).join(names, "idx")
    drawn = drawn.where(~F.array_contains("_gold", F.col("name")))
    place = Window.partitionBy(*sample_key, "pool_size").orderBy("_j")
    others = drawn.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= F.col("pool_size") - F.col("_n_gold"))
    both = others.select(*sample_key, "pool_size", "name", F.lit(False).alias("is_gold")).unionByName(
        wanted.select(*sample_key, "pool_size").join(golds, list(sample_key)).select(*sample_key, "pool_size", "name", F.lit(True).alias("is_gold"))
    )
    key = F.sha2(F.concat_ws("|", F.lit(f"{seed}"), F.col("pool_size"), *[F.col(k).cast("string") for k in sample_key], "name"), 256)
    order = Window.partitionBy(*sample_key, "pool_size").orderBy(key, "name")
    # Pools are joined several times by what follows; they are drawn once.
    return cut_lineage(both.withColumn("pos", F.row_number().over(order)).select(*sample_key, "pool_size", "name", "pos", "is_gold"))


def first_n(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of every key, the first in order (example queries, accepted queries up to a target)."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= n).drop("_r")


def chunk_number(order: Column, size: int) -> Column:
    """The number of a fixed-size chunk from a place counted from 0."""
    return F.floor(order / size).cast("bigint")
