"""Summaries of predictions and rankings, and comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentlake.functions.metrics import all_metrics


def rate(flag: str | Column) -> Column:
    """The share of true among the values that aren't null; null if there are none."""
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


def summarize(df: DataFrame, by: Sequence[str] = (), flag: str = "is_correct") -> DataFrame:
    """(by, ``total``, ``evaluated``, ``correct``, ``accuracy``); accuracy is null where nothing is evaluated."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count(flag).alias("evaluated"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("correct"), rate(flag).alias("accuracy")
    )


def summarize_runs(df: DataFrame, by: Sequence[str], flags: Sequence[str], means: Sequence[str]) -> DataFrame:
    """(by, ``count``, rates of flags and means of numbers over non-null values)."""
    return df.groupBy(*by).agg(F.count("*").alias("count"), *[rate(f).alias(f) for f in flags], *[F.avg(m).alias(m) for m in means])


def ranking_report(df: DataFrame, ranked: str, gold_scored: str, gold_all: str, grades: str | None = None) -> DataFrame:
    """(``stratum``, ``count``, metrics): means over all samples, those with one gold name and those with several.

    Metrics use ``gold_scored`` (the gold inside the pool), strata the size of ``gold_all``. Samples
    without scored gold or without a ranking are left out; a stratum without samples has no row.
    """
    used = df.where((F.size(F.coalesce(gold_scored, F.array().cast("array<string>"))) > 0) & F.col(ranked).isNotNull())
    metrics = all_metrics(F.col(ranked), F.col(gold_scored), F.col(grades) if grades else None)
    strata = F.array(F.lit("all"), F.when(F.size(F.array_distinct(gold_all)) == 1, "single").otherwise("multi"))
    rows = used.select(F.explode(strata).alias("stratum"), *[m.alias(n) for n, m in metrics.items()])
    return rows.groupBy("stratum").agg(F.count("*").alias("count"), *[F.avg(n).alias(n) for n in metrics])


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], ordinal: str, flag: str) -> DataFrame:
    """(keys, ``a_flag``, ``b_flag``): runs joined by key; of repeated keys in ``a`` the last counts, all of ``b`` stay."""
    last = Window.partitionBy(*keys).orderBy(F.col(ordinal).desc())
    once = a.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*keys, F.col(flag).alias(f"a_{flag}"))
    return b.select(*keys, F.col(flag).alias(f"b_{flag}")).join(once, list(keys)).select(*keys, f"a_{flag}", f"b_{flag}")


def construction_stats(rows: DataFrame, key: str = "tool_name") -> DataFrame:
    """One row: numbers of tools, proposed and accepted queries, acceptance rate, accepted per tool, share of tools without any."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("ok"))
    return per.agg(
        F.count("*").alias("tools"), F.sum("n").alias("proposed"), F.sum("ok").alias("accepted"), F.try_divide(F.sum("ok"), F.sum("n")).alias("acceptance_rate"),
        F.avg("ok").alias("accepted_per_tool"), F.avg((F.col("ok") == 0).cast("double")).alias("zero_rate"),
    )


def compression(df: DataFrame, method: str, full: str, measures: Sequence[str]) -> DataFrame:
    """(method, ratio of each measure): the full-context method's mean over each method's."""
    base = df.where(F.col(method) == full).agg(*[F.avg(m).alias(f"_{m}") for m in measures])
    means = df.groupBy(method).agg(*[F.avg(m).alias(m) for m in measures])
    return means.join(F.broadcast(base)).select(method, *[F.try_divide(F.col(f"_{m}"), F.col(m)).alias(f"{m}_ratio") for m in measures])
