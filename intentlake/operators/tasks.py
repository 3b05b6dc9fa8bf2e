"""Routing tasks with relevance entries: which are evaluated, what their gold is, which skills a manual covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relevance entries: ``task_id``, ``gt_skill_ids``, ``core_gt_ids`` (arrays), ``relevance`` (map of grades), ``task_type``.
RELEVANCE = "task_id string, gt_skill_ids array<string>, core_gt_ids array<string>, relevance map<string,double>, task_type string"
MODES = ("core", "single", "all")


def _names(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))


def task_gold(tasks: DataFrame, relevance: DataFrame, pool: DataFrame, mode: str = "core") -> DataFrame:
    """Tasks of a mode with ``gold_all``, ``gold`` (inside the pool, ``name``) and ``grades`` (inside the pool).

    ``core`` leaves out tasks of type generic_only and uses the core gold where the entry has one;
    ``single`` keeps tasks with exactly one gold name; ``all`` keeps all. A task without an entry has no gold.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    rows = tasks.join(relevance, "task_id", "left")
    gold = F.when(F.col("core_gt_ids").isNotNull(), _names("core_gt_ids")).otherwise(_names("gt_skill_ids")) if mode == "core" else _names("gt_skill_ids")
    rows = rows.withColumn("gold_all", gold)
    if mode == "core":
        rows = rows.where(F.coalesce("task_type", F.lit("")) != "generic_only")
    if mode == "single":
        rows = rows.where(F.size("gold_all") == 1)
    grades = rows.select("task_id", F.explode("relevance").alias("name", "grade")).join(pool.select("name").distinct(), "name")
    inside = rows.select("task_id", F.explode("gold_all").alias("name")).join(pool.select("name").distinct(), "name")
    golds = inside.groupBy("task_id").agg(F.sort_array(F.collect_set("name")).alias("gold"))
    maps = grades.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "grade")))).alias("grades"))
    out = rows.select(*tasks.columns, "gold_all").join(golds, "task_id", "left").join(maps, "task_id", "left")
    return out.withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def manual_scope(pool: DataFrame, relevance: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Names of the pool that a manual is built for, in order: those that any relevance entry mentions, or all without entries or matches."""
    names = pool.select("name").where("name is not null").distinct()
    if relevance is not None:
        keys = F.map_keys(F.coalesce("relevance", F.create_map().cast("map<string,double>")))
        mentioned = relevance.select(F.explode(F.array_union(F.array_union(_names("gt_skill_ids"), _names("core_gt_ids")), keys)).alias("name")).distinct()
        related = names.join(mentioned, "name", "left_semi")
        names = related if not related.isEmpty() else names
    names = names.orderBy("name")
    return names.limit(limit) if limit is not None else names
