"""Catalogues from row-wise sheets: fill-forward grouping and grouping by signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentlake.functions.text import first_text, getter_signatures, method_parameters, single_line, trim_sentence, value_type
from intentlake.session import cut_lineage

PARAMETER = "struct<name:string,type:string,description:string>"


def _first_parameters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``parameters``): the first definition of every name, in order of appearance. Rows: keys, ``ord``, ``pos``, name, type, description."""
    place = Window.partitionBy(*keys, "name").orderBy("ord", "pos")
    once = rows.withColumn("_r", F.row_number().over(place)).where("_r = 1")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "pos", "name", "type", "description")))
    fields = F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description")))
    return once.groupBy(*keys).agg(fields.alias("parameters"))


def last_marked(rows: DataFrame, keys: list[str], ordinal: str, mark: Column, out: str) -> DataFrame:
    """``rows`` with the ordinal of the last marked row up to each row, within ``keys``; null before the first.

    The rows are sorted by range partitions, so that a key with a third of all rows lies in many tasks. Each
    part looks back only over its own rows; what a part inherits is found on one row for each part and key.
    """
    parted = rows.withColumn("_m", F.when(mark, F.col(ordinal))).repartitionByRange(*keys, ordinal).withColumn("_p", F.spark_partition_id())
    parted = cut_lineage(parted)
    ends = parted.groupBy("_p", *keys).agg(F.max("_m").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.max("_end").over(before)).drop("_end")
    local = Window.partitionBy("_p", *keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    joined = parted.withColumn("_own", F.max("_m").over(local)).alias("x").join(carried.alias("c"), [F.col("x._p") == F.col("c._p"), *[F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]])
    return joined.select("x.*", F.coalesce("_own", "_carry").alias(out)).drop("_m", "_p", "_own")


def fill_forward_tools(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """(``ord``, ``name``, ``description``, ``parameters``) from sheet rows where a tool goes on over rows with a blank name.

    Columns: ``ord``, ``action_name``, ``action_description``, ``input_name``, ``input_type``,
    ``input_description``. A row with a name begins a tool, also if the name came before; rows before the
    first name are dropped; the first definition of a parameter counts. Sheets are independent: the
    order runs within ``sheet`` if it is given, so many sheets are worked off at once.
    """
    keys = [sheet] if sheet else []
    clean = rows.select(
        *keys, "ord", first_text("action_name").alias("name"), first_text("action_description").alias("tool_description"),
        first_text("input_name").alias("input"), value_type("input_type").alias("type"), first_text("input_description").alias("input_description"),
    )
    owned = last_marked(clean, keys, "ord", F.col("name") != "", "tool_ord").where("tool_ord is not null")
    tools = owned.where("ord = tool_ord").select(*keys, "tool_ord", "name", F.col("tool_description").alias("description"))
    params = owned.where("input <> ''").select(
        *keys, "tool_ord", "ord", F.lit(0).alias("pos"), F.col("input").alias("name"), "type", F.col("input_description").alias("description")
    )
    joined = tools.join(_first_parameters(params, [*keys, "tool_ord"]), [*keys, "tool_ord"], "left")
    return joined.select(*keys, F.col("tool_ord").alias("ord"), "name", "description", F.coalesce("parameters", F.array().cast(f"array<{PARAMETER}>")).alias("parameters"))


def signal_tools(rows: DataFrame, include_without_getter: bool = True) -> DataFrame:
    """(``ord``, ``name``, ``description``, ``parameters``): one tool for every signal.

    Columns: ``ord``, ``module``, ``signal_label``, ``api``, ``value_range``, ``signal``, ``signal_type``,
    ``prop_id``. Rows of one signal merge: getter parameters in order, the first of a name counting;
    different descriptions joined by blanks in order. Rows without a signal are dropped, and with
    ``include_without_getter`` false also those without a getter.
    """
    clean = rows.select("ord", *[first_text(c).alias(c) for c in ("module", "signal_label", "api", "value_range", "signal", "signal_type", "prop_id")])
    clean = clean.where("signal <> ''").withColumn("getters", getter_signatures("api"))
    if not include_without_getter:
        clean = clean.where(F.size("getters") > 0)
    described = clean.withColumn("text", signal_description(*[F.col(c) for c in ("module", "signal_label", "value_range", "signal_type", "prop_id")], F.col("getters")))
    once = described.groupBy("signal", "text").agg(F.min("ord").alias("ord"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    tools = once.groupBy("signal").agg(F.min("ord").alias("ord"), F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("description"))
    calls = clean.select("signal", "ord", "signal_label", F.posexplode("getters").alias("g", "getter"))
    args = calls.select("signal", "ord", "signal_label", "g", F.posexplode(method_parameters(F.col("getter.params"))).alias("p", "arg"))
    label = F.when(F.col("signal_label") == "", "该状态").otherwise(F.col("signal_label"))
    params = args.select(
        "signal", "ord", (F.col("g") * 1000 + F.col("p")).alias("pos"), F.col("arg.name").alias("name"), value_type("arg.type_name", signals=True).alias("type"),
        F.concat(F.col("arg.type_name"), F.lit(" "), F.col("arg.name"), F.lit("，用于指定查询"), label, F.lit("时的车辆区域或位置。")).alias("description"),
    )
    joined = tools.join(_first_parameters(params, ["signal"]), "signal", "left")
    return joined.select("ord", F.col("signal").alias("name"), "description", F.coalesce("parameters", F.array().cast(f"array<{PARAMETER}>")).alias("parameters"))


# The sentences of descriptions below and in ``signal_tools``.
def signal_description(module: Column, label: Column, value_range: Column, signal_type: Column, prop_id: Column, getters: Column) -> Column:
    """The sentence of each known part of a signal, joined."""
    names = F.array_join(F.transform(getters, lambda g: g["name"]), ", ")

    def part(value: Column, before: str, after: str = "。") -> Column:
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))

    head = F.when((module != "") & (label != ""), F.concat(F.lit("查询"), module, F.lit("模块的"), label, F.lit("。"))).otherwise(part(label, "查询"))
    return F.concat_ws(
        "", head, part(trim_sentence(single_line(value_range)), "返回值或范围："), part(signal_type, "VSpec类型："), part(prop_id, "PropID："), part(names, "北向查询API：")
    )
