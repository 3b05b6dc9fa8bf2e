"""Reading catalogues, manuals, cases, benchmarks and skill folders as DataFrames with ordinals."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from intentlake.operators.sampling import dense_index

TOOL = "struct<name:string,description:string,parameters:string,category:string>"
MANUAL = "struct<query:string,tool_name:string,source:string,verification_score:double>"
CASE = "struct<query:string,ground_truth_tool:string>"
SAMPLE = "id string, original_id string, candidate_size int, question string, query string, `function` array<struct<name:string,description:string,parameters:string>>, correct_tools array<string>, skill_name string, accepted boolean"
PREDICTION = "sample_id string, candidate_size int, query string, predicted_tool string, candidate_tools array<string>, retrieved_tools array<string>, scale_candidate_pool array<string>, correct_tools array<string>, is_correct boolean"


def _wrapped(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """``ord`` and ``x`` of a JSON array or of the array ``field`` of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", f"$.{field}")
    array = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(inner)
    return text.select(F.posexplode(F.from_json(array, f"array<{item}>")).alias("ord", "x")).withColumn("ord", F.col("ord").cast("bigint") + 1)


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """(``ord``, ``name``, ``description``, ``parameters`` JSON text, ``category``); missing descriptions are empty, missing parameters ``{}``."""
    if ".jsonl" in path:
        x = _in_line_order(read_jsonl(spark, path, "name string, description string, parameters string, category string").select(F.struct("*").alias("x")))
    else:
        x = _wrapped(spark, path, "tools", TOOL)
    return x.select(
        "ord", "x.name", F.coalesce("x.description", F.lit("")).alias("description"), F.coalesce("x.parameters", F.lit("{}")).alias("parameters"), "x.category"
    )


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """(``entry_ord``, ``query``, ``tool_name``, ``source`` or ``synthetic``, ``verification_score`` or 1)."""
    x = _wrapped(spark, path, "manual", MANUAL)
    score = F.coalesce("x.verification_score", F.lit(1.0)).alias("verification_score")
    return x.select(F.col("ord").alias("entry_ord"), "x.query", "x.tool_name", F.coalesce("x.source", F.lit("synthetic")).alias("source"), score)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(``ord``, ``query``, ``ground_truth_tool``)."""
    return _wrapped(spark, path, "cases", CASE).select("ord", "x.query", "x.ground_truth_tool")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file, or of the ``.jsonl`` and ``.jsonl.gz`` files of a folder, or of a folder that Spark wrote; blank lines are ignored, malformed ones fail."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("pathGlobFilter", "{*.jsonl,*.jsonl.gz,part-*.json,part-*.json.gz}").json(path) if Path(path).is_dir() else reader.json(path)


def _in_line_order(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``ord`` from 1: by file, then by place in the file, however the files were split."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return dense_index(placed, ["_f", "_b", "_m"], "ord").withColumn("ord", F.col("ord") + 1).drop("_f", "_b", "_m")


@F.arrow_udf(StringType())
def _contents(questions: pa.Array) -> pa.Array:
    def walk(x) -> Iterator[str]:
        if isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            if isinstance(x.get("content"), str):
                yield x["content"]

    return pa.array([None if q is None else "\n".join(walk(json.loads(q))) for q in questions.to_pylist()], pa.string())


def read_samples(spark: SparkSession, path: str, verified_only: bool = False, limit: int | None = None) -> DataFrame:
    """(``sample_id``, ``candidate_size``, ``query``, ``tools``, ``correct_tools``) of benchmark or scaled-benchmark lines.

    ``question`` may nest lists to any depth; its contents are joined by line ends. The id is
    ``original_id`` if present. ``verified_only`` keeps lines whose ``accepted`` is true, ``limit`` the first
    lines that are left.
    """
    rows = read_jsonl(spark, path, SAMPLE)
    if verified_only:
        rows = rows.where("accepted = true")
    if limit is not None:
        rows = _in_line_order(rows).where(F.col("ord") <= limit)
    query = F.coalesce(F.col("query"), _contents("question"))
    return rows.select(F.coalesce("original_id", "id").alias("sample_id"), "candidate_size", query.alias("query"), F.col("function").alias("tools"), "correct_tools")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(``sample_id``, ``gold``): the keys of the ground-truth calls in order."""
    rows = read_jsonl(spark, path, "id string, ground_truth array<map<string,string>>")
    return rows.select(F.col("id").alias("sample_id"), F.flatten(F.transform("ground_truth", F.map_keys)).alias("gold"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PREDICTION)


def read_generated_queries(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``ord``, ``query``) from JSON lines, a ``{"manual": [...]}`` object, a list, or an object of lists by name.

    The name is the first of tool_name, skill_id and name; blank queries are dropped.
    """
    item = "struct<tool_name:string,skill_id:string,name:string,query:string>"
    if ".jsonl" in path or Path(path).is_dir():
        rows = read_jsonl(spark, path, "tool_name string, skill_id string, name string, query string")
        rows = _in_line_order(rows.select(F.struct("tool_name", "skill_id", "name", "query").alias("x")))
    else:
        head = spark.read.text(path, wholetext=True)
        by_name = F.from_json("value", "map<string,array<string>>")
        is_map = ~F.startswith(F.ltrim("value"), F.lit("[")) & F.get_json_object("value", "$.manual").isNull()
        mapped = head.where(is_map).select(F.explode(by_name).alias("name", "list")).select("name", F.posexplode("list").alias("ord", "query"))
        mapped = mapped.select(F.struct(F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("skill_id"), "name", "query").alias("x"), F.col("ord").cast("bigint"))
        rows = _wrapped(spark, path, "manual", item).select("x", "ord").unionByName(mapped)
    name = F.coalesce(*[F.nullif(F.col(f"x.{c}"), F.lit("")) for c in ("tool_name", "skill_id", "name")])
    return rows.select(name.alias("name"), "ord", F.trim("x.query").alias("query")).where("name is not null and query <> ''")


def read_pool(spark: SparkSession, path: str, body_chars: int | None = 1800, category: str | None = None) -> DataFrame:
    """(``name``, ``description``, ``category``) of a skill pool: name, description and the compacted body's first characters, empty parts left out."""
    rows = read_jsonl(spark, path, "skill_id string, name string, description string, body string, source string")
    parts = [F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("description"), F.lit(""))]
    if body_chars is not None:
        parts.append(F.nullif(compact_text(F.col("body"), body_chars), F.lit("")))
    return rows.select(F.col("skill_id").alias("name"), F.concat_ws("\n", *parts).alias("description"), F.lit(category).cast("string").alias("category"))


def compact_text(text: Column, limit: int) -> Column:
    """Lines without white space at their ends, without blank lines and code fences, cut hard at ``limit`` characters."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("```")))
    return F.substring(F.array_join(kept, "\n"), 1, limit)


def front_matter(text: Column) -> Column:
    """The fields between the ``---`` lines at a text's start as a map; folded blocks are joined by blanks. Empty without them."""
    block = F.regexp_extract(text, r"^---\n((?s).*?)\n---\n", 1)
    # A block scalar's lines are indented or blank: put them on the key's line.
    folded = F.regexp_replace(block, r"\n(?:[ ]+|(?=\n))", " ")
    pairs = F.filter(F.split(folded, "\n"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.substring_index(x, ":", -1000), r"^[^:]*:", "")), r'^[|>]\s*|^"+|"+$', "")
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(value(x), r"\s+", " ")))
    keys = F.transform(entries, lambda e: e["col1"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["col1"]))
    return F.map_from_entries(last)


def first_paragraph(text: Column) -> Column:
    """The first paragraph with content, heading marks removed, up to 400 characters."""
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(F.regexp_replace(b, r"#+\s*", ""), r"^\s+|\s+$", ""))
    return F.coalesce(F.substring(F.get(F.filter(blocks, lambda b: b != ""), F.lit(0)), 1, 400), F.lit(""))


def read_skill_folders(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(``dir``, ``name``, ``description``) of every ``*/SKILL.md``, in order of folders, the first ``limit`` if given; a name that came before becomes ``name__dir``."""
    from pyspark.sql import Window

    files = spark.read.text(f"{root.rstrip('/')}/*/SKILL.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    fields = front_matter(F.col("value"))
    folder = F.element_at(F.split("file", "/"), -2)
    if limit is not None:
        files = files.orderBy(folder).limit(limit)
    body = F.regexp_replace("value", r"^---\n(?s).*?\n---\n", "")
    rows = files.select(
        folder.alias("dir"), F.coalesce(F.nullif(F.try_element_at(fields, F.lit("name")), F.lit("")), folder).alias("name"),
        F.coalesce(F.nullif(F.try_element_at(fields, F.lit("description")), F.lit("")), first_paragraph(body)).alias("description"),
    )
    again = F.row_number().over(Window.partitionBy("name").orderBy("dir")) > 1
    return rows.withColumn("name", F.when(again, F.concat("name", F.lit("__"), "dir")).otherwise(F.col("name")))


def read_intent_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``description``, ``inputs``) of a JSON object of intents; input types that aren't known are ``string``."""
    entry = "struct<actionName:string,actionNameZh:string,description:string,inputs:array<struct<name:string,type:string,desc:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("intent", "x"))
    known = ("string", "number", "integer", "boolean", "array", "object")
    kinds = F.transform("x.inputs", lambda i: F.struct(i["name"].alias("name"), F.when(i["type"].isin(*known), i["type"]).otherwise("string").alias("type"), i["desc"].alias("desc")))
    return rows.select(F.col("intent").alias("name"), F.coalesce("x.description", F.lit("")).alias("description"), kinds.alias("inputs"))


def read_sheet(spark: SparkSession, path: str, sheet: str, header_row: int = 1, data_start_row: int = 2) -> DataFrame:
    """Rows of a workbook's sheet as texts with ``ord``; blank rows are skipped, headers made unique, unnamed ones ``col_i``.

    A workbook is one small file and is read on the driver. Needs ``openpyxl``.
    """
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    rows = load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True)
    table = list(rows)
    return sheet_rows(spark, table[header_row - 1], table[data_start_row - 1 :])


def sheet_rows(spark: SparkSession, header, rows) -> DataFrame:
    """The DataFrame of ``read_sheet`` from a header and rows of values."""
    seen: dict[str, int] = {}
    names = []
    for i, h in enumerate(header, 1):
        name = str(h).strip() if h is not None and str(h).strip() else f"col_{i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    data = [[n, *[None if v is None else str(v) for v in r[: len(names)]]] for n, r in enumerate(rows, 1) if any(v is not None and str(v).strip() for v in r)]
    data = [[*r, *[None] * (1 + len(names) - len(r))] for r in data]
    return spark.createDataFrame(data, ", ".join(["ord bigint", *[f"`{n}` string" for n in names]]))
