"""Command line: ``python -m intentlake.cli COMMAND``. Explicit flags count before the JSON of ``--config``, that before defaults."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlake.functions.metrics import is_correct
from intentlake.operators import evaluate, manual, sampling, tasks
from intentlake.plans import pipelines, runners
from intentlake.session import local_session, shared_folder
from intentlake.sources import readers, sinks

DEFAULTS = {"queries_per_tool": 8, "distractors": 8, "seed": 7, "tool_top_k": 5, "proxy_top_k": 20, "sizes": "10,50,100", "mode": "core", "accepted_only": False, "method": "tfidf"}


def _catalogue(tools: DataFrame) -> DataFrame:
    named = sampling.unique_by(tools, "name", ["ord"])
    return sampling.dense_index(named.select("ord", "name"), ["ord"]).select("idx", "name")


def build_manual(spark: SparkSession, a: dict) -> DataFrame:
    """Templated queries of every tool that pass round-trip verification, written as a manual."""
    tools = sampling.unique_by(readers.read_tools(spark, a["tools"]), "name", ["ord"])
    proposed = manual.template_queries(tools, int(a["queries_per_tool"])).withColumn("query_id", F.concat_ws(":", "ord", "query_no"))
    rows = manual.verify_queries(proposed, tools, _catalogue(tools), int(a["distractors"]), int(a["seed"]))
    kept = rows.where("accepted").select(
        (F.col("ord") * 1000 + F.col("query_no")).alias("ord"), "query", F.col("name").alias("tool_name"), F.lit("templates").alias("source"), F.lit(1.0).alias("verification_score")
    )
    sinks.write_json_object(kept, a["out"], "manual", "ord")
    return evaluate.construction_stats(rows.withColumnRenamed("name", "tool_name"))


def query(spark: SparkSession, a: dict) -> DataFrame:
    """The tool chosen for one request, with the ranked candidates."""
    tools, entries = readers.read_tools(spark, a["tools"]), readers.read_manual(spark, a["manual"])
    case = spark.createDataFrame([(1, a["query"])], "ord long, query string")
    ranked = pipelines.proxy_ranking(case, entries, tools, int(a["tool_top_k"]), int(a["proxy_top_k"]))
    chosen = pipelines.choose_tools(ranked, case, tools)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "tool_name", "score"))), lambda x: F.struct(x["tool_name"].alias("tool_name"), x["score"].alias("score")))
    return chosen.join(ranked.groupBy("ord").agg(listed.alias("candidates")), "ord").drop("ord")


def benchmark(spark: SparkSession, a: dict) -> DataFrame:
    """Accuracy by pool size over drawn pools; requests whose pool has no manual entry don't count."""
    tools, entries = readers.read_tools(spark, a["tools"]), readers.read_manual(spark, a["manual"])
    cases = readers.read_cases(spark, a["cases"]).withColumn("gold", F.array_compact(F.array("ground_truth_tool")))
    sizes = [int(s) for s in str(a["sizes"]).split(",")]
    drawn = sampling.pools(cases, ["ord"], "gold", _catalogue(tools), sizes, int(a["seed"]))
    ranked = pipelines.scoped_ranking(cases, drawn, entries, int(a["tool_top_k"]))
    chosen = pipelines.choose_tools(ranked, cases, sampling.unique_by(tools, "name", ["ord"]), ["ord", "pool_size"])
    covered = drawn.join(entries.select(F.col("tool_name").alias("name")), "name", "left_semi").select("ord", "pool_size").distinct()
    first = drawn.groupBy("ord", "pool_size").agg(F.min_by("name", "pos").alias("_first"))
    rows = covered.join(first, ["ord", "pool_size"]).join(chosen, ["ord", "pool_size"], "left").join(cases.select("ord", "gold"), "ord")
    flagged = rows.withColumn("is_correct", is_correct(F.coalesce("predicted", "_first"), F.col("gold")))
    return evaluate.summarize(flagged, ["pool_size"]).orderBy("pool_size")


def scale(spark: SparkSession, a: dict) -> DataFrame:
    """A scaled benchmark: every case with pools of each size, written as JSON lines."""
    tools = sampling.unique_by(readers.read_tools(spark, a["tools"]), "name", ["ord"])
    cases = readers.read_cases(spark, a["cases"]).withColumn("gold", F.array_compact(F.array("ground_truth_tool")))
    drawn = sampling.pools(cases, ["ord"], "gold", _catalogue(tools), [int(s) for s in str(a["sizes"]).split(",")], int(a["seed"]))
    rows = sinks.scaled_rows(drawn, cases, tools)
    sinks.write_lines(rows, a["out"])
    return rows.groupBy("candidate_size").agg(F.count("*").alias("samples")).orderBy("candidate_size")


def normalize_queries(spark: SparkSession, a: dict) -> DataFrame:
    """Candidate rows to ``{tool_name, query}`` lines; blank queries are dropped, with ``accepted_only`` also rejected ones."""
    rows = readers.read_jsonl(spark, a["input"], "tool_name string, skill_id string, name string, query string, accepted boolean")
    if a["accepted_only"]:
        rows = rows.where("accepted = true")
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("tool_name", "skill_id", "name")])
    kept = rows.select(name.alias("tool_name"), F.trim("query").alias("query")).where("tool_name is not null and query <> ''")
    sinks.write_lines(kept, a["out"])
    return kept.groupBy("tool_name").agg(F.count("*").alias("queries"))


def evaluate_ranked(spark: SparkSession, a: dict) -> DataFrame:
    """Ranking metrics by stratum of ranked predictions (lines of ``task_id``, ``ranked``) against relevance lines and a pool."""
    wanted = readers.read_jsonl(spark, a["tasks"], "task_id string, instruction_text string")
    relevance = readers.read_jsonl(spark, a["relevance"], tasks.RELEVANCE)
    pool = readers.read_pool(spark, a["pool"], None)
    predictions = readers.read_jsonl(spark, a["predictions"], "task_id string, ranked array<string>")
    rows = tasks.task_gold(wanted, relevance, pool, a["mode"]).join(predictions, "task_id")
    return evaluate.ranking_report(rows, "ranked", "gold", "gold_all", "grades")


def _samples(spark: SparkSession, a: dict) -> DataFrame:
    """The samples of a benchmark file, with the answers' gold where a file of answers is given."""
    limit = int(a["limit"]) if a.get("limit") else None
    rows = readers.read_samples(spark, a["data"], bool(a.get("accepted_only")), limit)
    if a.get("answers"):
        gold = readers.read_answers(spark, a["answers"])
        rows = rows.drop("correct_tools").join(gold, "sample_id", "left").withColumnRenamed("gold", "correct_tools")
    return rows


def _entries(spark: SparkSession, a: dict, tools: DataFrame) -> DataFrame:
    """The given manual, or one that is built of templates for the samples' tools, kept under ``manual_out`` if that is given."""
    if a.get("manual"):
        return readers.read_manual(spark, a["manual"])
    proposed = manual.template_queries(tools, int(a["queries_per_tool"])).withColumn("query_id", F.concat_ws(":", "ord", "query_no"))
    rows = manual.verify_queries(proposed, tools, _catalogue(tools), int(a["distractors"]), int(a["seed"])).where("accepted")
    kept = rows.select((F.col("ord") * 1000 + F.col("query_no")).alias("ord"), "query", F.col("name").alias("tool_name"), F.lit("templates").alias("source"), F.lit(1.0).alias("verification_score"))
    if a.get("manual_out"):
        sinks.write_json_object(kept, a["manual_out"], "manual", "ord")
        return readers.read_manual(spark, a["manual_out"])
    return kept.withColumnRenamed("ord", "entry_ord")


def _tools_of(samples: DataFrame) -> DataFrame:
    """(``ord``, ``name``, ``description``, ``parameters``): every tool of the samples, the first definition by name."""
    each = samples.select("sample_id", F.posexplode("tools").alias("pos", "t")).select("sample_id", "pos", "t.*")
    once = sampling.unique_by(each, "name", ["sample_id", "pos"])
    return sampling.dense_index(once.select("name", "description", "parameters"), ["name"], "ord")


def _predicted(rows: DataFrame, a: dict) -> DataFrame:
    """Predictions written as lines, and their accuracy by pool size."""
    lines = rows.select(
        "sample_id", "candidate_size", "query", F.col("predicted").alias("predicted_tool"), F.col("retrieved").alias("retrieved_tools"), "correct_tools", "is_correct", "method", "setting"
    )
    sinks.write_lines(lines, a["out"])
    out = readers.read_predictions(spark := rows.sparkSession, a["out"])
    if a.get("compare_to"):
        before = readers.read_predictions(spark, a["compare_to"]).select("sample_id", "candidate_size", F.monotonically_increasing_id().alias("o"), "is_correct")
        both = evaluate.compare_runs(before, out, ["sample_id", "candidate_size"], "o", "is_correct")
        return both.groupBy("candidate_size").agg(evaluate.rate("a_is_correct").alias("before"), evaluate.rate("b_is_correct").alias("accuracy"), F.count("*").alias("total")).orderBy("candidate_size")
    return evaluate.summarize(out, ["candidate_size"]).orderBy("candidate_size")


def batch(spark: SparkSession, a: dict) -> DataFrame:
    """A benchmark file (or a scaled one, or one of skills) run by the manual's queries, the tool chosen among the best."""
    samples = _samples(spark, a)
    return _predicted(runners.run(samples, _entries(spark, a, _tools_of(samples)), "proxy", int(a["tool_top_k"])), a)


def scaled(spark: SparkSession, a: dict) -> DataFrame:
    """A benchmark file whose pools are grown to each size with tools of the other samples, then run as ``batch``."""
    samples = _samples(spark, a)
    tools = _tools_of(samples)
    asked = samples.select("sample_id", "query", "correct_tools")
    keyed = sampling.dense_index(asked.select("sample_id").distinct(), ["sample_id"], "ord").join(asked.dropDuplicates(["sample_id"]), "sample_id")
    drawn = sampling.pools(keyed.withColumnRenamed("correct_tools", "gold"), ["ord"], "gold", _catalogue(tools), [int(s) for s in str(a["sizes"]).split(",")], int(a["seed"]))
    rows = sinks.scaled_rows(drawn, keyed, tools).drop("original_id").join(keyed.select(F.col("ord").cast("string").alias("_o"), F.col("sample_id").alias("original_id")), F.substring_index("id", "_n", 1) == F.col("_o")).drop("_o")
    grown = a.get("data_out") or shared_folder(spark, "scaled")
    sinks.write_lines(rows, grown)
    return _predicted(runners.run(readers.read_samples(spark, grown), _entries(spark, a, tools), "proxy", int(a["tool_top_k"])), a)


def baseline(spark: SparkSession, a: dict) -> DataFrame:
    """A scaled benchmark file run by a method over the candidates' documents; the first is predicted."""
    samples = _samples(spark, a)
    entries = readers.read_manual(spark, a["manual"]) if a.get("manual") else spark.createDataFrame([], "entry_ord bigint, query string, tool_name string")
    return _predicted(runners.run(samples, entries, a["method"], int(a["tool_top_k"]), choose=a["method"] == "full_context"), a)


COMMANDS = {
    "build-manual": (build_manual, ("tools", "out")),
    "query": (query, ("tools", "manual", "query")),
    "benchmark": (benchmark, ("tools", "manual", "cases")),
    "scale": (scale, ("tools", "cases", "out")),
    "normalize-queries": (normalize_queries, ("input", "out")),
    "batch": (batch, ("data", "out")),
    "scaled": (scaled, ("data", "out")),
    "baseline": (baseline, ("data", "out")),
    "skill-scaled": (scaled, ("data", "out")),
    "skill-baseline": (baseline, ("data", "out")),
    "evaluate": (evaluate_ranked, ("tasks", "relevance", "pool", "predictions")),
}
OPTIONS = ("tools", "manual", "cases", "query", "out", "input", "tasks", "relevance", "pool", "predictions", "data", "answers", "limit", "manual_out", "data_out", "compare_to", *DEFAULTS)


def settings(argv: list[str]) -> tuple[str, dict]:
    parser = argparse.ArgumentParser(prog="intentlake", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--config")
    for name in OPTIONS:
        if name == "accepted_only":
            parser.add_argument("--accepted-only", action="store_true", default=None)
        else:
            parser.add_argument("--" + name.replace("_", "-"))
    given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    command, config = given.pop("command"), given.pop("config", None)
    out = DEFAULTS | (json.loads(Path(config).read_text()) if config else {}) | given
    if missing := [x for x in COMMANDS[command][1] if not out.get(x)]:
        parser.error(f"{command} needs " + ", ".join("--" + m for m in missing))
    return command, out


def main(argv: list[str] | None = None) -> int:
    command, values = settings(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.getActiveSession() or local_session()
    for row in COMMANDS[command][0](spark, values).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
