import json

import pytest

from intentlake import cli
from intentlake.operators import tasks

TOOLS = [
    {"name": f"{v}_{n}", "description": f"{v} the {n} of a place.", "parameters": {"type": "object", "properties": {n: {"type": "string"}}}}
    for v, n in [("read", "weather"), ("book", "flight"), ("find", "hotel"), ("write", "email"), ("plan", "calendar"), ("trade", "currency")]
]


def run(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_commands(spark, tmp_path, capsys):
    tools, cases, manual = (str(tmp_path / f"{n}.json") for n in ("tools", "cases", "manual"))
    (tmp_path / "tools.json").write_text(json.dumps({"tools": TOOLS}))
    (tmp_path / "cases.json").write_text(json.dumps([{"query": "the weather forecast of a place", "ground_truth_tool": "read_weather"}, {"query": "book me a flight", "ground_truth_tool": "book_flight"}]))
    stats = run(capsys, "build-manual", "--tools", tools, "--out", manual, "--distractors", "3")
    assert stats[0]["tools"] == 6 and stats[0]["accepted"] > 20
    got = run(capsys, "query", "--tools", tools, "--manual", manual, "--query", "book a flight please")
    assert got[0]["predicted"] == "book_flight" and got[0]["candidates"][0]["tool_name"] == "book_flight"
    sizes = run(capsys, "benchmark", "--tools", tools, "--manual", manual, "--cases", cases, "--sizes", "2,6")
    assert [(s["pool_size"], s["total"], s["accuracy"]) for s in sizes] == [(2, 2, 1.0), (6, 2, 1.0)]
    scaled = run(capsys, "scale", "--tools", tools, "--cases", cases, "--out", str(tmp_path / "scaled"), "--sizes", "3")
    assert scaled == [{"candidate_size": 3, "samples": 2}]
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, [{"skill_id": "a", "query": " q ", "accepted": True}, {"skill_id": "a", "query": "z", "accepted": False}, {"name": "b", "query": " "}])))
    (tmp_path / "config.json").write_text(json.dumps({"accepted_only": True, "out": "unused"}))
    kept = run(capsys, "normalize-queries", "--input", str(tmp_path / "raw.jsonl"), "--out", str(tmp_path / "norm"), "--config", str(tmp_path / "config.json"))
    assert kept == [{"tool_name": "a", "queries": 1}]


def test_missing_option():
    with pytest.raises(SystemExit):
        cli.settings(["query", "--tools", "x"])


def test_task_gold(spark):
    asked = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "task_id string")
    relevance = spark.createDataFrame(
        [("t1", ["a", "z"], ["a"], {"a": 2.0, "q": 1.0}, None), ("t2", ["b"], None, None, "generic_only"), ("t3", ["a", "b"], None, {}, "x")], tasks.RELEVANCE
    )
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    core = {r.task_id: (r.gold_all, r.gold, r.grades) for r in tasks.task_gold(asked, relevance, pool).collect()}
    assert core == {"t1": (["a"], ["a"], {"a": 2.0}), "t3": (["a", "b"], ["a", "b"], None), "t4": ([], [], None)}
    assert [r.task_id for r in tasks.task_gold(asked, relevance, pool, "single").collect()] == ["t2"]
    assert {r.task_id: r.gold for r in tasks.task_gold(asked, relevance, pool, "all").collect()}["t1"] == ["a"]
    assert [r.name for r in tasks.manual_scope(pool, relevance).collect()] == ["a", "b"]
    assert [r.name for r in tasks.manual_scope(pool, relevance.limit(0), 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        tasks.task_gold(asked, relevance, pool, "other")


def test_runs_of_benchmark_files(spark, tmp_path, capsys):
    def sample(i, query, tools, gold):
        return {"id": f"s{i}", "question": [[{"role": "user", "content": query}]], "function": [{**TOOLS[t], "parameters": json.dumps(TOOLS[t]["parameters"])} for t in tools], "correct_tools": gold, "accepted": True}

    data = tmp_path / "data.jsonl"
    data.write_text("\n".join(map(json.dumps, [sample(0, "the weather of a place", [1, 0, 2], ["read_weather"]), sample(1, "write an email", [3, 4], ["write_email"]), sample(2, "trade currency", [5], ["trade_currency"])])))
    answers = tmp_path / "answers.jsonl"
    answers.write_text("\n".join(json.dumps({"id": f"s{i}", "ground_truth": [{n: {}}]}) for i, n in enumerate(("read_weather", "write_email"))))
    out = run(capsys, "batch", "--data", str(data), "--out", str(tmp_path / "p"), "--answers", str(answers), "--manual-out", str(tmp_path / "manual.json"), "--distractors", "3")
    assert out == [{"candidate_size": 0, "total": 3, "evaluated": 2, "correct": 2, "accuracy": 1.0}]
    out = run(capsys, "scaled", "--data", str(data), "--out", str(tmp_path / "q"), "--manual", str(tmp_path / "manual.json"), "--sizes", "2,5", "--data-out", str(tmp_path / "grown"))
    assert [(r["candidate_size"], r["total"], r["accuracy"]) for r in out] == [(2, 3, 1.0), (5, 3, 1.0)]
    out = run(capsys, "baseline", "--data", str(tmp_path / "grown"), "--out", str(tmp_path / "r"), "--compare-to", str(tmp_path / "q"), "--method", "bm25")
    assert [(r["candidate_size"], r["before"], r["total"]) for r in out] == [(2, 1.0, 3), (5, 1.0, 3)] and all(r["accuracy"] > 0.5 for r in out)
    out = run(capsys, "skill-baseline", "--data", str(tmp_path / "grown"), "--out", str(tmp_path / "u"), "--method", "full_context", "--limit", "4")
    assert sum(r["total"] for r in out) == 4
