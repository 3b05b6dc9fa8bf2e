import gzip
import json

import pytest

from intentlake.sources import readers, sinks


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_catalogue_files(spark, tmp_path):
    tools = [{"name": "a", "description": "d", "parameters": {"type": "object", "properties": {"x": {"type": "string"}}}}, {"name": "b", "category": "c"}]
    for value in (tools, {"tools": tools}):
        got = readers.read_tools(spark, put(tmp_path / "tools.json", value)).orderBy("ord").collect()
        assert [(r.ord, r.name, r.description, r.category) for r in got] == [(1, "a", "d", None), (2, "b", "", "c")]
        assert json.loads(got[0].parameters)["properties"] == {"x": {"type": "string"}} and got[1].parameters == "{}"
    got = readers.read_manual(spark, put(tmp_path / "m.json", {"manual": [{"query": "q", "tool_name": "a"}]})).first()
    assert (got.entry_ord, got.source, got.verification_score) == (1, "synthetic", 1.0)
    assert readers.read_cases(spark, put(tmp_path / "c.json", {"cases": [{"query": "q", "ground_truth_tool": "a"}]})).first().ground_truth_tool == "a"


def test_lines(spark, tmp_path):
    sample = {"id": "s_n5", "original_id": "s", "question": [[{"role": "user", "content": "one"}], [[{"content": "two"}]]], "function": [{"name": "f", "parameters": {"a": 1}}], "correct_tools": ["f"]}
    put(tmp_path / "d/a.jsonl", json.dumps(sample) + "\n\n")
    with gzip.open(tmp_path / "d/b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "t", "query": "plain"}) + "\n")
    got = {r.sample_id: r for r in readers.read_samples(spark, str(tmp_path / "d")).collect()}
    assert got["s"].query == "one\ntwo" and got["s"].tools[0].name == "f" and got["t"].query == "plain"
    put(tmp_path / "ans.jsonl", json.dumps({"id": "s", "ground_truth": [{"f": {"x": [1]}}, {"g": {}}]}))
    assert readers.read_answers(spark, str(tmp_path / "ans.jsonl")).first().gold == ["f", "g"]


def test_generated_queries(spark, tmp_path):
    want = [("a", "q1"), ("a", "q2"), ("b", "q3")]
    rows = [{"tool_name": "a", "query": "q1"}, {"skill_id": "a", "query": " q2 "}, {"name": "b", "query": "q3"}, {"name": "b", "query": " "}]
    files = [
        put(tmp_path / "g.jsonl", "\n".join(map(json.dumps, rows))), put(tmp_path / "g1.json", rows), put(tmp_path / "g2.json", {"manual": rows}),
        put(tmp_path / "g3.json", {"a": ["q1", "q2"], "b": ["q3", ""]}),
    ]
    for f in files:
        got = readers.read_generated_queries(spark, f).orderBy("name", "ord").collect()
        assert [(r.name, r.query) for r in got] == want, f


def test_skill_folders(spark, tmp_path):
    put(tmp_path / "s/a/SKILL.md", '---\nname: "paint"\ndescription: >\n  first line\n\n  second line\nother: x:y\n---\n# Head\nbody')
    put(tmp_path / "s/b/SKILL.md", "---\nname: paint\n---\n\n# Title\n\nText here")
    put(tmp_path / "s/c/SKILL.md", "# Only\nbody text")
    got = {r.dir: r for r in readers.read_skill_folders(spark, str(tmp_path / "s")).collect()}
    assert (got["a"].name, got["a"].description) == ("paint", "first line second line")
    assert (got["b"].name, got["b"].description) == ("paint__b", "Title")
    assert (got["c"].name, got["c"].description) == ("c", "Only\nbody text")


def test_pool_and_sheet(spark, tmp_path):
    put(tmp_path / "p.jsonl", json.dumps({"skill_id": "s1", "name": "n", "description": "", "body": "# a\n\n```\n  b  "}))
    assert readers.read_pool(spark, str(tmp_path / "p.jsonl")).first().description == "n\n# a\nb"
    assert readers.read_pool(spark, str(tmp_path / "p.jsonl"), None).first().description == "n"
    sheet = readers.sheet_rows(spark, ["a", None, "a"], [(1, "x", None), (None, " ", None), ("y",)])
    assert sheet.columns == ["ord", "a", "col_2", "a_2"] and [tuple(r) for r in sheet.orderBy("ord").collect()] == [(1, "1", "x", None), (3, "y", None, None)]


def test_intents(spark, tmp_path):
    path = put(tmp_path / "i.json", {"x.Open": {"actionName": "open", "description": "d", "inputs": [{"name": "z", "type": "weird", "desc": "e"}]}})
    got = readers.read_intent_catalogue(spark, path).first()
    assert got.name == "x.Open" and got.inputs[0].type == "string"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "ord long, name string")
    sinks.write_json_object(df, str(tmp_path / "o/t.json"), "tools", "ord")
    assert json.loads((tmp_path / "o/t.json").read_text()) == {"tools": [{"name": "a"}, {"name": "b"}]}
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert readers.read_jsonl(spark, str(tmp_path / "lines") + "/*.json", "ord long, name string").count() == 2
    with pytest.raises(ValueError):
        sinks.checked_path("/etc/x")


def test_vector_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bb")], "id long, t string")
    marks = tmp_path / "calls"
    marks.mkdir()

    def embed(texts):
        for t in texts:
            (marks / f"{t}-{len(list(marks.iterdir()))}").touch()
        return [[float(len(t))] for t in texts]

    cache = sinks.VectorCache(spark, str(tmp_path / "cache"), "m1")
    assert {r.id: r.vector for r in cache.vectors(docs, "t", embed).collect()} == {1: [1.0], 2: [1.0], 3: None, 4: [2.0]}
    assert len(list(marks.iterdir())) == 2
    more = docs.unionByName(spark.createDataFrame([(5, "ccc")], "id long, t string"))
    assert {r.id: r.vector for r in cache.vectors(more, "t", embed).collect()}[5] == [3.0]
    assert len(list(marks.iterdir())) == 3
    assert sinks.VectorCache(spark, str(tmp_path / "cache"), "m2").read().count() == 0
