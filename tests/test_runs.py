import json

import pytest
from pyspark.sql import functions as F

from intentlake.functions.text import published_bucket
from intentlake.operators import manual
from intentlake.plans import catalogue_runs, runners
from intentlake.sources import readers, sinks


def test_published_bucket(spark):
    import hashlib

    words = ["weather", "", "sign:weather", "天气", None]
    want = [None if w is None else int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % n for w in words for n in (2, 2048)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", *[published_bucket("w", n) for n in (2, 2048)]).orderBy("i").collect()
    assert [x for r in rows for x in r[1:]] == want


def test_choices(spark):
    names = F.array(F.lit("open"), F.lit("open_door"), F.lit("close"))
    cases = {'"open_door"': "open_door", "I take open_door.": "open", " close ": "close", "none": None, None: None, "open_door, as asked": "open"}
    df = spark.createDataFrame([(c,) for c in cases], "a string")
    assert {r.a: r.c for r in df.select("a", manual.parse_choice(F.col("a"), names).alias("c")).collect()} == cases
    bare = {r.a: r.c for r in df.select("a", manual.parse_choice(F.col("a"), names, inside=False).alias("c")).collect()}
    assert bare["open_door, as asked"] == "open_door" and bare["I take open_door."] is None


def test_batch_answers_by_exact_name():
    rows = [{"name": "a", "needed": 2}, {"name": "a b", "needed": 1}]
    assert manual.batch_answers('Sure: {"a b": ["x", "y"], "a": [" p ", "", "q", 3]}', rows) == [["p", "q"], ["x"]]
    assert manual.batch_answers('["u"]', rows[1:]) == [["u"]]
    for bad in ('{"A": ["p", "q"], "a b": ["x"]}', '{"a": ["p"], "a b": ["x"]}', "nothing", '["u"]', '{"a": "pq", "a b": ["x"]}'):
        with pytest.raises(ValueError):
            manual.batch_answers(bad, rows)


def test_transient_errors_are_waited_for():
    calls, waits = [], []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError
        return "done"

    slept, manual.time.sleep = manual.time.sleep, waits.append
    try:
        assert manual.patient(call, 3, 0.5)("p") == "done" and waits == [0.5, 1.0]
        calls.clear()
        with pytest.raises(TimeoutError):
            manual.patient(call, 2, 0.5)("p")
        with pytest.raises(KeyError):
            manual.patient(lambda p: {}[p], 3, 0.5)("p")
    finally:
        manual.time.sleep = slept


def test_a_batch_without_use_is_asked_one_by_one():
    asked = []

    def call(prompt):
        asked.append(prompt)
        return '{"a": ["1"]}' if len(asked) < 3 else '["2"]'

    rows = [{"name": "a", "needed": 1}, {"name": "b", "needed": 1}]
    assert manual.chat_model(call, "cars")(rows) == [["1"], ["2"]]
    assert len(asked) == 3 and "cars" in asked[0]


def test_build_goes_on_and_refills(spark, tmp_path):
    tools = spark.createDataFrame([(i, f"tool {i}", None, None) for i in (1, 2, 49, 50)], "ord long, name string, description string, parameters string")
    log = str(tmp_path / "log")
    first = manual.build(tools.where("ord < 50"), log, catalogue_runs.stand_in_model, 2, 1, None, 2)
    assert {(r.tool_name, r.query) for r in first.collect()} == {(f"tool {i}", f"tool {i} request {k}") for i in (1, 2, 49) for k in (0, 1)}
    more = manual.build(tools, log, catalogue_runs.stand_in_model, 3, 2, None, 1).groupBy("tool_name").count().collect()
    assert {r.tool_name: r["count"] for r in more} == {"tool 1": 3, "tool 2": 3, "tool 49": 3}
    rows = manual.read_log(spark, log).collect()
    failed = [r for r in rows if r.error]
    # Finished tools weren't asked again; the failing one has a row for each expected query in both rounds.
    assert len(failed) == 6 and {r.tool_name for r in failed} == {"tool 50"} and {r.rejection_reason for r in failed} == {"model_failed"}
    assert len(rows) == 9 + 6


def test_samples_are_filtered_in_line_order(spark, tmp_path):
    lines = [{"id": str(i), "question": [[{"role": "user", "content": f"q{i}"}]], "function": [], "correct_tools": [], "accepted": [True, False, None][i % 3]} for i in range(9)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    kept = readers.read_samples(spark, str(tmp_path / "s.jsonl"), verified_only=True, limit=2)
    assert sorted((r.sample_id, r.query) for r in kept.collect()) == [("0", "q0"), ("3", "q3")]


def test_tools_of_lines_and_large_objects(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"name": "b", "parameters": {"x": 1}}\n\n{"name": "a", "description": "d"}\n')
    assert [tuple(r) for r in readers.read_tools(spark, str(tmp_path / "t.jsonl")).orderBy("ord").collect()] == [(1, "b", "", '{"x": 1}', None), (2, "a", "d", "{}", None)]
    path = str(tmp_path / "deep" / "o.json")
    sinks.write_json_object(spark.range(9000).select(F.col("id").alias("o"), F.concat(F.lit('q"\n'), "id").alias("query")), path, "cases", "o")
    assert len(json.loads((tmp_path / "deep" / "o.json").read_text())["cases"]) == 9000
    sinks.write_json_object(spark.range(0).select(F.col("id").alias("o"), "id"), path, "cases", "o")
    assert json.loads((tmp_path / "deep" / "o.json").read_text()) == {"cases": []}


def test_runs(spark):
    tool = lambda n, d: {"name": n, "description": d, "parameters": None}
    pool = [tool("find_hotel", "find a hotel"), tool("book_flight", "book a flight"), tool("find_hotel", "again")]
    samples = spark.createDataFrame(
        [("1", None, "reserve my trip by air", pool, ["book_flight"]), ("2", 3, "book a flight", pool, None), ("3", 1, None, pool[:1], ["x"]), ("4", 0, "q", [], ["x"])],
        "sample_id string, candidate_size int, query string, tools array<struct<name:string,description:string,parameters:string>>, correct_tools array<string>",
    )
    entries = spark.createDataFrame([(1, "reserve a trip by air", "book_flight"), (2, None, "find_hotel"), (3, "x y", None)], "entry_ord long, query string, tool_name string")
    for method in runners.RETRIEVERS:
        got = {r.sample_id: r for r in runners.run(samples, entries, method).collect()}
        assert set(got) == {"1", "2", "3", "4"}
        assert got["2"].predicted == "book_flight" or method == "proxy"
        assert got["2"].is_correct is None and got["3"].predicted == "find_hotel" and got["3"].is_correct is False and got["4"].predicted is None
        if method in ("proxy", "bm25_query_augmented", "tfidf_query_augmented"):
            assert got["1"].predicted == "book_flight" and got["1"].is_correct
        assert got["1"].setting == {"proxy": "manual"}.get(method, "query_augmented" if method.endswith("augmented") else "raw")
    with pytest.raises(ValueError):
        runners.retriever("nothing")


def test_word_lists_are_the_published_ones():
    from intentlake.functions import lexicon

    assert (len(lexicon.STOPWORDS), len(lexicon.SYNONYMS), len(lexicon.CJK_PHRASES), len(lexicon.CJK_SYNONYMS), len(lexicon.CONJUNCTIONS), len(lexicon.ACTIONS)) == (22, 19, 34, 12, 15, 26)
