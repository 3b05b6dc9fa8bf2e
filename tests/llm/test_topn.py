import random

from pyspark.sql import functions as F

from intentlake.llm import topn


def run(df, n=3, payload=("query",)):
    rows = topn.top_n(df, {"qid": F.col("qid"), "tool": F.col("tool")}, F.col("score"), {"e": F.col("entry"), "h": F.col("hit")}, n, list(payload), "r")
    return sorted(((x.qid, x.tool, x.r, x.h) for x in rows.collect()), key=str)


def brute(rows, n=3):
    groups = {}
    for qid, tool, score, entry, hit, _ in rows:
        if score is None or score != score or hit is None:
            continue
        groups.setdefault((qid, tool), set()).add((-score, entry is None, entry or 0, hit))
    return sorted(((q, t, k + 1, x[3]) for (q, t), s in groups.items() for k, x in enumerate(sorted(s)[:n])), key=str)


SCHEMA = "qid long, tool string, score double, entry long, hit long, query string"


def test_random(spark, monkeypatch):
    monkeypatch.setattr(topn, "REFILL_ROWS", 50)
    r = random.Random(4)
    rows = []
    for i in range(3000):
        qid = 7 if r.random() < 0.4 else r.choice([None, *range(30)])
        score = r.choice([0.5, 0.25, float("nan"), None, -1.0, 0.0, -0.0, float("inf"), r.random()])
        rows.append((qid, r.choice(["a", "b", None, ""]), score, r.choice([None, 1, 2, 3]), r.choice([None, *[2**53 + i] * 20]), f"q{i}"))
    rows += rows[:500]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df) == brute(rows)
    assert run(df, 1, ()) == brute(rows, 1)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1, 1, "x")], SCHEMA).withColumn("_group", F.lit(9)).withColumn("rank", F.lit(2))
    assert run(df) == [(1, "a", 1, 1)]
    assert run(df.limit(0)) == []


def test_heaps_merge_in_any_order(spark):
    import pyarrow as pa

    r = random.Random(6)
    rows = pa.table({"g": [r.randint(0, 3) for _ in range(400)], "score": [r.randint(0, 9) / 10 for _ in range(400)], "id": list(range(400))})
    order = [("score", "descending"), ("id", "ascending")]
    once = topn.keep_best(rows, ["g"], order, [], 4)
    parts = [topn.keep_best(rows.slice(a, 100), ["g"], order, [], 4) for a in (200, 0, 300, 100)]
    again = topn.keep_best(pa.concat_tables(parts), ["g"], order, [], 4)
    assert sorted(map(tuple, zip(*once.to_pydict().values()))) == sorted(map(tuple, zip(*again.to_pydict().values())))


def test_identifiers_are_strings(spark, monkeypatch):
    monkeypatch.setattr(topn, "REFILL_ROWS", 40)
    r = random.Random(8)
    rows = [(r.randint(0, 3), r.choice("ab"), r.choice([0.5, 0.25]), f"id{r.randint(0, 99):02d}", None if r.random() < 0.1 else "2024-01-0" + str(r.randint(1, 9))) for _ in range(900)]
    df = spark.createDataFrame(rows, "qid long, tool string, score double, hit string, day string").withColumn("day", F.to_date("day")).repartition(4)
    got = topn.top_n(df, {"qid": F.col("qid"), "tool": F.col("tool")}, F.col("score"), {"day": F.col("day"), "hit": F.col("hit")}, 4, [], "r").collect()
    groups = {}
    for qid, tool, score, hit, day in rows:
        groups.setdefault((qid, tool), set()).add((-score, day is None, day or "", hit))
    want = sorted((q, t, k + 1, x[3]) for (q, t), s in groups.items() for k, x in enumerate(sorted(s)[:4]))
    assert sorted((x.qid, x.tool, x.r, x.hit) for x in got) == want


def test_more_groups_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(topn, "REFILL_ROWS", 100)
    monkeypatch.setattr(topn, "HELD_ROWS", 150)
    r = random.Random(9)
    rows = [(r.randint(0, 700), r.choice(["a", None]), r.randint(0, 20) / 4, 1, i, f"q{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(df) == brute(rows)


def test_the_least_payload_of_equal_items(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1, 1, q) for q in ("z", None, "b", "c")], SCHEMA).repartition(4)
    assert [r.query for r in topn.top_n(df, {"qid": F.col("qid")}, F.col("score"), {"hit": F.col("hit")}, 3, ["query"]).collect()] == ["b"]
