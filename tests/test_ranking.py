import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentlake.functions import metrics
from intentlake.operators import evaluate, index, ranking, sampling
from intentlake.plans import pipelines


def expected(ranked, gold):
    rel = [1.0 if r in gold else 0.0 for r in ranked]
    dcg = lambda v, k: sum(x / math.log2(i + 2) for i, x in enumerate(v[:k]))
    first = lambda k: ranked[:k]
    out = {f"ndcg_{k}": dcg(rel, k) / d if (d := dcg([1.0] * len(gold), k)) else 0.0 for k in (1, 3, 10)}
    out |= {"hit_1": float(bool(set(first(1)) & gold)), "precision_3": sum(r in gold for r in first(3)) / 3}
    out["mrr_10"] = next((1 / (i + 1) for i, r in enumerate(first(10)) if r in gold), 0.0)
    out |= {f"recall_{k}": len(set(first(k)) & gold) / len(gold) if gold else 0.0 for k in (10, 20, 50)}
    return out | {f"full_coverage_{k}": float(gold <= set(first(k))) for k in (3, 5, 10)}


def test_metrics(spark):
    r = np.random.default_rng(0)
    rows = [([], ["a"]), (["a"], []), (["a", "a", "b"], ["a", "b"]), (["x", "y"], ["z"])]
    rows += [([f"t{x}" for x in r.permutation(70)[: r.integers(0, 60)]], sorted({f"t{x}" for x in r.integers(0, 80, r.integers(1, 6))})) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, ranked array<string>, gold array<string>")
    got = df.select("i", *[m.alias(n) for n, m in metrics.all_metrics(F.col("ranked"), F.col("gold")).items()]).collect()
    for g in got:
        for name, value in expected(rows[g.i][0], set(rows[g.i][1])).items():
            assert g[name] == pytest.approx(value), (name, rows[g.i])
        assert g.recall_10 <= g.recall_20 <= g.recall_50


def test_graded_and_flags(spark):
    df = spark.createDataFrame([(["a", "b"], {"b": 2.0, "c": 1.0}, ["b"])], "ranked array<string>, grades map<string,double>, gold array<string>")
    got = df.select(
        metrics.all_metrics(F.col("ranked"), F.col("gold"), F.col("grades"))["ndcg_3"].alias("n"), metrics.top_k_hit(F.col("ranked"), F.col("gold")).alias("h"),
        metrics.is_correct(F.lit("a"), F.col("gold")).alias("c"), metrics.is_correct(F.lit("a"), F.array().cast("array<string>")).alias("none"),
    ).first()
    assert got.n == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3))) and got.h is True and got.c is False and got.none is None


def test_tool_scores(spark):
    scores = {1: [0.5], 2: [0.5, 0.4], 3: [0.1, 0.9, 0.5], 5: [0.5] * 5, 7: [0.1 * i for i in range(7)]}
    rows = [(1, f"t{n}", s, i) for n, v in scores.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "q int, tool string, score double, ord int")
    got = {r.tool: r for r in ranking.tool_scores(df, ["q"], "tool", "ord").collect()}
    for n, v in scores.items():
        best = sorted(v, reverse=True)[:3]
        assert got[f"t{n}"].tool_score == pytest.approx(sum(best) / len(best) + 0.05 * min(n, 5)) and got[f"t{n}"].n_hits == n
    assert got["t3"].first_hit == 1 and got["t5"].first_hit == 0
    assert ranking.tool_scores(df.limit(0), ["q"], "tool", "ord").collect() == []


def test_back_fill_and_merge(spark):
    df = spark.createDataFrame([(["b"], ["a", "b", "c"])], "r array<string>, p array<string>")
    assert df.select(ranking.back_fill(F.col("r"), F.col("p"), 10).alias("x")).first().x == ["b", "a", "c"]
    assert df.select(ranking.back_fill(F.col("r"), F.col("p"), 2).alias("x")).first().x == ["b", "a"]
    rows = [(1, l, r, t) for l, ts in enumerate(["abc", "bd", ""]) for r, t in enumerate(ts, 1)]
    lists = spark.createDataFrame(rows, "s int, l int, r int, t string")
    merged = ranking.merge_ranked(lists, ["s"], "t", "l", "r", 10).orderBy("rank").collect()
    assert [x.t for x in merged] == ["a", "b", "d", "c"]


def test_dense_search(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((120, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 8), (202, [1.0]), (203, v[3].tolist()), (204, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for x in ranking.dense_search(df, "id", "v", df.where("id % 10 = 0 or id = 3"), 8, 4, block=5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    u = np.concatenate([v, v[3:4]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    ids = np.array([*range(120), 203])
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for q, found in got.items():
        k = list(ids).index(q)
        assert found == ids[np.lexsort((ids, -np.round(s[k], 12)))[:4]].tolist()
    assert set(got) == {*range(0, 120, 10), 3}
    assert ranking.dense_search(df, "id", "v", df.limit(0), 8, 4).collect() == []


def bm25(docs, query):
    tok = [[w for w in d.split() if len(w) > 1] for d in docs]
    n, av = len(docs), sum(map(len, tok)) / len(docs)
    out = []
    for t in tok:
        s = 0.0
        for w in query.split():
            if w in t:
                df = sum(w in x for x in tok)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / av))
        out.append(s)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["red", "blue", "green", "boat", "car"]), max_size=8).map(" ".join), min_size=1, max_size=8))
def test_bm25(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_ord long, document string")
    asked = spark.createDataFrame([(1, "red boat boat"), (2, ""), (3, None)], "ord long, query string")
    got = {r.doc_ord: r.score for r in index.bm25_index(df, ["doc_ord"], F.col("document")).score(asked, ["ord"], F.col("query")).collect()}
    for i, s in enumerate(bm25(docs, "red boat boat")):
        assert got.get(i, 0.0) == pytest.approx(s)
    ranked = pipelines.document_ranking(asked, df, 5).where("ord = 1").orderBy("rank").collect()
    want = sorted(range(len(docs)), key=lambda i: (-round(bm25(docs, "red boat boat")[i], 9), i))[:5]
    assert [r.doc_ord for r in ranked] == want


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "red boat"), (2, "red boat"), (3, "green car car"), (4, ""), (5, None)], "id long, t string")
    idf = index.smooth_idf(df, ["id"], F.col("t"))
    assert {r.term: round(r.idf, 9) for r in idf.collect()}["red"] == round(math.log(6 / 3) + 1, 9)
    v = index.hashed_vectors(df, ["id"], F.col("t"), idf).cache()
    for r in v.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect():
        assert r.n == pytest.approx(1.0)
    same = index.sparse_cosine(v.withColumnRenamed("id", "q"), ["q"], v, ["id"]).where("q = 1 and id = 2").first()
    assert same.score == pytest.approx(1.0)


def test_reports(spark):
    rows = [(1, True), (1, False), (1, None), (2, None)]
    got = {r.size: (r.total, r.evaluated, r.correct, r.accuracy) for r in evaluate.summarize(spark.createDataFrame(rows, "size int, is_correct boolean"), ["size"]).collect()}
    assert got == {1: (3, 2, 1, 0.5), 2: (1, 0, 0, None)}
    runs = spark.createDataFrame([("full", 100.0), ("a", 10.0), ("a", 30.0), ("z", 0.0)], "m string, tokens double")
    assert {r.m: r.tokens_ratio for r in evaluate.compression(runs, "m", "full", ["tokens"]).collect()} == {"full": 1.0, "a": 5.0, "z": None}
    report = spark.createDataFrame([(["a"], ["a"], ["a"]), (["b"], ["a"], ["a", "c"]), (["a"], [], ["q"]), (None, ["a"], ["a"])], "r array<string>, g array<string>, f array<string>")
    assert {x.stratum: (x["count"], x.hit_1) for x in evaluate.ranking_report(report, "r", "g", "f").collect()} == {"all": (2, 0.5), "single": (1, 1.0), "multi": (1, 0.0)}
    a = spark.createDataFrame([(1, 1, True), (1, 2, False), (3, 1, True)], "k int, o int, f boolean")
    b = spark.createDataFrame([(1, True), (1, False), (2, True)], "k int, f boolean")
    assert sorted((r.k, r.a_f, r.b_f) for r in evaluate.compare_runs(a, b, ["k"], "o", "f").collect()) == [(1, False, False), (1, False, True)]


def test_pools(spark):
    tools = spark.createDataFrame([(i * 3, f"t{i}") for i in range(37)], "ord long, name string")
    catalogue = sampling.dense_index(tools, ["ord"]).cache()
    assert [r.idx for r in catalogue.orderBy("ord").collect()] == list(range(37))
    asked = spark.createDataFrame([(1, ["t3"]), (2, ["t3", "t5", "nope"]), (3, ["nope"]), (4, None), (5, [])], "ord long, gold array<string>")
    sizes = [1, 5, 36, 37, 100]
    rows = sampling.pools(asked, ["ord"], "gold", catalogue.select("idx", "name"), sizes).collect()
    by = {}
    for r in rows:
        by.setdefault((r.ord, r.pool_size), []).append(r)
    assert set(by) == {(o, s) for o in (1, 2) for s in sizes}
    for (o, s), members in by.items():
        names = [m.name for m in members]
        gold = {"t3"} if o == 1 else {"t3", "t5"}
        assert len(set(names)) == len(names) == max(len(gold), min(s, 37)) and gold <= set(names)
        assert {m.name for m in members if m.is_gold} == gold
        assert sorted(m.pos for m in members) == list(range(1, len(names) + 1))
    again = sampling.pools(asked.repartition(3), ["ord"], "gold", catalogue.select("idx", "name"), sizes).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
