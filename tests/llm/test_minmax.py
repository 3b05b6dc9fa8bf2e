import random
import re

import numpy as np
from pyspark.sql import functions as F

from intentlake.functions.text import tool_key
from intentlake.llm import minmax


def brute(rows):
    def key(n):
        return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", n.replace("_", " ").replace("-", " ")).lower().strip()

    kept = []
    for i, q, t in dict.fromkeys(rows):
        if i is None or q is None or t is None or not key(t):
            continue
        p = "".join(c for c in q.lower() if c.isalnum())
        if len(p) >= 20:
            kept.append((i, key(t), {p[j : j + 3] for j in range(len(p) - 2)}))
    return {
        (min(a, b), max(a, b)) for a, ka, ga in kept for b, kb, gb in kept if a < b and ka == kb and len(ga & gb) / len(ga | gb) >= 0.6
    }


def fixture():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    rows, n = [], 0
    for group in range(40):
        base = [word() for _ in range(14)]
        tool = r.choice(["openDoor", "open_door", "open-door", "send mail"])
        for _ in range(r.randint(1, 5)):
            edited = [w if r.random() > 0.06 else word() for w in base]
            if r.random() < 0.3:
                edited = edited[7:] + edited[:7]
            n += 1
            rows.append((n, " ".join(edited), tool))
    rows += [(n + 1, None, "x"), (n + 2, "short", "x"), (n + 3, "a text that is long enough", None), (n + 4, "a text that is long enough", ""), (None, "a text that is long enough", "x")]
    rows += [(n + 10 + i, "exactly the same text once more, long enough", "hot") for i in range(12)]
    rows += [(n + 30, "EXACTLY the same text -- once more; long enough!", "hot"), (n + 31, "exactly the same text twice more, long enough", "hot"), (n + 31, "exactly the same text twice more, long enough", "hot")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "entry_ord long, query string, tool_name string, plain string, rep int")
    return df


def test_pairs(spark):
    rows = fixture()
    got = minmax.similar_pairs(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()
    pairs = [(r.a, r.b) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows)


def test_groups(spark):
    rows = fixture()
    got = {r.id: r for r in minmax.near_duplicate_groups(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    for i, r in got.items():
        assert r.group_id == find(i)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.group_id for r in minmax.groups(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty(spark):
    df = frame(spark, fixture()).limit(0)
    assert minmax.similar_pairs(df, "entry_ord", tool_key("tool_name"), F.col("query")).collect() == []
    assert minmax.near_duplicate_groups(df, "entry_ord", tool_key("tool_name"), F.col("query")).collect() == []


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CELL", 3)
    rows = fixture()
    got = minmax.similar_pairs(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()
    assert {(r.a, r.b) for r in got} == brute(rows)


def test_agreement_estimates_similarity():
    r = random.Random(2)
    a = "".join(r.choice("abcdefgh") for _ in range(400))
    b = a[:300] + "".join(r.choice("ijklmnop") for _ in range(100))
    ga, gb = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    sig = minmax.signatures([a, b], 3, 2048)
    agree = sig[0] == sig[1]
    truth = len(ga & gb) / len(ga | gb)
    assert abs(agree.mean() - truth) < 0.05
    assert abs(agree[0::2].mean() - agree[1::2].mean()) < 0.1
    assert np.array_equal(sig, minmax.signatures([a, b], 3, 2048))


def found(spark, rows):
    got = minmax.similar_pairs(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()
    pairs = [(r.a, r.b) for r in got]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_crowded_key_is_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CELL_TEXTS", 7)
    rows = fixture()
    assert found(spark, rows) == brute(rows)


def test_long_texts_split_a_key_too(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CELL_CHARS", 900)
    rows = fixture()
    assert found(spark, rows) == brute(rows)


def test_giant_key_goes_through_the_table_of_bands(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CELL_TEXTS", 5)
    monkeypatch.setattr(minmax, "MOST_CELLS", 3)
    monkeypatch.setattr(minmax, "CELL", 3)
    rows = fixture()
    assert found(spark, rows) == brute(rows)


def test_groups_of_crowded_keys(spark, monkeypatch):
    rows = [r for r in fixture() if r[0] is not None]
    whole = {tuple(r) for r in minmax.near_duplicate_groups(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()}
    monkeypatch.setattr(minmax, "CELL_TEXTS", 6)
    assert {tuple(r) for r in minmax.near_duplicate_groups(frame(spark, rows), "entry_ord", tool_key("tool_name"), F.col("query")).collect()} == whole


def test_banded_pairs_of_both_sides_only():
    h = np.array([[1, 9], [1, 8], [1, 8], [4, 9]])
    assert set(zip(*minmax.banded_pairs(h, np.zeros(4, int)))) == {(0, 1), (0, 2), (1, 2), (0, 3)}
    assert set(zip(*minmax.banded_pairs(h, np.array([1, 1, 2, 2])))) == {(0, 2), (1, 2), (0, 3)}


def test_wider_shingles():
    texts = ["one text of some length and words", "one text of some length and wordy", "something else altogether here"]
    i, j, s = minmax.similar_texts(texts, np.zeros(3, int), np.zeros(3, int), 0.6, 5, 64, 5)
    grams = [{t[a : a + 5] for a in range(len(t) - 4)} for t in texts]
    assert (i.tolist(), j.tolist()) == ([0], [1]) and abs(s[0] - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 1e-12


def test_agreements():
    r = np.random.default_rng(3)
    sig = r.integers(0, 3, (40, 323)).astype(np.uint32) << np.uint32(12)
    i, j = r.integers(0, 40, 5000), r.integers(0, 40, 5000)
    assert np.array_equal(minmax.agreements(sig, i, j), (sig[i] == sig[j]).sum(axis=1))
