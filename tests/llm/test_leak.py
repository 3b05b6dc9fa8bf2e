import random

from intentlake.llm import leak


def brute(docs, items, span=12):
    def grams(t):
        w = leak.words(t)
        return {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}

    return {(d, k) for d, t in docs for k, q in items if t and q and grams(t) & grams(q)}


def test_words():
    assert leak.words("It's 3.5 kg_x, 中文abc Ünï") == ["it", "s", "3", "5", "kg", "x", "中", "文", "abc", "ünï"]
    assert leak.words(None) == [] == leak.words("") == leak.words(" .,!")


def fixture(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 40)))) for i in range(80)]
    items += [(90, None), (91, ""), (92, "short one"), (93, items[0][1]), (94, "中" * 20)]
    docs = []
    for d in range(200):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            q = (r.choice(items[:80])[1]).split()
            a = r.randint(0, max(0, len(q) - 11))
            cut = q[a : a + r.randint(9, 16)]
            at = r.randint(0, len(w))
            w[at:at] = cut
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    docs += [(300, None), (301, ""), (302, "中" * 11), (303, "x " + "中" * 12), (304, "a" * 100_000)]
    return docs, items


def test_equals_brute_force():
    for seed in range(5):
        docs, items = fixture(seed)
        index = leak.ItemIndex([(k, q) for k, q in items if q is not None])
        texts = [t or "" for _, t in docs]
        got = {(docs[d][0], index.ids[i]) for d, i, _ in index.leaks(texts)}
        assert got == brute(docs, items)


def test_wand_equals_full_scoring(monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_POSTINGS", 4)
    docs, items = fixture(7)
    index = leak.ItemIndex([(k, q) for k, q in items if q is not None])
    r = random.Random(8)
    for _ in range(300):
        query = set(r.sample(range(len(index.term)), min(len(index.term), r.randint(1, 24))))
        score = [0.0] * len(index.ids)
        for x in query:
            for i, w in zip(*index.postings[x]):
                score[i] += w
        assert sorted(index.search(query)) == [i for i, s in enumerate(score) if s >= 1 - leak.EPSILON]


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(leak, "SHARD_BYTES", 2000)
    docs, items = fixture(3)
    df = spark.createDataFrame([(d, t, 5) for d, t in docs + docs[:20]], "doc_id long, text string, case_ord int")
    cases = spark.createDataFrame(items, "ord long, query string")
    got = [(r.doc_id, r.case_ord) for r in leak.leaked_items(df, cases).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert leak.leaked_items(df.limit(0), cases).collect() == []
    assert leak.leaked_items(df, cases.limit(0)).collect() == []


def test_answers(spark):
    question = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, question, "open_door"), (2, question, None), (3, question, " _ "), (4, question, "closeDoor")]
    docs = [(1, f"{question}. Use open-door!"), (2, f"{question} open the door"), (2, "open door"), (3, "open door")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cases = spark.createDataFrame(items, "ord long, query string, tool string")
    got = {(r.doc_id, r.case_ord): r.answer_found for r in leak.leaked_items(df, cases, item_answer="tool").collect()}
    assert got == {(1, 1): True, (1, 2): None, (1, 3): None, (1, 4): False, (2, 1): False, (2, 2): None, (2, 3): None, (2, 4): False}
