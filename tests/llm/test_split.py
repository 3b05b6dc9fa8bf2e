import pytest

from intentlake.llm import bpe, split

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(bpe.DEFAULT_RANKS), reason="no rank file")


def plain_cuts(offset, level, total, limit, overlap):
    """The cuts of one text, walked one after another."""
    succ = split.successors(offset, level, total, limit, overlap)
    at, out = 0, []
    while at < total:
        at = int(succ[at])
        out.append(at)
    return out


def check(spark, texts, limit=64, overlap=8):
    encoder = bpe.Encoder(bpe.read_rank_file())
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = split.split_oversized(df, max_tokens=limit, overlap=overlap).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = encoder.encode(t)
        pieces = sorted(by.get(i, []), key=lambda r: r.piece_no)
        assert bool(pieces) == (len(ids) > limit)
        end = 0
        for n, p in enumerate(pieces):
            assert p.piece_no == n and p.ids == ids[p.token_start : p.token_end] and 0 < len(p.ids) <= limit
            assert p.token_start == (end - overlap if n else 0) and p.token_end > end
            decoded = encoder.decode(p.ids)
            assert decoded == p.piece or decoded.lstrip("�") == p.piece
            end = p.token_end
        if pieces:
            assert end == len(ids) and pieces[-1].cut == "end"
    return by


def test_pieces(spark):
    words = " ".join(f"word{i}" for i in range(400))
    texts = [
        None, "", "   ", "short", words, "x" * 4000, "中文没有空格" * 200, "👩‍👩‍👧" * 200, "One. Two is longer. Three? " * 100,
        "A line of words here\n" * 100, "A paragraph of words.\n\n" * 100, "a\r\n\r\nb " * 200, " " * 5000, "\n" * 5000, words, "é" * 3000,
    ]
    by = check(spark, texts)
    assert {p.cut for p in by[10]} == {"paragraph", "end"}
    assert {p.cut for p in by[9]} == {"line", "end"}
    assert {p.cut for p in by[8]} == {"sentence", "end"}
    assert {p.cut for p in by[4]} == {"word", "end"}
    assert [p.token_end for p in by[4]] == [p.token_end for p in by[14]]


def test_doubling_equals_walking():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        total = int(r.integers(70, 900))
        offset = np.flatnonzero(r.random(total) < 0.6)
        level = r.integers(0, 5, len(offset)).astype(np.int8)
        succ = split.successors(offset, level, total, 64, 8)
        marks = np.flatnonzero(split.all_cuts(succ, np.array([0])))
        assert marks.tolist() == [0, *plain_cuts(offset, level, total, 64, 8)]


def test_limits(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert split.split_oversized(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        split.split_oversized(df, max_tokens=64, overlap=40)


def test_long_text(spark):
    check(spark, ["Some words make a sentence. " * 20_000], limit=1024, overlap=64)
