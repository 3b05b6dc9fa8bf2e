import base64
import random

import numpy as np
import pytest

from intentlake.llm import bpe

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(bpe.DEFAULT_RANKS), reason="no rank file")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_rank_file())


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [
    "", " ", "  ", "\n", " \n ", "a", "'s", "it's 'tis we'll  they've I'd", "''s", " 's", "\t's", "'re'", "x" * 5000, "ab" * 3000, "  a  b \n\n c\r\n\r\nd ",
    "<|endoftext|> x", "日本語のテキスト", "é́ 👩‍👩‍👧 ​﻿", "1 234 ½ ² 五", "\x1c\x85 　x", "don'T can't", "\x00\x01",
]


def test_equals_the_public_encoder(encoder, public):
    for text in CASES:
        assert encoder.encode(text) == public.encode_ordinary(text), repr(text)


def test_random_texts(encoder, public):
    alphabet = " '\t\nsretvmldLS12é中😀.́​\x1c\x85　"
    r = random.Random(5)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    ids, count = encoder.encode_texts(texts)
    at = np.concatenate(([0], np.cumsum(count)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == public.encode_ordinary(t), repr(t)


def test_round_trip(encoder):
    for text in CASES:
        assert encoder.decode(encoder.encode(text)) == text


def test_every_text_of_the_tables(encoder, public):
    import os

    import pyarrow.parquet as pq

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        ids, count = encoder.encode_texts(part)
        at = np.concatenate(([0], np.cumsum(count)))
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == public.encode_ordinary(t)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT_PIECES", 1)
    small = bpe.Encoder(bpe.read_rank_file())
    for text in CASES:
        assert small.encode(text) == encoder.encode(text)


def test_frame(spark):
    rows = [(1, "it's", "x"), (2, None, "y"), (3, "", "z"), (None, "a b", "w"), (1, "it's", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((r.doc_id or 0, tuple(r.ids)) for r in bpe.encode_ids(df).collect())
    assert [x[0] for x in out] == [0, 1, 1, 2, 3]
    assert out[1] == out[2] and out[3][1] == () and out[4][1] == ()
    assert bpe.encode_ids(df.limit(0)).collect() == []
    back = bpe.encode_ids(df).select(bpe.decode_ids("ids").alias("t")).collect()
    assert sorted(r.t for r in back) == ["", "", "a b", "it's", "it's"]


def test_rank_file_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RANK_FILE_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.read_rank_file()
