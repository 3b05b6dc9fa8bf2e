"""Byte-level BPE over a published rank file.

Three steps, each on whole Arrow batches:

* *Cutting* a text into the pieces of the published pattern (contractions, letter runs, number runs,
  other runs, white space) is done with array operations over the code points of the batch.
* *Merging* a piece that is not itself a token uses a priority queue of merge ranks over a doubly
  linked list of symbols. Queue entries are never removed; an entry whose pair has changed since is
  stale and skipped when it comes up. Each worker merges a piece once and keeps the result, so the
  cost of merging follows the number of different pieces.
* *Decoding* concatenates the vocabulary's byte strings.

Strings that look like special tokens are ordinary text. Empty and null texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A rank file is sent to every worker; a larger one is refused.
MAX_RANK_FILE_BYTES = 64 << 20
#: Code points that are cut at once; bounds the working memory of a batch, a longer text is cut alone.
CHUNK_CHARS = 1 << 20
#: Pieces whose merges a worker keeps; at this size the store starts anew, which changes no result.
MAX_KEPT_PIECES = 600_000

SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
# The code points of Unicode's White_Space property.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


def char_classes() -> np.ndarray:
    """The class of every code point: white space, letter (L*), number (N*) or other."""
    global _CLASSES
    if _CLASSES is None:
        category = unicodedata.category
        table = np.full(0x110000, OTHER, np.uint8)
        first = np.frombuffer("".join(category(chr(c))[0] for c in range(0x110000)).encode("ascii"), np.uint8)
        table[first == ord("L")] = LETTER
        table[first == ord("N")] = NUMBER
        table[list(WHITE_SPACE)] = SPACE
        _CLASSES = table
    return _CLASSES


_CLASSES: np.ndarray | None = None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cut_pieces(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Start offsets of the pieces of a text given as code points and classes.

    Several texts can be cut at once if a ``BREAK`` stands after each; a break is a piece by itself.
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    run = np.concatenate(([0], change))
    run_end = np.append(change, n)
    kind = cls[run]
    breaks = np.flatnonzero(kind == BREAK)
    # Empty texts leave breaks side by side: each stays a piece by itself.
    twin = breaks[run_end[breaks] - run[breaks] > 1]
    more_breaks = np.concatenate([np.arange(run[i] + 1, run_end[i]) for i in twin]) if len(twin) else np.zeros(0, np.int64)
    space = kind == SPACE
    ends_text = np.ones(len(run), bool)
    ends_text[:-1] = kind[1:] == BREAK
    last = run_end - 1
    # White space before a word: all but the last character is one piece, the last is its own piece or leads the word.
    split_last = space & ~ends_text & (run_end - run > 1)
    led = np.zeros(len(run), bool)
    led[1:] = space[:-1] & (cp[last[:-1]] == 0x20) & (kind[1:] != BREAK)
    starts = [run[space], last[split_last], run[~space & ~led], more_breaks]
    # Contractions: a lone apostrophe that begins a piece, then s, t, m, d, re, ve or ll.
    lone = np.flatnonzero((kind == OTHER) & (run_end - run == 1) & (cp[run] == 0x27) & ~led)
    lone = lone[lone + 1 < len(run)]
    lone = lone[kind[lone + 1] == LETTER]
    drop = np.zeros(0, np.int64)
    if len(lone):
        at = run[lone + 1]
        size = run_end[lone + 1] - at
        a = cp[at]
        b = cp[np.minimum(at + 1, n - 1)]
        two = (size > 1) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        taken = np.where(one, 1, np.where(two, 2, 0))
        hit = taken > 0
        drop = at[hit]
        rest = (at + taken)[hit & (taken < size)]
        starts.append(rest)
    mark = np.zeros(n, bool)
    for s in starts:
        mark[s] = True
    mark[drop] = False
    return np.flatnonzero(mark)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    symbol: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    #: The rank of the pair that starts at each symbol now; what the queue holds besides is stale.
    pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    # An entry is rank * 2**32 + position: least rank first, of equal ranks the leftmost.
    queue = [r << 32 | i for i, r in enumerate(pair) if r is not None]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        if pair[i] != entry >> 32:
            continue
        j = after[i]
        joined = symbol[i] = symbol[i] + symbol[j]
        pair[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = pair[i] = get(joined + symbol[k])
            if new is not None:
                heappush(queue, new << 32 | i)
        else:
            pair[i] = None
        h = before[i]
        if h >= 0:
            new = get(symbol[h] + joined)
            if pair[h] != new:
                pair[h] = new
                if new is not None:
                    heappush(queue, new << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[symbol[i]])
        i = after[i]
    return out


class Encoder:
    """A vocabulary with its worker-local store of merged pieces."""

    def __init__(self, rank_file: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.strings = {i: b for b, i in self.ranks.items()}
        self.width = max(self.strings) + 1
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Merge pieces that the store lacks and add them to it."""
        merged = [merge(p.encode("utf-8", "replace"), self.ranks) for p in new]
        end = np.cumsum(np.fromiter(map(len, merged), np.int64, len(merged)))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, int(end[-1]))
        used = int(self.start[-1])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(len(flat), used) + (1 << 16), np.int32)])
        self.flat[used : used + len(flat)] = flat
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.start = np.concatenate([self.start, used + end])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces one after another, and the number of ids of each piece."""
        if len(self.number) > MAX_KEPT_PIECES:
            self._forget()
        get = self.number.get
        number = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([pieces[k] for k in missing])))
            number[missing] = [get(pieces[k]) for k in missing]
        size = self.start[number + 1] - self.start[number]
        total = np.cumsum(size)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(self.start[number] - (total - size), size)
        return self.flat[where], size

    def encode_joined(self, joined: str, cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_pieces``, for the pieces that begin at ``starts``; a break has no ids."""
        real = cls[starts] != BREAK
        bounds = np.append(starts, len(joined))
        ids, size = self.encode_pieces([joined[a:b] for a, b in zip(starts[real].tolist(), bounds[1:][real].tolist())])
        all_sizes = np.zeros(len(starts), np.int64)
        all_sizes[real] = size
        return ids, all_sizes

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and the number of ids of each text."""
        joined, cp, cls, ends = join_texts(texts)
        starts = cut_pieces(cp, cls)
        ids, size = self.encode_joined(joined, cls, starts)
        before = np.concatenate(([0], np.cumsum(size)))
        upto = before[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0].tolist() if text else []

    def decode(self, ids) -> str:
        """The text of the ids: their byte strings concatenated. A null list and null or unknown ids give no bytes."""
        strings = self.strings
        return b"".join(strings.get(i, b"") for i in ids if i is not None).decode("utf-8", "replace") if ids is not None else ""


def join_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined by breaks: the string, its code points and classes, and the offset of the break after each text."""
    joined = "\0".join([*texts, ""])
    cp = code_points(joined)
    cls = char_classes()[cp]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    cls[ends] = BREAK
    return joined, cp, cls, ends


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(rank_file: bytes) -> Encoder:
    """The encoder of this Python worker for a rank file; built once."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_file)
    return _ENCODERS[key]


def read_rank_file(path: str = DEFAULT_RANKS) -> bytes:
    """The rank file's bytes, for sending to the workers; refuses files beyond ``MAX_RANK_FILE_BYTES``."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    return data


def chunks(sizes: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit``, or single rows."""
    a, total = 0, 0
    for b, s in enumerate(sizes.tolist()):
        if b > a and total + s > limit:
            yield a, b
            a, total = b, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def encode_ids(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, out_col: str = "ids"
) -> DataFrame:
    """(``id_col``, ``out_col`` ARRAY<INT>): the token ids of every row's whole text.

    Null and empty texts give an empty list, blank texts are encoded like others. Rows are neither
    dropped nor merged: repeated rows and null ids come out as often as they come in. Other columns
    are not read. No shuffle: the encoder runs where the text is scanned.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_rank_file(ranks_path))
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for a, b in chunks(sizes):
                ids, count = encoder.encode_texts([t or "" for t in texts.slice(a, b - a).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["_id", "_ids"])

    out = source.mapInArrow(run, f"_id {id_type}, _ids array<int>")
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias(out_col))


def decode_ids(ids: Column | str, ranks_path: str = DEFAULT_RANKS) -> Column:
    """The text of an ARRAY<INT> column of ids; an empty string for an empty or null list."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(read_rank_file(ranks_path))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        encoder = worker_encoder(shared.value)
        return pa.array([encoder.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(ids)
