"""Test items whose wording occurs in a corpus: BM25 retrieval with block-max WAND, then verification.

The test items are the documents of a BM25 index; every corpus text is cut into overlapping passages
and each passage is a query. A passage of ``2 * span`` words every ``span`` words contains each run of
``span`` consecutive words of the text whole, so if a text shares such a run with an item, one of its
passages contains all words of the run and scores at least the run's own BM25 sum against that item. A word that occurs in no item scores nothing and can be in no shared run,
so it ends a passage.
An item's threshold is the least such sum over its runs, hence retrieval above the threshold loses no
case. Retrieved pairs are verified by comparing runs of words, and it is noted whether the item's answer
occurs in the text too.

The index is built on the executors, in shards of a bounded size in bytes, by a hash of the item. Every
corpus text is read once and searched for the items of all shards, one shard's index at a time in memory.

Posting impacts are divided by the item's threshold, so that one threshold of 1 holds for all items
and block maxima stay comparable. Passages whose summed best impacts cannot reach 1 have no WAND
pivot; they are passed over for a whole batch at once.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.llm.bpe import LETTER, NUMBER, char_classes, chunks, code_points
from intentlake.session import cut_lineage

SPAN = 12
K1, B = 1.5, 0.75
BLOCK_POSTINGS = 32
#: Bytes of test items in one shard of the index, about.
SHARD_BYTES = 8 << 20
EPSILON = 1e-9
CJK_FIRST, CJK_LAST = 0x4E00, 0x9FFF


def word_starts(joined: str, cp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of all words of a lower-case text.

    A character U+4E00 to U+9FFF is a word by itself, and so is each longest run of other letters and numbers.
    """
    cp = code_points(joined) if cp is None else cp
    cls = char_classes()[cp]
    single = (cp >= CJK_FIRST) & (cp <= CJK_LAST)
    run = ((cls == LETTER) | (cls == NUMBER)) & ~single
    edge = np.flatnonzero(np.diff(run, prepend=False, append=False))
    alone = np.flatnonzero(single)
    start, end = np.concatenate([edge[0::2], alone]), np.concatenate([edge[1::2], alone + 1])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def shapes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 20-bit number from the first two characters, the last one and the length of each word; equal words have equal ones."""
    h = cp[start].astype(np.uint64)
    for x in (cp[np.minimum(start + 1, end - 1)], cp[end - 1], (end - start)):
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(8)) & np.uint64((1 << 20) - 1)


def stretches(known: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest stretch of known words of one text that has at least ``least`` words."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(known), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (known[1:] != known[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(known))
    keep = known[start] & (end - start >= least)
    return start[keep], end[keep]


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return [text[a:b] for a, b in zip(*map(np.ndarray.tolist, word_starts(text)))]


class ItemIndex:
    """An impact-ordered-by-item inverted index of test items with block maxima."""

    def __init__(self, items: list[tuple], span: int = SPAN):
        """``items``: id, text and, if there is one, answer."""
        self.span = span
        kept = [(k, w, a) for k, t, *a in items if len(w := words(t)) >= span]
        self.ids = [k for k, _, _ in kept]
        self.answers = [" ".join(words(a[0])) if a else "" for _, _, a in kept]
        self.term: dict[str, int] = {}
        texts = [[self.term.setdefault(x, len(self.term)) for x in w] for _, w, _ in kept]
        found = Counter(x for t in texts for x in set(t))
        n = len(texts)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in found.items()}
        mean = sum(map(len, texts)) / max(1, len(texts))
        self.runs: list[set[tuple[int, ...]]] = []
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, t in enumerate(texts):
            norm = K1 * (1 - B + B * len(t) / mean)
            weight = {x: idf[x] * c * (K1 + 1) / (c + norm) for x, c in Counter(t).items()}
            runs = {tuple(t[j : j + span]) for j in range(len(t) - span + 1)}
            self.runs.append(runs)
            threshold = min(sum(weight[x] for x in set(r)) for r in runs)
            for x, w in weight.items():
                postings.setdefault(x, []).append((i, w / threshold))
        self.postings = {x: ([i for i, _ in p], [w for _, w in p]) for x, p in postings.items()}
        self.block_max = {x: [max(w[b : b + BLOCK_POSTINGS]) for b in range(0, len(w), BLOCK_POSTINGS)] for x, (_, w) in self.postings.items()}
        joined = "\n".join(self.term)
        self.shapes = np.zeros(1 << 20, bool)
        self.shapes[shapes(code_points(joined), *word_starts(joined)) if self.term else []] = True
        self.term_max = np.array([max(self.postings[t][1]) for t in range(len(self.term))] + [0.0])

    def search(self, query: set[int]) -> list[int]:
        """Items that score at least 1 for a passage's distinct terms, by block-max WAND."""
        limit = 1 - EPSILON
        cursors = [[p[0][0], 0, x] for x in query if (p := self.postings.get(x))]
        hits = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for c, (_, _, x) in enumerate(cursors):
                bound += self.term_max[x]
                if bound >= limit:
                    pivot = c
                    break
            if pivot < 0:
                return hits
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # The blocks that hold the pivot item: their maxima and where the first of them ends.
            block_bound, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for cursor in cursors[: pivot + 1]:
                at, x = cursor[1], cursor[2]
                ids = self.postings[x][0]
                block = at // BLOCK_POSTINGS
                while ids[min(len(ids), (block + 1) * BLOCK_POSTINGS) - 1] < item and (block + 1) * BLOCK_POSTINGS < len(ids):
                    block += 1
                last = ids[min(len(ids), (block + 1) * BLOCK_POSTINGS) - 1]
                if last >= item:
                    block_bound += self.block_max[x][block]
                    next_item = min(next_item, last + 1)
            if block_bound >= limit:
                score, target = 0.0, item + 1
                for cursor in cursors[: pivot + 1]:
                    self._advance(cursor, item)
                    if cursor[0] == item:
                        score += self.postings[cursor[2]][1][cursor[1]]
                if score >= limit:
                    hits.append(item)
            else:
                target = max(item + 1, next_item)
            for cursor in cursors[: pivot + 1]:
                self._advance(cursor, target)
            cursors = [c for c in cursors if c[0] < len(self.ids)]
        return hits

    def _advance(self, cursor: list, item: int) -> None:
        """Move to the first posting at or after ``item``, whole blocks at a time."""
        ids = self.postings[cursor[2]][0]
        at, n = cursor[1], len(ids)
        while at + BLOCK_POSTINGS < n and ids[at + BLOCK_POSTINGS] < item:
            at += BLOCK_POSTINGS
        while at < n and ids[at] < item:
            at += 1
        cursor[1] = at
        cursor[0] = ids[at] if at < n else len(self.ids)

    def leaks(self, texts: list[str]) -> list[tuple[int, int, bool | None]]:
        """(text number, item number, whether the text holds the item's answer) of all verified pairs; null without an answer."""
        if not self.ids:
            return []
        span = self.span
        lower = [t.lower() for t in texts]
        joined = "\n".join(lower)
        cp = code_points(joined)
        start, end = word_starts(joined, cp)
        text_at = np.cumsum([0, *[len(t) + 1 for t in lower]])
        owner_of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, text_at)))
        # Words whose shape no item's word has needn't be looked up, nor the others where too few follow each other.
        lo, hi = stretches(self.shapes[shapes(cp, start, end)], owner_of, span)
        look = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        term = np.full(len(start), -1, np.int64)
        term[look] = np.fromiter(map(self.term.get, [joined[a:b] for a, b in zip(start[look].tolist(), end[look].tolist())], repeat(-1)), np.int64, len(look))
        # A word of no item breaks a passage, as a text's end does. Within each stretch of known words:
        # passages from every span-th word, of 2 * span words or up to the stretch's end.
        stretch, stretch_end = stretches(term >= 0, owner_of, span)
        count = (stretch_end - stretch) // span
        which = np.repeat(np.arange(len(stretch)), count)
        begin = stretch[which] + span * (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(begin + 2 * span, stretch_end[which])
        owner = owner_of[begin] if len(begin) else begin
        best = np.concatenate(([0.0], np.cumsum(self.term_max[term])))
        pairs = set()
        for p in np.flatnonzero(best[stop] - best[begin] >= 1 - 1e-6).tolist():
            passage = term[begin[p] : stop[p]].tolist()
            if hits := self.search(set(passage)):
                runs = {tuple(passage[j : j + span]) for j in range(len(passage) - span + 1)}
                pairs.update((int(owner[p]), i) for i in hits if not runs.isdisjoint(self.runs[i]))
        spoken: dict[int, str] = {}
        out = []
        for t, i in sorted(pairs):
            if self.answers[i] and t not in spoken:
                own = slice(*np.searchsorted(owner_of, [t, t + 1]).tolist())
                spoken[t] = " ".join(["", *[joined[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())], ""])
            out.append((t, i, f" {self.answers[i]} " in spoken[t] if self.answers[i] else None))
        return out


def index_shards(items: DataFrame, item_id: str, item_text: str, item_answer: str | None, span: int) -> list:
    """The index of the test items as broadcasts of bounded size, built on the executors; one shard at a time passes the driver."""
    answer = F.col(item_answer).cast("string") if item_answer else F.lit(None).cast("string")
    wanted = items.select(F.col(item_id).cast("bigint").alias("k"), F.col(item_text).cast("string").alias("t"), answer.alias("a")).where("k is not null and t is not null")
    shards = max(1, math.ceil((wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / SHARD_BYTES))

    def build(rows):
        index = ItemIndex(list(zip(rows["k"].tolist(), rows["t"].tolist(), rows["a"].tolist())), span)
        return pd.DataFrame({"blob": [pickle.dumps(index)]})

    placed = wanted.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    built = cut_lineage(placed.groupBy("shard").applyInPandas(build, "blob binary"))
    return [items.sparkSession.sparkContext.broadcast(bytes(r.blob)) for r in built.toLocalIterator(prefetchPartitions=False)]


def leaked_items(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "ord",
    item_text: str = "query",
    item_answer: str | None = None,
    span: int = SPAN,
) -> DataFrame:
    """(``id_col``, ``case_ord``, ``answer_found``): every text in which ``span`` consecutive words of a test item occur consecutively.

    Words are taken from the lower-case text: each character U+4E00 to U+9FFF and each longest run of
    other letters and numbers. Items under ``span`` words, null items and null ids leak nothing; null,
    empty and short texts contain nothing. Each pair is listed once, also if ids repeat. Items with
    equal wording are all listed. Texts are read whole; other columns aren't read.

    ``answer_found`` says whether the words of ``item_answer`` occur consecutively in the text as well (in
    any of the texts of one id); null where no answer column is given or the answer has no words.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")
    shards = index_shards(items, item_id, item_text, item_answer, span)
    found = source.mapInArrow(_finder(shards), "_id bigint, case_ord bigint, answer_found boolean")
    return found.groupBy("_id", "case_ord").agg(F.max("answer_found").alias("answer_found")).select(F.col("_id").alias(id_col), "case_ord", "answer_found")


def _finder(shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.asarray(pa.compute.binary_length(batch.column(1)))
            for shard in shards:
                if index is None or len(shards) > 1:
                    index = pickle.loads(shard.value)
                    # The broadcast stays on the worker's disk; its copy in memory isn't needed.
                    shard.__dict__.pop("_value", None)
                for a, b in chunks(sizes):
                    pairs = index.leaks(batch.column(1).slice(a, b - a).to_pylist())
                    if pairs:
                        t, i, answer = map(list, zip(*pairs))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[a:b][t]), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(answer, pa.bool_())], ["_id", "case_ord", "answer_found"]
                        )

    return run
