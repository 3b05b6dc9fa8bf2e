"""The tokenizer as vectorised functions on Arrow batches.

Runs of word characters are found by one regular expression a text. What a run stands for (its synonyms,
phrases and n-grams) is worked out once and kept as numbers of tokens; tokens become strings when a
batch is done. Time and memory are in proportion to the text and its tokens, whatever the runs' lengths.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from intentlake.functions.lexicon import CJK_PHRASES, CJK_SYNONYMS, STOPWORDS, SYNONYMS

RUNS = re.compile("[A-Za-z0-9_]+|[一-鿿]+")
#: Tokens that are kept by number; beyond, a new batch starts with none.
MOST_TOKENS = 1 << 19
#: Characters of a run that is kept with its tokens at most.
KEPT_RUN = 48


def run_tokens(run: str) -> list[str]:
    """The tokens of one run, in order."""
    if run[0] >= "一":
        phrases = [t for p in CJK_PHRASES if p in run for t in (p, *CJK_SYNONYMS.get(p, ()))]
        return phrases + [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    if len(run) == 1 or run in _STOPWORDS:
        return []
    return [run, *SYNONYMS.get(run, ())]


_STOPWORDS = frozenset(STOPWORDS)


class _Numbers:
    """Tokens by number, and the numbers of the tokens of each run."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.runs: dict[str, list[int]] = {}
        self._words = pa.array([], pa.string())

    def of(self, run: str) -> list[int]:
        found = []
        for token in run_tokens(run):
            if (n := self.number.get(token)) is None:
                n = self.number[token] = len(self.names)
                self.names.append(token)
            found.append(n)
        if len(run) <= KEPT_RUN:
            self.runs[run] = found
        return found

    def words(self) -> pa.Array:
        """All tokens by number."""
        if len(self._words) < len(self.names):
            self._words = pa.concat_arrays([self._words, pa.array(self.names[len(self._words) :], pa.string())])
        return self._words


_NUMBERS = _Numbers()


def token_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers of all texts' tokens, where each text's begin, with the end, and the tokens by number."""
    global _NUMBERS
    if len(_NUMBERS.number) > MOST_TOKENS:
        _NUMBERS = _Numbers()
    known, of = _NUMBERS.runs, _NUMBERS.of
    flat: list[int] = []
    begin = [0]
    for text in texts.to_pylist():
        if text:
            for run in RUNS.findall(text):
                found = known.get(run)
                flat += of(run) if found is None else found
        begin.append(len(flat))
    return np.array(flat, np.int32), np.array(begin, np.int64), _NUMBERS.words()


_TERM = StructType().add("term", StringType()).add("tf", IntegerType()).add("first_pos", IntegerType())
_COUNTS = StructType().add("dl", IntegerType()).add("terms", ArrayType(_TERM))


@F.arrow_udf(ArrayType(StringType()))
def tokens_of(normalized: pa.Array) -> pa.Array:
    """The tokens of normalised texts; null for null."""
    numbers, begin, words = token_numbers(normalized)
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), words.take(pa.array(numbers)), mask=normalized.is_null())


@F.arrow_udf(_COUNTS)
def counts_of(normalized: pa.Array) -> pa.Array:
    """For each normalised text its number of tokens and its different tokens with their number and first place; none for null."""
    numbers, begin, words = token_numbers(normalized)
    size = np.diff(begin)
    owner = np.repeat(np.arange(len(size)), size)
    kinds, first, tf = np.unique(owner * len(words) + numbers, return_index=True, return_counts=True)
    owner, term = np.divmod(kinds, max(1, len(words)))
    terms = pa.StructArray.from_arrays(
        [words.take(pa.array(term)), pa.array(tf.astype(np.int32)), pa.array((first - begin[owner]).astype(np.int32))], ["term", "tf", "first_pos"]
    )
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(size))))).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), terms)], ["dl", "terms"])
