"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

The tokens of a text are numbered from 0; a *boundary* is a token offset. Every boundary is joined to
its successor, the farthest legal end of the piece that starts ``overlap`` tokens before it. Squaring
the table of successors again and again, and following it from all cuts known so far, gives every cut
of every text of a batch in a number of rounds that is logarithmic in the number of pieces, without
walking a text cut by cut. A text lies in one row, so the tables stay inside its Arrow batch and no
shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.llm.bpe import BREAK, DEFAULT_RANKS, SPACE, Encoder, chunks, cut_pieces, join_texts, read_rank_file, worker_encoder

HARD, WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4
LEVEL_NAMES = ("hard", "word", "sentence", "line", "paragraph", "end")
END = 5
# Characters that end a line, that end a sentence, that end one without white space after, and that may close it.
LINE_ENDS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
SENTENCE_ENDS = tuple(map(ord, ".!?…;؟।。！？；"))
FULL_WIDTH_ENDS = tuple(map(ord, "。！？；"))
CLOSERS = tuple(map(ord, "\"')]}»”’」』）】"))


def boundary_levels(cp: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The level of a cut before each piece start: paragraph, line, sentence or word end."""
    n = len(cp)
    space = cls == SPACE
    last_word = np.maximum.accumulate(np.where(~space, np.arange(n), -1))
    nl = np.isin(cp, LINE_ENDS)
    nl[1:] &= ~((cp[1:] == 0x0A) & (cp[:-1] == 0x0D))
    line_ends = np.cumsum(nl)
    next_word = np.full(n + 1, n)
    next_word[:-1] = np.minimum.accumulate(np.where(~space, np.arange(n), n)[::-1])[::-1]
    before = np.maximum(starts - 1, 0)
    word = last_word[before]
    since = line_ends[before] - np.where(word >= 0, line_ends[np.maximum(word, 0)], 0)
    later = line_ends[np.minimum(next_word[starts], n - 1)] - line_ends[before] - nl[np.minimum(next_word[starts], n - 1)]
    # Between CR and LF no cut is better than a word's.
    torn = (cp[before] == 0x0D) & (cp[np.minimum(starts, n - 1)] == 0x0A)
    level = np.full(len(starts), WORD, np.int8)
    w = np.maximum(word, 0)
    closer = np.isin(cp[w], CLOSERS)
    end_char = np.where(closer, cp[np.maximum(w - 1, 0)], cp[w])
    gap = (starts > word + 1) | space[np.minimum(starts, n - 1)]
    level[np.isin(end_char, SENTENCE_ENDS) & (gap | np.isin(end_char, FULL_WIDTH_ENDS))] = SENTENCE
    whole = (later <= 0) & ~torn
    level[(since >= 1) & whole] = LINE
    level[(since >= 2) & whole] = PARAGRAPH
    return level


def successors(offset: np.ndarray, level: np.ndarray, total: int, limit: int, overlap: int) -> np.ndarray:
    """For every token offset of one text the farthest legal end of the piece after it; ``total`` leads to itself.

    ``offset`` (ascending) are the offsets where a cut may fall and ``level`` their levels. Of the ends
    within reach, paragraph, line and sentence ends in the reach's second half come first, in this
    order, each the farthest; then such ends anywhere in reach, then the farthest word end, then the
    farthest token that ends a character.
    """
    at = np.arange(total + 1)
    reach = np.where(at == 0, limit, at - overlap + limit)
    half = at + (reach - at) // 2
    least = np.where(at == 0, 0, at) + overlap
    nxt = np.full(total + 1, -1)
    for want, floor in (
        (PARAGRAPH, half), (LINE, half), (SENTENCE, half), (PARAGRAPH, least), (LINE, least), (SENTENCE, least), (WORD, least), (HARD, at),
    ):
        ends = offset[level >= want]
        if len(ends):
            k = np.searchsorted(ends, reach, "right") - 1
            found = np.where(k >= 0, ends[np.maximum(k, 0)], -1)
            nxt = np.where((nxt < 0) & (found > floor), found, nxt)
    nxt = np.where(nxt < 0, np.minimum(reach, total), nxt)
    return np.where(reach >= total, total, nxt)


def all_cuts(succ: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks every node that is reached from ``first`` over ``succ``: follow, then square the table."""
    mark = np.zeros(len(succ), bool)
    mark[first] = True
    known = first
    while True:
        reached = succ[known]
        reached = np.unique(reached[~mark[reached]])
        if not len(reached):
            return mark
        mark[reached] = True
        known = np.concatenate([known, reached])
        succ = succ[succ]


def split_texts(encoder: Encoder, texts: list[str], limit: int, overlap: int):
    """Pieces of many texts: text number, piece number, first and last token offset, level of its end, character offsets, ids."""
    joined, cp, cls, ends = join_texts(texts)
    starts = cut_pieces(cp, cls)
    ids, size = encoder.encode_joined(joined, cls, starts)
    token_at = np.concatenate(([0], np.cumsum(size)))
    owner = np.searchsorted(ends, starts)
    level = boundary_levels(cp, cls, starts)
    lengths = encoder_lengths(encoder)[ids]
    byte_at = np.concatenate(([0], np.cumsum(lengths)))
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    width[ends] = 0
    char_byte = np.concatenate(([0], np.cumsum(width)))
    # Tokens that begin with a character: the byte before them ends one.
    char_start = np.zeros(byte_at[-1] + 1, bool)
    char_start[char_byte[:-1][width > 0]] = True
    begins_char = char_start[byte_at[:-1]]
    first_token = np.searchsorted(owner, np.arange(len(texts)))
    base, stop = token_at[first_token], token_at[np.searchsorted(starts, ends)]
    big = np.flatnonzero(stop - base > limit)
    if not len(big):
        return None
    tables, shift, at = [], [], 0
    real = cls[starts] != BREAK
    for d in big.tolist():
        lo, hi, t0, total = first_token[d], np.searchsorted(starts, ends[d]), base[d], int(stop[d] - base[d])
        where = token_at[lo:hi][real[lo:hi]] - t0
        begins = begins_char[t0 : t0 + total]
        hard = np.flatnonzero(begins)
        lev = np.zeros(total, np.int8)
        lev[where] = level[lo:hi][real[lo:hi]]
        tables.append(successors(hard, lev[hard], total, limit, overlap) + at)
        shift.append(at)
        at += total + 1
    succ, shift = np.concatenate(tables), np.array(shift)
    cuts = np.flatnonzero(all_cuts(succ, shift))
    text = np.searchsorted(shift, cuts, "right") - 1
    local = cuts - shift[text]
    is_end = local > 0
    text_e, end = text[is_end], local[is_end]
    d = big[text_e]
    new_text = np.diff(text_e, prepend=-1) > 0
    number = np.arange(len(end)) - np.repeat(np.flatnonzero(new_text), np.diff(np.flatnonzero(new_text), append=len(end)))
    begin = np.where(number == 0, 0, np.roll(end, 1) - overlap)
    last = end == (stop - base)[d]
    # Breaks have no tokens: the piece that begins here is the first one at this offset.
    piece_at = np.searchsorted(token_at, base[d] + end)
    exact = token_at[piece_at] == base[d] + end
    cut_level = np.where(last, END, np.where(exact, level[np.minimum(piece_at, len(level) - 1)], HARD))
    doc_char = np.concatenate(([0], ends[:-1] + 1))[d]
    char_begin = np.searchsorted(char_byte, byte_at[base[d] + begin]) - doc_char
    char_end = np.searchsorted(char_byte, byte_at[base[d] + end]) - doc_char
    char_begin = np.where(begin == 0, 0, char_begin)
    return d, number, begin, end, cut_level, char_begin, char_end, ids, base[d]


def encoder_lengths(encoder: Encoder) -> np.ndarray:
    """Bytes of every token of the vocabulary."""
    if not hasattr(encoder, "lengths"):
        encoder.lengths = np.array([len(encoder.strings.get(i, b"")) for i in range(encoder.width)], np.int64)
    return encoder.lengths


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1024,
    overlap: int = 64,
    ranks_path: str = DEFAULT_RANKS,
    contents: bool = True,
) -> DataFrame:
    """Pieces of every text with more than ``max_tokens`` tokens.

    Output: ``id_col``, ``piece_no`` from 0, ``token_start`` and ``token_end`` (offsets into the text's
    tokens, end exclusive), ``cut`` (what the piece ends at: paragraph, line, sentence, word, hard or
    end), and with ``contents`` also ``piece`` (text) and ``ids``. Each piece has at most
    ``max_tokens`` tokens, and each after the first begins with the last ``overlap`` tokens of the one
    before. A piece whose overlap begins inside a character starts with the next whole character in
    ``piece``; ``ids`` are exact.

    Null, empty, blank and other texts within the limit have no rows. A text of at most ``max_tokens``
    UTF-8 bytes can't have more tokens and isn't encoded. Repeated rows are cut each; a null id stays
    null. Other columns are not read.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("overlap must be at least 0 and under half of max_tokens")
    shared = df.sparkSession.sparkContext.broadcast(read_rank_file(ranks_path))
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.octet_length("_text") > max_tokens)
    id_type = source.schema["_id"].dataType.simpleString()
    columns = f"_id {id_type}, piece_no int, token_start int, token_end int, cut string"
    if contents:
        columns += ", piece string, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        names = np.array(LEVEL_NAMES, dtype=object)
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0))
            for a, b in chunks(sizes):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                found = split_texts(encoder, texts, max_tokens, overlap)
                if found is None:
                    continue
                d, number, begin, end, level, c0, c1, ids, base = found
                out = [
                    batch.column(0).slice(a, b - a).take(pa.array(d)),
                    pa.array(number, pa.int32()),
                    pa.array(begin, pa.int32()),
                    pa.array(end, pa.int32()),
                    pa.array(names[level].tolist(), pa.string()),
                ]
                if contents:
                    out.append(pa.array([texts[k][x:y] for k, x, y in zip(d.tolist(), c0.tolist(), c1.tolist())], pa.string()))
                    size = end - begin
                    total = np.cumsum(size)
                    where = np.arange(total[-1]) + np.repeat(base + begin - (total - size), size)
                    offsets = np.concatenate(([0], total)).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[where])))
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in columns.split(", ")])

    return source.mapInArrow(run, columns).withColumnRenamed("_id", id_col)
