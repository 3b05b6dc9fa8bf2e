"""Near-duplicate short texts inside a key by min-max hashing.

Every permutation of the shingle universe gives two signature values, the least and the greatest
image of the text's shingles, so a signature of length L costs L/2 hash evaluations per shingle. Both
kinds agree for two texts with probability equal to their Jaccard similarity. Bands of ``rows``
values are hashed together; texts that share a band become candidates, and candidates are checked
exactly.

Texts of one key meet where the key lies: the texts are shuffled once, and signatures, bands and
checks of a key are made in one task, so that neither signatures nor candidates are shuffled. A key
with more texts than a cell holds is split into cells; every two of its cells meet in a task. Texts of
keys with more than ``MOST_CELLS`` cells, where that would copy a text too often, meet in a table of
band hashes instead.

With the default 64 bands of 5 values a pair is missed with probability 0.006 at similarity 0.6,
4e-4 at 0.65 and 8e-6 at 0.7. Candidates whose signatures agree in a share that is ``MARGIN`` or more
below the threshold aren't checked: at the threshold that is 5.5 standard deviations (2e-8).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.session import broadcast_if_small, cut_lineage

BANDS, ROWS = 64, 5
MARGIN = 0.15
#: Texts, and characters of texts, of one key in one cell, about.
CELL_TEXTS, CELL_CHARS = 8192, 1 << 23
#: Cells of a key whose cells meet two by two.
MOST_CELLS = 64
#: Members of a bucket of a giant key that meet in one join cell; larger buckets are split into cells of pairs.
CELL = 256
#: Texts that are hashed at once: their shingles stay in the processor's cache.
CHUNK_TEXTS = 512
SEED = 20240611


def plain_form(text: Column) -> Column:
    """Lower-case text with everything but Unicode letters and numbers removed."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all ``width``-character shingles of all texts, and where each text's begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = lengths - width + 1
    first = np.cumsum(lengths) - lengths
    begin = np.cumsum(count) - count
    where = np.arange(count.sum()) + np.repeat(first - begin, count)
    h = np.zeros(len(where), np.uint64)
    for k in range(width):
        h = (h ^ cp[where + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32), begin


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(texts: list[str], width: int, values: int) -> np.ndarray:
    """Min-max signatures, one row for each text; column 2p is the least and 2p+1 the greatest under permutation p."""
    x, begin = shingle_hashes(texts, width)
    factor, offset = permutations(values // 2)
    out = np.empty((values, len(texts)), np.uint32)
    for p in range(values // 2):
        h = (x ^ offset[p]) * factor[p]
        np.minimum.reduceat(h, begin, out=out[2 * p])
        np.maximum.reduceat(h, begin, out=out[2 * p + 1])
    return out.T


def band_hashes(sig: np.ndarray, key: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of key, band number and band values for each text and band."""
    h = key.astype(np.uint64)[:, None] ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]
    for r in range(rows):
        h = (h ^ sig[:, r : bands * rows : rows].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _bands(reps: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    values = bands * rows + (bands * rows) % 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_TEXTS):
                part = batch.slice(a, CHUNK_TEXTS)
                sig = signatures(part.column(2).to_pylist(), width, values)
                h = band_hashes(sig, part.column(1).to_numpy(zero_copy_only=False), bands, rows)
                offsets = pa.array(np.arange(0, h.size + 1, bands, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(h).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rep", "h"])

    return reps.select("rep", F.xxhash64("key"), "plain").mapInArrow(run, "rep bigint, h array<bigint>")


def banded_pairs(h: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of texts that share a band hash; where sides differ in a group, only pairs of both sides have to be found.

    ``h`` is (texts, bands). A pair is marked however many bands it shares.
    """
    # Texts of side 2 are columns of their own; where no text has a side, rows and columns are the same texts.
    whole = bool((side == 0).any())
    met = np.zeros((len(h), len(h)) if whole else (int((side == 1).sum()), int((side == 2).sum())), bool)
    place = np.arange(len(h)) if whole else np.where(side == 1, np.cumsum(side == 1), np.cumsum(side == 2)) - 1
    for band in h.T:
        order = np.argsort(band)
        value = band[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        step = 1
        while len(same):
            i, j = order[same], order[same + step]
            if whole:
                met[np.minimum(i, j), np.maximum(i, j)] = True
            else:
                across = side[i] != side[j]
                i, j = i[across], j[across]
                first = side[i] == 1
                met[place[np.where(first, i, j)], place[np.where(first, j, i)]] = True
            step += 1
            same = same[same + step < len(h)]
            same = same[value[same] == value[same + step]]
    i, j = np.divmod(np.flatnonzero(met), max(1, met.shape[1]))
    if not whole:
        i, j = np.flatnonzero(side == 1)[i], np.flatnonzero(side == 2)[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
    keep = (side[i] != side[j]) | (side[i] == 0)
    return i[keep], j[keep]


def agreements(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of signature values that agree, for each pair, by one byte of each value.

    One byte tells almost as much as the whole and is read four times as fast. Eight bytes are added up
    at a time, in lanes that can't overflow.
    """
    values = sig.shape[1]
    byte = np.zeros((len(sig), -(-values // 8) * 8), np.uint8)
    byte[:, :values] = (sig >> np.uint32(12)) & np.uint32(255)
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 4096):
        equal = (byte[i[a : a + 4096]] == byte[j[a : a + 4096]]).view(np.uint64)
        for lane in range(0, equal.shape[1], 255):
            lanes = np.ascontiguousarray(equal[:, lane : lane + 255].sum(axis=1, dtype=np.uint64))
            out[a : a + 4096] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)
    return out - (byte.shape[1] - values)


def similar_texts(texts: list[str], group: np.ndarray, side: np.ndarray, threshold: float, width: int, bands: int, per_band: int):
    """(i, j, similarity), i < j: the pairs of similar different texts of a group that min-max banding finds.

    Side 0 alone means that all pairs of the group are wanted; with sides 1 and 2 only pairs of both.
    """
    values = bands * per_band + (bands * per_band) % 2
    sig = np.concatenate([signatures(texts[a : a + CHUNK_TEXTS], width, values) for a in range(0, len(texts), CHUNK_TEXTS)])
    i, j = banded_pairs(band_hashes(sig, group, bands, per_band), side)
    i, j = i[group[i] == group[j]], j[group[i] == group[j]]
    agree = agreements(sig, i, j)
    fit = agree >= (threshold - MARGIN) * values
    i, j = i[fit], j[fit]
    sets = {t: frozenset([texts[t][a : a + width] for a in range(len(texts[t]) - width + 1)]) for t in np.unique(np.concatenate([i, j])).tolist()}
    similarity = np.array([(n := len(sets[a] & sets[b])) / (len(sets[a]) + len(sets[b]) - n) for a, b in zip(i.tolist(), j.tolist())], np.float64)
    fit = similarity >= threshold
    return i[fit], j[fit], similarity[fit]


def _met(cells: DataFrame, threshold: float, width: int, bands: int, per_band: int) -> DataFrame:
    """(``a``, ``b``, ``similarity``) of the texts that meet in cells; rows with a null similarity say that ``b`` is a copy of ``a``.

    ``cells``: (``g``, ``g2``) numbers of the cell or pair of cells, ``side``, ``id``, ``plain``; a cell's rows follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            """Whole cells, as many at a time as make up a cell's worth of texts."""
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) < CELL_TEXTS and sum(b.nbytes for b in held) < CELL_CHARS:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                g = table["g"].to_numpy()
                edges = np.flatnonzero(np.diff(g)) + 1
                first = 0
                while len(later := edges[edges > first]):
                    # Up to the last edge within a cell's worth, or past the one cell that is larger.
                    within = later[later - first <= CELL_TEXTS]
                    last = int(within[-1]) if len(within) else int(later[0])
                    if not len(later[later > last]) and len(g) - first < CELL_TEXTS:
                        break
                    yield table.slice(first, last - first)
                    first = last
                held = table.slice(first).to_batches()
            if held:
                yield pa.Table.from_batches(held)

        for table in groups():
            g, g2 = table["g"].to_numpy(), table["g2"].to_numpy()
            fresh = np.append(True, (g[1:] != g[:-1]) | (g2[1:] != g2[:-1]))
            group, ids, side = np.cumsum(fresh), table["id"].to_numpy(), table["side"].to_numpy()
            texts = table["plain"].to_pylist()
            rep: dict[tuple[int, str], int] = {}
            of = [rep.setdefault(x, n) for n, x in enumerate(zip(group.tolist(), texts))]
            least = dict.fromkeys(rep.values())
            for n, r in enumerate(of):
                if least[r] is None or ids[n] < least[r]:
                    least[r] = int(ids[n])
            kept = np.fromiter(rep.values(), np.int64, len(rep))
            name = np.fromiter((least[r] for r in kept.tolist()), np.int64, len(kept))
            times = Counter(of)
            copies = {(least[r], int(ids[n])) for n, r in enumerate(of) if times[r] > 1}
            i, j, similarity = similar_texts([texts[r] for r in kept.tolist()], group[kept], side[kept], threshold, width, bands, per_band)
            a, b = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
            a, b, similarity = a[a < b], b[a < b], similarity[a < b]
            left, right = (list(x) for x in zip(*copies)) if copies else ([], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(a, np.array(left, np.int64))), pa.array(np.append(b, np.array(right, np.int64))), pa.concat_arrays([pa.array(similarity, pa.float64()), pa.nulls(len(left), pa.float64())])],
                ["a", "b", "similarity"],
            )

    return cells.mapInArrow(run, "a bigint, b bigint, similarity double")


def _exact(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(t: str) -> frozenset[str]:
            return frozenset([t[i : i + width] for i in range(len(t) - width + 1)])

        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            score, last, s = [], None, frozenset()
            for t, u in zip(left, right):
                if t != last:
                    last, s = t, shingles(t)
                o = shingles(u)
                both = len(s & o)
                score.append(both / (len(s) + len(o) - both))
            score = np.array(score)
            keep = pa.array(score >= threshold)
            out = [batch.column(0), batch.column(1), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "similarity"]).filter(keep)

    return pairs.select("a", "b", "plain_a", "plain_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def text_classes(df: DataFrame, id_col: str, key: Column, text: Column, min_chars: int) -> DataFrame:
    """(``id``, ``key``, ``plain``) of the rows that take part: id, key and text present, key not empty, text long enough."""
    plain = df.select(F.col(id_col).cast("bigint").alias("id"), key.alias("key"), plain_form(text).alias("plain"))
    return plain.where("id is not null and key <> ''").where(F.char_length("plain") >= min_chars)


def key_cells(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(``key``, ``cells``) of the keys that need several cells, a table in the checkpoint folder."""
    sized = df.select(key.alias("key"), F.char_length(text).alias("chars")).where("key <> '' and chars > 0")
    cells = F.greatest(F.ceil(F.count("*") / CELL_TEXTS), F.ceil(F.sum("chars") / CELL_CHARS)).cast("int")
    return cut_lineage(sized.groupBy("key").agg(cells.alias("cells")).where("cells > 1"))


def similar_classes(
    rows: DataFrame, crowded: DataFrame, threshold: float, width: int = 3, bands: int = BANDS, per_band: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """Pairs of different plain texts of one key, and the copies.

    ``rows`` are those of ``text_classes``, ``crowded`` of ``key_cells``. Returns ``(pairs, copies)``:
    ``pairs(a, b, similarity)`` between representatives (the least id of each distinct key and plain text),
    and ``copies(rep, id)`` for every row of a class of several rows, the representative included. Copies
    are one text in their cell, however many there are.
    """
    small = broadcast_if_small(crowded)
    number = (F.xxhash64("key", "lo", "hi").alias("g"), F.hash("key", "lo", "hi").alias("g2"))
    alone = rows.join(small, "key", "left_anti").withColumns({"lo": F.lit(0), "hi": F.lit(0)}).select(*number, F.lit(0).alias("side"), "id", "plain")
    several, giant = [], []
    if not crowded.isEmpty():
        classes = rows.join(small, "key").groupBy("key", "plain", "cells").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        marked = classes.where("n > 1").select(F.xxhash64("key", "plain").alias("h1"), F.hash("key", "plain").alias("h2"), "rep")
        hashed = rows.join(small, "key").select(F.xxhash64("key", "plain").alias("h1"), F.hash("key", "plain").alias("h2"), "id")
        several = [hashed.join(broadcast_if_small(cut_lineage(marked)), ["h1", "h2"]).select("rep", "id")]
        own = F.pmod(F.xxhash64("plain"), F.col("cells")).cast("int")
        each = classes.where(f"cells <= {MOST_CELLS}").select("key", "plain", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
        each = each.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == F.col("lo"), 1).otherwise(2)
        alone = alone.unionByName(each.select(*number, side.alias("side"), F.col("rep").alias("id"), "plain"))
        if not crowded.where(f"cells > {MOST_CELLS}").isEmpty():
            giant = [_giant(cut_lineage(classes.where(f"cells > {MOST_CELLS}").select("key", "plain", "rep")), threshold, width, bands, per_band)]
    met = cut_lineage(_met(alone.repartition("g").sortWithinPartitions("g", "g2"), threshold, width, bands, per_band))
    pairs = reduce(DataFrame.unionByName, [met.where("similarity is not null"), *giant])
    copies = reduce(DataFrame.unionByName, [met.where("similarity is null").select(F.col("a").alias("rep"), F.col("b").alias("id")), *several])
    return pairs, copies


def _giant(reps: DataFrame, threshold: float, width: int, bands: int, per_band: int) -> DataFrame:
    """The pairs of similar texts of giant keys, through a table of band hashes."""
    sig = cut_lineage(_bands(reps, width, bands, per_band))
    members = sig.select("rep", F.explode("h").alias("h"))
    crowded = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    # Both sides of the bucket join read this small table; without it each would join all members again.
    shared = cut_lineage(members.join(crowded, "h").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")))
    all_cells = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = shared.select("h", F.col("rep").alias("a"), F.col("own").alias("s"), all_cells.alias("t"))
    right = shared.select("h", F.col("rep").alias("b"), all_cells.alias("s"), F.col("own").alias("t"))
    candidates = left.join(right, ["h", "s", "t"]).where("a < b").select("a", "b").distinct()
    texts = reps.select("rep", "plain")
    pairs = candidates.join(texts.select(F.col("rep").alias("b"), F.col("plain").alias("plain_b")), "b").join(
        texts.select(F.col("rep").alias("a"), F.col("plain").alias("plain_a")), "a"
    )
    return _exact(pairs, width, threshold)


def similar_pairs(
    df: DataFrame,
    id_col: str,
    key: Column,
    text: Column,
    threshold: float = 0.6,
    width: int = 3,
    min_chars: int = 20,
    bands: int = BANDS,
    per_band: int = ROWS,
) -> DataFrame:
    """(``a``, ``b``, ``similarity``), a < b: all pairs of rows of one key whose plain texts are similar.

    Similarity is the Jaccard coefficient of the sets of ``width``-character substrings of the plain
    forms. Rows with a null id, a null or empty key, a null text or a plain form under ``min_chars``
    characters take no part. Exact copies have similarity 1 and are paired with everything their
    representative is paired with. Rows that repeat an id are one row. Texts are compared whole.
    """
    rows = text_classes(df, id_col, key, text, max(min_chars, width))
    pairs, copies = similar_classes(rows, key_cells(df, key, text), threshold, width, bands, per_band)
    # Broadcast where there are few, so that the copies of one text, however many, needn't lie in one task.
    copies = broadcast_if_small(cut_lineage(copies.distinct()))
    of_a = copies.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    of_b = copies.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    spread = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    spread = spread.select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"), "similarity")
    between = spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    within = of_a.join(of_b, F.col("a") == F.col("b")).where("id_a < id_b")
    return between.unionByName(within.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("similarity")))


def groups(pairs: DataFrame) -> DataFrame:
    """(``id``, ``group_id``): connected components of (``a``, ``b``) pairs, named by their least id.

    Alternates large-star and small-star rounds until nothing changes; each round is a table in the
    checkpoint folder, and only the number of changed links comes to the driver.
    """
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.where("u <> v").distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def near_duplicate_groups(df: DataFrame, id_col: str, key: Column, text: Column, threshold: float = 0.6, width: int = 3, min_chars: int = 20) -> DataFrame:
    """(``id``, ``group_id``, ``links``): every row that takes part with the least id of its group.

    Groups are connected components over similar texts of one key; a row without a similar other row is
    a group of its own. ``links`` counts the different similar texts of the row's text. Copies share
    group and links of their representative and aren't expanded into pairs. Conditions as in
    ``similar_pairs``.
    """
    rows = text_classes(df, id_col, key, text, max(min_chars, width)).dropDuplicates(["id"])
    pairs, copies = similar_classes(rows, key_cells(df, key, text), threshold, width)
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    names = groups(pairs.select("a", "b")).withColumnRenamed("id", "rep")
    owner = rows.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    named = owner.join(names, "rep", "left").join(degree, "rep", "left")
    return named.select("id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
