"""Nearest vectors by shifted Hilbert orderings of projected vectors.

Each ordering projects the unit vectors onto a few random orthonormal directions, shifts them by a
random offset and sorts them along a Hilbert curve. The sorted table is range-partitioned; inside a
partition every block of neighbouring keys is compared with itself and the blocks before and after
it by matrix products, and each vector keeps its best ``k``. The lists of all orderings are merged.
The curve goes down to cells of about the resolution of the directions, so that near-copies, of which
one coarse cell can hold any number, are ordered among themselves as other vectors are.

The windows grow with the table: a block has 3 * sqrt(N) vectors (``BLOCK`` at least) and beyond
``ONE_MORE`` vectors every fourfold adds an ordering, since a window's share of the table shrinks.

Directions have 16-bit components on the way through the shuffles, scaled by the greatest component
(128 bytes instead of 256; a component is off by 1.5e-5 of the greatest at most). Ranks that this
leaves open are decided by the vectors themselves. Copies of one direction are one point,
represented by the least id, so that a value that many rows share can't fill a key range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentlake.operators import ranking
from intentlake.session import broadcast_if_small, cut_lineage

ORDERINGS = 5
#: Bits of a projection in one part of the key, and the parts: the first part is the cell, the others refine it.
PROJECTED, BITS, PARTS = 12, 5, 3
#: Rows of a block at least; a vector meets at least so many neighbours on either side in each ordering.
BLOCK = 2048
#: Vectors beyond which orderings are added, one for every fourfold.
ONE_MORE = 200_000
#: Rows of a range partition that are aimed at, at least.
PARTITION_ROWS = 1 << 15
#: Rows for each range partition whose keys set the partitions' bounds, about.
SAMPLE = 128
#: Rows that are compared with a window at once.
SLICE = 512
SEED = 77
SCALE16, SCALE24 = 32767.0, float((1 << 23) - 1)
#: What a squared distance can be off for a unit of distance: six standard deviations of the rounding of components under 0.5.
OPEN = 4e-5


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve through a grid of 2**bits cells a side.

    ``points`` is (rows, dimensions) of cell numbers and dimensions * bits is at most 63.
    """
    return hilbert_parts(points, bits, 1)[0]


def hilbert_parts(points: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """(parts, rows): positions along the curve through a grid of 2**(bits * parts) cells a side, most significant part first.

    The transform between axes and the transposed curve index published by J. Skilling (Programming the
    Hilbert curve, AIP Conference Proceedings 707, 2004), for all points at once.
    The first part is the position of the coarse cell of 2**bits a side; dimensions * bits is at most 63.
    """
    each, bits = bits, bits * parts
    x = np.ascontiguousarray(points.T.astype(np.uint32))
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            inverted = (x[i] & bit) != 0
            swapped = np.where(inverted, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= swapped ^ np.where(inverted, below, np.uint32(0))
            x[i] ^= swapped if i else np.uint32(0)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[dims - 1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    key = np.zeros((parts, x.shape[1]), np.int64)
    for level in range(bits - 1, -1, -1):
        part = parts - 1 - level // each
        for i in range(dims):
            key[part] = (key[part] << 1) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
    return key


def frames(dim: int, orderings: int, projected: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ordering orthonormal directions and a shift; the same on every worker."""
    r = np.random.default_rng(SEED)
    return [(np.linalg.qr(r.standard_normal((dim, dim)))[0][:, :projected], r.random(projected)) for _ in range(orderings)]


def orderings_for(n: int) -> int:
    return ORDERINGS + max(0, math.ceil(math.log(max(n, 1) / ONE_MORE, 4)))


def block_for(n: int) -> int:
    return max(BLOCK, math.ceil(3 * math.sqrt(n)))


def ordering_keys(unit: np.ndarray, ids: np.ndarray, orderings: int, projected: int) -> list[np.ndarray]:
    """For each ordering the rows' keys along its curve, as bytes that compare like the keys.

    Rows that even the finest cell can't tell apart stand in another order in each ordering, by a hash of their id.
    """
    dim, out = unit.shape[1], []
    for o, (directions, shift) in enumerate(frames(dim, orderings, projected)):
        # A logistic curve spreads the projections of unit vectors evenly over the grid.
        even = 1 / (1 + np.exp(-1.7 * np.sqrt(dim) * (unit @ directions)))
        cell = ((even + shift) * (1 << (BITS * PARTS - 1))).astype(np.int64)
        key = np.empty((len(unit), PARTS + 1), ">u8")
        key[:, :PARTS] = hilbert_parts(np.minimum(cell, (1 << BITS * PARTS) - 1), BITS, PARTS).T
        mixed = (ids.astype(np.uint64) + np.uint64(o + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key[:, PARTS] = mixed * np.uint64(0xBF58476D1CE4E5B9)
        out.append(key.view(f"S{8 * (PARTS + 1)}").reshape(-1))
    return out


def pack(unit: np.ndarray) -> np.ndarray:
    """Components as 16-bit numbers, the greatest of each vector at full scale: (rows, 2 * dimensions) bytes."""
    return np.rint(unit * (SCALE16 / np.abs(unit).max(axis=1))[:, None]).astype("<i2").view(np.uint8)


def unpack(code: pa.Array, dim: int) -> np.ndarray:
    """The float64 unit vectors of packed ones."""
    raw = np.frombuffer(code.buffers()[2], np.uint8)[code.offset * 2 * dim : (code.offset + len(code)) * 2 * dim]
    v = raw.view("<i2").reshape(len(code), dim).astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def fingerprints(unit: np.ndarray) -> np.ndarray:
    """Two 64-bit multilinear hashes of each direction with 24-bit components: (2, rows)."""
    fixed = np.rint(unit * SCALE24).astype(np.int64).astype(np.uint64)
    r = np.random.default_rng(SEED + 1)
    factors = r.integers(0, 1 << 63, (2, unit.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.stack([(fixed * f).sum(axis=1, dtype=np.uint64) for f in factors])
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


def usable(vector: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of vectors with exactly ``dim`` components, all finite and not all 0, and their unit vectors."""
    size = np.asarray(vector.value_lengths().fill_null(-1))
    row = np.flatnonzero(size == dim)
    if not len(row):
        return row, np.zeros((0, dim))
    v = vector.take(pa.array(row)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    v = v[ok]
    v = v / np.abs(v).max(axis=1)[:, None]
    return row[ok], v / np.sqrt((v * v).sum(axis=1))[:, None]


def best_in_window(own: np.ndarray, window: np.ndarray, own_at: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``window`` and halves of the squared distances of the k nearest to each row; own rows begin at ``own_at`` there.

    Half of a squared distance of unit vectors is 1 minus their cosine. What is nearest is looked for in
    single precision around the own rows' mean, as near-copies differ by less than their common part
    leaves digits for; the distances of what was found are computed in double precision.
    """
    mean = own.mean(axis=0)
    near = (window - mean).astype(np.float32)
    half = (near * near).sum(axis=1) / 2
    take = min(k + 2, len(window) - 1)
    places, gaps = np.empty((len(own), min(k, take)), np.int64), np.empty((len(own), min(k, take)))
    for a in range(0, len(own), SLICE):
        rows = np.arange(min(SLICE, len(own) - a))
        score = near[own_at + a : own_at + a + len(rows)] @ near.T
        score -= half
        score[rows, own_at + a + rows] = -np.inf
        who = np.empty((len(rows), take), np.int64)
        for j in range(take):
            who[:, j] = score.argmax(axis=1)
            score[rows, who[:, j]] = -np.inf
        gap = own[a : a + len(rows), None, :] - window[who]
        gap = np.einsum("ijk,ijk->ij", gap, gap) / 2
        order = np.argsort(gap, axis=1, kind="stable")[:, : places.shape[1]]
        places[a : a + len(rows)], gaps[a : a + len(rows)] = np.take_along_axis(who, order, 1), np.take_along_axis(gap, order, 1)
    return places, gaps


def _candidates(keyed: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """Per key-sorted partition the best k of every vector among the neighbouring blocks. A partition holds one ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            held, count = [], 0
            for batch in batches:
                ids, unit = batch.column(0).to_numpy(), unpack(batch.column(1), dim)
                a = 0
                while a < len(ids):
                    c = min(len(ids), a + block - count)
                    held.append((ids[a:c], unit[a:c]))
                    count += c - a
                    a = c
                    if count == block:
                        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                        held, count = [], 0
            if held:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

        def compare(window):
            own = window[1]
            near = [x for x in window if x is not None]
            ids, unit = np.concatenate([x[0] for x in near]), np.concatenate([x[1] for x in near])
            if len(ids) < 2:
                return
            at, gap = best_in_window(own[1], unit, len(window[0][0]) if window[0] is not None else 0, k)
            offsets = pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))) for x in (ids[at], gap.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), *lists], ["id", "near", "gap"])

        window: list = [None, None, None]
        for b in blocks():
            window = [window[1], window[2], b]
            if window[1] is not None:
                yield from compare(window)
        window = [window[1], window[2], None]
        if window[1] is not None:
            yield from compare(window)

    return keyed.mapInArrow(run, "id bigint, near array<bigint>, gap array<float>")


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The best k + 1 of each id over its lists of all orderings: ``near``, ``gap``, and whether the codes leave a rank among them open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            near, gaps = batch.column(1), batch.column(2)
            inner = near.flatten()
            owner = np.repeat(np.repeat(np.arange(len(ids)), np.asarray(near.value_lengths())), np.asarray(inner.value_lengths()))
            other, gap = inner.flatten().to_numpy(), gaps.flatten().flatten().to_numpy()
            order = np.lexsort((gap, other, owner))
            owner, other, gap = owner[order], other[order], gap[order]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
            owner, other, gap = owner[fresh], other[fresh], gap[fresh]
            order = np.lexsort((other, gap, owner))
            owner, other, gap = owner[order], other[order], gap[order]
            place = np.arange(len(owner)) - np.repeat(np.flatnonzero(np.diff(owner, prepend=-1)), np.bincount(owner, minlength=1)[np.unique(owner)])
            keep = place < k + 1
            owner, other, gap = owner[keep], other[keep], gap[keep].astype(np.float64)
            close = np.zeros(len(owner), bool)
            close[1:] = (owner[1:] == owner[:-1]) & (gap[1:] - gap[:-1] < OPEN * np.sqrt(2 * gap[1:]) + 1e-12)
            size = np.bincount(owner, minlength=len(ids))
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(gap)), pa.array(np.bincount(owner[close], minlength=len(ids)) > 0)],
                ["id", "near", "gap", "open"],
            )

    gathered = lists.groupBy("id").agg(F.collect_list("near").alias("near"), F.collect_list("gap").alias("gap"))
    return gathered.mapInArrow(run, "id bigint, near array<bigint>, gap array<double>, open boolean")


def _settled(merged: DataFrame, vectors: DataFrame) -> DataFrame:
    """(``id``, ``other``, ``cosine``): candidates with their cosines, those of open ranks from the vectors themselves.

    ``merged`` is a table in the checkpoint folder. Only vectors that take part in an open rank are joined.
    """
    pair = F.explode(F.arrays_zip("near", "gap")).alias("x")
    known = merged.where("not open").select("id", pair).select("id", F.col("x.near").alias("other"), (1 - F.col("x.gap")).alias("cosine"))
    asked = merged.where("open").select("id", F.explode("near").alias("other"))
    wanted = broadcast_if_small(cut_lineage(asked.select("id").union(asked.select("other")).distinct()))
    vectors = vectors.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("v").alias("v"))
    sides = asked.join(vectors.withColumnRenamed("v", "a"), "id").join(vectors.select(F.col("id").alias("other"), F.col("v").alias("b")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Usable vectors only, which all have the same length.
            a, b = (batch.column(i).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (2, 3))
            a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
            cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["id", "other", "cosine"])

    return known.unionByName(sides.select("id", "other", "a", "b").mapInArrow(run, "id bigint, other bigint, cosine double"))


def _key_bounds(source: DataFrame, dim: int, total: int, orderings: int, projected: int, parts: int) -> list[np.ndarray]:
    """The keys that part each ordering's range, from the keys of a bounded sample of rows."""
    if parts == 1:
        return [np.zeros(0, f"S{8 * (PARTS + 1)}")] * orderings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, unit = usable(batch.column(1), dim)
            if len(row):
                for o, key in enumerate(ordering_keys(unit, batch.column(0).to_numpy()[row], orderings, projected)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), o)), pa.array(key.view(f"V{key.itemsize}").tolist(), pa.binary())], ["o", "key"])

    some = source.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total // (SAMPLE * parts)))) == 0)
    rows = some.mapInArrow(run, "o bigint, key binary").collect()
    bounds = []
    for o in range(orderings):
        keys = np.sort(np.array([bytes(r.key) for r in rows if r.o == o], f"S{8 * (PARTS + 1)}"))
        bounds.append(keys[(np.arange(1, parts) * len(keys)) // parts] if len(keys) else keys)
    return bounds


def nearest(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    dim: int = 64,
    orderings: int | None = None,
    partition_rows: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """(``id``, ``rank`` 1..k, ``other``, ``cosine``): the k most similar other vectors of every usable vector.

    A vector is usable if it has exactly ``dim`` components, all finite and not all 0; other rows and
    rows with a null id have no neighbours and are none. Equal cosines: the smaller id first. Copies of
    one direction are neighbours of each other at cosine 1. Rows that repeat an id are one row. With k
    or fewer usable rows each row has all others. Approximate: a neighbour can be missed if no ordering
    brings it near (see the README for measured recall); what is listed is ranked by its true cosine, and
    ``cosine`` is exact where ranks are close and else to about 1e-5.

    ``exact`` compares every vector with every other in blocks instead, whose cost grows with the square
    of the table. ``orderings`` is ``orderings_for`` the number of vectors unless given.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null")
    if exact:
        whole = source.dropDuplicates(["id"])
        found = ranking.dense_search(whole, "id", "v", whole, dim, k)
        return found.select(F.col("query_id").alias("id"), "rank", F.col("id").alias("other"), F.col("score").alias("cosine"))
    projected = min(PROJECTED, dim)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, unit = usable(batch.column(1), dim)
            code = pack(unit) if len(row) else np.zeros((0, 2 * dim), np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(row), [None, pa.py_buffer(code.tobytes())])
            h = fingerprints(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), packed.cast(pa.binary()), pa.array(h[0]), pa.array(h[1])], ["id", "code", "h1", "h2"])

    points = source.mapInArrow(codes, "id bigint, code binary, h1 bigint, h2 bigint")
    # Copies: only a hash and the least ids of each direction are gathered, never a direction's rows.
    hashed = cut_lineage(points.select("id", "h1", "h2"))
    total = hashed.count()
    copies = cut_lineage(_least_ids(hashed, k + 1))
    followers = _followers(hashed, copies)
    orderings = orderings or orderings_for(total)
    block = block_for(total)
    parts = max(1, -(-total // (partition_rows or max(PARTITION_ROWS, 8 * block))))
    bounds = _key_bounds(source, dim, total, orderings, projected, parts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, code = batch.column(0), batch.column(1)
            for o, key in enumerate(ordering_keys(unpack(code, dim), ids.to_numpy(), orderings, projected)):
                part = o * parts + np.searchsorted(bounds[o], key, side="right")
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.itemsize), len(key), [None, pa.py_buffer(key.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), packed.cast(pa.binary()), ids, code], ["part", "key", "id", "code"])

    single = points.select("id", "code").join(broadcast_if_small(followers.select("id")), "id", "left_anti")
    keyed = single.mapInArrow(keys, "part int, key binary, id bigint, code binary")
    keyed = keyed.repartitionById(orderings * parts, "part").sortWithinPartitions("key", "id").select("id", "code")
    merged = cut_lineage(_merge(_candidates(keyed, dim, k + 1, block), k))
    return _with_copies(_settled(merged, source), copies, followers, k)


def _least_ids(hashed: DataFrame, m: int) -> DataFrame:
    """(``h1``, ``h2``, ``ids``, ``n``) of the directions that several rows have: the m least ids and the number of different ids.

    The rows of such directions are ranked by a bounded window over ids alone.
    """
    counted = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n"))
    many = broadcast_if_small(cut_lineage(counted.where("rep <> last").select("h1", "h2", "n")))
    rows = hashed.join(many, ["h1", "h2"]).distinct()
    place = Window.partitionBy("h1", "h2").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(place)).where(F.col("r") <= m)
    return least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("n").alias("n"))


def _followers(hashed: DataFrame, copies: DataFrame) -> DataFrame:
    """(``id``, ``rep``): every row of a direction of several rows but its representative."""
    named = broadcast_if_small(copies.select("h1", "h2", F.col("ids")[0].alias("rep")))
    return cut_lineage(hashed.join(named, ["h1", "h2"]).where("id <> rep").select("id", "rep").distinct())


def _with_copies(found: DataFrame, copies: DataFrame, followers: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows from the neighbours of representatives: copies first, then copies of neighbours.

    Tables of the directions that several rows have are broadcast where they are small, so that the rows of
    one direction, however many, needn't lie in one task.
    """
    several = copies.select(F.col("ids")[0].alias("rep"), "ids")
    of_other = broadcast_if_small(several.select(F.col("rep").alias("other"), F.col("ids").alias("others")))
    spread = found.join(of_other, "other", "left").withColumn("others", F.coalesce("others", F.array("other")))
    to_class = spread.select(F.col("id").alias("rep"), "cosine", F.explode("others").alias("other"))
    rows = to_class.select(F.col("rep").alias("id"), "other", "cosine")
    of_several = cut_lineage(to_class.join(broadcast_if_small(several.select("rep")), "rep", "left_semi"))
    rows = rows.unionByName(followers.join(broadcast_if_small(of_several), "rep").select("id", "other", "cosine"))
    members = several.select("rep", F.col("rep").alias("id")).unionByName(followers.select("rep", "id"))
    twins = members.join(broadcast_if_small(several), "rep").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine")).where("id <> other")
    everything = rows.unionByName(twins)
    place = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    ranked = everything.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "other", "cosine")
