"""The N best items of every group by a mergeable aggregation of bounded heaps.

Each task keeps, for every group it meets, a bounded heap of the group's N best items; only the heaps
are shuffled, so a group with a third of all rows sends N rows per task. After the shuffle the heaps
of a group are merged into one, from which the ranks are read. Merging is associative: a task whose
heaps hold more than ``HELD_ROWS`` rows hands them on and begins anew, so its memory is bounded however
many groups it meets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task takes in at once, and rows that its heaps hold at most before they are handed on.
REFILL_ROWS, HELD_ROWS = 1 << 16, 1 << 18


class _Later:
    """A value whose order is turned round, for values that have no negative."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value

    def __hash__(self):
        return hash(self.value)


def _merit(column: pa.ChunkedArray, direction: str) -> list:
    """For each row something that is greater the better the row stands: ascending columns turned round, nulls the least."""
    values = column.to_pylist()
    if pa.types.is_integer(column.type):
        return [float("-inf") if v is None else v if direction == "descending" else -v for v in values]
    if pa.types.is_floating(column.type):
        # Ascending, NaN comes after all numbers, descending before them.
        if direction == "descending":
            return [(0,) if v is None else (2,) if v != v else (1, v) for v in values]
        return [(0,) if v is None else (1,) if v != v else (2, -v) for v in values]
    return [(0,) if v is None else (1, v if direction == "descending" else _Later(v)) for v in values]


def _group_keys(rows: pa.Table, groups: Sequence[str]) -> list[tuple]:
    """The groups' values, NaN as a text, since it isn't equal to itself."""
    columns = [rows[g].to_pylist() for g in groups]
    columns = [["nan" if v != v else v for v in c] if pa.types.is_floating(rows.schema.field(g).type) else c for g, c in zip(groups, columns)]
    return list(zip(*columns)) if columns else [()] * rows.num_rows


def bounded_heaps(rows: pa.Table, groups: Sequence[str], order: Sequence[tuple[str, str]], payload: Sequence[str], n: int) -> dict[tuple, dict]:
    """For each group its heap's items: merit to row number. Of equal items (all of ``order`` equal) the one with the least payload stays."""
    heaps: dict[tuple, tuple[list, dict]] = {}

    def standing(at: int) -> tuple:
        return tuple((v is None, v) for v in (rows[p][at].as_py() for p in payload))

    for at, (key, *merit) in enumerate(zip(_group_keys(rows, groups), *[_merit(rows[c], d) for c, d in order])):
        merit = tuple(merit)
        if (found := heaps.get(key)) is None:
            heaps[key] = ([merit], {merit: at})
            continue
        heap, items = found
        if merit in items:
            if payload and standing(at) < standing(items[merit]):
                items[merit] = at
        elif len(heap) < n:
            heappush(heap, merit)
            items[merit] = at
        elif heap[0] < merit:
            del items[heapreplace(heap, merit)]
            items[merit] = at
    return {key: items for key, (_, items) in heaps.items()}


def keep_best(rows: pa.Table, groups: Sequence[str], order: Sequence[tuple[str, str]], payload: Sequence[str], n: int) -> pa.Table:
    """The rows of each group's bounded heap, in no order."""
    kept = [at for items in bounded_heaps(rows, groups, order, payload, n).values() for at in items.values()]
    return rows.take(pa.array(kept, pa.int64()))


def _heaps(rows: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, str]], payload: Sequence[str], n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, fresh, waiting = None, [], 0

        def refilled():
            table = pa.Table.from_batches(fresh)
            return keep_best(pa.concat_tables([heaps, table]) if heaps else table, groups, order, payload, n).combine_chunks()

        for batch in batches:
            fresh.append(batch)
            waiting += batch.num_rows
            # Refilling goes over the heaps too: wait until the fresh rows are as many.
            if waiting >= max(REFILL_ROWS, heaps.num_rows if heaps else 0):
                heaps, fresh, waiting = refilled(), [], 0
                if heaps.num_rows > HELD_ROWS:
                    yield from heaps.to_batches(1 << 16)
                    heaps = None
        if fresh:
            heaps = refilled()
        if heaps is not None:
            yield from heaps.to_batches(1 << 16)

    return rows.mapInArrow(run, rows.schema)


def top_n(
    df: DataFrame,
    groups: dict[str, Column],
    score: Column,
    tie: dict[str, Column],
    n: int,
    payload: Sequence[str] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """The ``n`` best items of every group: group columns, ``rank_col`` 1..n, ``score``, tie columns, ``payload``.

    Items are compared by ``score`` descending, then by the ``tie`` columns ascending (nulls last); the
    last of them must be the item's unique identifier. Rows that agree in score and all tie columns are
    one item, so repeated deliveries count once, with the payload of one of them (the least, by its own
    columns, nulls last). Group and tie columns may have any type that can be compared; groups are atomic values. Rows with a null or NaN score or a null identifier have no place and are left out; a null
    in a group column is a group of its own. Other columns are not read.
    """
    names = list(tie)
    rows = df.select(
        *[c.alias(g) for g, c in groups.items()], score.cast("double").alias("score"), *[c.alias(t) for t, c in tie.items()], *payload
    ).where(F.col("score").isNotNull() & ~F.isnan("score") & F.col(names[-1]).isNotNull())
    # -0.0 and 0.0 are one score.
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))
    order = [("score", "descending"), *[(t, "ascending") for t in names]]
    return merge_heaps(_heaps(rows, list(groups), order, list(payload), n), list(groups), order, n, payload, rank_col)


def merge_heaps(
    heaps: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, str]], n: int, payload: Sequence[str], rank_col: str
) -> DataFrame:
    """Merge partial heaps of the same groups; associative, so heaps of several inputs may be united first.

    A group's heaps lie together, sorted by group, so that one group's heap at a time has to be held.
    """
    placed = heaps.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at, rank = [], []
            for items in bounded_heaps(table, groups, order, payload, n).values():
                at += [items[m] for m in sorted(items, reverse=True)]
                rank += range(1, len(items) + 1)
            out = table.take(pa.array(at, pa.int64())).append_column("rank", pa.array(rank, pa.int32()))
            yield from out.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting < REFILL_ROWS:
                continue
            table = pa.Table.from_batches(held)
            keys = _group_keys(table, groups)
            last = len(keys) - 1
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            if last:
                yield from ranked(table.slice(0, last))
            # The group that may go on, cut back to its heap.
            held = keep_best(table.slice(last), groups, order, payload, n).to_batches()
            waiting = sum(b.num_rows for b in held)
        if held:
            yield from ranked(pa.Table.from_batches(held))

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(heaps.schema.fields)) + ", r int"
    out = placed.mapInArrow(lambda batches: (b.rename_columns([*[f"c{i}" for i in range(b.num_columns - 1)], "r"]) for b in run(batches)), schema)
    named = dict(zip(heaps.columns, out.columns))
    ends = [c for c, _ in order]
    return out.select(*[F.col(named[g]).alias(g) for g in groups], F.col("r").alias(rank_col), *[F.col(named[c]).alias(c) for c in (*ends, *payload)])
