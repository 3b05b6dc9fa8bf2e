"""Ranking: bounded ranks, tool scores, back-fill and merging of ranked lists.

Every ranking has a total order: score descending, then the ordinals that are given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentlake.functions.vectors import unit_vectors


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of every group with their rank from 1. Spark limits every group before the shuffle."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(place)).where(F.col(rank_col) <= k)


def by_score(*ordinals: str) -> list[Column]:
    return [F.col("score").desc_nulls_last(), *[F.col(o).asc_nulls_last() for o in ordinals]]


def tool_scores(hits: DataFrame, group: Sequence[str], tool: str, ordinal: str, support: Sequence[str] = ()) -> DataFrame:
    """(group, tool, ``tool_score``, ``n_hits``, ``first_hit``): the mean of a tool's best three hits plus 0.05 for each hit up to five.

    ``first_hit`` is the least ordinal among the tool's hits of the best score, for breaking ties. With
    ``support`` columns there is also ``support``, an array of structs of these columns of the three best
    hits in their order. Rank and count come from one placement of the hits, and three hits of each tool
    are kept, so large groups need no collected list. Scores are added as decimals of twelve places, so
    the sum doesn't depend on their order. Null and non-finite scores and null tools must be left out before.
    """
    place = Window.partitionBy(*group, tool)
    ranked = hits.withColumns({"_r": F.row_number().over(place.orderBy(*by_score(ordinal))), "_n": F.count("*").over(place)}).where("_r <= 3")
    listed = F.array_sort(F.collect_list(F.struct(F.col("_r"), F.struct(*support).alias("s")))) if support else None
    best = ranked.groupBy(*group, tool).agg(
        F.sum(F.col("score").cast("decimal(30,12)")).cast("double").alias("_sum"), F.count("*").alias("_n3"), F.max("_n").alias("n_hits"),
        F.min(F.when(F.col("_r") == 1, F.col(ordinal))).alias("first_hit"), *([F.transform(listed, lambda x: x["s"]).alias("support")] if support else []),
    )
    score = F.col("_sum") / F.col("_n3") + 0.05 * F.least("n_hits", F.lit(5))
    return best.select(*group, tool, score.alias("tool_score"), "n_hits", "first_hit", *(["support"] if support else []))


def back_fill(ranked: Column, pool: Column, k: int) -> Column:
    """The ranked names, then the pool's in pool order, without repetitions, up to the lesser of k and the pool's size."""
    return F.slice(F.array_union(ranked, pool), F.lit(1), F.least(F.lit(k), F.size(F.array_distinct(pool))))


def merge_ranked(rows: DataFrame, sample: Sequence[str], tool: str, list_col: str, rank_col: str, k: int) -> DataFrame:
    """(sample, tool, ``rank``): lists interleaved rank by rank, in list order within a rank, each tool once, k at most."""
    first = Window.partitionBy(*sample, tool).orderBy(rank_col, list_col)
    once = rows.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    return top_k(once, sample, [F.col(rank_col), F.col(list_col)], k, "_rank").select(*sample, tool, F.col("_rank").alias("rank"))


def merge_and_fill(rows: DataFrame, sample: Sequence[str], tool: str, list_col: str, rank_col: str, samples: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(sample, tool, ``rank``): ``merge_ranked``, topped up with the pool's tools in pool order up to the lesser of k and the pool's size.

    ``samples`` has the sample columns, ``pool`` the tool and its place ``pos``, the same for all samples.
    Ranked tools that aren't in the pool stay. A sample misses k tools at most, and of the pool's first k
    places as many are taken as it has none of already, so only these are looked at.
    """
    merged = merge_ranked(rows, sample, tool, list_col, rank_col, k)
    size = pool.count()
    first = pool.orderBy("pos").limit(2 * k).select(F.col(tool), "pos")
    fill = samples.select(*sample).distinct().join(F.broadcast(first)).join(merged.select(*sample, tool), [*sample, tool], "left_anti")
    both = merged.select(*sample, tool, F.col("rank").alias("_a"), F.lit(None).cast("bigint").alias("_b")).unionByName(
        fill.select(*sample, tool, F.lit(None).cast("int").alias("_a"), F.col("pos").cast("bigint").alias("_b"))
    )
    filled = top_k(both, sample, [F.col("_a").asc_nulls_last(), F.col("_b")], k)
    return filled.where((F.col("rank") <= size) | F.col("_a").isNotNull()).select(*sample, tool, "rank")


def ranked_lists(rows: DataFrame, group: Sequence[str], value: str, rank_col: str = "rank", out: str = "ranked") -> DataFrame:
    """(group, ``ranked``): the values of each group as an array in rank order. For ranks that are bounded already."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(value).alias("v"))))
    return rows.groupBy(*group).agg(F.transform(pairs, lambda x: x["v"]).alias(out))


#: Query vectors that are compared at once, and blocks of them that one scan of the rows works off.
QUERY_BLOCK, SCAN_BLOCKS = 4096, 16


def dense_search(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, dim: int, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(``query_id``, ``rank``, ``id``, ``score``): the k greatest cosines of every query vector over all rows, itself left out.

    ``queries`` has the same two columns. It is worked off in blocks of ``block`` vectors and each scan of
    the rows takes ``SCAN_BLOCKS`` of them, so what is sent to the workers is bounded; each task keeps k
    rows for each query. Vectors with another number of components, null or non-finite components or only
    zeros take no part. Equal cosines: the smaller id first.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    wanted = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    found = None
    for shared in _query_blocks(wanted, dim, block):
        part = rows.mapInArrow(_block_search(shared, dim, k), "query_id bigint, id bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
    return top_k(found, ["query_id"], by_score("id"), k).select("query_id", "rank", "id", "score")


def _query_blocks(wanted: DataFrame, dim: int, block: int):
    """Lists of broadcasts of (ids, unit vectors), as many as one scan works off."""
    context = wanted.sparkSession.sparkContext
    ids, vectors, ready = [], [], []

    def sent():
        at, unit = unit_vectors(pa.array(vectors, pa.list_(pa.float64())), dim)
        return [context.broadcast((np.array(ids)[at], unit))] if len(at) else []

    for r in wanted.orderBy("id").toLocalIterator():
        ids.append(r.id)
        vectors.append(r.v)
        if len(ids) == block:
            ready += sent()
            ids, vectors = [], []
            if len(ready) == SCAN_BLOCKS:
                yield ready
                ready = []
    ready += sent() if ids else []
    if ready:
        yield ready


def _best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row with their ids, equal scores by the smaller id. Only what reaches the k-th greatest is sorted."""
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, at = np.nonzero(score >= least[:, None])
    order = np.lexsort((ids[row, at], -score[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = (first[:, None] + np.arange(k)).reshape(-1)
    return score[row[keep], at[keep]].reshape(-1, k), ids[row[keep], at[keep]].reshape(-1, k)


def _block_search(shared, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in shared]
        best = [(np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)) for ids, _ in blocks]
        for batch in batches:
            for start in range(0, batch.num_rows, UNIT_BLOCK):
                piece = batch.slice(start, UNIT_BLOCK)
                at, unit = unit_vectors(piece.column(1), dim)
                if not len(at):
                    continue
                ids = piece.column(0).to_numpy()[at]
                for n, (query_ids, query) in enumerate(blocks):
                    score = query @ unit.T
                    score[query_ids[:, None] == ids[None, :]] = -np.inf
                    every = np.concatenate([best[n][1], np.broadcast_to(ids, score.shape)], axis=1)
                    best[n] = _best_of(np.concatenate([best[n][0], score], axis=1), every, k)
        for (query_ids, _), (score, ids) in zip(blocks, best):
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, real.sum(axis=1))), pa.array(ids[real]), pa.array(score[real])], ["query_id", "id", "score"]
            )

    return run


#: Units that are compared with a query block at once.
UNIT_BLOCK = 1024


def dense_tool_search(
    df: DataFrame, id_col: str, tool_col: str, vector_col: str, queries: DataFrame, dim: int, k: int, block: int = QUERY_BLOCK
) -> DataFrame:
    """(``query_id``, ``rank``, tool, ``score``): the k best tools of every query vector over all their units, the query itself left out.

    A tool's score is the mean of its three greatest cosines plus 0.05 for each of its units up to five.
    The units of a tool lie together, so that each task keeps k tools for each query of a block and
    the best three of the tool at hand. Equal scores: the smaller tool name first. Usable vectors are
    those of ``dense_search``; rows without a tool take no part.
    """
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    rows = df.select(*columns, F.col(tool_col).alias("tool")).where("id is not null and v is not null and tool is not null")
    rows = rows.repartition("tool").sortWithinPartitions("tool")
    found = None
    for blocks in _query_blocks(queries.select(*columns).where("id is not null and v is not null"), dim, block):
        for shared in blocks:
            part = rows.mapInArrow(_tool_search(shared, dim, k), "query_id bigint, tool string, score double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id bigint, tool string, score double")
    return top_k(found, ["query_id"], by_score("tool"), k).select("query_id", "rank", F.col("tool").alias(tool_col), "score")


def _tool_search(shared, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query = shared.value
        n = len(query_ids)
        best, names = np.full((n, k), -np.inf), np.full((n, k), "", object)
        done: list[tuple[str, np.ndarray]] = []
        tool, top, units = None, None, None

        def merge():
            nonlocal best, names
            # Tools come in the order of their names and the sort is stable, so equal scores keep it.
            score = np.concatenate([best, *[x[1][:, None] for x in done]], axis=1)
            every = np.concatenate([names, np.broadcast_to(np.array([x[0] for x in done], object), (n, len(done)))], axis=1)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best, names = np.take_along_axis(score, order, 1), np.take_along_axis(every, order, 1)
            done.clear()

        def finish():
            size = np.minimum(units, 3)
            total = np.where(np.isfinite(top), top, 0).sum(axis=1)
            done.append((tool, np.where(units > 0, np.round(total / np.maximum(size, 1) + 0.05 * np.minimum(units, 5), 9), -np.inf)))
            if len(done) == 64:
                merge()

        for batch in batches:
            for start in range(0, batch.num_rows, UNIT_BLOCK):
                piece = batch.slice(start, UNIT_BLOCK)
                at, unit = unit_vectors(piece.column(1), dim)
                if not len(at):
                    continue
                ids, tools = piece.column(0).to_numpy()[at], np.array(piece.column(2).to_pylist(), object)[at]
                score = np.round(query @ unit.T, 9)
                own = query_ids[:, None] == ids[None, :]
                score[own] = -np.inf
                edges = np.flatnonzero(tools[1:] != tools[:-1]) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(tools)]):
                    if tools[a] != tool:
                        if tool is not None:
                            finish()
                        tool, top, units = tools[a], np.full((n, 3), -np.inf), np.zeros(n, np.int64)
                    both = np.concatenate([top, score[:, a:b]], axis=1)
                    top = np.partition(both, both.shape[1] - 3, axis=1)[:, -3:]
                    units = units + (b - a) - own[:, a:b].sum(axis=1)
        if tool is not None:
            finish()
        if done:
            merge()
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, real.sum(axis=1))), pa.array(names[real].tolist(), pa.string()), pa.array(best[real])], ["query_id", "tool", "score"]
        )

    return run
