"""Ranking metrics as expressions over a ranked array, a gold array and a cut-off.

Ranked and gold arrays of names; a null array counts as empty. Without gold, recall is 0 and coverage 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, k)


def relevances(ranked: Column, gold: Column) -> Column:
    """1 for each ranked name that is gold, else 0."""
    return F.transform(ranked, lambda r: F.when(F.array_contains(gold, r), 1.0).otherwise(0.0))


def graded(ranked: Column, grades: Column) -> Column:
    """The grade of each ranked name from a map, 0 for others."""
    return F.transform(ranked, lambda r: F.coalesce(F.try_element_at(grades, r).cast("double"), F.lit(0.0)))


def dcg_at(relevance: Column, k: int) -> Column:
    """Sum of relevance / log2(place + 1), places from 1."""
    gains = F.transform(_first(relevance, k), lambda x, i: x / F.log2(i.cast("double") + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def ndcg_at(relevance: Column, ideal: Column, k: int) -> Column:
    """DCG over the DCG of the ideal relevances in descending order; 0 if that is 0."""
    best = dcg_at(F.sort_array(ideal, asc=False), k)
    return F.when(best > 0, dcg_at(relevance, k) / best).otherwise(0.0)


def mrr_at(ranked: Column, gold: Column, k: int) -> Column:
    """1 / the first relevant place, else 0."""
    places = F.transform(_first(ranked, k), lambda r, i: F.when(F.array_contains(gold, r), 1.0 / (i + 1)).otherwise(0.0))
    return F.coalesce(F.array_max(places), F.lit(0.0))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(_first(ranked, k), gold), 1.0).otherwise(0.0)


def precision_at(ranked: Column, gold: Column, k: int) -> Column:
    """Relevant places among the first k, divided by k also for shorter lists."""
    return F.size(F.filter(_first(ranked, k), lambda r: F.array_contains(gold, r))) / F.lit(float(k))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.size(F.array_intersect(_first(ranked, k), gold)) / n).otherwise(0.0)


def full_coverage_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(F.array_except(gold, _first(ranked, k))) == 0, 1.0).otherwise(0.0)


def all_metrics(ranked: Column, gold: Column, grades: Column | None = None) -> dict[str, Column]:
    """The twelve reported metrics; graded relevance where the map of grades isn't null or empty."""
    rel, ideal = relevances(ranked, gold), F.transform(F.array_distinct(gold), lambda _: F.lit(1.0))
    if grades is not None:
        use = F.coalesce(F.size(grades) > 0, F.lit(False))
        rel = F.when(use, graded(ranked, grades)).otherwise(rel)
        ideal = F.when(use, F.map_values(grades).cast("array<double>")).otherwise(ideal)
    return {
        "ndcg_1": ndcg_at(rel, ideal, 1),
        "ndcg_3": ndcg_at(rel, ideal, 3),
        "ndcg_10": ndcg_at(rel, ideal, 10),
        "hit_1": hit_at(ranked, gold, 1),
        "precision_3": precision_at(ranked, gold, 3),
        "mrr_10": mrr_at(ranked, gold, 10),
        "recall_10": recall_at(ranked, gold, 10),
        "recall_20": recall_at(ranked, gold, 20),
        "recall_50": recall_at(ranked, gold, 50),
        "full_coverage_3": full_coverage_at(ranked, gold, 3),
        "full_coverage_5": full_coverage_at(ranked, gold, 5),
        "full_coverage_10": full_coverage_at(ranked, gold, 10),
    }


def top_k_hit(ranked: Column, gold: Column) -> Column:
    """Whether a ranked name is gold; null without gold."""
    return F.when(F.size(gold) > 0, F.arrays_overlap(ranked, gold))


def is_correct(predicted: Column, gold: Column) -> Column:
    """Whether the prediction is gold; null without gold."""
    return F.when(F.size(gold) > 0, F.coalesce(F.array_contains(gold, predicted), F.lit(False)))
