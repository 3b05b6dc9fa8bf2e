"""Lexical and hashed-vector indexes as plain tables.

An index is a table of postings; searching is an equi-join of query terms with postings, a sum per
query and document, and a bounded rank. Statistics are over all documents, those without tokens
included. With ``pool`` columns every statistic and every match is per pool.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.functions.text import count_tokens, hash_bucket
from intentlake.session import cut_lineage, written_table

K1, B = 1.5, 0.75
DIMENSIONS = 2048


def term_counts(docs: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, ``term``, ``tf``, ``first_pos``, ``dl``): tokens of every document with their number and first place, and the document's length.

    Documents without tokens have no rows. Tokens are counted inside each text, so what is shuffled is a
    row for each different token of a text; texts of equal keys are one document.
    """
    counted = docs.select(*keys, count_tokens(text).alias("_t")).select(*keys, F.col("_t.dl").alias("dl"), F.inline_outer("_t.terms")).where("term is not null")
    return counted.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"), F.max("dl").alias("dl"))


def document_frequency(counts: DataFrame, pool: Sequence[str] = ()) -> DataFrame:
    """(pool, ``term``, ``df``) from term counts."""
    return counts.groupBy(*pool, "term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: Column, pool: Sequence[str] = ()) -> DataFrame:
    """(pool, ``n_docs``, ``avgdl``): number of documents and their mean number of tokens, empty ones included."""
    sized = docs.select(*pool, count_tokens(text).alias("_t")).select(*pool, F.col("_t.dl").alias("dl"))
    return sized.groupBy(*pool).agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))


@dataclass
class Bm25Index:
    """Term counts and statistics of a collection; k1 = 1.5 and b = 0.75.

    ``counts``: (pool, keys, ``term``, ``tf``, ``dl``), ``stats``: (pool, ``n_docs``, ``avgdl``), a single row without pools.
    """

    counts: DataFrame
    stats: DataFrame
    keys: tuple[str, ...]
    pool: tuple[str, ...]

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """(pool, keys, ``term``, ``weight``), the part of the score that doesn't depend on the query; of the terms in ``only`` alone if given."""
        wanted = [*self.pool, "term"]
        counts = self.counts if only is None else self.counts.join(only.select(*wanted).distinct(), wanted, "left_semi")
        rows = counts.join(document_frequency(counts, self.pool), [*self.pool, "term"])
        rows = rows.join(self.stats, list(self.pool)) if self.pool else rows.join(F.broadcast(self.stats))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9)))
        return rows.select(*self.pool, *self.keys, "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("weight"))

    def score(self, queries: DataFrame, query_keys: Sequence[str], text: Column) -> DataFrame:
        """(query keys, keys, ``score``, ``touch``) of all documents that share a term with a query.

        A term counts as often as the query has it. ``touch`` is the place of the first query token that
        matched; documents a query doesn't touch have no row. Terms that no query has leave before
        anything is joined; frequencies and statistics are those of the whole collection.
        """
        terms = term_counts(queries, [*self.pool, *query_keys], text).drop("dl").withColumnRenamed("tf", "qtf")
        met = terms.join(self.postings(terms), [*self.pool, "term"])
        return met.groupBy(*self.pool, *query_keys, *self.keys).agg(
            F.sum(F.col("qtf") * F.col("weight")).alias("score"), F.min("first_pos").alias("touch")
        )


def bm25_index(docs: DataFrame, keys: Sequence[str], text: Column) -> Bm25Index:
    """The index of a collection; null texts are documents without tokens.

    Lengths come with the counts and the number of tokens is the sum of the counts, so texts are tokenised
    once: the uses of the counts share one shuffle.
    """
    counts = term_counts(docs, keys, text)
    tokens = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_tokens"))
    stats = docs.agg(F.count("*").alias("n_docs")).join(F.broadcast(tokens))
    return Bm25Index(counts.drop("first_pos"), stats.select("n_docs", (F.col("_tokens") / F.greatest("n_docs", F.lit(1))).alias("avgdl")), tuple(keys), ())


def pooled_bm25_index(placed: DataFrame, docs: DataFrame, key: str, text: Column, pool: Sequence[str]) -> Bm25Index:
    """The indexes of many pools that draw on the same documents.

    ``placed``: (pool, key), ``docs``: every document once. Terms are counted once for each document and
    placed in each of its pools when a search asks for them.
    """
    counts = term_counts(docs, [key], text).drop("first_pos")
    lengths = counts.groupBy(key).agg(F.max("dl").alias("dl"))
    sized = placed.join(lengths, key, "left")
    stats = sized.groupBy(*pool).agg(F.count("*").alias("n_docs"), (F.sum(F.coalesce("dl", F.lit(0))) / F.count("*")).alias("avgdl"))
    return _Pooled(counts, stats, (key,), tuple(pool), placed)


@dataclass
class _Pooled(Bm25Index):
    placed: DataFrame

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        counts = self.counts if only is None else self.counts.join(only.select("term").distinct(), "term", "left_semi")
        inside = counts.join(self.placed.select(*self.pool, *self.keys), list(self.keys))
        return Bm25Index(inside, self.stats, self.keys, self.pool).postings(only)


@dataclass
class _Units(Bm25Index):
    """The index of units that are a shared document and a text of their own; ``units``: (shared key, unit key, ``dl``), ``own``: counts by unit key."""

    units: DataFrame
    shared: DataFrame
    own: DataFrame

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        shared_key, unit_key = self.keys
        wanted = None if only is None else only.select("term").distinct()
        keep = lambda c: c if wanted is None else c.join(wanted, "term", "left_semi")
        both = self.units.join(keep(self.shared), shared_key).select(*self.keys, "term", "tf", "dl")
        both = both.unionByName(self.units.join(keep(self.own), unit_key).select(*self.keys, "term", "tf", "dl"))
        counts = both.groupBy(*self.keys, "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        return Bm25Index(counts, self.stats, self.keys, ()).postings()


def unit_bm25_index(docs: DataFrame, shared_key: str, document: Column, texts: DataFrame, unit_key: str, text: Column) -> Bm25Index:
    """The index of units that each consist of a shared document and a text of their own, or of the document alone.

    ``docs`` has the shared key (unique), ``texts`` both keys, one row a unit; documents without texts are a
    unit with a null unit key. Documents and texts are counted once each, not once a unit, and placed in
    their units when a search asks for their terms. The two must not run into one another: a token
    ends where the document ends.
    """
    shared = written_table(term_counts(docs, [shared_key], document).drop("first_pos"), "counts")
    own = written_table(term_counts(texts, [unit_key], text).drop("first_pos"), "counts")
    length = lambda counts, key, name: counts.groupBy(key).agg(F.max("dl").alias(name))
    units = docs.select(shared_key).join(texts.select(shared_key, unit_key), shared_key, "left")
    units = units.join(length(shared, shared_key, "_s"), shared_key, "left").join(length(own, unit_key, "_o"), unit_key, "left")
    units = cut_lineage(units.select(shared_key, unit_key, (F.coalesce("_s", F.lit(0)) + F.coalesce("_o", F.lit(0))).alias("dl")))
    stats = units.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    return _Units(own, stats, (shared_key, unit_key), (), units, shared.drop("dl"), own.drop("dl"))


def smooth_idf(docs: DataFrame, keys: Sequence[str], text: Column, pool: Sequence[str] = ()) -> DataFrame:
    """(pool, ``term``, ``df``, ``idf``) with idf = ln((N + 1) / (df + 1)) + 1 over all documents of the pool."""
    return idf_of_counts(term_counts(docs, [*pool, *keys], text), docs, pool)


def idf_of_counts(counts: DataFrame, docs: DataFrame, pool: Sequence[str] = ()) -> DataFrame:
    """``smooth_idf`` from the term counts of ``docs``."""
    frequency = document_frequency(counts, pool)
    n = docs.groupBy(*pool).agg(F.count("*").alias("n_docs"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    rows = frequency.join(n, list(pool)) if pool else frequency.join(F.broadcast(n))
    return rows.select(*pool, "term", "df", idf.alias("idf"))


def hashed_vectors(
    docs: DataFrame, keys: Sequence[str], text: Column, idf: DataFrame, dims: int = DIMENSIONS, pool: Sequence[str] = (), bucket: Callable[..., Column] = hash_bucket
) -> DataFrame:
    """(pool, keys, ``idx``, ``w``): sparse unit vectors of hashed TF-IDF weights.

    A term adds sign * (1 + ln tf) * idf at its bucket; the sign comes from a second hash, unknown terms
    have idf 1. ``bucket`` is the hash, ``hash_bucket`` or ``published_bucket``. Documents whose weights are
    all 0 or that have no tokens have no rows.
    """
    return vectors_of_counts(term_counts(docs, [*pool, *keys], text), keys, idf, dims, pool, bucket)


def vectors_of_counts(
    counts: DataFrame, keys: Sequence[str], idf: DataFrame, dims: int = DIMENSIONS, pool: Sequence[str] = (), bucket: Callable[..., Column] = hash_bucket
) -> DataFrame:
    """``hashed_vectors`` from term counts."""
    keys = [*pool, *keys]
    sign = lambda term: F.when(bucket(F.concat(F.lit("sign:"), term), 2) == 0, 1.0).otherwise(-1.0)
    known = idf.select(*pool, "term", "idf")
    terms = counts.join(known, [*pool, "term"], "left")
    weight = sign(F.col("term")) * (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(1.0))
    cells = terms.select(*keys, bucket("term", dims).alias("idx"), weight.alias("w")).groupBy(*keys, "idx").agg(F.sum("w").alias("w"))
    norms = cells.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return cells.join(norms, list(keys)).where("norm > 0").select(*keys, "idx", (F.col("w") / F.col("norm")).alias("w"))


def sparse_cosine(queries: DataFrame, query_keys: Sequence[str], docs: DataFrame, keys: Sequence[str], pool: Sequence[str] = ()) -> DataFrame:
    """(pool, query keys, keys, ``score``) of sparse unit vectors that share a dimension: an equi-join on pool and dimension."""
    met = queries.withColumnRenamed("w", "qw").join(docs, [*pool, "idx"])
    return met.groupBy(*pool, *query_keys, *keys).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
