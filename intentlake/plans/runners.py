"""Whole runs over samples with candidate pools: retrieval by a named method, the tool that is chosen, and its evaluation.

A sample is (``sample_id``, ``candidate_size``, ``query``, ``tools``, ``correct_tools``) as
``readers.read_samples`` gives them; ``candidate_size`` may be null. All samples are worked off in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.functions.metrics import is_correct
from intentlake.operators import index, manual, ranking
from intentlake.plans import pipelines
from intentlake.session import cut_lineage, written_table

KEY = ["sample_id", "candidate_size"]
NONE = "array<string>"


def sample_pools(samples: DataFrame) -> DataFrame:
    """(key, ``name``, ``description``, ``parameters``, ``pos``): the candidates of every sample in order, each name once."""
    each = samples.select(*KEY, F.posexplode("tools").alias("pos", "t")).select(*KEY, "pos", "t.name", "t.description", "t.parameters")
    return ranking.top_k(each.where("name is not null"), [*KEY, "name"], [F.col("pos")], 1, "_r").drop("_r")


def proxy(samples: DataFrame, pools: DataFrame, entries: DataFrame, k: int, proxy_top_k: int = 20) -> DataFrame:
    """The tools of each sample's nearest manual queries among those of its pool, by hashed TF-IDF with the statistics of these."""
    inside = pools.select(*KEY, F.col("name").alias("tool_name")).join(entries.select("entry_ord", "tool_name"), "tool_name")
    # An entry's tokens are counted once, however many pools hold it.
    once = written_table(index.term_counts(entries, ["entry_ord"], F.col("query")).drop("first_pos", "dl"), "counts")
    counts = inside.join(once, "entry_ord").select(*KEY, "entry_ord", "term", "tf")
    idf = index.idf_of_counts(counts, inside, KEY)
    vectors = index.vectors_of_counts(counts, ["entry_ord"], idf, pool=KEY)
    asked = index.hashed_vectors(samples.select(*KEY, "query"), [], F.col("query"), idf, pool=KEY)
    scores = index.sparse_cosine(asked, [], vectors, ["entry_ord"], KEY).withColumn("score", F.round("score", pipelines.DIGITS))
    best = ranking.top_k(scores, KEY, ranking.by_score("entry_ord"), proxy_top_k, "place").where("score > 0")
    hits = best.join(entries.select("entry_ord", "tool_name"), "entry_ord")
    return pipelines.rank_tools(hits, KEY, "tool_name", k, "place").withColumnRenamed("tool_name", "name")


def _documents(pools: DataFrame, entries: DataFrame | None) -> DataFrame:
    """The search text of every candidate: name, description and parameters, with ``entries`` also its manual queries."""
    made = pools.withColumn("category", F.lit(None).cast("string"))
    if entries is None:
        return made.select(*KEY, "name", "pos", pipelines.tool_document(False).alias("document"))
    ordered = F.array_sort(F.collect_list(F.struct("entry_ord", "query")))
    asked = entries.where("query <> ''").groupBy(F.col("tool_name").alias("name")).agg(F.transform(ordered, lambda x: x["query"]).alias("_asked"))
    asked = made.join(asked, "name", "left").withColumn("_asked", F.coalesce("_asked", F.array().cast(NONE)))
    return asked.select(*KEY, "name", "pos", pipelines.tool_document(False, F.col("_asked")).alias("document"))


def _in_pool_order(scores: DataFrame, pools: DataFrame, k: int) -> DataFrame:
    rows = pools.select(*KEY, "name", "pos").join(scores.select(*KEY, "name", "score"), [*KEY, "name"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranking.top_k(rows, KEY, ranking.by_score("pos"), k).select(*KEY, "rank", "name", "score")


def document_bm25(samples: DataFrame, pools: DataFrame, entries: DataFrame | None, k: int) -> DataFrame:
    """The candidates of each sample by BM25 of their documents inside the pool; those without a match follow in pool order."""
    built = index.Bm25Index(*_pool_counts(_documents(pools, entries)), ("name",), tuple(KEY))
    scores = built.score(samples.select(*KEY, "query"), [], F.col("query"))
    return _in_pool_order(scores.withColumn("score", F.round("score", pipelines.DIGITS)), pools, k)


def _pool_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = index.term_counts(docs, [*KEY, "name"], F.col("document")).drop("first_pos")
    return counts, index.corpus_stats(docs, F.col("document"), KEY)


def document_tfidf(samples: DataFrame, pools: DataFrame, entries: DataFrame | None, k: int) -> DataFrame:
    """The candidates of each sample by hashed TF-IDF of their documents inside the pool; those without a match follow in pool order."""
    docs = _documents(pools, entries)
    counts = written_table(index.term_counts(docs, [*KEY, "name"], F.col("document")).drop("first_pos", "dl"), "counts")
    idf = index.idf_of_counts(counts, docs, KEY)
    vectors = index.vectors_of_counts(counts, ["name"], idf, pool=KEY)
    asked = index.hashed_vectors(samples.select(*KEY, "query"), [], F.col("query"), idf, pool=KEY)
    scores = index.sparse_cosine(asked, [], vectors, ["name"], KEY).withColumn("score", F.round("score", pipelines.DIGITS))
    return _in_pool_order(scores, pools, k)


def whole_pool(samples: DataFrame, pools: DataFrame, entries: DataFrame | None, k: int) -> DataFrame:
    """No retrieval: the pool itself in its order, for choosing with the whole context."""
    return ranking.top_k(pools.select(*KEY, "name", "pos"), KEY, [F.col("pos")], k).select(*KEY, "rank", "name")


#: Retrieval methods by name; ``_query_augmented`` adds the manual's queries to the documents.
RETRIEVERS: dict[str, Callable[..., DataFrame]] = {
    "proxy": proxy,
    "bm25": lambda s, p, e, k: document_bm25(s, p, None, k),
    "bm25_query_augmented": document_bm25,
    "tfidf": lambda s, p, e, k: document_tfidf(s, p, None, k),
    "tfidf_query_augmented": document_tfidf,
    "full_context": whole_pool,
}


def retriever(method: str) -> Callable[..., DataFrame]:
    if method not in RETRIEVERS:
        raise ValueError(f"unknown method {method}: one of {', '.join(RETRIEVERS)}")
    return RETRIEVERS[method]


def method_setting(method: Column) -> Column:
    """What a method searches: the manual, documents with its queries, or bare documents. Null for null."""
    return F.when(method == "proxy", "manual").when(F.endswith(method, F.lit("_query_augmented")), "query_augmented").when(method.isNotNull(), "raw")


def run(samples: DataFrame, entries: DataFrame, method: str = "proxy", k: int = 5, choose: bool = True) -> DataFrame:
    """(key, ``query``, ``predicted``, ``retrieved``, ``correct_tools``, ``is_correct``, ``method``, ``setting``) of every sample.

    The predicted tool is, among those retrieved, the one that shares most terms with the request, else the
    first, else the pool's first; without ``choose`` it is the first. ``is_correct`` is null where no correct
    tools are known. A sample without candidates predicts nothing.
    """
    samples = samples.withColumn("candidate_size", F.coalesce("candidate_size", F.lit(0)))
    # Both are used several times by what follows.
    pools = cut_lineage(sample_pools(samples))
    every = (2**31 - 1) if method == "full_context" else k
    ranked = cut_lineage(retriever(method)(samples, pools, entries, every))
    first = pools.groupBy(*KEY).agg(F.min_by("name", "pos").alias("_pool_first"))
    lists = ranking.ranked_lists(ranked, KEY, "name").withColumnRenamed("ranked", "retrieved")
    best = ranked.where("rank = 1").select(*KEY, F.col("name").alias("_first"))
    out = samples.select(*KEY, "query", "correct_tools").join(first, KEY, "left").join(lists, KEY, "left").join(best, KEY, "left")
    picked = F.coalesce("_first", "_pool_first")
    if choose:
        texts = pools.select(*KEY, "name", manual.terms_of(manual.tool_text(F.col("name"), F.col("description"), F.col("parameters"))).alias("_doc"))
        asked = samples.select(*KEY, manual.terms_of(F.col("query")).alias("_terms"))
        chosen = manual.select_tool(ranked.join(texts, [*KEY, "name"]).join(asked, KEY), KEY, "_terms", "_doc", "name", "rank")
        out = out.join(chosen.select(*KEY, "selected"), KEY, "left")
        picked = F.coalesce("selected", "_first", "_pool_first")
    retrieved = F.coalesce("retrieved", F.array_compact(F.array("_pool_first")))
    return out.select(
        *KEY, "query", picked.alias("predicted"), retrieved.alias("retrieved"), "correct_tools",
        F.when(F.size(F.coalesce("correct_tools", F.array().cast(NONE))) > 0, is_correct(picked, F.col("correct_tools"))).alias("is_correct"),
        F.lit(method).alias("method"), method_setting(F.lit(method)).alias("setting"),
    )
