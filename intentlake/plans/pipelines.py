"""Retrieval pipelines: requests against manuals and catalogues, scored, ranked, filtered, merged and selected.

Scores of documents are rounded to nine decimals before they are ranked and tool scores are sums of
decimals, so that ties don't depend on the order in which a sum was built; ties go by ordinals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.functions.jsonx import sorted_json
from intentlake.functions.text import decompose_query, term_overlap
from intentlake.operators import index, ranking
from intentlake.operators import manual as select
from intentlake.session import written_table

DIGITS = 9


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", DIGITS))


def tool_document(canonical: bool = True, generated: Column | None = None) -> Column:
    """The search text of a tool: name, category, description, its parameters if it has any, then generated queries.

    ``canonical`` writes the parameters with sorted keys; else their text is taken as it is. ``generated``
    is an array of queries. Nulls count as empty.
    """
    params = sorted_json("parameters") if canonical else F.col("parameters")
    has = F.coalesce(~F.trim(params).isin("", "{}", "[]", "null"), F.lit(False))
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    parts = [
        line("TOOL_NAME: ", F.col("name")), line("CATEGORY: ", F.col("category")), line("DESCRIPTION: ", F.col("description")),
        F.when(has, F.concat(F.lit("PARAMETERS_SCHEMA: "), params)),
    ]
    if generated is not None:
        asked = F.filter(generated, lambda q: F.coalesce(q != "", F.lit(False)))
        listed = F.array_join(F.transform(asked, lambda q: F.concat(F.lit("- "), q)), "\n")
        parts.append(F.when(F.size(asked) > 0, F.concat(F.lit("GENERATED_QUERIES:\n"), listed)))
    return F.concat_ws("\n", *parts)


def augmented_units(tools: DataFrame, queries: DataFrame, tool_key: str, canonical: bool = True) -> DataFrame:
    """(tool columns, ``unit_ord``, ``document``): one unit for every query of a tool, one with the bare document for tools without.

    ``queries`` has ``tool_key``, ``entry_ord`` and ``query``; null and empty queries make no unit.
    """
    asked = queries.where("query is not null and query <> ''").select(F.col(tool_key), F.col("entry_ord").alias("unit_ord"), "query")
    doc = tool_document(canonical)
    unit = F.when(F.col("query").isNull(), doc).otherwise(F.concat(doc, F.lit("\nGENERATED_QUERY: "), F.col("query")))
    return tools.join(asked, tool_key, "left").withColumn("document", unit).drop("query")


def manual_hits(cases: DataFrame, manual: DataFrame, k: int | None, pool: Sequence[str] = ()) -> DataFrame:
    """BM25 hits of requests in a manual: (pool, ``ord``, ``rank``, ``entry_ord``, ``tool_name``, ``score``), only entries that share a term.

    With ``pool`` columns index and statistics are per pool. ``k`` bounds the hits of a request, None keeps all with rank null.
    """
    if pool:
        built = index.pooled_bm25_index(manual.select(*pool, "entry_ord"), manual.select("entry_ord", "query").distinct(), "entry_ord", F.col("query"), pool)
    else:
        built = index.bm25_index(manual, ["entry_ord"], F.col("query"))
    scores = _rounded(built.score(cases, ["ord"], F.col("query")))
    if k is not None:
        scores = ranking.top_k(scores, [*pool, "ord"], ranking.by_score("touch", "entry_ord"), k)
    names = manual.select(*pool, "entry_ord", "tool_name")
    return scores.join(names, [*pool, "entry_ord"])


def tfidf_hits(cases: DataFrame, manual: DataFrame, k: int) -> DataFrame:
    """The k nearest manual entries of each request by hashed TF-IDF cosine; only positive scores stay, after the cut."""
    # Tokens are counted once, for the statistics and for the vectors.
    counts = written_table(index.term_counts(manual, ["entry_ord"], F.col("query")).drop("first_pos", "dl"), "counts")
    idf = index.idf_of_counts(counts, manual)
    entries = index.vectors_of_counts(counts, ["entry_ord"], idf)
    asked = index.hashed_vectors(cases, ["ord"], F.col("query"), idf)
    scores = _rounded(index.sparse_cosine(asked, ["ord"], entries, ["entry_ord"]))
    best = ranking.top_k(scores, ["ord"], ranking.by_score("entry_ord"), k).where("score > 0")
    return best.join(manual.select("entry_ord", "tool_name"), "entry_ord")


def pool_tfidf_ranking(cases: DataFrame, drawn: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(``ord``, ``pool_size``, ``rank``, ``name``, ``score``): the k best tools of every pool by hashed TF-IDF cosine of their documents.

    Statistics are those of the pool; tools that share nothing with the request count with 0 and ties go
    in pool order. ``docs`` has ``name`` and ``document``.
    """
    pool = ["ord", "pool_size"]
    placed = drawn.withColumnRenamed("pos", "place")
    # A document's tokens are counted once, however many pools hold it.
    once = written_table(index.term_counts(docs, ["name"], F.col("document")).drop("first_pos", "dl"), "counts")
    counts = placed.join(once, "name").select(*pool, "place", "term", "tf")
    idf = index.idf_of_counts(counts, placed, pool)
    vectors = index.vectors_of_counts(counts, ["place"], idf, pool=pool)
    requests = drawn.select(*pool).distinct().join(cases.select("ord", "query"), "ord")
    asked = index.hashed_vectors(requests, [], F.col("query"), idf, pool=pool)
    scores = _rounded(index.sparse_cosine(asked, [], vectors, ["place"], pool)).withColumnRenamed("place", "pos")
    rows = drawn.join(scores, [*pool, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranking.top_k(rows, pool, ranking.by_score("pos"), k).select(*pool, "rank", "name", "score")


def rank_tools(hits: DataFrame, group: Sequence[str], tool: str, k: int, ordinal: str, support: Sequence[str] = ()) -> DataFrame:
    """(group, ``rank``, tool, ``score``, ``n_hits``): tools of each request by their score; ties by their first hit's ordinal, then name.

    With ``support`` columns also ``support``, those columns of the tool's three best hits.
    """
    scored = ranking.tool_scores(hits, group, tool, ordinal, support).withColumnRenamed("tool_score", "score")
    best = ranking.top_k(scored, group, ranking.by_score("first_hit", tool), k)
    return best.select(*group, "rank", tool, "score", "n_hits", *(["support"] if support else []))


def document_ranking(cases: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(``ord``, ``rank``, ``doc_ord``, ``score``): the k best documents of every request by BM25, documents without a match following with 0.

    ``docs`` has ``doc_ord`` and ``document``. Since a request misses at most k places, only the first k
    documents in order can fill them.
    """
    built = index.bm25_index(docs, ["doc_ord"], F.col("document"))
    best = ranking.top_k(_rounded(built.score(cases, ["ord"], F.col("query"))), ["ord"], ranking.by_score("doc_ord"), k)
    # What is sent to all tasks is one array of k ordinals.
    first = docs.select("doc_ord").orderBy("doc_ord").limit(k).agg(F.collect_list("doc_ord").alias("_all"))
    fill = cases.select("ord").join(F.broadcast(first)).select("ord", F.explode("_all").alias("doc_ord"), F.lit(0.0).alias("score"))
    fill = fill.join(best.select("ord", "doc_ord"), ["ord", "doc_ord"], "left_anti")
    both = best.select("ord", "doc_ord", "score").unionByName(fill)
    return ranking.top_k(both, ["ord"], ranking.by_score("doc_ord"), k).select("ord", "rank", "doc_ord", "score")


def within_pool(ranked: DataFrame, pools: DataFrame, group: Sequence[str], name: str, k: int, fill: bool) -> DataFrame:
    """(group, pool_size, ``ranked``): a global ranking cut down to each pool; with ``fill`` topped up in pool order.

    ``ranked`` has group, ``rank`` and the name, ``pools`` group, ``pool_size``, the name and ``pos``.
    """
    kept = pools.join(ranked.select(*group, name, "rank"), [*group, name], "left" if fill else "inner")
    place = ranking.top_k(kept, [*group, "pool_size"], [F.col("rank").asc_nulls_last(), F.col("pos")], k, "_place")
    return ranking.ranked_lists(place, [*group, "pool_size"], name, "_place")


def decomposed(cases: DataFrame, keep_original: bool = True) -> DataFrame:
    """(``ord``, ``part``, ``query``): the parts of every request, from 0."""
    return cases.select("ord", F.posexplode(decompose_query("query", keep_original)).alias("part", "query"))


def decomposed_ranking(cases: DataFrame, manual: DataFrame, k: int, pool: DataFrame | None = None) -> DataFrame:
    """(``ord``, ``rank``, ``tool_name``): every part's tools by BM25, merged rank by rank.

    With ``pool`` (``tool_name``, ``pos``) every request's list is topped up with its tools in pool order.
    """
    parts = decomposed(cases)
    built = index.bm25_index(manual, ["entry_ord"], F.col("query"))
    hits = _rounded(built.score(parts, ["ord", "part"], F.col("query"))).join(manual.select("entry_ord", "tool_name"), "entry_ord")
    tools = rank_tools(hits, ["ord", "part"], "tool_name", k, "entry_ord")
    if pool is None:
        return ranking.merge_ranked(tools, ["ord"], "tool_name", "part", "rank", k)
    return ranking.merge_and_fill(tools, ["ord"], "tool_name", "part", "rank", cases, pool, k)


def scoped_ranking(asked: DataFrame, drawn: DataFrame, manual: DataFrame, k: int) -> DataFrame:
    """(``ord``, ``pool_size``, ``rank``, ``tool_name``, ``score``, ``n_hits``): tools of every pool from an index over the pool's entries only.

    ``asked`` has ``ord`` and ``query``, ``drawn`` the pools with ``ord``, ``pool_size`` and ``name``.
    """
    pool = drawn.select(F.col("ord").alias("pid"), "pool_size", F.col("name").alias("tool_name"))
    entries = pool.join(manual.select("entry_ord", "query", "tool_name"), "tool_name")
    requests = drawn.select("ord", "pool_size").distinct().join(asked.select("ord", "query"), "ord").withColumn("pid", F.col("ord"))
    hits = manual_hits(requests, entries, None, ["pid", "pool_size"])
    return rank_tools(hits, ["ord", "pool_size"], "tool_name", k, "entry_ord")


def proxy_ranking(cases: DataFrame, manual: DataFrame, tools: DataFrame, tool_top_k: int = 5, proxy_top_k: int = 20) -> DataFrame:
    """(``ord``, ``rank``, ``tool_name``, ``score``, ``n_hits``) over the nearest manual entries; unknown tools are dropped after the cut."""
    hits = tfidf_hits(cases, manual, proxy_top_k).withColumnRenamed("rank", "place")
    known = hits.join(tools.select(F.col("name").alias("tool_name")).distinct(), "tool_name")
    return rank_tools(known, ["ord"], "tool_name", tool_top_k, "place")


def choose_tools(ranked: DataFrame, cases: DataFrame, tools: DataFrame, group: Sequence[str] = ("ord",)) -> DataFrame:
    """(group, ``predicted``, ``confidence``): of each request's ranked tools the one that shares most terms with it, else the first.

    Terms are those of name, description and parameters; ``confidence`` is the overlap with name and
    description alone. Requests without ranked tools have no row.
    """
    texts = tools.select(
        F.col("name").alias("tool_name"), select.terms_of(select.tool_text(F.col("name"), F.col("description"), F.col("parameters"))).alias("_doc"),
        select.terms_of(select.tool_text(F.col("name"), F.col("description"))).alias("_short"),
    )
    rows = ranked.join(cases.select("ord", select.terms_of(F.col("query")).alias("_terms")), "ord").join(texts, "tool_name")
    chosen = select.select_tool(rows, list(group), "_terms", "_doc", "tool_name", "rank")
    first = rows.groupBy(*group).agg(F.min_by("tool_name", "rank").alias("_first"))
    named = first.join(chosen, list(group)).select(*group, F.coalesce("selected", "_first").alias("predicted"))
    own = rows.withColumnRenamed("tool_name", "predicted").select(*group, "predicted", term_overlap(F.col("_terms"), F.col("_short")).alias("confidence"))
    return named.join(own, [*group, "predicted"]).select(*group, "predicted", "confidence")
