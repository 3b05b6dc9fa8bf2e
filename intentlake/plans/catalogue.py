"""The registered queries of the core and their SQL. Every query reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intentlake.functions import jsonx, metrics, vectors
from intentlake.functions import text as T
from intentlake.operators import convert, evaluate, index, manual, nested, ranking, sampling
from intentlake.plans import oracle as O
from intentlake.plans import pipelines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual with tool keys as tool names."""
    return read(spark, sf_dir, "manual").withColumn("tool_name", T.tool_key("tool_name"))


def keyed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, first registration of each tool key, keys as names."""
    tools = read(spark, sf_dir, "tools").withColumn("name", T.tool_key("name"))
    return sampling.unique_by(tools, "name", ["ord"])


def keyed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "cases").withColumn("ground_truth_tool", T.tool_key("ground_truth_tool"))


TOOLS_N = f"tools_n as (select * exclude (k, r) replace (k as name) from (select *, {O.key('name')} as k, row_number() over (partition by {O.key('name')} order by ord) as r from tools) where r = 1 and k is not null)"
CASES_N = f"cases_n as (select ord, query, {O.key('ground_truth_tool')} as ground_truth_tool from cases)"


# ---- the nested records of the catalogue


@query(f"with recursive {O.nodes_cte('tools', 'ord', 'parameters')} select ord, path as param_path, parent_path from nodes where is_record")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tool parameter at any depth."""
    return nested.parameters(read(spark, sf_dir, "tools"))


@query(
    f"with recursive {O.nodes_cte('tools', 'ord', 'parameters')} select ord, level, node_key, parent_key, ordinal, name, "
    "case when kind = 'list' and json_type(record, '/type') = 'VARCHAR' or kind = 'schema' and json_type(record, '/type') = 'VARCHAR' then record ->> '/type' end as type, "
    "case when json_type(record, '/description') = 'VARCHAR' then record ->> '/description' end as description from nodes"
)
def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child tables of all levels with two of their attributes, where these are texts."""
    _, tables = nested.child_tables(read(spark, sf_dir, "tools"), ["ord"], "parameters")
    columns = ("ord", "level", "node_key", "parent_key", "ordinal", "name")
    rows = [
        t.select(*columns, *[_text_attribute(t, n).alias(n) for n in ("type", "description")])
        for t in tables.values()
    ] or [read(spark, sf_dir, "tools").limit(0).select("ord", *[F.lit(None).cast(c).alias(n) for n, c in zip((*columns[1:], "type", "description"), ("int", "string", "string", "int", "string", "string", "string"))])]
    return reduce(DataFrame.unionByName, rows)


def _text_attribute(table: DataFrame, name: str):
    known = table.schema["attributes"].dataType.fieldNames()
    # An array or object in a column of several kinds is JSON text.
    value = F.col(f"attributes.{name}").cast("string") if name in known else F.lit(None).cast("string")
    return F.when(~F.coalesce(F.try_parse_json(value).isNotNull() & F.rlike(value, F.lit(r"^[\[{]")), F.lit(False)), value)


@query(
    f"with recursive {O.nodes_cte('tools', 'ord', 'parameters')} select ord, node_key, parent_key, record_parent_key, ordinal, level, is_record, name, path, parent_path from nodes"
)
def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the parameter trees with surrogate keys, ordinals and levels."""
    return nested.flatten_records(read(spark, sf_dir, "tools"), ["ord"], "parameters")


# ---- text functions


@query(f"select ord, {O.norm('name')} as normalized, {O.key('name')} as tool_key from tools")
def text_normalize(spark, sf_dir):
    return read(spark, sf_dir, "tools").select("ord", T.normalize_text("name").alias("normalized"), T.tool_key("name").alias("tool_key"))


@query(f"select entry_ord, unnest(range(len(tk))) as pos, unnest(tk) as term from (select entry_ord, {O.tok('query')} as tk from manual)")
def text_tokens(spark, sf_dir):
    tokens = read(spark, sf_dir, "manual").select("entry_ord", F.posexplode(T.tokenize("query")).alias("pos", "term"))
    return tokens.select("entry_ord", F.col("pos").cast("bigint").alias("pos"), "term")


@query(f"with {O.counts_cte('c', 'documents', 'doc_id', 'text')} select term, count(*) as df, sum(tf)::bigint as tf from c group by 1")
def text_term_statistics(spark, sf_dir):
    counts = index.term_counts(read(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"select count(*) as n_docs, round(sum(coalesce(len({O.tok('query')}), 0))::double / count(*), 9) as avgdl from manual")
def text_corpus_stats(spark, sf_dir):
    stats = index.corpus_stats(read(spark, sf_dir, "manual"), F.col("query"))
    return stats.select("n_docs", F.round("avgdl", 9).alias("avgdl"))


@query(f"with {TOOLS_N}, {CASES_N} select c.ord, round({O.overlap(O.tok('c.query'), O.tok('t.description'))}, 9) as overlap from cases_n c join tools_n t on c.ground_truth_tool = t.name")
def text_overlap(spark, sf_dir):
    rows = keyed_cases(spark, sf_dir).withColumnRenamed("ord", "case_ord").join(keyed_tools(spark, sf_dir), F.col("ground_truth_tool") == F.col("name"))
    return rows.select(F.col("case_ord").alias("ord"), F.round(T.term_overlap(T.tokenize("query"), T.tokenize("description")), 9).alias("overlap"))


@query(f"with x as (select ord, {O.tok('coalesce(name, chr(32))')} || {O.tok('coalesce(description, chr(32))')} as tk from tools), t as (select ord, unnest(tk) as term, unnest(range(len(tk))) as pos from x), c as (select ord, term, count(*) as n, min(pos) as f from t group by all), r as (select *, row_number() over (partition by ord order by n desc, f) as place from c) select ord, term, place from r where place <= 6")
def text_top_terms(spark, sf_dir):
    rows = manual.top_terms(read(spark, sf_dir, "tools"), ["ord"], [F.coalesce("name", F.lit(" ")), F.coalesce("description", F.lit(" "))], 6)
    return rows.select("ord", F.posexplode("terms").alias("p", "term")).select("ord", "term", (F.col("p") + 1).cast("bigint").alias("place"))


@query(f"select distinct tool_name, {O.bucket('tool_name', 2048)} as bucket from manual where tool_name is not null")
def text_hash_buckets(spark, sf_dir):
    names = read(spark, sf_dir, "manual").where("tool_name is not null").select("tool_name").distinct()
    return names.select("tool_name", T.hash_bucket("tool_name", 2048).alias("bucket"))


@query("select doc_id, sha256(text || chr(0)) as digest from documents")
def text_digests(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("text").isNotNull(), T.text_digest(F.array("text"))).alias("digest"))


@query("select doc_id, greatest(1, coalesce(length(text), 0) // 4)::int as tokens from documents")
def text_token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"select doc_id, list_transform(regexp_extract_all(text, 'TOOL_NAME:\s*([^\n\r]+)', 1), lambda n: trim(n))::varchar as names, sha256(regexp_replace(text, '<\|([^|\r\n]{1,100})\|>', '< |\1| >', 'g')) as defused from documents where text is not null")
def text_context_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null")
    shown = F.concat(F.lit("["), F.array_join(T.tool_names_in("text"), ", "), F.lit("]"))
    return docs.select("doc_id", shown.alias("names"), F.sha2(T.defuse_markers("text"), 256).alias("defused"))


_S, _PARTS, _LEAD, _ACTS = O.decompose("query")


@query(
    f"with s as (select entry_ord, {_S} as s from manual where query is not null), p as (select entry_ord, s, {_PARTS} as parts, {_LEAD} as lead from s), "
    f"n as (select entry_ord, s, parts, list_transform(parts, lambda x: case when regexp_matches(x, '{_ACTS}') then x else lead || x end) as named from p), "
    "f as (select entry_ord, s, parts, unnest(named) as part, unnest(range(len(named))) as pos from n where len(parts) > 1), "
    "u as (select entry_ord, s, part, min(pos) as pos from f group by all), "
    "a as (select entry_ord, part, pos from u union all select entry_ord, s, 1000000 from n where len(parts) > 1 and not list_contains(named, s) "
    "union all select entry_ord, s, 0 from n where len(parts) <= 1 and s <> '') "
    "select entry_ord, part, row_number() over (partition by entry_ord order by pos) - 1 as part_no from a"
)
def text_decompose(spark, sf_dir):
    rows = read(spark, sf_dir, "manual").select("entry_ord", F.posexplode(T.decompose_query("query")).alias("p", "part"))
    return rows.select("entry_ord", "part", F.col("p").cast("bigint").alias("part_no"))


@query(
    f"with {TOOLS_N}, {CASES_N}, r as (select c.ord as case_ord, c.query, t.parameters as p from cases_n c join tools_n t on c.ground_truth_tool = t.name), "
    "o as (select * from r where json_valid(p) and json_type(p, '/properties') = 'OBJECT'), "
    "e as (select case_ord, query, p, unnest(json_keys(p, '/properties')) as parameter from o), "
    "k as (select case_ord, query, parameter, coalesce(json_extract_string(p, '/properties/' || replace(replace(parameter, '~', '~0'), '/', '~1') || '/type'), '') as kind from e), "
    f"t as (select *, {O.tok('query')} as tk, {O.tok('parameter')} as kt, regexp_extract_all(query, '-?[0-9]+(?:\\.[0-9]+)?') as nums, regexp_extract_all(upper(query), '\\b[A-Z]{{3}}\\b') as codes from k), "
    "v as (select case_ord, parameter, case when len(tk) = 0 then null when kind in ('integer', 'number') and len(nums) > 0 then nums[1] "
    "when contains(parameter, 'currency') and len(codes) > 0 then case when starts_with(parameter, 'to') and len(codes) > 1 then codes[2] else codes[1] end "
    "when list_has_any(kt, tk) then array_to_string(tk[-3:], ' ') end as value from t) select case_ord, parameter, value from v where value is not null"
)
def text_arguments(spark, sf_dir):
    """The argument of every top-level parameter of a case's tool that its request holds."""
    rows = keyed_cases(spark, sf_dir).withColumnRenamed("ord", "case_ord").join(keyed_tools(spark, sf_dir), F.col("ground_truth_tool") == F.col("name"))
    props = F.map_entries(F.from_json(F.get_json_object("parameters", "$.properties"), "map<string,string>"))
    each = rows.select("case_ord", "query", F.explode(props).alias("p"))
    value = jsonx.extract_arguments("query", F.col("p.key"), F.coalesce(F.get_json_object("p.value", "$.type"), F.lit("")))
    return each.select("case_ord", F.col("p.key").alias("parameter"), value.alias("value")).where("value is not null")


@query(
    "with a as (select ord, parameters, regexp_extract('Here it is:' || chr(10) || parameters || chr(10) || 'Done.', '(?s)\\[.*\\]') as l, regexp_extract('Here it is:' || chr(10) || parameters || chr(10) || 'Done.', '(?s)\\{.*\\}') as o from tools) "
    "select ord, case when parameters is null then null when l <> '' and json_valid(l) then json_type(l) when o <> '' and json_valid(o) then json_type(o) end as kind from a"
)
def text_recovered_json(spark, sf_dir):
    """The kind of JSON value that each parameter text holds, wrapped in chatter and recovered."""
    answer = F.concat(F.lit("Here it is:\n"), F.col("parameters"), F.lit("\nDone."))
    return read(spark, sf_dir, "tools").select("ord", F.substring_index(F.schema_of_variant(jsonx.recover_json(answer)), "<", 1).alias("kind"))


# ---- vectors


@query("select u.vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(list_cosine_similarity(u.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as cosine from embeddings u where exists (select 1 from embeddings where vec_id = 0)")
def vector_norms(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    zero = rows.where("vec_id = 0").select(F.col("embedding").alias("z"))
    joined = rows.join(F.broadcast(zero))
    cosine = vectors.dot(vectors.normalize("embedding"), vectors.normalize("z"))
    return joined.select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(cosine, 6).alias("cosine"))


@query(
    "with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0), "
    "s as (select query_id, vec_id as id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as score, list_cosine_similarity(q.v, e.embedding::double[]) as exact from q join embeddings e on e.vec_id <> query_id), "
    "r as (select *, row_number() over (partition by query_id order by exact desc, id) as rank from s) select query_id, id, rank, score from r where rank <= 10"
)
def vector_search(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = ranking.dense_search(rows, "vec_id", "embedding", rows.where("vec_id % 100 = 0"), 64, 10)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(
    f"with u as (select unit_id, {O.key('tool_name')} as tool, vector::double[] as v from query_augmented_units where unit_id is not null and len(vector) = 64 "
    "and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0), "
    "c as (select q.unit_id as query_id, u.unit_id as id, u.tool, list_cosine_similarity(q.v, u.v) as score from u q join u on u.unit_id <> q.unit_id where q.unit_id % 100 = 0), "
    "n as (select query_id, id, tool, round(score, 9) as score, row_number() over (partition by query_id order by score desc, id) as place from c), "
    f"h as (select * from n where place <= 50 and score > 0 and tool is not null), {O.tool_rank('tr', 'h', 'query_id', 'tool', 'id')} "
    "select query_id, tool, rank, n_hits, score from tr where rank <= 10"
)
def vector_tool_search(spark, sf_dir):
    """Tools of the nearest units of every hundredth unit, by the tool score."""
    units = read(spark, sf_dir, "query_augmented_units")
    near = ranking.dense_search(units, "unit_id", "vector", units.where("unit_id % 100 = 0"), 64, 50).withColumn("score", F.round("score", 9))
    names = units.select(F.col("unit_id").alias("id"), T.tool_key("tool_name").alias("tool"))
    rows = pipelines.rank_tools(near.where("score > 0").join(names, "id").where("tool is not null"), ["query_id"], "tool", 10, "id")
    return rows.select("query_id", "tool", F.col("rank").cast("bigint").alias("rank"), "n_hits", "score")


@query(
    f"with u as (select unit_id, {O.key('tool_name')} as tool, vector::double[] as v from query_augmented_units where unit_id is not null and len(vector) = 64 "
    "and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0), "
    "s as (select q.unit_id as query_id, u.tool, u.unit_id, round(list_cosine_similarity(q.v, u.v), 9) as score from u q join u on u.unit_id <> q.unit_id where q.unit_id % 100 = 0 and u.tool is not null), "
    "h as (select *, row_number() over (partition by query_id, tool order by score desc) as r, count(*) over (partition by query_id, tool) as n from s), "
    "t as (select query_id, tool, round(sum(case when r <= 3 then score else 0 end) / least(any_value(n), 3) + 0.05 * least(any_value(n), 5), 9) as score from h group by all), "
    "k as (select *, row_number() over (partition by query_id order by score desc, tool) as rank from t) select query_id, tool, rank, score from k where rank <= 10"
)
def vector_unit_tools(spark, sf_dir):
    """Tools for every hundredth unit from all units, by the mean of a tool's best three cosines and its number of units."""
    units = read(spark, sf_dir, "query_augmented_units").withColumn("tool", T.tool_key("tool_name"))
    rows = ranking.dense_tool_search(units, "unit_id", "tool", "vector", units.where("unit_id % 100 = 0"), 64, 10)
    return rows.select("query_id", "tool", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"))


# ---- indexes and retrieval


@query(f"with {O.counts_cte('c', 'manual', 'entry_ord', 'query')}, n as (select count(*) as n from manual), d as (select term, count(*) as df from c group by 1) select term, df, round(ln((n + 1) / (df + 1)) + 1, 9) as idf from d, n")
def index_smooth_idf(spark, sf_dir):
    idf = index.smooth_idf(read(spark, sf_dir, "manual"), ["entry_ord"], F.col("query"))
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


_TFIDF = (
    f"{O.counts_cte('md', 'manual', 'entry_ord', 'query')}, {O.counts_cte('cq', 'cases', 'ord', 'query')}, nn as (select count(*) as n from manual), "
    "idf as (select term, ln((n + 1) / (df + 1)) + 1 as idf from (select term, count(*) as df from md group by 1), nn), "
    f"dw as (select entry_ord, {O.bucket('term', 2048)} as idx, sum(case when {O.bucket(chr(39) + 'sign:' + chr(39) + ' || term', 2)} = 0 then 1.0 else -1.0 end * (1 + ln(tf)) * coalesce(idf, 1.0)) as w from md left join idf using (term) group by all), "
    f"qw as (select ord, {O.bucket('term', 2048)} as idx, sum(case when {O.bucket(chr(39) + 'sign:' + chr(39) + ' || term', 2)} = 0 then 1.0 else -1.0 end * (1 + ln(tf)) * coalesce(idf, 1.0)) as w from cq left join idf using (term) group by all), "
    "du as (select entry_ord, idx, w / sqrt(sum(w * w) over (partition by entry_ord)) as w from dw), qu as (select ord, idx, w / sqrt(sum(w * w) over (partition by ord)) as w from qw), "
    "sc as (select ord, entry_ord, round(sum(qu.w * du.w), 9) as score from qu join du using (idx) group by all), "
    "top as (select *, row_number() over (partition by ord order by score desc, entry_ord) as rank from sc)"
)


@query(f"with {_TFIDF} select ord, entry_ord, rank, score from top where rank <= 20 and score > 0")
def retrieve_tfidf(spark, sf_dir):
    hits = pipelines.tfidf_hits(read(spark, sf_dir, "cases"), read(spark, sf_dir, "manual"), 20)
    return hits.select("ord", "entry_ord", F.col("rank").cast("bigint").alias("rank"), "score")


@query(
    f"with {_TFIDF}, {TOOLS_N}, {O.M}, h as (select t.ord, m.tool_name, t.score, t.rank from top t join manual_n m using (entry_ord) join tools_n n on n.name = m.tool_name where t.rank <= 20 and score > 0), "
    f"{O.tool_rank('tr', 'h', 'ord', 'tool_name', 'rank')} select ord, tool_name, rank, n_hits, score from tr where rank <= 5"
)
def retrieve_proxy_index(spark, sf_dir):
    """Requests to tools over the nearest manual entries; unknown tools are dropped after the cut."""
    rows = pipelines.proxy_ranking(read(spark, sf_dir, "cases"), keyed_manual(spark, sf_dir), keyed_tools(spark, sf_dir))
    return rows.select("ord", "tool_name", F.col("rank").cast("bigint").alias("rank"), "n_hits", "score")


_CHOSEN = (
    f"{_TFIDF}, {TOOLS_N}, {O.M}, h as (select t.ord, m.tool_name, t.score, t.rank from top t join manual_n m using (entry_ord) join tools_n n on n.name = m.tool_name where t.rank <= 20 and score > 0), "
    f"{O.tool_rank('tr', 'h', 'ord', 'tool_name', 'rank')}, "
    "d as (select tr.ord, tr.tool_name, tr.rank, c.query, t.name || ' ' || coalesce(t.description, '') as short, t.name || ' ' || coalesce(t.description, '') || ' ' || coalesce(t.parameters, '') as doc from tr join cases c on c.ord = tr.ord join tools_n t on t.name = tr.tool_name where tr.rank <= 5), "
    f"o as (select *, {O.overlap(O.tok('query'), O.tok('doc'))} as ov, {O.overlap(O.tok('query'), O.tok('short'))} as conf from d), r as (select *, row_number() over (partition by ord order by ov desc, rank) as r from o)"
)


@query(f"with {_CHOSEN} select ord, tool_name as predicted, round(conf, 9) as confidence from r where r = 1")
def select_final(spark, sf_dir):
    """The tool that is chosen among the five best of every request."""
    tools = keyed_tools(spark, sf_dir)
    cases = read(spark, sf_dir, "cases")
    rows = pipelines.choose_tools(pipelines.proxy_ranking(cases, keyed_manual(spark, sf_dir), tools), cases, tools)
    return rows.select("ord", "predicted", F.round("confidence", 9).alias("confidence"))


_BM = O.bm25_cte("b", "manual_n", "entry_ord", "query", "cases", "ord", "query")


@query(f"with {O.M}, {_BM}, r as (select *, row_number() over (partition by ord order by score desc, touch, entry_ord) as rank from b) select ord, entry_ord, tool_name, rank, score from r join manual_n using (entry_ord) where rank <= 20")
def retrieve_bm25(spark, sf_dir):
    hits = pipelines.manual_hits(read(spark, sf_dir, "cases"), keyed_manual(spark, sf_dir), 20)
    return hits.select("ord", "entry_ord", "tool_name", F.col("rank").cast("bigint").alias("rank"), "score")


_BM_TOOLS = f"{O.M}, {_BM}, h as (select b.ord, m.tool_name, b.score, b.entry_ord from b join manual_n m using (entry_ord) where m.tool_name is not null), {O.tool_rank('tr', 'h', 'ord', 'tool_name', 'entry_ord')}"


def bm25_tools(spark, sf_dir, k, among=None):
    """Tools by BM25; with ``among`` (``ord``, ``name``) only those of each request's pools are ranked, whose order stays the same."""
    hits = pipelines.manual_hits(read(spark, sf_dir, "cases"), keyed_manual(spark, sf_dir), None).where("tool_name is not null")
    if among is not None:
        hits = hits.join(among.select("ord", F.col("name").alias("tool_name")).distinct(), ["ord", "tool_name"], "left_semi")
    return pipelines.rank_tools(hits, ["ord"], "tool_name", k, "entry_ord")


@query(f"with {_BM_TOOLS} select ord, tool_name, rank, n_hits, score from tr where rank <= 10")
def retrieve_bm25_tools(spark, sf_dir):
    return bm25_tools(spark, sf_dir, 10).select("ord", "tool_name", F.col("rank").cast("bigint").alias("rank"), "n_hits", "score")


@query(
    f"with docs as (select ord as doc_ord, {O.tool_doc()} as document from tools), {O.bm25_cte('b', 'docs', 'doc_ord', 'document', 'cases', 'ord', 'query')}, "
    "a as (select c.ord, d.doc_ord, coalesce(b.score, 0.0) as score from cases c cross join docs d left join b on b.ord = c.ord and b.doc_ord = d.doc_ord), "
    "r as (select *, row_number() over (partition by ord order by score desc, doc_ord) as rank from a) select ord, doc_ord, rank, score from r where rank <= 10"
)
def retrieve_bm25_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "tools").select(F.col("ord").alias("doc_ord"), pipelines.tool_document(False).alias("document"))
    rows = pipelines.document_ranking(read(spark, sf_dir, "cases"), docs, 10)
    return rows.select("ord", "doc_ord", F.col("rank").cast("bigint").alias("rank"), "score")


_UNITS = (
    f"{TOOLS_N}, {O.M}, mq as (select * from manual_n where query is not null and query <> ''), "
    f"units as (select row_number() over (order by t.ord, m.entry_ord nulls first) as unit, t.ord as tool_ord, t.name, {O.tool_doc()} || case when m.query is null then '' else chr(10) || 'GENERATED_QUERY: ' || m.query end as document "
    "from tools_n t left join mq m on m.tool_name = t.name)"
)


def units_of(spark, sf_dir):
    tools = keyed_tools(spark, sf_dir).withColumn("tool_name", F.col("name"))
    return pipelines.augmented_units(tools, keyed_manual(spark, sf_dir), "tool_name", canonical=False)


@query(f"with {_UNITS} select tool_ord as ord, count(*) as units, sum({O.bucket('document', 1000000007)})::bigint as checksum from units group by 1")
def units_augmented(spark, sf_dir):
    return units_of(spark, sf_dir).groupBy("ord").agg(F.count("*").alias("units"), F.sum(T.hash_bucket("document", 1000000007)).alias("checksum"))


@query(
    f"with {_UNITS}, {O.bm25_cte('b', 'units', 'unit', 'document', 'cases', 'ord', 'query')}, n as (select name, count(*) as n from units group by 1), "
    "h as (select b.ord, u.name, b.score, row_number() over (partition by b.ord, u.name order by b.score desc, b.unit) as hr from b join units u using (unit)), "
    "s as (select ord, h.name, round(sum(case when hr <= 3 then score else 0 end) / least(n, 3) + 0.05 * least(n, 5), 9) as score from h join n using (name) group by ord, h.name, n.n), "
    "r as (select *, row_number() over (partition by ord order by score desc, name) as rank from s) select ord, name, rank, score from r where rank <= 10"
)
def retrieve_units(spark, sf_dir):
    """Tools by their units' BM25 scores; a tool's units without a match count with 0."""
    tools = keyed_tools(spark, sf_dir)
    asked = keyed_manual(spark, sf_dir).where("query is not null and query <> ''").join(tools.select("ord", F.col("name").alias("tool_name")), "tool_name")
    texts = asked.select("ord", F.col("entry_ord").alias("unit_ord"), F.concat(F.lit("GENERATED_QUERY: "), "query").alias("said"))
    built = index.unit_bm25_index(tools, "ord", pipelines.tool_document(False), texts, "unit_ord", F.col("said"))
    requests = read(spark, sf_dir, "cases").select(F.col("ord").alias("request"), "query")
    hits = built.score(requests, ["request"], F.col("query")).withColumn("score", F.round("score", 9))
    place = Window.partitionBy("request", "ord").orderBy(F.desc("score"), "unit_ord")
    best = hits.withColumn("r", F.row_number().over(place)).where("r <= 3").groupBy("request", "ord").agg(F.sum("score").alias("s"))
    sizes = built.units.groupBy("ord").agg(F.count("*").alias("n"))
    scored = best.join(sizes, "ord").join(tools.select("ord", "name"), "ord").withColumnRenamed("ord", "tool_ord").withColumnRenamed("request", "ord")
    score = F.round(F.col("s") / F.least("n", F.lit(3)) + 0.05 * F.least("n", F.lit(5)), 9)
    rows = ranking.top_k(scored.withColumn("score", score), ["ord"], ranking.by_score("name"), 10)
    return rows.select("ord", "name", F.col("rank").cast("bigint").alias("rank"), "score")


def _decomposed_sql() -> str:
    cut, parts, lead, acts = O.decompose("query")
    return (
        f"{TOOLS_N}, {O.M}, known as (select * from manual_n where tool_name is not null), ds as (select ord, {cut} as s from cases where query is not null), "
        f"dp as (select ord, s, {parts} as parts, {lead} as lead from ds), "
        f"dn as (select ord, s, parts, list_transform(parts, lambda x: case when regexp_matches(x, '{acts}') then x else lead || x end) as named from dp), "
        "df as (select ord, unnest(named) as query, unnest(range(len(named))) as pos from dn where len(parts) > 1), "
        "da as (select ord, query, min(pos) as pos from df group by all union all select ord, s, 1000000 from dn where len(parts) > 1 and not list_contains(named, s) "
        "union all select ord, s, 0 from dn where len(parts) <= 1 and s <> ''), "
        "parts as (select ord, query, row_number() over (partition by ord order by pos) - 1 as part from da), "
        + O.bm25_cte("b", "known", "entry_ord", "query", "parts", "ord, part", "query")
        + ", h as (select b.ord, b.part, m.tool_name, b.score, b.entry_ord from b join known m using (entry_ord)), "
        + O.tool_rank("tr", "h", "ord, part", "tool_name", "entry_ord")
        + ", f as (select *, row_number() over (partition by ord, tool_name order by rank, part) as f from tr where rank <= 10), "
        "merged as (select ord, tool_name, row_number() over (partition by ord order by rank, part) as rank from f where f = 1), top as (select * from merged where rank <= 10)"
    )


_DECOMPOSED = _decomposed_sql()


@query(f"with {_DECOMPOSED} select ord, tool_name, rank from top")
def retrieve_decomposed(spark, sf_dir):
    """Parts of every request ranked apart and merged rank by rank."""
    entries = keyed_manual(spark, sf_dir).where("tool_name is not null")
    rows = pipelines.decomposed_ranking(read(spark, sf_dir, "cases"), entries, 10)
    return rows.select("ord", "tool_name", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"with {_DECOMPOSED}, fill as (select c.ord, t.name as tool_name, t.ord as pos from cases c cross join tools_n t where not exists (select 1 from top where top.ord = c.ord and top.tool_name = t.name)), "
    "every as (select ord, tool_name, rank, null as pos from top union all select ord, tool_name, null, pos from fill), "
    "r as (select ord, tool_name, row_number() over (partition by ord order by rank nulls last, pos) as rank from every) select ord, tool_name, rank from r where rank <= 10"
)
def retrieve_decomposed_filled(spark, sf_dir):
    """The merged lists topped up in the order of the catalogue, so that every request has ten tools."""
    entries = keyed_manual(spark, sf_dir).where("tool_name is not null")
    pool = keyed_tools(spark, sf_dir).select(F.col("name").alias("tool_name"), F.col("ord").alias("pos"))
    rows = pipelines.decomposed_ranking(read(spark, sf_dir, "cases"), entries, 10, pool)
    return rows.select("ord", "tool_name", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"with {_BM_TOOLS}, s as (select ord, tool_name, string_agg(entry_ord::varchar || ':' || query, '|' order by hr) as support from tr_r join (select entry_ord, query from manual_n) using (entry_ord) where hr <= 3 group by all) "
    "select ord, tool_name, rank, support from tr join s using (ord, tool_name) where rank <= 5"
)
def retrieve_bm25_support(spark, sf_dir):
    """The five best tools of every request with the three manual queries that speak most for each."""
    entries = keyed_manual(spark, sf_dir)
    hits = pipelines.manual_hits(read(spark, sf_dir, "cases"), entries, None).where("tool_name is not null")
    rows = pipelines.rank_tools(hits, ["ord"], "tool_name", 5, "entry_ord", ["entry_ord"])
    said = rows.select("ord", "tool_name", "rank", F.posexplode("support").alias("place", "s")).select("ord", "tool_name", "rank", "place", F.col("s.entry_ord").alias("entry_ord"))
    said = said.join(entries.select("entry_ord", "query"), "entry_ord")
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("entry_ord").cast("string"), F.lit(":"), "query").alias("t"))))
    rows = said.groupBy("ord", "tool_name", "rank").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "|").alias("support"))
    return rows.select("ord", "tool_name", F.col("rank").cast("bigint").alias("rank"), "support")


@query(
    "with h as (select qid, hit_id, any_value(score) as score, any_value(" + O.key("tool_name") + ") as tool from hits where tool_name is not null and isfinite(score) and score > 0 group by qid, hit_id), "
    + O.tool_rank("tr", "h", "qid", "tool", "hit_id") + " select qid, tool, rank, n_hits, score from tr where rank <= 5"
)
def rank_hit_tools(spark, sf_dir):
    """The five best tools of every logged request; a hit delivered again counts once."""
    hits = read(spark, sf_dir, "hits").where("tool_name is not null and score > 0 and score < double('infinity')")
    once = hits.groupBy("qid", "hit_id").agg(F.min("score").alias("score"), F.min(T.tool_key("tool_name")).alias("tool"))
    return pipelines.rank_tools(once, ["qid"], "tool", 5, "hit_id").select("qid", "tool", F.col("rank").cast("bigint").alias("rank"), "n_hits", "score")


# ---- pools, filters, selection

_SIZES = (10, 50)
#: The sizes of the published benchmarks; skills go up to 200.
_SCALED_SIZES = (2, 5, 10, 20, 50, 100, 200)


def case_pools(spark, sf_dir, sizes=_SIZES):
    """Pools of each size, 10 and 50 tools unless given, for every case that has a known tool."""
    names = keyed_tools(spark, sf_dir).select("ord", "name")
    catalogue = sampling.dense_index(names, ["ord"]).select("idx", "name")
    asked = keyed_cases(spark, sf_dir).withColumn("gold", F.array_compact(F.array("ground_truth_tool")))
    return sampling.pools(asked, ["ord"], "gold", catalogue, sizes)


def _pools_sql() -> str:
    def h(suffix: str, n: str) -> str:
        return f"(('0x' || substr(sha256('7|' || pool_size || '|' || ord || '|{suffix}'), 1, 15))::ubigint % {n})::bigint"

    return (
        f"{TOOLS_N}, {CASES_N}, cat as (select row_number() over (order by ord) - 1 as idx, name from tools_n), nn as (select count(*) as n from cat), "
        "pr as (select n, (select min(p) from (select unnest(range(greatest(n, 2), n * 2 + 10)) as p) where not exists (select 1 from (select unnest(range(2, 2000)) as d) where d * d <= p and p % d = 0)) as p from nn), "
        "g as (select c.ord, c.ground_truth_tool as name from cases_n c join cat on cat.name = c.ground_truth_tool), "
        "w as (select g.ord, g.name as gold, z.pool_size, p, n from g cross join (select unnest([10, 50]) as pool_size) z cross join pr), "
        f"ab as (select *, {h('a', '(p - 1)')} + 1 as a, {h('b', 'p')} as b from w), "
        "dr as (select ord, gold, pool_size, a, b, p, unnest(range(least(p, pool_size + p - n + 1))) as j from ab), "
        "nm as (select dr.ord, pool_size, cat.name, j from dr join cat on cat.idx = (a * j + b) % p where cat.name <> gold), "
        "ot as (select *, row_number() over (partition by ord, pool_size order by j) as r from nm), "
        "al as (select ord, pool_size, name, false as is_gold from ot where r <= pool_size - 1 union all select ord, pool_size, gold, true from w), "
        "pools as (select *, row_number() over (partition by ord, pool_size order by sha256('7|' || pool_size || '|' || ord || '|' || name), name) as pos from al)"
    )


_POOLS = _pools_sql()


@query(f"with {_POOLS} select ord, pool_size, name, pos, is_gold from pools")
def sample_pools(spark, sf_dir, sizes=_SIZES):
    return case_pools(spark, sf_dir, sizes).select("ord", "pool_size", "name", F.col("pos").cast("bigint").alias("pos"), "is_gold")


@query(
    f"with {_POOLS}, {_BM_TOOLS}, k as (select p.ord, p.pool_size, p.name, p.pos, t.rank as gr from pools p left join tr t on t.ord = p.ord and t.tool_name = p.name), "
    "r as (select *, row_number() over (partition by ord, pool_size order by gr nulls last, pos) as rank from k) select ord, pool_size, string_agg(name, '|' order by rank) as ranked from r where rank <= 10 group by all"
)
def filter_after_ranking(spark, sf_dir, sizes=_SIZES):
    """A global ranking cut down to each pool and topped up in pool order."""
    drawn = case_pools(spark, sf_dir, sizes)
    ranked = bm25_tools(spark, sf_dir, 2**31 - 1, drawn).withColumnRenamed("tool_name", "name")
    rows = pipelines.within_pool(ranked, drawn, ["ord"], "name", 10, fill=True)
    return rows.select("ord", "pool_size", F.array_join("ranked", "|").alias("ranked"))


_SCOPED = (
    f"{_POOLS}, {O.M}, pm as (select p.ord as pid, p.pool_size, m.entry_ord, m.query, m.tool_name from pools p join manual_n m on m.tool_name = p.name), "
    "pc as (select distinct p.ord as pid, p.pool_size, c.ord, c.query from pools p join cases c on c.ord = p.ord), "
    + O.bm25_cte("b", "pm", "entry_ord", "query", "pc", "ord", "query", "pid, pool_size")
    + ", h as (select b.ord, b.pool_size, pm.tool_name, b.score, b.entry_ord from b join pm on pm.pid = b.pid and pm.pool_size = b.pool_size and pm.entry_ord = b.entry_ord), "
    + O.tool_rank("tr", "h", "ord, pool_size", "tool_name", "entry_ord")
)


def scoped_tools(spark, sf_dir, k, sizes=_SIZES):
    """Tools of every pool from an index over the pool's manual entries only."""
    drawn = case_pools(spark, sf_dir, sizes)
    return drawn, pipelines.scoped_ranking(read(spark, sf_dir, "cases"), drawn, keyed_manual(spark, sf_dir), k)


@query(f"with {_SCOPED} select ord, pool_size, tool_name, rank, n_hits, score from tr where rank <= 5")
def filter_before_ranking(spark, sf_dir, sizes=_SIZES):
    return scoped_tools(spark, sf_dir, 5, sizes)[1].select("ord", "pool_size", "tool_name", F.col("rank").cast("bigint").alias("rank"), "n_hits", "score")


@query(
    f"with {_SCOPED}, gd as (select ord, pool_size, name as gold from pools where is_gold), f as (select ord, pool_size, arg_min(name, pos) as fallback from pools group by all), "
    "pd as (select gd.*, coalesce(t.tool_name, f.fallback) as predicted from gd join f using (ord, pool_size) left join tr t on t.ord = gd.ord and t.pool_size = gd.pool_size and t.rank = 1) "
    "select pool_size, count(*) as total, count(*) as evaluated, sum((predicted = gold)::int)::bigint as correct, round(avg((predicted = gold)::int), 9) as accuracy from pd group by 1"
)
def evaluate_by_pool_size(spark, sf_dir, sizes=_SIZES):
    """Accuracy of the first tool, or the pool's first without any, by pool size."""
    drawn, tools = scoped_tools(spark, sf_dir, 1, sizes)
    gold = drawn.groupBy("ord", "pool_size").agg(F.array_compact(F.collect_list(F.when(F.col("is_gold"), F.col("name")))).alias("gold"), F.min_by("name", "pos").alias("first"))
    rows = gold.join(tools.select("ord", "pool_size", "tool_name"), ["ord", "pool_size"], "left").withColumn("predicted", F.coalesce("tool_name", "first"))
    flagged = rows.withColumn("is_correct", metrics.is_correct(F.col("predicted"), F.col("gold")))
    return evaluate.summarize(flagged, ["pool_size"]).withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"with {_POOLS}, d as (select p.ord, p.pool_size, p.name, p.pos, c.query, t.name || ' ' || coalesce(t.description, '') || ' ' || coalesce(t.parameters, '') as doc from pools p join cases c on c.ord = p.ord join tools_n t on t.name = p.name), "
    f"o as (select *, {O.overlap(O.tok('query'), O.tok('doc'))} as ov from d), r as (select *, row_number() over (partition by ord, pool_size order by ov desc, pos) as r from o) "
    "select ord, pool_size, case when ov > 0 then name end as selected, round(ov, 9) as overlap from r where r = 1"
)
def select_by_overlap(spark, sf_dir, sizes=_SIZES):
    tools = keyed_tools(spark, sf_dir)
    texts = tools.select("name", manual.terms_of(manual.tool_text(F.col("name"), F.col("description"), F.col("parameters"))).alias("doc"))
    asked = read(spark, sf_dir, "cases").select("ord", manual.terms_of(F.col("query")).alias("terms"))
    rows = case_pools(spark, sf_dir, sizes).join(asked, "ord").join(texts, "name")
    chosen = manual.select_tool(rows, ["ord", "pool_size"], "terms", "doc", "name", "pos")
    return chosen.select("ord", "pool_size", "selected", F.round("overlap", 9).alias("overlap"))


_SIGN = f"case when {O.bucket(chr(39) + 'sign:' + chr(39) + ' || term', 2)} = 0 then 1.0 else -1.0 end"


@query(
    f"with {_POOLS}, docs as (select name, {O.tool_doc()} as document from tools_n), pd as (select ord, pool_size, pos as place, document from pools join docs using (name)), "
    "pq as (select distinct p.ord, p.pool_size, c.query from pools p join cases c using (ord)), "
    f"{O.counts_cte('dc', 'pd', 'ord, pool_size, place', 'document')}, {O.counts_cte('qc', 'pq', 'ord, pool_size', 'query')}, "
    "np as (select ord, pool_size, count(*) as n from pd group by all), idf as (select ord, pool_size, term, ln((any_value(np.n) + 1) / (count(*) + 1)) + 1 as idf from dc join np using (ord, pool_size) group by all), "
    f"dw as (select ord, pool_size, place, {O.bucket('term', 2048)} as idx, sum({_SIGN} * (1 + ln(tf)) * idf) as w from dc join idf using (ord, pool_size, term) group by all), "
    f"qw as (select ord, pool_size, {O.bucket('term', 2048)} as idx, sum({_SIGN} * (1 + ln(tf)) * coalesce(idf, 1.0)) as w from qc left join idf using (ord, pool_size, term) group by all), "
    "dn as (select ord, pool_size, place as pos, sqrt(sum(w * w)) as norm from dw group by all), qn as (select ord, pool_size, sqrt(sum(w * w)) as norm from qw group by all), "
    "sc as (select ord, pool_size, place as pos, sum(dw.w * qw.w) as s from qw join dw using (ord, pool_size, idx) group by all), "
    "sa as (select p.ord, p.pool_size, p.name, p.pos, round(coalesce(s / (dn.norm * qn.norm), 0.0), 9) + 0.0 as score from pools p left join sc using (ord, pool_size, pos) left join dn using (ord, pool_size, pos) left join qn using (ord, pool_size)), "
    "r as (select *, row_number() over (partition by ord, pool_size order by score desc, pos) as rank from sa) select ord, pool_size, name, rank, score from r where rank <= 10"
)
def retrieve_pool_tfidf(spark, sf_dir, sizes=_SIZES):
    """Tools of every pool by the TF-IDF of their documents inside the pool."""
    docs = keyed_tools(spark, sf_dir).select("name", pipelines.tool_document(False).alias("document"))
    rows = pipelines.pool_tfidf_ranking(read(spark, sf_dir, "cases"), case_pools(spark, sf_dir, sizes), docs, 10)
    return rows.select("ord", "pool_size", "name", F.col("rank").cast("bigint").alias("rank"), "score")


for _f in (sample_pools, filter_after_ranking, filter_before_ranking, evaluate_by_pool_size, select_by_overlap):
    # The same over pools of all published sizes.
    _QUERIES[f"{_f.__name__}_scaled"] = partial(_f, sizes=_SCALED_SIZES)
    _SQL[f"{_f.__name__}_scaled"] = _SQL[_f.__name__].replace("[10, 50]", str(list(_SCALED_SIZES)))


@query(f"with {O.M} select entry_ord, tool_name from manual_n m where not exists (select 1 from tools t where {O.key('t.name')} = m.tool_name)")
def join_unknown_tools(spark, sf_dir):
    names = read(spark, sf_dir, "tools").select(T.tool_key("name").alias("tool_name"))
    return keyed_manual(spark, sf_dir).join(names, "tool_name", "left_anti").select("entry_ord", "tool_name")


@query(f"with {O.M} select entry_ord, tool_name from manual_n m where exists (select 1 from tools t where {O.key('t.name')} = m.tool_name)")
def join_known_tools(spark, sf_dir):
    names = read(spark, sf_dir, "tools").select(T.tool_key("name").alias("tool_name"))
    return keyed_manual(spark, sf_dir).join(names, "tool_name", "left_semi").select("entry_ord", "tool_name")


@query(f"with {TOOLS_N} select ord, name from tools_n")
def distinct_tools(spark, sf_dir):
    return keyed_tools(spark, sf_dir).select("ord", "name")


# ---- manuals


def candidates(spark, sf_dir):
    """Manual entries as candidate rows: accepted from a verification score of 0.8."""
    rows = keyed_manual(spark, sf_dir)
    return rows.withColumn("accepted", F.when(F.col("verification_score").isNotNull() & ~F.isnan("verification_score"), F.col("verification_score") >= 0.8))


_CAND = f"cand as (select entry_ord, query, {O.key('tool_name')} as tool_name, case when isnan(verification_score) then null else verification_score >= 0.8 end as accepted from manual)"


@query(f"with {_CAND}, r as (select *, row_number() over (partition by tool_name order by entry_ord) as r from cand where accepted and query <> '') select entry_ord, tool_name from r where r <= 3")
def manual_accepted(spark, sf_dir):
    return manual.accepted_manual(candidates(spark, sf_dir), 3).select("entry_ord", "tool_name")


@query(f"with {_CAND}, h as (select tool_name, count(*) as n from cand where accepted group by 1), {TOOLS_N} select ord, name, 3 - coalesce(n, 0) as needed from tools_n left join h on h.tool_name = name where 3 - coalesce(n, 0) > 0")
def manual_unfinished(spark, sf_dir):
    return manual.unfinished(keyed_tools(spark, sf_dir), candidates(spark, sf_dir), 3).select("ord", "name", "needed")


@query(f"with {_CAND}, p as (select tool_name, count(*) as n, sum(coalesce(accepted, false)::int) as ok from cand group by 1) select count(*) as tools, sum(n)::bigint as proposed, sum(ok)::bigint as accepted, round(sum(ok) / sum(n), 9) as acceptance_rate, round(avg(ok), 9) as accepted_per_tool, round(avg((ok = 0)::int), 9) as zero_rate from p")
def manual_statistics(spark, sf_dir):
    rows = evaluate.construction_stats(candidates(spark, sf_dir))
    return rows.select("tools", "proposed", "accepted", *[F.round(c, 9).alias(c) for c in ("acceptance_rate", "accepted_per_tool", "zero_rate")])


@query(f"with {O.M}, r as (select *, row_number() over (partition by tool_name order by entry_ord) as r from manual_n where tool_name is not null) select tool_name, string_agg(entry_ord::varchar, ',' order by entry_ord) as entries from r where r <= 3 group by 1")
def manual_examples(spark, sf_dir):
    rows = sampling.first_n(keyed_manual(spark, sf_dir).where("tool_name is not null"), "tool_name", ["entry_ord"], 3)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("entry_ord")), lambda x: x.cast("string")), ",")
    return rows.groupBy("tool_name").agg(listed.alias("entries"))


@query("select ord, (row_number() over (order by ord) - 1) // 64 as batch from tools")
def manual_batches(spark, sf_dir):
    placed = sampling.dense_index(read(spark, sf_dir, "tools").select("ord"), ["ord"])
    return placed.select("ord", sampling.chunk_number(F.col("idx"), 64).alias("batch"))


def _generated_sql() -> str:
    def h(suffix: str, n: str) -> str:
        return f"(('0x' || substr(sha256('7|9|' || query_id || '|{suffix}'), 1, 15))::ubigint % {n})::bigint"

    def filled(template: str) -> str:
        text = O.lit(template)
        for mark, value in (("{d}", "d"), ("{n}", "n"), ("{t}", "t")):
            text = f"replace({text}, '{mark}', {value})" if mark in template else text
        return text

    templates = "[" + ", ".join(filled(t) for t in manual.TEMPLATES) + "]"
    texts = [f"{O.tok(f'coalesce({c}, {chr(39) * 2})')}" for c in ("name", "description", "parameters")]
    return (
        f"{TOOLS_N}, tt as (select ord, {' || '.join(texts)} as tk from tools_n), te as (select ord, unnest(tk) as term, unnest(range(len(tk))) as pos from tt), "
        "tc as (select ord, term, count(*) as n, min(pos) as f from te group by all), tp as (select *, row_number() over (partition by ord order by n desc, f) as place from tc), "
        "tm as (select ord, string_agg(term, ' ' order by place) as main from tp where place <= 3 group by 1), "
        "tv as (select ord, name, regexp_replace(coalesce(description, ''), '\\.+$', '') as d, replace(coalesce(name, ''), '_', ' ') as n, coalesce(main, replace(coalesce(name, ''), '_', ' ')) as t from tools_n left join tm using (ord)), "
        f"tq as (select ord, name, unnest({templates}) as query, unnest(range({len(manual.TEMPLATES)})) as query_no from tv), pq as (select *, ord || ':' || query_no as query_id from tq), "
        "cat as (select row_number() over (order by ord) - 1 as idx, name from tools_n), nn as (select count(*) as n from cat), "
        "pr as (select n, (select min(p) from (select unnest(range(greatest(n, 2), n * 2 + 10)) as p) where not exists (select 1 from (select unnest(range(2, 2000)) as d) where d * d <= p and p % d = 0)) as p from nn), "
        f"ab as (select query_id, name as gold, p, n, {h('a', '(p - 1)')} + 1 as a, {h('b', 'p')} as b from pq cross join pr), "
        "dr as (select query_id, gold, a, b, p, unnest(range(least(p, 9 + p - n + 1))) as j from ab), nm as (select query_id, cat.name, j from dr join cat on cat.idx = (a * j + b) % p where cat.name <> gold), "
        "ot as (select *, row_number() over (partition by query_id order by j) as r from nm), al as (select query_id, name from ot where r <= 8 union all select query_id, name from pq), "
        "pl as (select *, row_number() over (partition by query_id order by sha256('7|9|' || query_id || '|' || name), name) as pos from al), "
        f"dq as (select query_id, {O.tok('query')} as qt from pq), dd as (select name, {O.tok('concat_ws(chr(32), coalesce(name, chr(39) || chr(39)), coalesce(description, repeat(chr(32), 0)), coalesce(parameters, repeat(chr(32), 0)))')} as dt from tools_n), "
        f"ov as (select query_id, name, pos, {O.overlap('qt', 'dt')} as ov from pl join dq using (query_id) join dd using (name)), "
        "ch as (select *, row_number() over (partition by query_id order by ov desc, pos) as r from ov), "
        "made as (select q.ord, q.name, q.query_no::int as query_no, q.query, q.query_id, case when c.ov > 0 then c.name end as verifier_choice from pq q left join ch c on c.query_id = q.query_id and c.r = 1)"
    )


@query(
    f"with {_generated_sql()} select *, coalesce(verifier_choice = name, false) as accepted, "
    "case when coalesce(verifier_choice = name, false) then null when verifier_choice is null then 'no_choice' else 'other_tool' end as rejection_reason from made"
)
def manual_generated(spark, sf_dir):
    """Template queries of every tool, verified against eight distractors each."""
    tools = keyed_tools(spark, sf_dir)
    catalogue = sampling.dense_index(tools.select("ord", "name"), ["ord"]).select("idx", "name")
    proposed = manual.template_queries(tools).withColumn("query_id", F.concat_ws(":", "ord", "query_no"))
    return manual.verify_queries(proposed, tools, catalogue)


# ---- catalogues from sheets


@query(
    "with s as (select entry_ord as ord, source as sheet, case when entry_ord % 3 = 1 then trim(coalesce(tool_name, '')) else '' end as name, coalesce(trim(query), '') as q from manual), "
    "c as (select *, last_value(case when name not in ('', 'none', 'nan') then ord end ignore nulls) over (partition by sheet order by ord) as t from s) "
    "select sheet, t as ord, count(distinct case when q not in ('', 'none', 'nan') then q end) as n_parameters from c where t is not null group by all"
)
def convert_fill_forward(spark, sf_dir):
    """Manual rows read as sheets by source: every third row begins a tool, the others go on."""
    out = _sheet_tools(spark, sf_dir)
    return out.select(F.when(F.col("sheet") != "~", F.col("sheet")).alias("sheet"), "ord", F.size("parameters").cast("bigint").alias("n_parameters"))


def _sheet_tools(spark, sf_dir):
    rows = read(spark, sf_dir, "manual").select(
        F.coalesce("source", F.lit("~")).alias("sheet"), F.col("entry_ord").alias("ord"), F.when(F.col("entry_ord") % 3 == 1, F.col("tool_name")).alias("action_name"),
        F.col("query").alias("action_description"), F.col("query").alias("input_name"), F.lit("Integer").alias("input_type"), F.col("source").alias("input_description"),
    )
    return convert.fill_forward_tools(rows, "sheet")


@query(
    f"with s as (select ord, {O.cleaned('category')} as module, {O.cleaned('description')} as label, {O.cleaned('regexp_replace(name, ' + O.lit('[^A-Za-z0-9]') + ', ' + O.lit('') + ', ' + O.lit('g') + ')')} as nm, {O.key('name')} as signal, name as raw from tools), "
    "u as (select * from s where signal is not null and lower(signal) not in ('none', 'nan') and signal <> ''), "
    "g as (select *, case when raw is not null then [regexp_extract('boolean get' || regexp_replace(raw, '[^A-Za-z0-9]', '', 'g') || '(', 'boolean (get[A-Za-z_]\\w*)\\(', 1)] else [] end as getter from u), "
    "d as (select signal, ord, label, getter, case when module <> '' and label <> '' then '查询' || module || '模块的' || label || '。' when label <> '' then '查询' || label || '。' else '' end || 'VSpec类型：boolean。' || "
    "case when len(getter) > 0 and getter[1] <> '' then '北向查询API：' || getter[1] || '。' else '' end as text from g), "
    "t as (select signal, text, min(ord) as ord from d group by all), tools_s as (select signal as name, min(ord) as ord, string_agg(text, ' ' order by ord, text) as description from t group by 1), "
    "f as (select signal, label, row_number() over (partition by signal order by ord) as r from d where len(getter) > 0 and getter[1] <> ''), "
    "l as (select signal, case when label = '' then '该状态' else label end as label from f where r = 1) "
    "select t.ord, t.name, t.description, case when l.signal is null then '[]' else json_array(json_object('name', 'zoneId', 'type', 'string', 'description', 'DoorZone zoneId，用于指定查询' || l.label || '时的车辆区域或位置。'), "
    "json_object('name', 'level', 'type', 'integer', 'description', 'int level，用于指定查询' || l.label || '时的车辆区域或位置。'))::varchar end as parameters from tools_s t left join l on l.signal = t.name"
)
def convert_signals(spark, sf_dir):
    """Tools as signals whose getter takes a zone."""
    api = F.concat(F.lit("boolean get"), F.regexp_replace("name", "[^A-Za-z0-9]", ""), F.lit("(@NonNull DoorZone zoneId, int level)"))
    rows = read(spark, sf_dir, "tools").select(
        "ord", F.col("category").alias("module"), F.col("description").alias("signal_label"), api.alias("api"), F.lit(None).cast("string").alias("value_range"),
        T.tool_key("name").alias("signal"), F.lit("boolean").alias("signal_type"), F.lit(None).cast("string").alias("prop_id"),
    )
    return convert.signal_tools(rows).withColumn("parameters", F.to_json("parameters"))


@query("select p_partkey, case when regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') in ('int', 'integer', 'long') then 'integer' when regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') in ('float', 'double', 'number', 'decimal') then 'number' else 'string' end as kind, trim(p_name) as name from part")
def convert_value_types(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.value_type("p_type").alias("kind"), T.clean_text("p_name").alias("name"))


@query(
    f"with s as (select entry_ord as ord, source as sheet, case when entry_ord % 3 = 1 then {O.cleaned('tool_name')} else '' end as name, {O.cleaned('query')} as q, {O.cleaned('source')} as d from manual), "
    "c as (select *, last_value(case when name <> '' then ord end ignore nulls) over (partition by sheet order by ord) as t from s), "
    "p as (select sheet, t, q, d, ord, row_number() over (partition by sheet, t, q order by ord) as r from c where t is not null and q <> ''), "
    "l as (select sheet, t, string_agg(q || ' integer ' || d, '|' order by ord) as parameters, count(*) as n from p where r = 1 group by all) "
    "select c.sheet, c.t as ord, c.name, c.q as description, coalesce(l.parameters, '') as parameters from c left join l on l.sheet is not distinct from c.sheet and l.t = c.t where c.ord = c.t"
)
def convert_sheets(spark, sf_dir):
    """As ``convert_fill_forward`` with the tools' names and descriptions and all their parameters."""
    out = _sheet_tools(spark, sf_dir)
    listed = F.array_join(F.transform("parameters", lambda x: F.concat_ws(" ", x["name"], x["type"], x["description"])), "|")
    return out.select(F.when(F.col("sheet") != "~", F.col("sheet")).alias("sheet"), "ord", "name", "description", listed.alias("parameters"))


# ---- evaluation


def judged(spark, sf_dir):
    """Ranked tools of the logged requests that have gold, a third of the tools by the hash of their names, as the SQL states it.

    Requests without such a tool are left out; ``scored`` has all requests and takes gold from the data.
    """
    hits = read(spark, sf_dir, "hits").where("tool_name is not null and score > 0 and score < double('infinity')")
    best = hits.groupBy("qid", T.tool_key("tool_name").alias("tool")).agg(F.max("score").alias("score"))
    ranked = ranking.ranked_lists(ranking.top_k(best, ["qid"], ranking.by_score("tool"), 50), ["qid"], "tool")
    odd = F.pmod(T.hash_bucket(F.col("tool"), 1000), F.lit(3)) == 0
    gold = best.where(odd).groupBy("qid").agg(F.sort_array(F.collect_set("tool")).alias("gold"))
    return ranked.join(gold, "qid")


_JUDGED = (
    "best as (select qid, " + O.key("tool_name") + " as tool, max(score) as score from hits where tool_name is not null and isfinite(score) and score > 0 group by all), "
    "rk as (select *, row_number() over (partition by qid order by score desc, tool) as r from best), rl as (select qid, list(tool order by r) as ranked from rk where r <= 50 group by 1), "
    f"gl as (select qid, list(tool order by tool) as gold from best where {O.bucket('tool', 1000)} % 3 = 0 group by 1), judged as (select * from rl join gl using (qid))"
)
_METRICS = O.metrics_sql("ranked", "gold")


@query(f"with {_JUDGED} select qid, " + ", ".join(f"round({e}, 9) as {n}" for n, e in _METRICS.items()) + " from judged")
def evaluate_rankings(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.select("qid", *[F.round(m, 9).alias(n) for n, m in metrics.all_metrics(F.col("ranked"), F.col("gold")).items()])


@query(
    f"with {_JUDGED}, m as (select len(gold) as g, " + ", ".join(f"{e} as {n}" for n, e in _METRICS.items()) + " from judged), s as (select 'all' as stratum, * from m union all select case when g = 1 then 'single' else 'multi' end, * from m) "
    "select stratum, count(*) as count, " + ", ".join(f"round(avg({n}), 9) as {n}" for n in _METRICS) + " from s group by 1"
)
def evaluate_strata(spark, sf_dir):
    rows = evaluate.ranking_report(judged(spark, sf_dir), "ranked", "gold", "gold")
    return rows.select("stratum", "count", *[F.round(n, 9).alias(n) for n in _METRICS])


def scored(spark, sf_dir):
    """Ranked tools of every logged request and its gold: the tools of hits that score 0.9 or more. Without any, ranking or gold is empty."""
    hits = read(spark, sf_dir, "hits").where("qid is not null")
    valid = hits.where("tool_name is not null and score > 0 and score < double('infinity')")
    best = valid.groupBy("qid", T.tool_key("tool_name").alias("tool")).agg(F.max("score").alias("score"))
    ranked = ranking.ranked_lists(ranking.top_k(best, ["qid"], ranking.by_score("tool"), 50), ["qid"], "tool")
    gold = best.where("score >= 0.9").groupBy("qid").agg(F.sort_array(F.collect_set("tool")).alias("gold"))
    rows = hits.select("qid").distinct().join(ranked, "qid", "left").join(gold, "qid", "left")
    none = F.array().cast("array<string>")
    return rows.select("qid", F.coalesce("ranked", none).alias("ranked"), F.coalesce("gold", none).alias("gold"))


_SCORED = (
    "best as (select qid, " + O.key("tool_name") + " as tool, max(score) as score from hits where tool_name is not null and isfinite(score) and score > 0 group by all), "
    "rk as (select *, row_number() over (partition by qid order by score desc, tool) as r from best), rl as (select qid, list(tool order by r) as ranked from rk where r <= 50 group by 1), "
    "gl as (select qid, list(tool order by tool) as gold from best where score >= 0.9 group by 1), "
    "scored as (select q.qid, coalesce(ranked, []) as ranked, coalesce(gold, []) as gold from (select distinct qid from hits where qid is not null) q left join rl using (qid) left join gl using (qid))"
)
_SCORED_METRICS = {n: f"case when len(gold) = 0 then 0.0 else {e} end" if n.startswith("recall") else e for n, e in _METRICS.items()}


@query(f"with {_SCORED} select qid, " + ", ".join(f"round({e}, 9) as {n}" for n, e in _SCORED_METRICS.items()) + " from scored")
def evaluate_scored_rankings(spark, sf_dir):
    """The metrics of every logged request, those without gold included."""
    rows = scored(spark, sf_dir)
    return rows.select("qid", *[F.round(m, 9).alias(n) for n, m in metrics.all_metrics(F.col("ranked"), F.col("gold")).items()])


@query(
    f"with {_SCORED}, m as (select len(gold) as g, " + ", ".join(f"{e} as {n}" for n, e in _SCORED_METRICS.items()) + " from scored where len(gold) > 0), s as (select 'all' as stratum, * from m union all select case when g = 1 then 'single' else 'multi' end, * from m) "
    "select stratum, count(*) as count, " + ", ".join(f"round(avg({n}), 9) as {n}" for n in _METRICS) + " from s group by 1"
)
def evaluate_scored_strata(spark, sf_dir):
    """The report over all logged requests; by its rule those without gold are in no stratum."""
    rows = evaluate.ranking_report(scored(spark, sf_dir), "ranked", "gold", "gold")
    return rows.select("stratum", "count", *[F.round(n, 9).alias(n) for n in _METRICS])


@query(
    f"with a as (select qid, hit_id as o, score > 0.5 as f from hits), l as (select qid, arg_max(f, o) as a_f from (select distinct qid, o, f from a) group by 1), "
    "m as (select qid, max(o) as o from a group by 1), la as (select m.qid, any_value(a.f) as f from m join a on a.qid = m.qid and a.o = m.o group by 1), "
    "b as (select distinct qid, hit_id, score > 0.7 as f from hits) select b.qid, la.f as a_flag, count(*) as n, sum(coalesce(b.f, false)::int)::bigint as b_true from b join la using (qid) group by all"
)
def evaluate_compare(spark, sf_dir):
    """Two runs over the log by request: the last row of the one, all rows of the other."""
    hits = read(spark, sf_dir, "hits")
    a = hits.select("qid", "hit_id", (F.col("score") > 0.5).alias("flag")).distinct()
    b = hits.select("qid", "hit_id", (F.col("score") > 0.7).alias("flag")).distinct()
    both = evaluate.compare_runs(a, b.drop("hit_id"), ["qid"], "hit_id", "flag")
    return both.groupBy("qid", "a_flag").agg(F.count("*").alias("n"), F.count_if(F.coalesce("b_flag", F.lit(False))).alias("b_true"))


@query("with m as (select event_type, avg(value) as v from events group by 1), b as (select avg(value) as v from events where event_type = (select min(event_type) from events)) select m.event_type, round(b.v / m.v, 9) as value_ratio from m, b")
def evaluate_compression(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "value")
    first = events.agg(F.min("event_type").alias("first"))
    rows = events.join(F.broadcast(first))
    base = rows.where("event_type = first").agg(F.avg("value").alias("_v"))
    means = rows.groupBy("event_type").agg(F.avg("value").alias("value"))
    return means.join(F.broadcast(base)).select("event_type", F.round(F.try_divide(F.col("_v"), F.col("value")), 9).alias("value_ratio"))


FLAGSHIP = retrieve_bm25_tools


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
