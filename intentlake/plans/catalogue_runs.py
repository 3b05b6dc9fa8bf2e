"""Registered queries of whole runs, of resumable builds, and of files that are written in a published shape and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.functions import metrics
from intentlake.functions import text as T
from intentlake.operators import evaluate, manual, ranking, tasks
from intentlake.plans import catalogue as C
from intentlake.plans import oracle as O
from intentlake.plans import pipelines, runners
from intentlake.plans.catalogue import query, read
from intentlake.session import shared_folder
from intentlake.sources import readers, sinks
from intentlake.streaming import usage

_POOLS = C._POOLS


def scaled_samples(spark, sf_dir) -> DataFrame:
    """A scaled benchmark over pools of 10 and 50, written as JSON lines and read back."""
    drawn = C.case_pools(spark, sf_dir)
    folder = shared_folder(spark, "scaled")
    sinks.write_lines(sinks.scaled_rows(drawn, read(spark, sf_dir, "cases"), C.keyed_tools(spark, sf_dir)), folder)
    return readers.read_samples(spark, folder)


@query(f"with {_POOLS} select p.ord::varchar as sample_id, p.pool_size as candidate_size, coalesce(any_value(c.query), '') as query, count(*) as n_tools, string_agg(name, '|' order by pos) as tools, string_agg(case when is_gold then name end, '|' order by name) as correct from pools p join cases c on c.ord = p.ord group by 1, 2")
def source_samples(spark, sf_dir):
    """The samples that come back from a scaled benchmark's file."""
    rows = scaled_samples(spark, sf_dir)
    names = F.transform("tools", lambda t: t["name"])
    return rows.select(
        "sample_id", "candidate_size", F.coalesce("query", F.lit("")).alias("query"), F.size("tools").cast("bigint").alias("n_tools"), F.array_join(names, "|").alias("tools"),
        F.array_join("correct_tools", "|").alias("correct"),
    )


def _predictions(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("sample_id").cast("bigint").alias("ord"), F.col("candidate_size").alias("pool_size"), "predicted", "is_correct", F.array_join("retrieved", "|").alias("retrieved"), "setting"
    )


_CHOICE = (
    f"qt as (select ord, {O.tok('query')} as qk from cases), dt as (select name, {O.tok('name || chr(32) || coalesce(description, repeat(chr(32), 0)) || chr(32) || coalesce(parameters, repeat(chr(32), 0))')} as dk from tools_n), "
    f"ov as (select r.*, {O.overlap('qk', 'dk')} as ov from ranked r join qt using (ord) join dt using (name)), "
    "ch as (select *, row_number() over (partition by ord, pool_size order by ov desc, rank) as cr from ov), "
    "fi as (select ord, pool_size, max(case when rank = 1 then name end) as first, string_agg(name, '|' order by rank) as retrieved from ranked group by all), "
    "pf as (select ord, pool_size, arg_min(name, pos) as pool_first, max(case when is_gold then name end) as gold from pools group by all), "
    "pr_out as (select pf.ord, pf.pool_size, coalesce(case when ch.ov > 0 then ch.name end, fi.first, pool_first) as predicted, gold, coalesce(retrieved, pool_first) as retrieved from pf left join fi using (ord, pool_size) left join ch on ch.ord = pf.ord and ch.pool_size = pf.pool_size and ch.cr = 1)"
)
_OUT = "select ord, pool_size, predicted, predicted = gold as is_correct, retrieved, '{}' as setting from pr_out"

_PROXY = (
    f"{_POOLS}, {O.M}, pe as (select p.ord, p.pool_size, m.entry_ord as place, m.query as document, m.tool_name from pools p join manual_n m on m.tool_name = p.name), "
    "pq as (select distinct p.ord, p.pool_size, c.query from pools p join cases c using (ord)), "
    f"{O.counts_cte('dc', 'pe', 'ord, pool_size, place', 'document')}, {O.counts_cte('qc', 'pq', 'ord, pool_size', 'query')}, "
    "np as (select ord, pool_size, count(*) as n from pe group by all), idf as (select ord, pool_size, term, ln((any_value(np.n) + 1) / (count(*) + 1)) + 1 as idf from dc join np using (ord, pool_size) group by all), "
    f"dw as (select ord, pool_size, place, {O.bucket('term', 2048)} as idx, sum({C._SIGN} * (1 + ln(tf)) * idf) as w from dc join idf using (ord, pool_size, term) group by all), "
    f"qw as (select ord, pool_size, {O.bucket('term', 2048)} as idx, sum({C._SIGN} * (1 + ln(tf)) * coalesce(idf, 1.0)) as w from qc left join idf using (ord, pool_size, term) group by all), "
    "dn as (select ord, pool_size, place, sqrt(sum(w * w)) as norm from dw group by all), qn as (select ord, pool_size, sqrt(sum(w * w)) as norm from qw group by all), "
    "sc as (select ord, pool_size, place, round(sum(dw.w * qw.w) / (any_value(dn.norm) * any_value(qn.norm)), 9) as score from qw join dw using (ord, pool_size, idx) join dn using (ord, pool_size, place) join qn using (ord, pool_size) where dn.norm > 0 and qn.norm > 0 group by ord, pool_size, place), "
    "tp as (select *, row_number() over (partition by ord, pool_size order by score desc, place) as spot from sc), "
    "h as (select t.ord, t.pool_size, m.tool_name, t.score, t.spot from tp t join manual_n m on m.entry_ord = t.place where t.spot <= 20 and t.score > 0), "
    + O.tool_rank("tr", "h", "ord, pool_size", "tool_name", "spot")
    + ", ranked as (select ord, pool_size, tool_name as name, rank from tr where rank <= 5)"
)


@query(f"with {_PROXY}, {_CHOICE} " + _OUT.format("manual"))
def run_proxy(spark, sf_dir):
    """A scaled benchmark run by the pools' manual queries, the tool chosen among five."""
    return _predictions(runners.run(scaled_samples(spark, sf_dir), C.keyed_manual(spark, sf_dir), "proxy", 5))


@query(f"with {_POOLS}, ranked as (select ord, pool_size, name, pos as rank from pools), {_CHOICE} " + _OUT.format("raw"))
def run_full_context(spark, sf_dir):
    """A scaled benchmark run without retrieval, the tool chosen among the whole pool."""
    return _predictions(runners.run(scaled_samples(spark, sf_dir), C.keyed_manual(spark, sf_dir), "full_context"))


def _document_run(generated: bool) -> str:
    bare = "concat_ws(chr(10), 'TOOL_NAME: ' || coalesce(name, ''), 'CATEGORY: ', 'DESCRIPTION: ' || coalesce(description, ''), case when parameters is not null and trim(parameters) not in ('', '{}', '[]', 'null') then 'PARAMETERS_SCHEMA: ' || parameters end)"
    asked = "asked as (select tool_name as name, string_agg('- ' || query, chr(10) order by entry_ord) as q from manual_n where query <> '' group by 1)"
    docs = f"docs as (select name, {bare}" + (" || coalesce(chr(10) || 'GENERATED_QUERIES:' || chr(10) || q, '')" if generated else "") + " as document from tools_n" + (" left join asked using (name))" if generated else ")")
    return (
        f"{_POOLS}, {O.M}, {asked}, {docs}, pd as (select p.ord as pid, p.pool_size, p.name as dname, d.document from pools p join docs d using (name)), "
        "pq as (select distinct p.ord as pid, p.pool_size, c.ord, c.query from pools p join cases c using (ord)), "
        + O.bm25_cte("b", "pd", "dname", "document", "pq", "ord", "query", "pid, pool_size")
        + ", sa as (select p.ord, p.pool_size, p.name, p.pos, coalesce(b.score, 0.0) as score from pools p left join b on b.ord = p.ord and b.pool_size = p.pool_size and b.dname = p.name), "
        "rk as (select *, row_number() over (partition by ord, pool_size order by score desc, pos) as rank from sa), ranked as (select ord, pool_size, name, rank from rk where rank <= 5), "
        "po as (select ord, pool_size, max(case when rank = 1 then name end) as predicted, string_agg(name, '|' order by rank) as retrieved from ranked group by all), "
        "gl as (select ord, pool_size, name as gold from pools where is_gold), pr_out as (select po.*, gold from po join gl using (ord, pool_size))"
    )


@query(f"with {_document_run(False)} " + _OUT.format("raw"))
def run_bm25(spark, sf_dir):
    """A scaled benchmark run by BM25 of the candidates' documents; the first is predicted."""
    return _predictions(runners.run(scaled_samples(spark, sf_dir), C.keyed_manual(spark, sf_dir), "bm25", 5, choose=False))


@query(f"with {_document_run(True)} " + _OUT.format("query_augmented"))
def run_bm25_query_augmented(spark, sf_dir):
    """As ``run_bm25`` with the manual's queries in the documents."""
    return _predictions(runners.run(scaled_samples(spark, sf_dir), C.keyed_manual(spark, sf_dir), "bm25_query_augmented", 5, choose=False))


@query(
    f"with {_POOLS}, {C._BM_TOOLS}, k as (select p.ord, p.pool_size, p.name, p.pos, t.rank as gr from pools p join tr t on t.ord = p.ord and t.tool_name = p.name), "
    "r as (select *, row_number() over (partition by ord, pool_size order by gr, pos) as rank from k) select ord, pool_size, string_agg(name, '|' order by rank) as ranked from r where rank <= 10 group by all"
)
def filter_after_ranking_bare(spark, sf_dir):
    """A global ranking cut down to each pool and not topped up."""
    drawn = C.case_pools(spark, sf_dir)
    ranked = C.bm25_tools(spark, sf_dir, 2**31 - 1, drawn).withColumnRenamed("tool_name", "name")
    rows = pipelines.within_pool(ranked, drawn, ["ord"], "name", 10, fill=False)
    return rows.select("ord", "pool_size", F.array_join("ranked", "|").alias("ranked"))


# ---- resumable builds


def stand_in_model(rows: list[dict]) -> list[list[str]]:
    """A model for tests: numbered requests; it fails for batches that hold a tool whose ordinal is a multiple of 50."""
    if any(r["ord"] % 50 == 0 for r in rows):
        raise ValueError("no answer")
    return [[f"{r['name']} request {i}" for i in range(r["needed"])] for r in rows]


@query(
    f"with {C._CAND}, {C.TOOLS_N}, h as (select tool_name, count(*) as n, count_if(query <> '') as said from cand where accepted and tool_name is not null group by 1), "
    "t as (select ord, name, greatest(0, 3 - coalesce(n, 0)) as needed from tools_n left join h on h.tool_name = name), "
    "old as (select tool_name, query, row_number() over (partition by tool_name order by entry_ord) as r from cand where accepted and query <> '' and tool_name in (select name from tools_n)), "
    "made as (select name as tool_name, name || ' request ' || i as query from (select *, unnest(range(needed)) as i from t where ord % 50 <> 0)) "
    "select tool_name, query from old where r <= 3 union all select m.tool_name, m.query from made m"
)
def manual_refilled(spark, sf_dir):
    """A manual whose accepted entries are three for each tool, what was missing asked from a stand-in model in one round, batches of one tool."""
    tools = C.keyed_tools(spark, sf_dir).select("ord", "name", "description", "parameters")
    folder = shared_folder(spark, "build")
    # What an earlier run left: the accepted entries of the manual as round 1.
    known = C.candidates(spark, sf_dir).where("accepted").join(tools.select(F.col("name").alias("tool_name")), "tool_name", "left_semi")
    # The log keeps a row for each entry, in the order of the manual.
    rows = known.select(
        F.lit(1).alias("round"), F.format_string("%019d", "entry_ord").alias("query_id"), F.col("entry_ord").alias("ord"), "tool_name", "query", "accepted",
        F.lit(None).cast("string").alias("verifier_choice"), F.lit(None).cast("string").alias("rejection_reason"), F.lit(None).cast("string").alias("error"),
    )
    rows.write.mode("append").parquet(folder)
    return manual.build(tools, folder, stand_in_model, 3, 1, None, 1).select("tool_name", "query")


# ---- files


@query("select row_number() over (order by ord) as ord, name, coalesce(description, '') as description, coalesce(parameters, '{}') as parameters, category from tools")
def source_tools(spark, sf_dir):
    """The catalogue as a JSON object, written and read back."""
    path = shared_folder(spark, "tools") + ".json"
    sinks.write_json_object(read(spark, sf_dir, "tools").select("ord", "name", "description", "parameters", "category"), path, "tools", "ord")
    return readers.read_tools(spark, path)


@query("select row_number() over (order by entry_ord) as entry_ord, query, tool_name, coalesce(source, 'synthetic') as source, round(case when isnan(verification_score) then 1.0 else coalesce(verification_score, 1.0) end, 6) as verification_score from manual")
def source_manual(spark, sf_dir):
    """The manual as a JSON object, written and read back; a score that isn't a number has no JSON form and is left out."""
    path = shared_folder(spark, "manual") + ".json"
    rows = read(spark, sf_dir, "manual").withColumn("verification_score", F.when(~F.isnan("verification_score"), F.col("verification_score")))
    sinks.write_json_object(rows.select("entry_ord", "query", "tool_name", "source", "verification_score"), path, "manual", "entry_ord")
    return readers.read_manual(spark, path).withColumn("verification_score", F.round("verification_score", 6))


@query("select row_number() over (order by ord) as ord, query, ground_truth_tool from cases")
def source_cases(spark, sf_dir):
    path = shared_folder(spark, "cases") + ".json"
    sinks.write_json_object(read(spark, sf_dir, "cases").select("ord", "query", "ground_truth_tool"), path, "cases", "ord")
    return readers.read_cases(spark, path)


@query("select tool_name as name, trim(query) as query, count(*) as n from manual where tool_name <> '' and trim(query) <> '' group by all")
def source_generated_queries(spark, sf_dir):
    """The manual's queries as JSON lines, written and read back."""
    folder = shared_folder(spark, "queries.jsonl")
    sinks.write_lines(read(spark, sf_dir, "manual").select("tool_name", "query"), folder)
    return readers.read_generated_queries(spark, folder).groupBy("name", "query").agg(F.count("*").alias("n"))


@query("select name, concat_ws(chr(10), nullif(trim(name), ''), nullif(trim(category), ''), nullif(trim(regexp_replace(description, '^\\s+|\\s+$', '', 'g')), '')) as description from tools")
def source_pool(spark, sf_dir):
    """Tools as lines of a skill pool, with their descriptions as bodies."""
    folder = shared_folder(spark, "pool.jsonl")
    rows = read(spark, sf_dir, "tools").select(F.col("name").alias("skill_id"), "name", F.col("category").alias("description"), F.col("description").alias("body"))
    sinks.write_lines(rows, folder)
    return readers.read_pool(spark, folder).select("name", "description")


@query("with u as (select 'stage' || (hit_id % 3) as stage, coalesce(tool_name, '?') as model, hit_id % 7 as tokens from hits) select stage, model, 2 * count(*) as calls, 2 * sum(tokens)::bigint as prompt_tokens from u group by all")
def sink_usage(spark, sf_dir):
    """The hits as a usage log that two writers append to, summed up."""
    path = shared_folder(spark, "usage")
    rows = read(spark, sf_dir, "hits").select(
        F.concat(F.lit("stage"), F.col("hit_id") % 3).alias("stage"), F.coalesce("tool_name", F.lit("?")).alias("model"), F.lit(1.5).alias("latency_ms"), (F.col("hit_id") % 7).alias("prompt_tokens")
    )
    for _ in range(2):
        usage.append_usage(rows, path)
    return usage.summarize_usage(usage.read_usage(spark, path)).select("stage", "model", "calls", "prompt_tokens")


def stand_in_embedder(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("select doc_id, length(text)::double as characters, len(string_split(text, ' '))::double as words from documents")
def sink_vectors(spark, sf_dir):
    """Vectors of all documents through the cache: the first half computed by an earlier run, each text once."""
    cache = sinks.VectorCache(spark, shared_folder(spark, "vectors"), "stand-in:2")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cache.vectors(docs.where("doc_id % 2 = 0"), "text", stand_in_embedder)
    rows = cache.vectors(docs, "text", stand_in_embedder)
    return rows.select("doc_id", F.col("vector")[0].alias("characters"), F.col("vector")[1].alias("words"))


# ---- evaluation with grades


def _graded_sql() -> str:
    def dcg(values: str, k: int) -> str:
        return f"coalesce(list_sum(list_transform({values}[1:{k}], lambda x, i: x / log2(i + 1))), 0.0)"

    at = {k: f"coalesce({dcg('got', k)} / nullif({dcg('list_reverse_sort(map_values(grades))', k)}, 0), 0.0)" for k in (1, 3, 10)}
    return (
        "best as (select qid, " + O.key("tool_name") + " as tool, max(score) as score, count(*) as n from hits where tool_name is not null and isfinite(score) and score > 0 group by all), "
        "rk as (select *, row_number() over (partition by qid order by n desc, tool) as r from best), rl as (select qid, list(tool order by r) as ranked from rk where r <= 50 group by 1), "
        "gr as (select qid, map(list(tool order by tool), list(case when score >= 0.95 then 2.0 else 1.0 end order by tool)) as grades from best where score >= 0.9 group by 1), "
        "jd as (select *, list_transform(ranked, lambda x: coalesce(map_extract_value(grades, x), 0.0)) as got from rl join gr using (qid)) "
        "select qid, " + ", ".join(f"round({e}, 9) as ndcg_{k}" for k, e in at.items()) + " from jd"
    )


@query(f"with {_graded_sql()}")
def evaluate_graded(spark, sf_dir):
    """Graded relevance of the logged requests' tools ranked by number of hits: 2 from a score of 0.95, 1 from 0.9; requests with any grade."""
    hits = read(spark, sf_dir, "hits").where("qid is not null and tool_name is not null and score > 0 and score < double('infinity')")
    best = hits.groupBy("qid", T.tool_key("tool_name").alias("tool")).agg(F.max("score").alias("best"), F.count("*").alias("score"))
    ranked = ranking.ranked_lists(ranking.top_k(best, ["qid"], ranking.by_score("tool"), 50), ["qid"], "tool")
    grade = F.when(F.col("best") >= 0.95, 2.0).otherwise(1.0)
    grades = best.where("best >= 0.9").groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", grade.alias("g"))))).alias("grades"))
    rows = ranked.join(grades, "qid")
    found = metrics.all_metrics(F.col("ranked"), F.map_keys("grades"), F.col("grades"))
    return rows.select("qid", *[F.round(found[n], 9).alias(n) for n in ("ndcg_1", "ndcg_3", "ndcg_10")])


@query(
    "with h as (select qid, tool_name, case when score is null or isnan(score) then null else score >= 0.5 end as good, case when isfinite(score) then score end as s from hits) "
    "select tool_name, count(*) as count, round(avg(good::int), 9) as good, round(avg(s), 6) as s from h group by 1"
)
def evaluate_runs(spark, sf_dir):
    """Rates and means by tool name over the logged hits, values that are missing left out of each."""
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    rows = read(spark, sf_dir, "hits").select("tool_name", F.when(~F.isnan("score"), F.col("score") >= 0.5).alias("good"), finite.alias("s"))
    return evaluate.summarize_runs(rows, ["tool_name"], ["good"], ["s"]).select("tool_name", "count", F.round("good", 9).alias("good"), F.round("s", 6).alias("s"))


# ---- routing tasks, bodies and digests


def _relevance(spark, sf_dir) -> DataFrame:
    """Relevance entries of the cases that have a tool: the tool is gold, and core gold for even ordinals."""
    cases = C.keyed_cases(spark, sf_dir).where("ground_truth_tool is not null")
    gold = F.array("ground_truth_tool")
    return cases.select(
        F.col("ord").cast("string").alias("task_id"), gold.alias("gt_skill_ids"), F.when(F.col("ord") % 2 == 0, gold).alias("core_gt_ids"),
        F.create_map("ground_truth_tool", F.lit(2.0)).alias("relevance"), F.when(F.col("ord") % 5 == 0, "generic_only").alias("task_type"),
    )


@query(
    f"with {C.TOOLS_N}, {C.CASES_N} select c.ord::varchar as task_id, coalesce(c.ground_truth_tool, '') as gold_all, coalesce(t.name, '') as gold, case when t.name is not null then 2.0::double end as grade "
    "from cases_n c left join tools_n t on t.name = c.ground_truth_tool where c.ord % 5 <> 0 or c.ground_truth_tool is null"
)
def task_gold(spark, sf_dir):
    """The core tasks with their gold, whole and inside the pool, and its grade."""
    asked = read(spark, sf_dir, "cases").select(F.col("ord").cast("string").alias("task_id"))
    rows = tasks.task_gold(asked, _relevance(spark, sf_dir), C.keyed_tools(spark, sf_dir))
    grade = F.try_element_at(F.map_values("grades"), F.lit(1))
    return rows.select("task_id", F.array_join("gold_all", "|").alias("gold_all"), F.array_join("gold", "|").alias("gold"), grade.alias("grade"))


@query(f"with {C.TOOLS_N}, {C.CASES_N} select distinct t.name from tools_n t join cases_n c on c.ground_truth_tool = t.name")
def task_scope(spark, sf_dir):
    """The tools that a manual is built for: those that a relevance entry mentions."""
    return tasks.manual_scope(C.keyed_tools(spark, sf_dir), _relevance(spark, sf_dir))


@query(
    f"with {O.M}, {C.TOOLS_N}, g as (select tool_name, string_agg('- ' || query, chr(10) order by entry_ord) as q from manual_n where query <> '' group by 1) "
    "select t.name as skill_id, sha256(coalesce(t.description, '') || coalesce(chr(10) || chr(10) || 'GENERATED_QUERIES:' || chr(10) || q, '')) as body from tools_n t left join g on g.tool_name = t.name"
)
def sink_bodies(spark, sf_dir):
    """Tools as skills whose bodies have the manual's queries appended, as digests."""
    skills = C.keyed_tools(spark, sf_dir).select(F.col("name").alias("skill_id"), F.col("description").alias("body"))
    asked = C.keyed_manual(spark, sf_dir).where("query <> '' and tool_name is not null").select(F.col("tool_name").alias("name"), F.col("entry_ord").alias("ord"), "query")
    return sinks.augmented_bodies(skills, asked).select("skill_id", F.sha2("body", 256).alias("body"))


@query("select category, substr(sha1(string_agg(name || repeat(chr(0), 2), '' order by ord)), 1, 16) as digest from tools group by 1")
def text_pool_digests(spark, sf_dir):
    """A digest of each category's tool names in order."""
    rows = read(spark, sf_dir, "tools").groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("x"))
    return rows.select("category", T.pool_digest(F.transform("x", lambda t: t["name"])).alias("digest"))
