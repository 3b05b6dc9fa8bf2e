"""The queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlake.functions.text import tool_key
from intentlake.llm import bpe, hilbert, leak, minmax, split, topn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar manual entries of one tool."""
    pairs = minmax.similar_pairs(_read(spark, sf_dir, "manual"), "entry_ord", tool_key("tool_name"), F.col("query"))
    return pairs.select(F.col("a").alias("entry_ord_a"), F.col("b").alias("entry_ord_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every manual entry that takes part, and its number of similar other texts."""
    rows = minmax.near_duplicate_groups(_read(spark, sf_dir, "manual"), "entry_ord", tool_key("tool_name"), F.col("query"))
    return rows.withColumnRenamed("id", "entry_ord")


def _best_hits(spark: SparkSession, sf_dir: str, payload: list[str]) -> DataFrame:
    hits = _read(spark, sf_dir, "hits").where("tool_name is not null and score > 0 and score < double('infinity')")
    return topn.top_n(
        hits, {"qid": F.col("qid"), "tool_key": tool_key("tool_name")}, F.col("score"),
        {"entry_ord": F.col("entry_ord"), "hit_id": F.col("hit_id")}, 3, payload, "hit_rank",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best hits of every request and tool."""
    return _best_hits(spark, sf_dir, []).select("qid", F.col("hit_rank").cast("bigint").alias("hit_rank"), "hit_id")


def p2_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best hits of every request and tool with their query."""
    rows = _best_hits(spark, sf_dir, ["query"])
    return rows.select("qid", "tool_key", F.col("hit_rank").cast("bigint").alias("hit_rank"), "hit_id", "score", "query")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units of which at least one is among the five nearest of the other."""
    near = hilbert.nearest(_read(spark, sf_dir, "query_augmented_units"), "unit_id", "vector")
    return near.select(F.least("id", "other").alias("unit_id_a"), F.greatest("id", "other").alias("unit_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest units of every usable unit with their documents."""
    units = _read(spark, sf_dir, "query_augmented_units")
    near = hilbert.nearest(units, "unit_id", "vector")
    documents = units.select(F.col("unit_id").alias("other"), "document")
    rows = near.join(documents, "other", "left")
    return rows.select(F.col("id").alias("unit_id"), "rank", F.col("other").alias("neighbour_id"), "cosine", "document")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_ids(_read(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation requests they leak."""
    return p6_leaks(spark, sf_dir).drop("answer_found")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, the evaluation requests they leak, and whether the request's tool is named there too."""
    return leak.leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "cases"), item_answer="ground_truth_tool")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut: those with a second piece."""
    pieces = split.split_oversized(_read(spark, sf_dir, "documents"))
    return pieces.where("piece_no = 1").select("doc_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized documents."""
    return split.split_oversized(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_hits, p3_found, p3_neighbours, p5_ids, p6_found, p6_leaks, p7_found, p7_pieces)}


TOOL_KEY = r"trim(lower(regexp_replace(translate(tool_name, '_-', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g')))"

_PLAIN = rf"""entry as (
  select entry_ord, {TOOL_KEY} as tool_key, regexp_replace(lower(query), '[^\p{{L}}\p{{N}}]+', '', 'g') as plain from manual),
part as (select * from entry where tool_key <> '' and entry_ord is not null and length(plain) >= 20),
gram as (
  select distinct entry_ord, tool_key, substr(plain, i, 3) as g
  from (select entry_ord, tool_key, plain, unnest(range(1, length(plain) - 1)) as i from part)),
size as (select entry_ord, count(*) as n from gram group by 1),
both_have as (
  select a.entry_ord as a, b.entry_ord as b, count(*) as n
  from gram a join gram b on a.tool_key = b.tool_key and a.g = b.g and a.entry_ord < b.entry_ord group by 1, 2),
pair as (
  select p.a, p.b from both_have p join size x on x.entry_ord = p.a join size y on y.entry_ord = p.b
  where p.n::double / (x.n + y.n - p.n) >= 0.6)"""

_GROUPS = f"""{_PLAIN},
class as (select tool_key, plain, min(entry_ord) as rep from part group by all),
member as (select p.entry_ord, c.rep from part p join class c using (tool_key, plain)),
edge as (
  select distinct x.rep as u, y.rep as v from (select a, b from pair union all select b, a from pair) p
  join member x on x.entry_ord = p.a join member y on y.entry_ord = p.b where x.rep <> y.rep),
reach as (select rep as id, rep as g from class union select e.v, r.g from reach r join edge e on e.u = r.id),
named as (select id, min(g) as group_id from reach group by 1),
degree as (select u, count(*) as links from edge group by 1)"""

_HITS = f"""hit as (
  select distinct hit_id, qid, entry_ord, {TOOL_KEY} as tool_key, score, query from hits
  where tool_name is not null and isfinite(score) and score > 0),
ranked as (
  select *, row_number() over (partition by qid, tool_key order by score desc, entry_ord, hit_id) as hit_rank from hit)"""


_NEAR = """unit as (
  select unit_id, any_value(vector::double[]) as v from query_augmented_units where unit_id is not null and len(vector) = 64
  and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1),
cosine as (select a.unit_id as a, b.unit_id as b, list_cosine_similarity(a.v, b.v) as c from unit a join unit b on a.unit_id <> b.unit_id),
near as (select *, row_number() over (partition by a order by c desc, b) as r from cosine)"""


def _words(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({c}), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


_LEAKS = f"""doc as (select doc_id, {_words("text")} as w from documents where doc_id is not null and text is not null),
item as (select ord, {_words("query")} as w, {_words("coalesce(ground_truth_tool, '')")} as answer from cases where ord is not null and query is not null),
doc_run as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') as run from (select *, unnest(range(1, len(w) - 10)) as i from doc)),
item_run as (select distinct ord, array_to_string(w[i : i + 11], ' ') as run from (select *, unnest(range(1, len(w) - 10)) as i from item)),
leak as (select distinct doc_id, ord from doc_run join item_run using (run))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_PLAIN} select a as entry_ord_a, b as entry_ord_b from pair",
        "p6_found": f"with {_LEAKS} select doc_id, ord as case_ord from leak",
        "p6_leaks": f"with {_LEAKS} select doc_id, ord as case_ord, bool_or(case when len(answer) > 0 then contains(' ' || array_to_string(doc.w, ' ') || ' ', ' ' || array_to_string(answer, ' ') || ' ') end) "
        "as answer_found from leak join doc using (doc_id) join item using (ord) group by 1, 2",
        "p1_groups": f"with recursive {_GROUPS} select entry_ord, group_id, coalesce(links, 0) as links from member join named on id = rep left join degree on u = rep",
        "p3_found": f"with {_NEAR} select distinct least(a, b) as unit_id_a, greatest(a, b) as unit_id_b from near where r <= 5",
        "p2_found": f"with {_HITS} select qid, hit_rank, hit_id from ranked where hit_rank <= 3",
        "p2_hits": f"with {_HITS} select qid, tool_key, hit_rank, hit_id, score, query from ranked where hit_rank <= 3",
    }
