"""Building a manual: proposed queries per tool, round-trip verification, acceptance and resuming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intentlake.functions.jsonx import json_payload
from intentlake.functions.text import term_overlap, tokenize
from intentlake.operators.sampling import dense_index, pools
from intentlake.session import cut_lineage

# The sentence templates of the offline teacher, {d} description, {n} name, {t} main terms.
TEMPLATES = (
    "I want to {d}.",
    "Help me with {n}.",
    "Find a tool for {t}.",
    "Can you handle {t} using the right API?",
    "I need {n} with the required parameters.",
    "Run something that can {d}.",
    "Which function should I call for {t}?",
    "Use the service related to {t}.",
)


def top_terms(df: DataFrame, keys: Sequence[str], texts: Sequence[Column], limit: int) -> DataFrame:
    """(keys, ``terms``): the most frequent tokens of several texts together, ties by first occurrence; an empty array for none."""
    tokens = F.flatten(F.array(*[F.coalesce(tokenize(t), F.array().cast("array<string>")) for t in texts]))
    pos = df.select(*keys, F.posexplode(tokens).alias("pos", "term"))
    counts = pos.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    place = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    best = counts.withColumn("r", F.row_number().over(place)).where(F.col("r") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"])
    lists = best.groupBy(*keys).agg(listed.alias("terms"))
    return df.select(*keys).distinct().join(lists, list(keys), "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def template_queries(tools: DataFrame, count: int = 8, key: str = "ord") -> DataFrame:
    """(``key``, ``name``, ``query_no``, ``query``): up to eight templated queries for every tool.

    Main terms are the first three of the six most frequent tokens of name, description and parameters,
    or the name if there are none. Null descriptions and parameters count as empty.
    """
    name, description = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    terms = top_terms(tools, [key], [name, description, F.coalesce("parameters", F.lit(""))], 6)
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    main = F.when(F.size("terms") > 0, F.array_join(F.slice("terms", 1, 3), " ")).otherwise(spaced)
    values = {"d": F.regexp_replace(description, r"\.+$", ""), "n": spaced, "t": main}

    def fill(template: str) -> Column:
        for k, v in values.items():
            if f"{{{k}}}" in template:
                before, after = template.split(f"{{{k}}}")
                return F.concat(F.lit(before), v, F.lit(after))
        return F.lit(template)

    rows = tools.join(terms, key).select(key, "name", F.posexplode(F.array(*[fill(t) for t in TEMPLATES[:count]])).alias("query_no", "query"))
    return rows


def terms_of(text: Column) -> Column:
    """The different tokens of a text. Computed before a join it is computed once a text, not once a pair."""
    return F.array_distinct(tokenize(text))


def select_tool(candidates: DataFrame, group: Sequence[str], query_terms: str, document_terms: str, name: str, pos: str) -> DataFrame:
    """(group, ``selected``, ``overlap``): the candidate whose document shares most terms with the query.

    Terms are given as arrays (``terms_of``). Ties by ``pos``; ``selected`` is null where no candidate shares any.
    """
    scored = candidates.withColumn("overlap", term_overlap(F.col(query_terms), F.col(document_terms)))
    place = Window.partitionBy(*group).orderBy(F.desc("overlap"), pos)
    best = scored.withColumn("_r", F.row_number().over(place)).where("_r = 1")
    return best.select(*group, F.when(F.col("overlap") > 0, F.col(name)).alias("selected"), "overlap")


def tool_text(*columns: Column) -> Column:
    """Name, description and parameters joined by blanks, nulls as empty texts."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def verify_queries(proposed: DataFrame, tools: DataFrame, catalogue: DataFrame, distractors: int = 8, seed: int = 7) -> DataFrame:
    """Every proposed query with ``accepted``, ``verifier_choice`` and ``rejection_reason``.

    ``proposed`` has ``query_id``, ``name`` and ``query``; a query is accepted if among its tool and sampled
    distractors the verifier picks its tool.
    """
    asked = proposed.withColumn("_gold", F.array("name"))
    drawn = pools(asked, ["query_id"], "_gold", catalogue, [distractors + 1], seed).withColumnRenamed("name", "candidate")
    texts = tools.select(F.col("name").alias("candidate"), terms_of(tool_text(F.col("name"), F.col("description"), F.col("parameters"))).alias("_doc"))
    rows = proposed.select("query_id", terms_of(F.col("query")).alias("_terms")).join(drawn, "query_id").join(texts, "candidate")
    chosen = select_tool(rows, ["query_id"], "_terms", "_doc", "candidate", "pos")
    out = proposed.join(chosen, "query_id", "left")
    accepted = F.coalesce(F.col("selected") == F.col("name"), F.lit(False))
    reason = F.when(~accepted, F.when(F.col("selected").isNull(), "no_choice").otherwise("other_tool"))
    return out.select(*proposed.columns, accepted.alias("accepted"), F.col("selected").alias("verifier_choice"), reason.alias("rejection_reason"))


def accepted_manual(rows: DataFrame, per_tool: int | None = None, order: Sequence[str] = ("entry_ord",)) -> DataFrame:
    """Rows with ``accepted`` true and a query that isn't empty, at most ``per_tool`` of each tool in order."""
    kept = rows.where("accepted = true and query is not null and query <> ''")
    if per_tool is not None:
        place = Window.partitionBy("tool_name").orderBy(*order)
        kept = kept.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= per_tool).drop("_r")
    return kept


def unfinished(tools: DataFrame, rows: DataFrame, target: int, key: str = "name") -> DataFrame:
    """Tools with fewer accepted queries than ``target`` and the number ``needed`` (resuming and refilling)."""
    have = rows.where("accepted = true").groupBy(F.col("tool_name").alias(key)).agg(F.count("*").alias("_have"))
    out = tools.join(have, key, "left").withColumn("needed", F.lit(target) - F.coalesce("_have", F.lit(0))).drop("_have")
    return out.where("needed > 0")


def generate(df: DataFrame, columns: Sequence[str], model: Callable[[list[dict]], list[list[str]]], batch_size: int = 16, attempts: int = 3) -> DataFrame:
    """The rows of ``columns`` with ``queries`` (ARRAY<STRING>) from a model, or ``error`` where it fails.

    ``model`` gets a batch of rows as dictionaries and returns a list of queries for each. It is called on
    the executors, a batch at a time, up to ``attempts`` times; a batch that keeps failing becomes error
    rows, so a run goes on and can be resumed with ``unfinished``.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", queries array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                rows, error, out = part.to_pylist(), None, None
                for _ in range(attempts):
                    try:
                        out = model(rows)
                        if len(out) != len(rows):
                            raise ValueError(f"{len(out)} answers for {len(rows)} rows")
                        error = None
                        break
                    except Exception as e:  # a model can fail in any way; the row says how
                        error, out = f"{type(e).__name__}: {e}", None
                lists = pa.array(out if out is not None else [None] * len(rows), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([error] * len(rows), pa.string())], [*columns, "queries", "error"])

    return df.select(*columns).mapInArrow(run, schema)


def parse_choice(answer: Column, names: Column, inside: bool = True) -> Column:
    """The tool an answer names: the trimmed answer itself, else (``inside``) the first name it contains in pool order, else its first word if that is a name, else null.

    Quotes around an answer don't count.
    """
    text = F.regexp_replace(F.trim(answer), "^[\"']+|[\"']+$", "")
    word = F.regexp_extract(text, "[A-Za-z0-9_./-]+", 0)
    held = F.get(F.filter(names, lambda n: F.contains(text, n)), F.lit(0)) if inside else F.lit(None).cast("string")
    return F.when(F.array_contains(names, text), text).otherwise(F.coalesce(held, F.when(F.array_contains(names, word), word)))


def generation_prompt(rows: Sequence[dict], domain: str = "") -> str:
    """What a model is asked for one tool or several: so many requests of users for each, as JSON by exact tool name."""
    about = f" They come from {domain}." if domain else ""
    listed = json.dumps([{k: r[k] for k in ("name", "description", "parameters", "needed") if r.get(k) is not None} for r in rows], ensure_ascii=False)
    return (
        f"For each tool below write as many requests as its \"needed\" says, as its users would phrase them: varied, some indirect, none naming the tool.{about} "
        f"Answer with one JSON object whose keys are the exact tool names and whose values are lists of strings.\n{listed}"
    )


def batch_answers(text: str, rows: Sequence[dict]) -> list[list[str]]:
    """The queries for each row from a model's answer, by exact tool name; raises ``ValueError`` where a tool is missing or has too few.

    The answer is a JSON object of lists, or for a single tool a list.
    """
    found = json_payload(text)
    if isinstance(found, list) and len(rows) == 1:
        found = {rows[0]["name"]: found}
    if not isinstance(found, dict):
        raise ValueError("the answer holds no object of lists")
    out = []
    for r in rows:
        asked = found.get(r["name"])
        queries = [q.strip() for q in asked if isinstance(q, str) and q.strip()] if isinstance(asked, list) else []
        if len(queries) < r["needed"]:
            raise ValueError(f"{len(queries)} of {r['needed']} queries for {r['name']}")
        out.append(queries[: r["needed"]])
    return out


#: Errors after which a call is worth repeating; others are passed on at once.
TRANSIENT = (TimeoutError, ConnectionError, OSError)


def patient(call: Callable[[str], str], attempts: int = 3, wait: float = 1.0) -> Callable[[str], str]:
    """``call``, repeated after transient errors with a pause that grows by ``wait`` seconds each time; the last error is passed on."""

    def run(prompt: str) -> str:
        for n in range(1, attempts + 1):
            try:
                return call(prompt)
            except TRANSIENT:
                if n == attempts:
                    raise
                time.sleep(wait * n)

    return run


def chat_model(call: Callable[[str], str], domain: str = "") -> Callable[[list[dict]], list[list[str]]]:
    """A model for ``generate`` from a function that answers prompts: one prompt for a batch, then one for each tool if the batch's answer is no use."""

    def model(rows: list[dict]) -> list[list[str]]:
        try:
            return batch_answers(call(generation_prompt(rows, domain)), rows)
        except ValueError:
            if len(rows) == 1:
                raise
            return [batch_answers(call(generation_prompt([r], domain)), [r])[0] for r in rows]

    return model


LOG = "round int, query_id string, ord bigint, tool_name string, query string, accepted boolean, verifier_choice string, rejection_reason string, error string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The candidate rows of a build so far; none where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def build(
    tools: DataFrame, path: str, model: Callable[[list[dict]], list[list[str]]], target: int = 8, rounds: int = 3, distractors: int | None = 8, batch_size: int = 16, seed: int = 7
) -> DataFrame:
    """(``ord``, ``tool_name``, ``query``, ``query_id``): the accepted queries of every tool, the first ``target`` of the log.

    ``tools``: ``ord``, ``name`` (unique), ``description``, ``parameters``. Each round asks the model for what a
    tool still needs, verifies it (not if ``distractors`` is None) and appends to the log under ``path``; rows
    of tools whose model failed say why. A build that ended early goes on where it stopped, finished tools
    aren't asked for again, and rejected queries are made up for in the next round. Batches hold tools that need
    equally many.
    """
    spark = tools.sparkSession
    catalogue = dense_index(tools.select("ord", "name"), ["ord"]).select("idx", "name") if distractors is not None else None
    for _ in range(rounds):
        log = read_log(spark, path)
        todo = cut_lineage(unfinished(tools.select("ord", "name", "description", "parameters"), log.select("tool_name", "accepted"), target))
        if todo.isEmpty():
            break
        number = (log.agg(F.max("round")).first()[0] or 0) + 1
        ordered = todo.repartitionByRange("needed", "ord").sortWithinPartitions("needed", "ord")
        made = cut_lineage(generate(ordered, ["ord", "name", "description", "parameters", "needed"], model, batch_size))
        some = made.where("error is null").select("ord", "name", F.posexplode(F.slice("queries", F.lit(1), F.col("needed"))).alias("no", "query"))
        some = some.withColumn("query_id", F.concat_ws(":", "ord", F.lit(number), "no"))
        if distractors is not None:
            some = verify_queries(some, tools, catalogue, distractors, seed)
        else:
            some = some.withColumns({"accepted": F.lit(True), "verifier_choice": F.lit(None).cast("string"), "rejection_reason": F.lit(None).cast("string")})
        rows = some.select(F.lit(number).alias("round"), "query_id", "ord", F.col("name").alias("tool_name"), "query", "accepted", "verifier_choice", "rejection_reason", F.lit(None).cast("string").alias("error"))
        # One row for each query that was expected.
        failed = made.where("error is not null").select("ord", "name", "error", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)).alias("no"))
        failed = failed.select(
            F.lit(number).alias("round"), F.concat_ws(":", "ord", F.lit(number), "no").alias("query_id"), "ord", F.col("name").alias("tool_name"), F.lit(None).cast("string").alias("query"),
            F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("verifier_choice"), F.lit("model_failed").alias("rejection_reason"), "error",
        )
        rows.unionByName(failed).write.mode("append").parquet(path)
    kept = accepted_manual(read_log(spark, path), target, ("round", "query_id"))
    return kept.select("ord", "tool_name", "query", "query_id")
