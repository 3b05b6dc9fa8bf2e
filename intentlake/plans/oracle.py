"""The SQL (DuckDB) that states the core queries, built from the same word lists and written independently of the Spark plans."""

from __future__ import annotations

from intentlake.functions.lexicon import ACTIONS, CJK_PHRASES, CJK_SYNONYMS, CONJUNCTIONS, STOPWORDS, SYNONYMS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::varchar[]"


def mp(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lst(v)}" for k, v in table.items()) + "}"


def norm(c: str) -> str:
    return rf"lower(regexp_replace(replace(replace({c}, '_', ' '), '-', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'))"


def key(c: str) -> str:
    return f"trim({norm(c)})"


def cleaned(c: str) -> str:
    t = rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
    return f"case when lower({t}) in ('none', 'nan') then '' else {t} end"


def grams(t: str, n: int) -> str:
    return f"list_transform(range(1, greatest(1, length({t}) - {n} + 2)), lambda i: substr({t}, i::int, {n}))"


def tok(c: str) -> str:
    phrases = f"flatten(list_transform(list_filter({lst(CJK_PHRASES)}, lambda p: contains(t, p)), lambda p: [p] || coalesce(map_extract_value({mp(CJK_SYNONYMS)}, p), []::varchar[])))"
    return (
        f"flatten(list_transform(regexp_extract_all({norm(c)}, '[A-Za-z0-9_]+|[一-鿿]+'), lambda t: case "
        f"when regexp_matches(t, '^[一-鿿]') then {phrases} || {grams('t', 2)} || {grams('t', 3)} || {grams('t', 4)} "
        f"when length(t) <= 1 or list_contains({lst(STOPWORDS)}, t) then []::varchar[] "
        f"else [t] || coalesce(map_extract_value({mp(SYNONYMS)}, t), []::varchar[]) end))"
    )


def bucket(c: str, n: int) -> str:
    return f"(('0x' || substr(sha256({c}), 1, 15))::ubigint % {n})::bigint"


def overlap(a: str, b: str) -> str:
    """From two token lists."""
    x, y = f"list_distinct({a})", f"list_distinct({b})"
    return f"case when len({x}) > 0 and len({y}) > 0 then len(list_intersect({x}, {y})) / sqrt(len({x}) * len({y})) else 0.0 end"


def counts_cte(name: str, source: str, keys: str, text: str) -> str:
    """CTEs: ``{name}_t`` tokens with place, ``{name}`` counts."""
    return (
        f"{name}_t as (select {keys}, unnest(tk) as term, unnest(range(len(tk))) as pos from (select {keys}, {tok(text)} as tk from {source})), "
        f"{name} as (select {keys}, term, count(*) as tf, min(pos) as first_pos from {name}_t group by all)"
    )


def bm25_cte(name: str, docs: str, dkeys: str, dtext: str, queries: str, qkeys: str, qtext: str, pool: str = "") -> str:
    """CTEs that end in ``{name}``: (pool, query keys, doc keys, score, touch)."""
    p = f"{pool}, " if pool else ""
    on = "".join(f" and a.{x.strip()} = b.{x.strip()}" for x in pool.split(",") if x.strip())
    dk = ", ".join(f"b.{x.strip()}" for x in dkeys.split(","))
    qk = ", ".join(f"a.{x.strip()}" for x in qkeys.split(","))
    pa = "".join(f"a.{x.strip()}, " for x in pool.split(",") if x.strip())
    same = lambda ks: " and ".join(f"x.{k.strip()} is not distinct from y.{k.strip()}" for k in ks.split(",") if k.strip()) or "true"
    return (
        f"{name}_len as (select {p}{dkeys}, coalesce(len({tok(dtext)}), 0) as dl from {docs}), "
        f"{name}_st as (select {p}count(*) as n, sum(dl)::double / count(*) as av from {name}_len group by all), "
        f"{counts_cte(name + '_d', docs, p + dkeys, dtext)}, "
        f"{name}_df as (select {p}term, count(*) as df from {name}_d group by all), "
        f"{name}_w as (select x.*, ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * y.dl / greatest(s.av, 1e-9))) as w "
        f"from {name}_d x join {name}_len y on {same(p + dkeys)} join {name}_df f on x.term = f.term"
        + "".join(f" and x.{k.strip()} = f.{k.strip()}" for k in pool.split(",") if k.strip())
        + f" join {name}_st s on true" + "".join(f" and x.{k.strip()} = s.{k.strip()}" for k in pool.split(",") if k.strip())
        + f"), {counts_cte(name + '_q', queries, p + qkeys, qtext)}, "
        f"{name} as (select {pa}{qk}, {dk}, round(sum(a.tf * b.w), 9) as score, min(a.first_pos) as touch "
        f"from {name}_q a join {name}_w b on a.term = b.term{on} group by all)"
    )


def tool_rank(name: str, hits: str, group: str, tool: str, ordinal: str) -> str:
    """CTEs that end in ``{name}``: (group, tool, score, n_hits, rank)."""
    return (
        f"{name}_r as (select *, row_number() over (partition by {group}, {tool} order by score desc, {ordinal}) as hr from {hits}), "
        f"{name}_s as (select {group}, {tool}, sum(case when hr <= 3 then score::decimal(30, 12) end)::double / least(count(*), 3) + 0.05::double * least(count(*), 5) as score, "
        f"count(*) as n_hits, min(case when hr = 1 then {ordinal} end) as fh from {name}_r group by all), "
        f"{name} as (select *, row_number() over (partition by {group} order by score desc, fh, {tool}) as rank from {name}_s)"
    )


def tool_doc() -> str:
    return (
        "concat_ws(chr(10), 'TOOL_NAME: ' || coalesce(name, ''), 'CATEGORY: ' || coalesce(category, ''), 'DESCRIPTION: ' || coalesce(description, ''), "
        "case when parameters is not null and trim(parameters) not in ('', '{}', '[]', 'null') then 'PARAMETERS_SCHEMA: ' || parameters end)"
    )


def decompose(c: str) -> str:
    s = rf"regexp_replace({c}, '\s+', '', 'g')"
    acts = "(" + "|".join(ACTIONS) + ")"
    lead = "case " + " ".join(f"when starts_with(s, {lit(a)}) then {lit(a)}" for a in ACTIONS) + " else '' end"
    parts = f"list_filter(string_split_regex(s, {lit('|'.join(CONJUNCTIONS))}), lambda p: length(p) >= 2)"
    return s, parts, lead, acts


M = "manual_n as (select entry_ord, query, " + key("tool_name") + " as tool_name from manual)"


def metrics_sql(ranked: str, gold: str) -> dict[str, str]:
    """Metric expressions over list columns; gold holds different names."""

    def first(k: int) -> str:
        return f"{ranked}[1:{k}]"

    def dcg(k: int) -> str:
        return f"coalesce(list_sum(list_transform({first(k)}, lambda r, i: case when list_contains({gold}, r) then 1.0 / log2(i + 1) else 0.0 end)), 0.0)"

    def ideal(k: int) -> str:
        return f"list_sum(list_transform(range(1, least({k}, len({gold})) + 1), lambda i: 1.0 / log2(i + 1)))"

    out = {f"ndcg_{k}": f"coalesce({dcg(k)} / {ideal(k)}, 0.0)" for k in (1, 3, 10)}
    out["hit_1"] = f"case when list_has_any({first(1)}, {gold}) then 1.0 else 0.0 end"
    out["precision_3"] = f"len(list_filter({first(3)}, lambda r: list_contains({gold}, r))) / 3.0"
    out["mrr_10"] = f"coalesce(list_max(list_transform({first(10)}, lambda r, i: case when list_contains({gold}, r) then 1.0 / i else 0.0 end)), 0.0)"
    out |= {f"recall_{k}": f"len(list_intersect({first(k)}, {gold})) / len({gold})::double" for k in (10, 20, 50)}
    out |= {f"full_coverage_{k}": f"case when list_has_all({first(k)}, {gold}) then 1.0 else 0.0 end" for k in (3, 5, 10)}
    return {n: f"({e})::double" for n, e in out.items()}


def nodes_cte(table: str, key: str, text: str) -> str:
    """CTEs that end in ``nodes``: every node of the nested records, the children of a node worked out level by level."""
    ptr = lambda k: f"replace(replace({k}, '~', '~0'), '/', '~1')"
    child = lambda i, n, r, v, k: f"{{'i': {i}, 'n': {n}, 'r': {r}, 'v': {v}, 's': {v}, 'k': '{k}'}}"
    record = "{'i': 0, 'n': v ->> '/name', 'r': true, 'v': v, 's': json_extract(v, '/fields'), 'k': 'list'}"
    kind = "struct(i bigint, n varchar, r boolean, v json, s json, k varchar)[]"

    def children(v: str, k: str) -> str:
        names = f"case when json_type({v}, '/properties') = 'OBJECT' then json_keys({v}, '/properties') else []::varchar[] end"
        props = f"list_transform({names}, lambda n, i: {child('i::bigint - 1', 'n', 'true', f'json_extract({v}, {chr(39)}/properties/{chr(39)} || {ptr(chr(110))})', 'schema')})"
        items = f"case when json_type({v}, '/items') = 'OBJECT' then [{child('0::bigint', chr(39) + '*' + chr(39), 'false', f'json_extract({v}, {chr(39)}/items{chr(39)})', 'schema')}] else [] end"
        alternatives = [
            f"case when json_type({v}, '/{w}') = 'ARRAY' then list_transform(range(json_array_length({v}, '/{w}')::bigint), lambda j: {child('j', chr(39) + '|' + chr(39) + ' || j', 'false', f'json_extract({v}, {chr(39)}/{w}/{chr(39)} || j)', 'schema')}) else [] end"
            for w in ("oneOf", "anyOf")
        ]
        schema = " || ".join(f"({x})::{kind}" for x in (props, items, *alternatives))
        elements = f"list_filter(case when json_type({v}) = 'ARRAY' then json_extract({v}, '$[*]') else []::json[] end, lambda v: json_type(v) = 'OBJECT' and json_type(v, '/name') = 'VARCHAR')"
        return f"case when {k} = 'list' then (list_transform({elements}, lambda v: {record}))::{kind} when json_type({v}) = 'OBJECT' then {schema} else []::{kind} end"

    step = f"{ptr('c.n')}"
    return (
        f"texts as (select {key}, case when json_valid({text}) then case when json_type({text}) = 'VARCHAR' then ({text}::json) ->> '$' else {text} end end as t from {table}), "
        f"roots as (select {key}, t::json as v from texts where t is not null and json_valid(t) and json_type(t) <> 'VARCHAR'), "
        f"every as (select {key}, '0' as node_key, null::varchar as parent_key, null::varchar as record_parent_key, '0' as record_key, 0 as ordinal, 0 as level, false as is_record, null::varchar as name, '' as path, '' as parent_path, "
        f"'' as record_path, null::json as record, case when json_type(v) = 'ARRAY' then 'list' else 'schema' end as kind, v as sub from roots union all "
        f"select {key}, node_key || '.' || place, node_key, record_key, case when c.r then node_key || '.' || place else record_key end, place::int, level + 1, c.r, case when c.r then c.n end, "
        f"case when path = '' then '' else path || '/' end || case when c.r then {step} else c.n end, record_path, case when c.r then case when path = '' then '' else path || '/' end || {step} else record_path end, c.v, c.k, c.s "
        f"from (select *, unnest(cs) as c, unnest(range(len(cs))) as place from (select *, {children('sub', 'kind')} as cs from every))), "
        "nodes as (select * from every where level > 0)"
    )
