"""JSON in text: canonical forms, recovery from model answers, argument extraction."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from intentlake.functions.text import as_col, tokenize


@F.arrow_udf(StringType())
def sorted_json(texts: pa.Array) -> pa.Array:
    """JSON with sorted keys and non-ASCII characters as they are; null for null and for texts that aren't JSON."""
    out = []
    for t in texts.to_pylist():
        try:
            out.append(None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def recover_json(answer: Column | str) -> Column:
    """The JSON in a model's answer as a VARIANT: the whole text, else from the first ``[`` to the last ``]``, else ``{`` to ``}``; null if none parses."""
    text = as_col(answer)
    cut = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.coalesce(whole_json(text), whole_json(cut(r"(?s)\[.*\]")), whole_json(cut(r"(?s)\{.*\}")))


def whole_json(text: Column) -> Column:
    """A text's JSON as a VARIANT, null if the text isn't one JSON value from end to end.

    The parser stops where a value ends. What follows it can't make an element of an array and the rest of
    an object at once, so both are tried.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    return F.when(inside[0] & inside[1], F.try_parse_json(text))


def extract_arguments(query: Column | str, key: Column, kind: Column) -> Column:
    """The argument of one parameter that a request holds, as text; null if there is none.

    Numbers: the first number. Parameters whose name has ``currency``: a three-letter code, the first, or
    the second if the name begins with ``to``. Others: if the request shares a token with the name, its
    last three tokens. A request without tokens gives none.
    """
    q = as_col(query)
    tokens = tokenize(q)
    numbers = F.regexp_extract_all(q, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    codes = F.regexp_extract_all(F.upper(q), F.lit(r"\b[A-Z]{3}\b"), F.lit(0))
    second = F.startswith(key, F.lit("to")) & (F.size(codes) > 1)
    return (
        F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(kind.isin("integer", "number") & (F.size(numbers) > 0), F.get(numbers, F.lit(0)))
        .when(F.contains(key, F.lit("currency")) & (F.size(codes) > 0), F.when(second, F.get(codes, F.lit(1))).otherwise(F.get(codes, F.lit(0))))
        .when(F.arrays_overlap(tokenize(key), tokens), F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - 2, F.lit(1)), F.lit(3)), " "))
    )


def json_payload(text: str):
    """The driver-side form of ``recover_json``; raises ``ValueError`` if no JSON is found."""
    for found in (text, *(m.group(0) for p in (r"(?s)\[.*\]", r"(?s)\{.*\}") if (m := re.search(p, text)))):
        try:
            return json.loads(found)
        except ValueError:
            continue
    raise ValueError("no JSON in the text")
