"""Text expressions on columns, evaluated in the JVM but for the tokenizer, which works on Arrow batches.

Every function takes a column or a column's name and gives null for null unless its docstring says
otherwise.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from intentlake.functions.lexicon import ACTIONS, CONJUNCTIONS
from intentlake.functions.tokens import counts_of, tokens_of

def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalize_text(c: Column | str) -> Column:
    """``_`` and ``-`` become blanks, ``fooBar`` becomes ``foo bar``, everything is lower case. Null stays null."""
    spaced = F.translate(as_col(c), "_-", "  ")
    return F.lower(F.regexp_replace(spaced, "(?<=[a-z0-9])(?=[A-Z])", " "))


def tool_key(c: Column | str) -> Column:
    """The spelling-independent key of a tool name: normalised text without blanks at both ends; null for null."""
    return F.trim(normalize_text(c))


def tokenize(c: Column | str) -> Column:
    """The tokens of a text as an array, in order and with repetitions.

    ASCII words of two or more characters that are no stopwords, each followed by its synonyms; for each
    CJK run the known phrases with their synonyms, then all 2-, 3- and 4-grams. Null for null, an empty
    array for a text without tokens.
    """
    return tokens_of(normalize_text(c))


def count_tokens(c: Column | str) -> Column:
    """``STRUCT<dl, terms: ARRAY<STRUCT<term, tf, first_pos>>>``: the number of tokens, and each different token with its number and first place.

    0 and none for null and for a text without tokens.
    """
    return counts_of(normalize_text(c))


def term_overlap(left_tokens: Column, right_tokens: Column) -> Column:
    """Common different tokens over the root of the product of the numbers of different tokens; 0 if a side has none or is null."""
    a, b = F.array_distinct(left_tokens), F.array_distinct(right_tokens)
    n = F.size(a) * F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(n)).otherwise(0.0)


def hash_bucket(c: Column | str, buckets: int) -> Column:
    """A stable bucket of a string: the first 60 bits of its SHA-256, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(as_col(c), 256), 1, 15), 16, 10).cast("bigint") % buckets


@F.arrow_udf(LongType())
def _blake(texts: pa.Array) -> pa.Array:
    # Eight bytes as a signed number; the bucket is taken of the unsigned one.
    return pa.array([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t in texts.to_pylist()], pa.int64())


def published_bucket(c: Column | str, buckets: int) -> Column:
    """The bucket of a string by the published hash: BLAKE2b of eight bytes, big-endian and unsigned, modulo ``buckets`` (at most 2**31)."""
    h = _blake(as_col(c))
    # 2**64 mod buckets makes up for the sign.
    return F.pmod(F.pmod(h, F.lit(buckets)) + F.when(h < 0, F.lit((1 << 64) % buckets)).otherwise(F.lit(0)), F.lit(buckets)).cast("bigint")


def text_digest(texts: Column) -> Column:
    """SHA-256 over an array of texts, each ended by a NUL character."""
    return F.sha2(F.array_join(F.transform(texts, lambda t: F.concat(t, F.chr(F.lit(0)))), ""), 256)


def pool_digest(documents: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 over an ordered array of documents, each ended by two NUL characters."""
    end = F.repeat(F.chr(F.lit(0)), F.lit(2))
    return F.substring(F.sha1(F.array_join(F.transform(documents, lambda d: F.concat(d, end)), "")), 1, 16)


def estimate_tokens(*texts: Column) -> Column:
    """A quarter of the characters of the texts joined by line ends, rounded down, at least 1. Null texts count nothing."""
    return F.greatest(F.lit(1), F.floor(F.char_length(F.concat_ws("\n", *texts)) / 4).cast("int"))


def clean_text(c: Column | str) -> Column:
    """Without white space at both ends; ``none``, ``nan`` (any case) and null become an empty text."""
    t = F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.lower(t).isin("none", "nan"), "").otherwise(t)


def first_text(*cs: Column | str) -> Column:
    """The first of the cleaned texts that isn't empty, else an empty text."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cs], F.lit(""))


def single_line(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(as_col(c), r"\s+", " "), "^ | $", "")


def trim_sentence(c: Column | str) -> Column:
    """Without full stops and semicolons at the end."""
    return F.regexp_replace(as_col(c), "[。.;；]+$", "")


# Spellings of value types and the JSON schema type each means.
VALUE_TYPES = {
    "integer": ("int", "integer", "long"),
    "number": ("float", "double", "number", "decimal"),
    "boolean": ("bool", "boolean"),
    "array": ("array", "list"),
    "dict": ("dict", "object", "map"),
}
SIGNAL_INTEGERS = ("short", "byte", "integerzone")


def value_type(c: Column | str, signals: bool = False) -> Column:
    """The schema type a type's spelling means, ``string`` for others and null.

    With ``signals`` more integer spellings are known and any spelling that holds ``list`` or ``array`` is an array.
    """
    name = F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), "[^a-z0-9]+", "")
    out = F.when(name.isin(*VALUE_TYPES["integer"], *(SIGNAL_INTEGERS if signals else ())), "integer")
    for kind in ("number", "boolean", "array", "dict"):
        is_kind = name.isin(*VALUE_TYPES[kind])
        if kind == "array" and signals:
            is_kind = F.contains(name, F.lit("list")) | F.contains(name, F.lit("array"))
        out = out.when(is_kind, kind)
    return out.otherwise("string")


def decompose_query(c: Column | str, keep_original: bool = True) -> Column:
    """The parts of a request that names several intents, as an array.

    White space is removed; the text is cut at conjunctions and separators; parts under two characters
    go. If two or more remain, a leading action of the request is put before the parts that name none;
    parts are listed once, followed by the whole request. Otherwise the request is its only part. A
    blank text has no parts.
    """
    compact = F.regexp_replace(as_col(c), r"\s+", "")
    parts = F.filter(F.split(compact, "|".join(CONJUNCTIONS)), lambda p: F.char_length(p) >= 2)
    leading = reduce(lambda w, a: w.when(F.startswith(compact, F.lit(a)), a), ACTIONS[1:], F.when(F.startswith(compact, F.lit(ACTIONS[0])), ACTIONS[0]))
    leading = leading.otherwise("")
    has_action = lambda p: F.rlike(p, F.lit("|".join(ACTIONS)))
    named = F.array_distinct(F.transform(parts, lambda p: F.when(has_action(p), p).otherwise(F.concat(leading, p))))
    several = F.array_union(named, F.array(compact)) if keep_original else named
    return F.when(compact == "", strings([])).when(F.size(parts) <= 1, F.array(compact)).otherwise(several)


def getter_signatures(c: Column | str) -> Column:
    """``ARRAY<STRUCT<return_type, name, params>>`` of the methods ``Type getX(params)`` in a text; empty for null."""
    # Fixed value: the pattern of a getter's signature.
    pattern = r"\b([A-Za-z_][\w.<>\[\]?]*)\s+(get[A-Za-z_]\w*)\s*\(([^)]*)\)"
    text = F.coalesce(as_col(c), F.lit(""))
    group = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(group, ("return_type", "name", "params"))])
    return F.transform(zipped, lambda s: F.struct(s["return_type"].alias("return_type"), s["name"].alias("name"), s["params"].alias("params")))


def method_parameters(params: Column) -> Column:
    """``ARRAY<STRUCT<type_name, name>>`` of a parameter list; annotations are removed, parts without a type passed over."""
    plain = F.transform(F.split(params, ","), lambda p: single_line(F.regexp_replace(p, r"@\w+(?:\([^)]*\))?\s*", "")))
    typed = F.filter(plain, lambda p: F.contains(p, F.lit(" ")))
    pairs = F.transform(
        typed,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(.*) (\S+)$", 1).alias("type_name"), F.regexp_replace(F.regexp_extract(p, r"^(.*) (\S+)$", 2), r"^\.+", "").alias("name")
        ),
    )
    return F.filter(pairs, lambda p: p["name"] != "")


def tool_names_in(c: Column | str) -> Column:
    """The names after ``TOOL_NAME:`` in a retrieved context, trimmed."""
    return F.transform(F.regexp_extract_all(as_col(c), F.lit(r"TOOL_NAME:\s*([^\n\r]+)"), F.lit(1)), lambda n: F.trim(n))


def defuse_markers(c: Column | str) -> Column:
    """``<|x|>`` becomes ``< |x| >``, so that no marker of a vector store remains."""
    return F.regexp_replace(as_col(c), r"<\|([^|\r\n]{1,100})\|>", "< |$1| >")
