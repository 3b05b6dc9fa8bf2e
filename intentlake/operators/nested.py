"""Deeply nested JSON to flat tables that keep parent-child links.

Texts are parsed once. One pass brings every record into the shape that both record forms share: its
name, its attributes and the array of its children. The schema is then inferred from these shapes: the
attributes of all records with the type their values have in common, and the number of levels. The
merged schema decides how many explode steps the plan has and which columns the tables get. Each step
explodes one level of arrays into child rows, which carry the surrogate key of their parent and their
ordinal in its array. Rows that are done pass through, so all levels come from one plan without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.session import cut_lineage, written_table

#: Levels that one plan explodes; deeper records go on from a table in the checkpoint folder.
LEVELS_PER_PLAN = 6


class _Invalid(ValueError):
    pass


def _refuse(_: str):
    raise _Invalid


class _Number(str):
    """A number as it is written."""


def read_json(text: str):
    """The value of an RFC 8259 text, numbers as written; raises ``ValueError`` where it isn't one.

    Of repeated keys the last counts. A text nested too deep for the recursive reader is read by
    ``_read_deep``.
    """
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_Number, parse_float=_Number)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    """As ``read_json`` with an explicit stack instead of recursion."""
    scanner = json.JSONDecoder(parse_constant=_refuse, parse_int=_Number, parse_float=_Number)
    blank = " \t\n\r"
    i, n = 0, len(text)
    stack: list = []
    root: list = []
    place = lambda v: root.append(v)
    expect = "value"
    while True:
        while i < n and text[i] in blank:
            i += 1
        if expect == "end":
            if i < n:
                raise ValueError("text after the value")
            return root[0]
        if i >= n:
            raise ValueError("the text ends early")
        c = text[i]
        if expect in ("value", "value or ]"):
            if c == "]" and expect == "value or ]":
                expect = "close"
                continue
            if c == "{":
                box: dict | list = {}
                place(box)
                stack.append(box)
                i += 1
                expect = "key or }"
                continue
            if c == "[":
                box = []
                place(box)
                stack.append(box)
                i += 1
                place, expect = box.append, "value or ]"
                continue
            value, i = scanner.raw_decode(text, i)
            place(value)
            expect = "next" if stack else "end"
            continue
        top = stack[-1] if stack else None
        if expect in ("key", "key or }"):
            if c == "}" and expect == "key or }":
                expect = "close"
                continue
            if c != '"':
                raise ValueError("a key is missing")
            key, i = scanner.raw_decode(text, i)
            while i < n and text[i] in blank:
                i += 1
            if i >= n or text[i] != ":":
                raise ValueError("a colon is missing")
            i += 1
            place, expect = (lambda v, box=top, key=key: box.__setitem__(key, v)), "value"
            continue
        if expect == "next" and c == ",":
            i += 1
            if isinstance(top, dict):
                expect = "key"
            else:
                place, expect = top.append, "value"
            continue
        if c == ("}" if isinstance(top, dict) else "]"):
            stack.pop()
            i += 1
            expect = "next" if stack else "end"
            continue
        raise ValueError("unexpected character")


def _clean(s: str) -> str:
    """A name as valid UTF-8: lone surrogates become the replacement character."""
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_text(value) -> str:
    """The JSON text of a value that was read, without recursion."""
    out: list[str] = []
    stack: list = [(value,)]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        (value,) = top
        if isinstance(value, _Number):
            out.append(value)
        elif isinstance(value, dict):
            out.append("{")
            stack.append("}")
            for k, (name, x) in enumerate(reversed(value.items())):
                stack += [*([","] if k else []), (x,), json.dumps(name, ensure_ascii=False) + ":"]
        elif isinstance(value, list):
            out.append("[")
            stack.append("]")
            for k, x in enumerate(reversed(value)):
                stack += [*([","] if k else []), (x,)]
        else:
            out.append(json.dumps(value, ensure_ascii=False))
    return "".join(out)


def value_kind(value) -> str:
    if isinstance(value, _Number):
        return "number"
    return {str: "string", bool: "boolean", list: "array", dict: "object", type(None): "null"}[type(value)]


def _attributes(node, kind: str) -> dict:
    """What a record says of itself: all its entries but those that hold its children, and in a list of records its name."""
    if not isinstance(node, dict):
        return {}
    if kind == "list":
        return {k: v for k, v in node.items() if k not in ("name", "fields")}
    box = {"properties": dict, "items": dict, "oneOf": list, "anyOf": list}
    return {k: v for k, v in node.items() if not isinstance(v, box.get(k, ()))}


def _schema_children(node) -> list[tuple[str, bool, object, str]]:
    """(step or name, is a record, value, kind) of the children of a schema or of a list of records."""
    out: list[tuple[str, bool, object, str]] = []
    if isinstance(node, dict):
        if isinstance(p := node.get("properties"), dict):
            out += [(name, True, value, "schema") for name, value in p.items()]
        if isinstance(p := node.get("items"), dict):
            out.append(("*", False, p, "schema"))
        for word in ("oneOf", "anyOf"):
            if isinstance(p := node.get(word), list):
                out += [(f"|{i}", False, value, "schema") for i, value in enumerate(p)]
    return out


def normal_shape(value) -> tuple[list, int, set[tuple[str, str]]]:
    """A value in the shape both record forms share, its number of levels, and the names and kinds of its attributes.

    The shape is a list of nodes ``{"n": name or step, "r": is a parameter, "a": attributes as JSON texts,
    "c": list of nodes}``. It is built level by level, without recursion.
    """
    root: list = []
    level = [(value, "list" if isinstance(value, list) else "schema", root)]
    depth, kinds = 0, set()
    while level:
        below = []
        for node, kind, into in level:
            if kind == "list":
                children = [
                    (record["name"], True, record, record.get("fields"), "list")
                    for record in (node if isinstance(node, list) else ())
                    if isinstance(record, dict) and type(record.get("name")) is str
                ]
            else:
                children = [(name, is_record, child, child, child_kind) for name, is_record, child, child_kind in _schema_children(node)]
            for name, is_record, record, child, child_kind in children:
                nodes: list = []
                said = _attributes(record, child_kind)
                kinds.update((_clean(k), value_kind(v)) for k, v in said.items())
                # A text is kept as it is, other values as JSON.
                into.append({"n": _clean(name), "r": is_record, "a": {_clean(k): _clean(v) if type(v) is str else _clean(json_text(v)) for k, v in said.items() if v is not None}, "c": nodes})
                below.append((child, child_kind, nodes))
        depth += bool(below)
        level = below
    return root, depth, kinds


def _dump(nodes: list) -> str:
    """JSON text of a list of nodes, without recursion."""
    out: list[str] = []
    stack: list = [nodes]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        elif isinstance(top, dict):
            out.append('{"n":' + json.dumps(top["n"], ensure_ascii=False) + ',"r":' + ("true" if top["r"] else "false") + ',"a":' + json.dumps(top["a"], ensure_ascii=False) + ',"c":')
            stack += ["}", top["c"]]
        else:
            out.append("[")
            stack.append("]")
            for k, x in enumerate(reversed(top)):
                stack.append(x)
                if k + 1 < len(top):
                    stack.append(",")
    return "".join(out)


def _shapes(df: DataFrame, key_cols: list[str], json_col: str) -> DataFrame:
    """Key columns, ``shape`` (JSON text of the normal shape), ``depth`` and ``kinds`` (attribute names and kinds) of each row that has any nodes."""
    source = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)], F.col(json_col).cast("string").alias("text")).where("text is not null")
    schema = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(key_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shapes, depths, kinds = [], [], [], []
            for row, text in enumerate(batch.column(len(key_cols)).to_pylist()):
                try:
                    value = read_json(text)
                    if type(value) is str:
                        value = read_json(value)
                except ValueError:
                    continue
                nodes, depth, found = normal_shape(value)
                if nodes:
                    at.append(row)
                    # The library's writer is faster, but recursive.
                    shapes.append(json.dumps(nodes, ensure_ascii=False, separators=(",", ":")) if depth < 100 else _dump(nodes))
                    depths.append(depth)
                    kinds.append([{"name": n, "kind": k} for n, k in sorted(found)])
            keys = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(key_cols))]
            names = [*(f"k{i}" for i in range(len(key_cols))), "shape", "depth", "kinds"]
            pairs = pa.array(kinds, pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())])))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(shapes, pa.string()), pa.array(depths, pa.int32()), pairs], names)

    return source.mapInArrow(run, f"{schema}, shape string, depth int, kinds array<struct<name:string,kind:string>>")


@dataclass
class RecordSchema:
    """The merged schema of all records: its levels and the common type of each attribute's values."""

    levels: int
    attributes: dict[str, str]

    def attribute_columns(self, attributes: Column) -> list[Column]:
        """The attributes as columns of their types; arrays, objects and values of several kinds stay JSON text."""
        return [F.try_element_at(attributes, F.lit(n)).try_cast(self.attributes[n]).alias(n) for n in sorted(self.attributes)]


#: Spark's type for values of one kind.
COLUMN_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


def inferred_schema(shapes: DataFrame) -> RecordSchema:
    """Merged over the rows' own schemas, which were found when they were parsed. Only names and kinds come to the driver."""
    depth = shapes.agg(F.max("depth")).first()[0] or 0
    kinds: dict[str, set[str]] = {}
    for r in shapes.select(F.inline("kinds")).distinct().toLocalIterator():
        kinds.setdefault(r["name"], set()).add(r["kind"])
    common = {n: {*k} - {"null"} for n, k in kinds.items()}
    return RecordSchema(depth, {n: COLUMN_TYPES.get(next(iter(k)), "string") if len(k) == 1 else "string" for n, k in common.items()})


def merged_schema(depth: int, attributes: bool = True) -> str:
    """The record schema of all rows, down to ``depth`` levels; what lies below stays JSON text."""
    said = "a:map<string,string>," if attributes else ""
    return reduce(lambda below, _: f"array<struct<n:string,r:boolean,{said}c:{below}>>", range(depth), "string")


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _child_rows(nodes: Column, parent: Column, level: int, attributes: bool) -> Column:
    """The array of rows that one level of nodes explodes into."""

    def row(x: Column, ordinal: Column) -> Column:
        step = F.when(x["r"], _escaped(x["n"])).otherwise(x["n"])
        path = F.when(parent["path"] == "", step).otherwise(F.concat(parent["path"], F.lit("/"), step))
        return F.struct(
            F.concat(parent["node_key"], F.lit("."), ordinal.cast("string")).alias("node_key"),
            parent["node_key"].alias("parent_key"),
            parent["record_key"].alias("record_parent_key"),
            F.when(x["r"], F.concat(parent["node_key"], F.lit("."), ordinal.cast("string"))).otherwise(parent["record_key"]).alias("record_key"),
            ordinal.cast("int").alias("ordinal"),
            F.lit(level).alias("level"),
            x["r"].alias("is_record"),
            F.when(x["r"], x["n"]).alias("name"),
            path.alias("path"),
            parent["record_path"].alias("parent_path"),
            F.when(x["r"], path).otherwise(parent["record_path"]).alias("record_path"),
            *([x["a"].alias("attributes")] if attributes else []),
        )

    return F.transform(nodes, lambda x, i: F.struct(row(x, i).alias("row"), x["c"].alias("below")))


def flatten_records(
    df: DataFrame, key_cols: list[str], json_col: str, levels_per_plan: int = LEVELS_PER_PLAN, attributes: bool = False
) -> DataFrame:
    """One row for every node of every row's nested records.

    Output: the key columns, then ``node_key`` (surrogate key within the row: the ordinals from the top,
    joined by dots), ``parent_key``, ``record_parent_key`` (nearest enclosing record), ``ordinal`` (place
    in the parent's array, from 0), ``level`` (from 1), ``is_record`` (false for array elements and
    alternatives), ``name``, ``path`` and ``parent_path``. The root's key is the text ``0``.

    Two record forms are read: an object is a schema with ``properties`` (its records), ``items`` (if an
    object), ``oneOf`` and ``anyOf``; an array is a list of records ``{name, fields}``. A text that is a
    JSON string is read once more. Null and empty texts, texts that aren't RFC 8259 JSON and values
    without records have no rows; records without a string as name are passed over. Repeated rows and
    null keys come out as often as they come in, and other columns aren't read, whatever their names.
    Without any records the result is empty. ``attributes`` adds a column ``attributes`` (MAP of names to texts:
    strings as they are, other values as JSON, nulls left out).
    """
    shapes = written_table(_shapes(df, key_cols, json_col), "shapes")
    return _exploded(shapes, key_cols, shapes.agg(F.max("depth")).first()[0] or 0, levels_per_plan, attributes)


def _exploded(shapes: DataFrame, key_cols: list[str], depth: int, levels_per_plan: int, attributes: bool) -> DataFrame:
    """The rows of ``flatten_records`` from the shapes, one explode for each of ``depth`` levels."""
    keys = [f"k{i}" for i in range(len(key_cols))]
    root = F.struct(
        F.lit("0").alias("node_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("record_parent_key"),
        F.lit("0").alias("record_key"), F.lit(0).alias("ordinal"), F.lit(0).alias("level"), F.lit(False).alias("is_record"),
        F.lit(None).cast("string").alias("name"), F.lit("").alias("path"), F.lit("").alias("parent_path"), F.lit("").alias("record_path"),
        *([F.create_map().cast("map<string,string>").alias("attributes")] if attributes else []),
    )
    todo = shapes.select(*keys, root.alias("row"), F.col("shape").alias("below"))
    parts, level = [], 0
    while True:
        steps = max(1, min(levels_per_plan, depth - level))
        rows = todo.withColumn("below", F.from_json("below", merged_schema(steps, attributes), {"maxNestingDepth": "100000"}))
        for step in range(steps):
            level += 1
            children = _child_rows(F.col("below"), F.col("row"), level, attributes)
            # A row whose level has been exploded goes on alone; a row of this level also yields its children.
            if step == 0:
                rows = rows.select(*keys, F.explode(children).alias("x"))
            else:
                same = F.array(F.struct(F.col("row").alias("row"), F.lit(None).cast(merged_schema(steps - step - 1, attributes)).alias("below")))
                exploded = F.when(F.col("below").isNull() | (F.size("below") == 0), same).otherwise(F.concat(same, children))
                rows = rows.select(*keys, F.explode(exploded).alias("x"))
            rows = rows.select(*keys, F.col("x.row").alias("row"), F.col("x.below").alias("below"))
        if level < depth:
            rows = cut_lineage(rows)
            todo = rows.where("below is not null and below <> '[]'")
        parts.append(rows.select(*keys, "row"))
        if level >= depth:
            break
    out = reduce(DataFrame.unionByName, parts)
    fields = ("node_key", "parent_key", "record_parent_key", "ordinal", "level", "is_record", "name", "path", "parent_path", *(["attributes"] if attributes else []))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, key_cols)], *[F.col(f"row.{f}").alias(f) for f in fields])


def parameters(df: DataFrame, key_col: str = "ord", json_col: str = "parameters") -> DataFrame:
    """One row per parameter at any depth: ``key_col``, ``param_path``, ``parent_path``. See ``flatten_records``."""
    rows = flatten_records(df, [key_col], json_col).where("is_record")
    return rows.select(key_col, F.col("path").alias("param_path"), "parent_path")


def child_tables(df: DataFrame, key_cols: list[str], json_col: str, levels_per_plan: int = LEVELS_PER_PLAN) -> tuple[RecordSchema, dict[int, DataFrame]]:
    """The merged schema of all rows' records, and one child table for each level.

    A table has the columns of ``flatten_records`` and ``attributes``, a struct of the merged schema's
    attributes; ``parent_key`` refers to the table of the level above (``0`` in the first). Conditions as
    in ``flatten_records``; without any records there are no tables.
    """
    shapes = written_table(_shapes(df, key_cols, json_col), "shapes")
    schema = inferred_schema(shapes)
    if not schema.levels:
        return schema, {}
    rows = cut_lineage(_exploded(shapes, key_cols, schema.levels, levels_per_plan, True))
    said = schema.attribute_columns(F.col("attributes"))
    rows = rows.withColumn("attributes", F.struct(*said) if said else F.struct(F.lit(None).cast("string").alias("none")))
    return schema, {level: rows.where(F.col("level") == level) for level in range(1, schema.levels + 1)}
