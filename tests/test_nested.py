import json
from collections import Counter

import pytest

from intentlake.operators import nested


def brute(text):
    def bad(_):
        raise ValueError

    def escape(n):
        return n.replace("~", "~0").replace("/", "~1")

    out = []

    def schema(v, path, parent):
        if not isinstance(v, dict):
            return
        if isinstance(v.get("properties"), dict):
            for k, x in v["properties"].items():
                here = path + [escape(k)]
                out.append(("/".join(here), "/".join(parent)))
                schema(x, here, here)
        if isinstance(v.get("items"), dict):
            schema(v["items"], path + ["*"], parent)
        for word in ("oneOf", "anyOf"):
            for i, x in enumerate(v[word] if isinstance(v.get(word), list) else []):
                schema(x, path + [f"|{i}"], parent)

    def records(v, path):
        for r in v if isinstance(v, list) else []:
            if isinstance(r, dict) and isinstance(r.get("name"), str):
                here = path + [escape(r["name"])]
                out.append(("/".join(here), "/".join(path)))
                records(r.get("fields"), here)

    try:
        v = json.loads(text, parse_constant=bad)
        if isinstance(v, str):
            v = json.loads(v, parse_constant=bad)
    except (ValueError, TypeError):
        return out
    records(v, []) if isinstance(v, list) else schema(v, [], [])
    return out


def deep(n):
    v = {"properties": {"end": {}}}
    for i in range(n):
        v = {"properties": {f"l{i}": v}} if i % 3 else {"properties": {"a": {"items": v}, "b": 1}}
    return json.dumps(v)


TEXTS = [
    None, "", " ", "{}", "[]", "null", "1", '"x"', "{", '{"properties":{"a":{}}} x', "{'properties':{'a':1}}", '{"properties":{"a":NaN}}', '{"properties":{"a":01}}',
    '{"properties":{"a":1e999,"b":-0.0}}', '{"properties":{"a":1,"a":{"properties":{"x":1}}}}', '{"properties":["a"]}', '{"properties":{"":{},"a/b":{},"~":{},"~1/":{"properties":{"x.y[0]":null}}}}',
    '{"items":{"properties":{"a":{}}},"default":{"properties":{"no":{}}}}', '{"items":[{"properties":{"no":{}}}]}',
    '{"oneOf":[{"properties":{"a":{}}},3,{"anyOf":[{"items":{"properties":{"b":{}}}}]}],"properties":{"oneOf":{"oneOf":[{},{"properties":{"c":{}}}]}}}',
    '[{"name":"a","fields":[{"name":"b/c","type":"x"},{"nope":1},5,{"name":7}]},{"name":"a"}]', json.dumps('{"properties":{"in":{}}}'), json.dumps(json.dumps('{"properties":{"no":{}}}')),
    '﻿{"properties":{"no":{}}}', ' \n\t{"properties":{"sp":{"type":"x\\u00e9"}}}\r\n', '{"properties":{"tab\\t":{},"raw\ttab":{}}}', '{"properties":{"\\ud83d\\ude00":{},"名":{}}}', deep(9), deep(40),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "ord long, parameters string, row string, depth int")


@pytest.mark.parametrize("levels", [2, 6])
def test_equals_brute_force(spark, levels):
    rows = nested.flatten_records(frame(spark, TEXTS), ["ord"], "parameters", levels).where("is_record").collect()
    got = Counter((r.ord, r.path, r.parent_path) for r in rows)
    want = Counter((i, p, q) for i, t in enumerate(TEXTS) if t is not None for p, q in brute(t))
    assert got == want


def test_links(spark):
    rows = nested.flatten_records(frame(spark, TEXTS + TEXTS), ["ord"], "parameters").collect()
    keys = {(r.ord, r.node_key): r for r in rows}
    assert len(keys) == len(rows)
    for r in rows:
        assert r.node_key == f"{r.parent_key}.{r.ordinal}"
        if r.level > 1:
            assert keys[r.ord, r.parent_key].level == r.level - 1
        if r.record_parent_key != "0":
            owner = keys[r.ord, r.record_parent_key]
            assert owner.is_record and owner.path == r.parent_path
    schema, tables = nested.child_tables(frame(spark, TEXTS), ["ord"], "parameters")
    assert list(tables) == list(range(1, schema.levels + 1)) and all(t.count() > 0 for t in tables.values())
    assert sum(t.count() for t in tables.values()) * 2 == len(rows)


def test_empty(spark):
    assert nested.parameters(frame(spark, TEXTS).limit(0)).collect() == []
    assert nested.parameters(frame(spark, ["{}", None])).collect() == []


def test_very_deep_text_is_read():
    n = 60_000
    assert nested.read_json("[" * n + "]" * n) is not None
    for bad in ("[" * n, "[" * n + "}" * n, "[" * n + "]" * n + "x", '{"a":' * n + "1" + "}" * (n - 1), "[" * n + "1," + "]" * n):
        with pytest.raises(ValueError):
            nested.read_json(bad)


def test_deep_reader_equals_the_usual_one():
    for t in TEXTS:
        if t is None:
            continue
        try:
            want = json.loads(t, parse_constant=nested._refuse, parse_int=nested._Number, parse_float=nested._Number)
        except ValueError:
            with pytest.raises(ValueError):
                nested._read_deep(t)
        else:
            assert nested._read_deep(t) == want


def test_attributes_have_the_merged_schemas_types(spark):
    texts = [
        '{"properties":{"a":{"type":"string","minimum":1.50,"required":true,"enum":[1,"x",null,{"k":2e999}],"properties":{"b":{"type":["x","y"],"description":"d\\u00e9"}}}}}',
        '[{"name":"c","type":"int","minimum":2,"default":null,"fields":[{"name":"d","minimum":"many","required":false,"properties":5}]}]',
        '{"properties":{"e":7,"f":{"items":[1],"anyOf":{"k":1}}}}',
    ]
    schema, tables = nested.child_tables(frame(spark, texts), ["ord"], "parameters")
    assert schema.attributes == {
        "type": "string", "minimum": "string", "required": "boolean", "enum": "string", "description": "string", "default": "string", "properties": "double", "items": "string", "anyOf": "string",
    }
    rows = {r.name: r.attributes.asDict() for t in tables.values() for r in t.collect()}
    said = lambda n: {k: v for k, v in rows[n].items() if v is not None}
    assert said("a") == {"type": "string", "minimum": "1.50", "required": True, "enum": '[1,"x",null,{"k":2e999}]'}
    assert said("b") == {"type": '["x","y"]', "description": "dé"}
    assert said("c") == {"type": "int", "minimum": "2"}
    assert said("d") == {"minimum": "many", "required": False, "properties": 5.0}
    assert said("e") == {} and said("f") == {"items": "[1]", "anyOf": '{"k":1}'}
    assert nested.child_tables(frame(spark, ["{}", None]), ["ord"], "parameters") == (nested.RecordSchema(0, {}), {})


def test_json_text_round_trip():
    for t in TEXTS:
        try:
            value = nested.read_json(t or "")
        except ValueError:
            continue
        assert nested.read_json(nested.json_text(value)) == value
