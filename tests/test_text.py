from pyspark.sql import functions as F

from intentlake.functions import jsonx, vectors
from intentlake.functions import text as T


def one(spark, expr, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'string' if not isinstance(v, (list, float)) else ('array<double>' if isinstance(v, list) and v and isinstance(v[0], float) else 'array<string>')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, T.normalize_text("s"), s="getHTTPResponse_code-x2Y") == "get httpresponse code x2 y"
    assert one(spark, T.normalize_text("s"), s=None) is None
    assert one(spark, T.tool_key("s"), s="_send-Mail_") == "send mail"


def test_tokenize(spark):
    assert one(spark, T.tokenize("s"), s="Get the hotel, a élan x") == ["hotel", "stay", "lodging", "lan"]
    assert one(spark, T.tokenize("s"), s="") == []
    assert one(spark, T.tokenize("s"), s="the of a") == []
    assert one(spark, T.tokenize("s"), s=None) is None
    assert one(spark, T.tokenize("s"), s="屏") == []
    assert one(spark, T.tokenize("s"), s="关闭屏幕") == [
        "屏幕", "画面", "画幅", "screen", "size", "关闭", "取消", "关掉", "禁用", "off", "disable", "关闭", "闭屏", "屏幕", "关闭屏", "闭屏幕", "关闭屏幕",
    ]


def test_overlap(spark):
    overlap = T.term_overlap(T.tokenize("a"), T.tokenize("b"))
    assert one(spark, overlap, a="blue boat", b="blue car blue") == 0.5
    assert one(spark, overlap, a="", b="x y") == 0.0
    assert one(spark, overlap, a=None, b="blue") == 0.0


def test_decompose(spark):
    d = T.decompose_query("s")
    assert one(spark, d, s="打开空调和车窗，然后关闭天窗") == ["打开空调", "打开车窗", "关闭天窗", "打开空调和车窗，然后关闭天窗"]
    assert one(spark, d, s="no separator") == ["noseparator"]
    assert one(spark, d, s="  ") == []
    assert one(spark, d, s=None) is None
    assert one(spark, T.decompose_query("s", False), s="aa,bb,aa") == ["aa", "bb"]


def test_small_functions(spark):
    assert one(spark, T.clean_text("s"), s=" NaN ") == ""
    assert one(spark, T.first_text("a", "b"), a=" none", b=" x ") == "x"
    assert one(spark, T.estimate_tokens(F.col("s")), s="x" * 11) == 2
    assert one(spark, T.estimate_tokens(F.col("s")), s=None) == 1
    assert one(spark, T.value_type("s"), s="Long") == "integer"
    assert one(spark, T.value_type("s"), s="List<int>") == "string"
    assert one(spark, T.value_type("s", True), s="List<int>") == "array"
    assert one(spark, T.value_type("s"), s=None) == "string"
    assert one(spark, T.trim_sentence("s"), s="a b。.;") == "a b"
    assert one(spark, T.tool_names_in("s"), s="x TOOL_NAME: a b \nTOOL_NAME:c") == ["a b", "c"]
    assert one(spark, T.defuse_markers("s"), s="<|end|> <||>") == "< |end| > <||>"
    assert len(one(spark, T.pool_digest(F.array("s")), s="doc")) == 16


def test_getters(spark):
    api = "boolean getDoorOpenStatus(@NonNull DoorZone zoneId),\nint getLevel()"
    got = one(spark, T.getter_signatures("s"), s=api)
    assert [(g.return_type, g.name) for g in got] == [("boolean", "getDoorOpenStatus"), ("int", "getLevel")]
    params = one(spark, T.method_parameters(F.col("s")), s="@NonNull DoorZone zoneId, int...xs, alone")
    assert [(p.type_name, p.name) for p in params] == [("DoorZone", "zoneId")]
    assert one(spark, T.getter_signatures("s"), s=None) == []


def test_json(spark):
    assert one(spark, jsonx.sorted_json("s"), s='{"b":1,"a":"é"}') == '{"a": "é", "b": 1}'
    assert one(spark, jsonx.sorted_json("s"), s="{") is None
    assert one(spark, F.to_json(jsonx.recover_json("s")), s='Sure: ["a"] ok') == '["a"]'
    assert one(spark, F.to_json(jsonx.recover_json("s")), s='so {"a":1}.') == '{"a":1}'
    assert one(spark, jsonx.recover_json("s").isNull(), s="nothing") is True
    argument = lambda key, kind: jsonx.extract_arguments("s", F.lit(key), F.lit(kind))
    text = "Convert 12.5 USD to EUR for the amount"
    assert one(spark, argument("amount", "number"), s=text) == "12.5"
    assert one(spark, argument("from_currency", "string"), s="change usd eur") == "USD"
    assert one(spark, argument("to_currency", "string"), s="usd eur now") == "EUR"
    assert one(spark, argument("zzz", "string"), s=text) is None
    assert one(spark, argument("zzz", "number"), s="") is None


def test_vectors(spark):
    assert one(spark, vectors.dot("a", "b"), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, vectors.normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]


def test_recovered_json_is_whole(spark):
    from intentlake.functions import jsonx

    cases = {
        '{"a": 1}': '{"a":1}', "well: [1, 2] done": "[1,2]", '["x"], "y": [1] then {"k": 2}': '{"k":2}', "[1] and ]": None, "{1} or }": None, "1, 2": None, "1}": None, "1]": None, '1, "x": 2': None, "": None, None: None, " 7 ": "7",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.j for r in df.select("t", F.to_json(jsonx.recover_json("t")).alias("j")).collect()}
    assert got == cases
