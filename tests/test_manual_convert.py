from pyspark.sql import functions as F

from intentlake.operators import convert, manual, sampling


def test_fill_forward(spark):
    rows = [
        (1, None, None, "lost", "int", "x"), (2, "openDoor", "opens", "zone", "Integer", "which"), (3, "", None, "level", "Float", "how far"), (4, "nan", None, "zone", "Bool", "second"),
        (5, "closeDoor", "closes", None, None, None), (6, "openDoor", "again", "zone", "list", None),
    ]
    df = spark.createDataFrame(rows, "ord long, action_name string, action_description string, input_name string, input_type string, input_description string")
    got = convert.fill_forward_tools(df).orderBy("ord").collect()
    assert [(r.ord, r.name, r.description, [(p.name, p.type, p.description) for p in r.parameters]) for r in got] == [
        (2, "openDoor", "opens", [("zone", "integer", "which"), ("level", "number", "how far")]),
        (5, "closeDoor", "closes", []),
        (6, "openDoor", "again", [("zone", "array", "")]),
    ]
    assert convert.fill_forward_tools(df.limit(0)).collect() == []


def test_signals(spark):
    rows = [
        (1, "Door", "open state", "boolean getOpen(@NonNull DoorZone zoneId)", "0: shut; 1: open。", "Vehicle.Door", "boolean", "7"),
        (2, "Door", "lock", "int getLock(DoorZone zoneId, int side)", None, "Vehicle.Door", None, None),
        (3, None, "speed", "setSpeed(int x)", None, "Vehicle.Speed", None, "nan"),
        (4, None, "lost", "int getX()", None, None, None, None),
        (5, "Door", "lock", "int getLock(DoorZone zoneId, int side)", None, "Vehicle.Door", None, None),
    ]
    df = spark.createDataFrame(rows, "ord long, module string, signal_label string, api string, value_range string, signal string, signal_type string, prop_id string")
    got = convert.signal_tools(df).orderBy("ord").collect()
    assert [r.name for r in got] == ["Vehicle.Door", "Vehicle.Speed"]
    assert [(p.name, p.type) for p in got[0].parameters] == [("zoneId", "string"), ("side", "integer")]
    assert got[0].description == (
        "查询Door模块的open state。返回值或范围：0: shut; 1: open。VSpec类型：boolean。PropID：7。北向查询API：getOpen。 查询Door模块的lock。北向查询API：getLock。"
    )
    assert got[0].parameters[0].description == "DoorZone zoneId，用于指定查询open state时的车辆区域或位置。"
    assert got[1].description == "查询speed。" and got[1].parameters == []
    assert [r.name for r in convert.signal_tools(df, include_without_getter=False).collect()] == ["Vehicle.Door"]


def test_templates_and_verification(spark):
    rows = [(i, f"tool_{w}", f"{w} the {w} quickly.", "{}", None) for i, w in enumerate(["paint", "grill", "weld", "sail", "knit", "bake"], 1)] + [(9, "bare", None, None, None)]
    tools = spark.createDataFrame(rows, "ord long, name string, description string, parameters string, category string")
    proposed = manual.template_queries(tools).withColumn("query_id", F.concat_ws(":", "ord", "query_no"))
    texts = {(r.name, r.query_no): r.query for r in proposed.collect()}
    assert texts["tool_paint", 0] == "I want to paint the paint quickly."
    assert texts["tool_paint", 2] == "Find a tool for paint quickly."
    assert texts["bare", 2] == "Find a tool for bare." and len(texts) == 56
    catalogue = sampling.dense_index(tools.select("ord", "name"), ["ord"]).select("idx", "name")
    checked = {r.query_id: r for r in manual.verify_queries(proposed, tools, catalogue, 3).collect()}
    assert checked["1:0"].accepted and checked["1:0"].verifier_choice == "tool_paint" and checked["1:0"].rejection_reason is None
    assert len(checked) == 56


def test_acceptance(spark):
    rows = [(1, "a", "q", True), (2, "a", "q2", True), (3, "a", "q3", True), (4, "a", "", True), (5, "b", "q", False), (6, "b", "q", None), (7, "b", None, True)]
    df = spark.createDataFrame(rows, "entry_ord long, tool_name string, query string, accepted boolean")
    assert sorted(r.entry_ord for r in manual.accepted_manual(df, 2).collect()) == [1, 2]
    tools = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {r.name: r.needed for r in manual.unfinished(tools, df, 3).collect()} == {"b": 2, "c": 3}


def test_generation_survives_failures(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "ord long, name string").coalesce(1)

    def model(rows):
        if any(r["name"] == "t4" for r in rows):
            raise RuntimeError("disconnected")
        return [[f"use {r['name']}"] for r in rows]

    got = {r.name: r for r in manual.generate(df, ["ord", "name"], model, batch_size=3, attempts=2).collect()}
    assert got["t0"].queries == ["use t0"] and got["t0"].error is None
    assert got["t4"].queries is None and "disconnected" in got["t4"].error and len(got) == 10


def test_choice(spark):
    df = spark.createDataFrame([(" b ",), ("I pick a_b",), ("none",), (None,)], "answer string")
    names = F.array(F.lit("b"), F.lit("a_b"))
    assert [r.x for r in df.select(manual.parse_choice(F.col("answer"), names).alias("x")).collect()] == ["b", "b", None, None]
