"""Shapes of payloads against what their readers expect."""

import datetime as dt
import json

from floodlens.operators.drift import expected_fields, fields_of_shape, shape_drift

RAW = "source string, date date, json_str string"
DAY, NEXT = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def drift(spark, *rows):
    table = [(s, d, t if t is None or isinstance(t, str) else json.dumps(t)) for s, d, t in rows]
    return sorted((r.source, r.date, r.field, r.problem, r.expected, r.found) for r in shape_drift(spark.createDataFrame(table, RAW)).collect())


TIDE = {"fuente": "x", "puerto": "p", "altura_marea_m": 1.5, "tendencia": "sube", "pleamar": False}


def test_nothing_is_told_of_payloads_as_expected(spark):
    assert drift(spark, ("inocar_mareas", DAY, TIDE), ("inocar_mareas", NEXT, {**TIDE, "altura_marea_m": 2, "tendencia": None})) == []
    features = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": "[1,2]"}, "properties": {"a": "b", "c": None}}]}
    assert drift(spark, ("ndbc_buoys", DAY, features), ("ndbc_buoys", DAY, {"type": "x", "features": None})) == []


def test_new_gone_and_other_types(spark):
    changed = {**{k: v for k, v in TIDE.items() if k != "puerto"}, "altura_marea_m": "1.5", "extra": {"deep": [1, {"x": 2}]}}
    assert drift(spark, ("inocar_mareas", DAY, TIDE), ("inocar_mareas", NEXT, changed)) == sorted([
        ("inocar_mareas", NEXT, "puerto", "gone", "string", None), ("inocar_mareas", NEXT, "altura_marea_m", "type", "double", "string"),
        ("inocar_mareas", NEXT, "extra", "new", None, "object")])
    # A field that one payload of the day has is not gone; kinds that differ within a day are told.
    mixed = drift(spark, ("inocar_mareas", DAY, TIDE), ("inocar_mareas", DAY, {**changed, "extra": None, "pleamar": 1}))
    assert [(f, p, k) for _, _, f, p, _, k in mixed] == [("altura_marea_m", "type", "variant"), ("extra", "new", "void"), ("pleamar", "type", "variant")]


def test_nested_fields_are_named_once(spark):
    noaa = {"metadata": {"source": "s", "timestamp": "t"}, "data": [{"year": 2024, "month": "1", "regions": {"nino_3": {"sst": 1.0, "anomaly": 0, "other": 1}}}]}
    found = {(f, p) for _, _, f, p, _, _ in drift(spark, ("noaa", DAY, noaa))}
    assert found == {("data[].month", "type"), ("data[].regions.nino_3.other", "new"), *((f"data[].regions.{r}", "gone") for r in ("nino_1_2", "nino_4", "nino_3_4"))}
    assert {(f, p) for _, _, f, p, _, _ in drift(spark, ("noaa", DAY, {"data": {"year": 1}}))} == {("data", "type"), ("metadata", "gone")}


def test_texts_that_are_no_object_and_other_sources(spark):
    assert drift(spark, ("inocar_mareas", DAY, "{"), ("inocar_mareas", DAY, None), ("inocar_mareas", DAY, "[1]"), (None, DAY, "7")) == []
    assert [(s, f, p) for s, _, f, p, _, _ in drift(spark, ("elsewhere", DAY, {"a": {"b": 1}, "c": 2}))] == [("elsewhere", "a", "unknown_source"), ("elsewhere", "c", "unknown_source")]
    assert drift(spark) == []


def test_shapes_are_taken_apart(spark):
    value = {"a": 1, "b c": {"d:e": [1.5, {"f": None}], "g`h": True}, "i": [], "j": [[1], [2]]}
    df = spark.createDataFrame([(json.dumps(value),)], "t string")
    shape = df.selectExpr("schema_of_variant_agg(parse_json(t)) AS s").first().s
    found = dict(fields_of_shape(shape))
    assert found["a"] == "bigint" and found["b c.d:e"] == "array" and found["b c.g`h"] == "boolean" and found["j[][]"] == "bigint" and found["i[]"] == "void"
    assert dict(expected_fields("x STRUCT<y: ARRAY<STRUCT<z: DOUBLE, m: MAP<STRING, STRING>>>>")) == {
        "x": "object", "x.y": "array", "x.y[]": "object", "x.y[].z": "double", "x.y[].m": "open"}
