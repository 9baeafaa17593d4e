"""Drift of payload shapes: which fields of a source's payloads are new, gone or of another type, day by day.

The shape of a source's day is one aggregate over variants, merged within and between tasks; no payload is collected. What it
says is taken apart into paths and set against the fields that the readers expect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.schemas import PAYLOAD_SCHEMAS
from floodlens.session import ship_package

#: Kinds that a reader of the key takes without loss: whole numbers pass as fractions, anything passes as text.
FITS = {
    "double": {"double", "bigint", "decimal"}, "int": {"bigint"}, "bigint": {"bigint"}, "boolean": {"boolean"},
    "string": {"string"}, "array": {"array"}, "object": {"object"}, "any": None,
}
_SCALAR = re.compile(r"[A-Z]+(?:\([0-9, ]+\))?")
_NAME = re.compile(r"`((?:[^`]|``)*)`|([^:`]+)")


def fields_of_shape(shape: str) -> list[tuple[str, str]]:
    """``path, kind`` of every field in the text of a variant's shape; elements of an array are ``path[]``.

    Kinds are object, array and the scalar types in lower case; ``void`` stands for null alone, ``variant`` for several kinds.
    """
    found: list[tuple[str, str]] = []

    def read(at: int, path: str) -> int:
        scalar = _SCALAR.match(shape, at)
        name, at = scalar[0].split("(")[0].lower(), scalar.end()
        found.append((path, name))
        if name == "array" and shape.startswith("<", at):
            at = read(at + 1, f"{path}[]") + 1
        elif name == "object" and shape.startswith("<", at):
            at += 1
            while shape[at] != ">":
                field = _NAME.match(shape, at)
                own = field[1].replace("``", "`") if field[1] is not None else field[2]
                at = read(field.end() + 2, f"{path}.{own}" if path else own)
                at += 2 if shape.startswith(", ", at) else 0
            at += 1
        return at

    read(0, "")
    return found[1:] if found[0] == ("", "object") else found


def expected_fields(schema: str) -> list[tuple[str, str]]:
    """``path, kind`` of the fields of a payload schema; below a map, and in text that may be anything, no field is named."""
    found: list[tuple[str, str]] = []

    def read(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            if path:
                found.append((path, "object"))
            for f in kind.fields:
                read(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            found.append((path, "array"))
            read(kind.elementType, f"{path}[]")
        else:
            found.append((path, "open" if isinstance(kind, T.MapType) else kind.simpleString()))

    read(T._parse_datatype_string(schema), "")
    return found


def payload_shapes(raw: DataFrame) -> DataFrame:
    """``source, date, shape, n_payloads`` of the payloads that are JSON objects."""
    parsed = raw.select("source", "date", F.try_parse_json("json_str").alias("payload"))
    objects = parsed.where(F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False)))
    return objects.groupBy("source", "date").agg(F.schema_of_variant_agg("payload").alias("shape"), F.count(F.lit(1)).alias("n_payloads"))


def shape_drift(raw: DataFrame, schemas: Mapping[str, str] = PAYLOAD_SCHEMAS) -> DataFrame:
    """``source, date, field, problem, expected, found`` where a day's payloads depart from what their readers expect.

    ``problem`` is ``new`` (no reader knows the field), ``gone`` (no payload of the day has it), ``type`` (of a kind that the
    reader would turn into NULL) or ``unknown_source``. A field that is null all day is not gone; a field below one that is
    gone, new or of another type is not named again. Payloads that are no JSON object are not looked at.
    """
    ship_package(raw.sparkSession)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, d, path, kind) for s, d, shape in zip(*(c.to_pylist() for c in batch.columns)) for path, kind in fields_of_shape(shape)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["source", "date", "field", "found"])

    # One row per source and day.
    days = payload_shapes(raw).select("source", "date", "shape")
    seen = days.mapInArrow(take_apart, "source string, date date, field string, found string")
    known = [(s, path, kind) for s, schema in schemas.items() for path, kind in expected_fields(schema)]
    wanted = raw.sparkSession.createDataFrame(known, "source string, field string, expected string")  # as many rows as the readers have fields
    due = days.select("source", "date").join(F.broadcast(wanted), "source")
    both = due.join(seen, ["source", "date", "field"], "full")
    fits = F.lit(False)
    for expected, kinds in FITS.items():
        if kinds is not None:
            fits = fits | ((F.col("expected") == expected) & F.col("found").isin(sorted(kinds)))
    fits = fits | (F.col("found") == "void") | ((F.col("expected") == "open") & F.col("found").isin("object", "void"))
    sources = F.broadcast(wanted.select("source").distinct().withColumn("known", F.lit(True)))
    problem = F.when(F.col("known").isNull(), "unknown_source").when(F.col("expected").isNull(), "new").when(F.col("found").isNull(), "gone").when(~fits, "type")
    told = both.join(sources, "source", "left").withColumn("problem", problem)
    # Every field has its parent's verdict, which speaks for what lies below.
    parent = F.regexp_replace("field", r"(\[\]|\.[^.\[]+|^[^.\[]+)$", "")
    above = told.where("problem is not null or found = 'void' or expected = 'open'").select(
        "source", "date", F.col("field").alias("parent"), F.lit(True).alias("spoken"))
    top = told.withColumn("parent", parent).join(above, ["source", "date", "parent"], "left").where("problem is not null and spoken is null")
    return top.where("problem <> 'unknown_source' or parent = ''").select("source", "date", "field", "problem", "expected", "found")
