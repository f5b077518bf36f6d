"""Sources that stand in files: arrays of JSON objects, trees of names, GeoPackage layers."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trees are read so deep.
DEPTH = 15
#: Rows of a layer that a task reads.
LAYER_ROWS = 10_000


def json_records(spark: SparkSession, path: str, schema: str, fields: list[str] | None = None) -> DataFrame:
    """The objects of an array of JSON objects, or of some of their fields. A file that holds anything else is an error."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    if first is None or not first[0].lstrip("﻿ \t").startswith("["):
        raise ValueError(f"{path} holds no array")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(*fields) if fields else rows


def tree_of_names(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Nested {"name", "children"} objects as rows: path (array of names), parent_path, name, depth, has_children. Siblings of one name are one node.

    A tree deeper than DEPTH is refused when its rows are read: the task ends with an error that says so.
    """
    schema = "struct<name:string>"
    for _ in range(DEPTH):
        schema = f"struct<name:string,children:array<{schema}>>"
    root = F.from_json(text_col, schema)
    level = texts.select(root.alias("n"), F.array().cast("array<string>").alias("above")).filter("n.name IS NOT NULL")
    rows = None
    for depth in range(1, DEPTH + 1):
        deep = depth < DEPTH
        if not deep:
            below = F.coalesce(F.size("n.children") > 0, F.lit(False))
            level = level.withColumn("n", F.when(below, F.raise_error(F.lit(f"a tree is deeper than {DEPTH} levels")).cast(level.schema["n"].dataType)).otherwise(F.col("n")))
        now = level.select(F.concat("above", F.array("n.name")).alias("path"), F.col("above").alias("parent_path"), F.col("n.name").alias("name"), F.lit(depth).alias("depth"), (F.coalesce(F.size("n.children") > 0, F.lit(False)) if deep else F.lit(False)).alias("has_children"))
        rows = now if rows is None else rows.unionByName(now)
        if deep:
            level = level.select(F.concat("above", F.array("n.name")).alias("above"), F.explode("n.children").alias("n")).select("n", "above").filter("n.name IS NOT NULL")
    return rows.groupBy("path", "parent_path", "name", "depth").agg(F.bool_or("has_children").alias("has_children"))


def rings_of(blob: bytes | None) -> list | None:
    """Parts, each an array of rings of (lon, lat), of a GeoPackage polygon or multipolygon; null for other geometries."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]

    def number(at: int, order: str, kind: str) -> tuple[int, int]:
        return struct.unpack_from(order + kind, blob, at)[0], at + struct.calcsize(kind)

    def geometry(at: int) -> tuple[list | None, int]:
        order = "<" if blob[at] else ">"
        kind, at = number(at + 1, order, "I")
        width = 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3))
        count, at = number(at, order, "I")
        parts: list = []
        if kind % 1000 == 6:
            for _ in range(count):
                part, at = geometry(at)
                parts += part or []
            return parts, at
        if kind % 1000 != 3:
            return None, at
        rings = []
        for _ in range(count):
            n, at = number(at, order, "I")
            values = struct.unpack_from(f"{order}{n * width}d", blob, at)
            rings.append([{"lon": values[k], "lat": values[k + 1]} for k in range(0, n * width, width)])
            at += 8 * n * width
        return [rings], at

    return geometry(at)[0]


def geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], geometry: str = "geom") -> DataFrame:
    """id, the columns as texts, and parts (polygons) of a layer. Each task reads a range of row ids; the file is where all executors see it."""
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in [*columns, geometry])
    source = '"' + layer.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {source}").fetchone()
    point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
    schema = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in columns), ("parts", pa.list_(pa.list_(pa.list_(point))))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch["start"].to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT rowid, {quoted} FROM {source} WHERE rowid >= ? AND rowid < ?", (start, start + LAYER_ROWS)).fetchall()
                data = [{"id": r[0], **{c: None if v is None else str(v) for c, v in zip(columns, r[1:-1], strict=True)}, "parts": rings_of(r[-1])} for r in rows]
                yield pa.RecordBatch.from_pylist(data, schema)

    tasks = max(1, -(-(high - low + 1) // LAYER_ROWS))
    ranges = spark.range(0, tasks, 1, tasks).select((F.lit(low) + F.col("id") * LAYER_ROWS).alias("start"))
    names = ", ".join(f"`{c}` string" for c in columns)
    return ranges.mapInArrow(read, f"id long, {names + ', ' if names else ''}parts array<array<array<struct<lon:double,lat:double>>>>")
