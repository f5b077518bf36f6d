"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.sources.tables import LINE_ID, SHAPES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB tables that several queries' SQL begins with; see terrace.sources.tables.
DIVISIONS = """divisions AS (
    SELECT (r_regionkey + 1000000000)::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region
    UNION ALL SELECT (n_nationkey + 100000000)::BIGINT, (n_regionkey + 1000000000)::BIGINT, n_name FROM nation
    UNION ALL SELECT c_custkey, (c_nationkey + 100000000)::BIGINT, c_name FROM customer)"""
DEEP = """tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 3 THEN c_custkey // 3 END AS parent_id, c_name AS name FROM customer)"""
CLOSURE = """closure AS (
    SELECT id AS node, id AS ancestor, 0::BIGINT AS distance FROM {tree}
    UNION ALL SELECT c.node, t.parent_id, c.distance + 1 FROM closure c JOIN {tree} t ON t.id = c.ancestor WHERE t.parent_id IS NOT NULL)"""
POINTS = """points AS (SELECT p_partkey AS id, p_brand AS brand, p_partkey * 37 % 3600 / 10 - 180 AS lon, p_partkey * 91 % 1700 / 10 - 85 AS lat FROM part)"""
BOXES = """boxes AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey * 14 - 180 AS west, n_nationkey * 7 % 120 - 60 AS south,
    n_nationkey * 14 - 160 AS east, n_nationkey * 7 % 120 - 35 AS north FROM nation)"""
HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def deep_closure() -> str:
    return f"WITH RECURSIVE {DEEP}, {CLOSURE.format(tree='tree')}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
OBJECTS = """objects AS (SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_type AS kind, p_size AS size, p_retailprice AS price,
    p_partkey * 37 % 3600 / 10 - 180 AS lon, p_partkey * 91 % 1700 / 10 - 85 AS lat FROM part)"""
PLACES = f"""places AS (SELECT {LINE_ID} AS id, l_partkey AS object_id, (l_orderkey * 53 + l_linenumber * 7) % 3600 / 10 - 180 AS lon,
    (l_orderkey * 29 + l_suppkey * 11) % 1700 / 10 - 85 AS lat, l_returnflag <> 'R' AS offered, l_returnflag AS flag FROM lineitem)"""


def _edge_rows() -> str:
    rows = [(part, ring, modulus, k, *a, *b) for part, ring, modulus, points in SHAPES for k, (a, b) in enumerate(zip(points, points[1:], strict=False))]
    return ", ".join(map(str, rows))


#: The edges of terrace.sources.tables.parts_of_nations.
EDGES = f"""edges AS (SELECT (n_nationkey + 100000000)::BIGINT AS region_id, part, ring, k, n_nationkey * 14 - 180.0::DOUBLE + dx1 AS x1, n_nationkey * 7 % 120 - 60.0::DOUBLE + dy1 AS y1,
    n_nationkey * 14 - 180.0::DOUBLE + dx2 AS x2, n_nationkey * 7 % 120 - 60.0::DOUBLE + dy2 AS y2
    FROM nation, (VALUES {_edge_rows()}) AS shape(part, ring, modulus, k, dx1, dy1, dx2, dy2) WHERE n_nationkey % modulus = 0)"""
#: Even-odd crossings of a ray to the east, without points on the border.
AROUND = """sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
    AND NOT bool_or((x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))"""
DIRECT = f"""{PLACES}, {EDGES}, direct AS (SELECT DISTINCT id AS place, region_id FROM (
    SELECT id, region_id, part FROM places JOIN edges ON true WHERE offered GROUP BY id, lon, lat, region_id, part HAVING {AROUND}))"""
