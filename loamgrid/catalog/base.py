"""Registry of named queries with their SQL twins, and the shared input views.

The driver tables hold no coordinates.  The views below place rows by whole
number arithmetic that Spark and DuckDB evaluate identically.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "pts": """SELECT event_id AS id, 77.0 + CAST((event_id*7919) % 10000 AS DOUBLE)/1e4 AS lon,
        8.0 + CAST((event_id*6007) % 10000 AS DOUBLE)/1e4 AS lat, value, event_type, user_id, ts FROM events""",
    "facilities": """SELECT s_suppkey AS id, s_name AS name, 77.0 + CAST((s_suppkey*37) % 1000 AS DOUBLE)/1e3 AS lon,
        8.0 + CAST((s_suppkey*613) % 1000 AS DOUBLE)/1e3 AS lat,
        CAST(1000 + s_suppkey % 5 * 500 AS DOUBLE) AS radius_m, CAST(2 + s_suppkey % 3 AS DOUBLE) AS height_m FROM supplier""",
    "zones": """SELECT n_nationkey AS id, n_name AS name, n_regionkey AS grp,
        77.0 + CAST(n_nationkey % 5 AS DOUBLE)*2e-1 AS minx, 8.0 + CAST(floor(n_nationkey/5e0) AS DOUBLE)*2e-1 AS miny,
        77.0 + CAST(n_nationkey % 5 + 1 AS DOUBLE)*2e-1 AS maxx, 8.0 + CAST(floor(n_nationkey/5e0)+1 AS DOUBLE)*2e-1 AS maxy FROM nation""",
    "dem": """SELECT r AS "row", c AS col, CAST(1000 - 3*abs(c-50) - r % 40 + ((r*r*7 + c*13 + r*c) % 17) AS DOUBLE) AS z
        FROM (SELECT CAST(floor(o_orderkey/1e2) AS BIGINT) AS r, o_orderkey % 100 AS c FROM orders) AS o""",
    "gfc": """SELECT c_custkey AS id, c_mktsegment AS category, c_acctbal AS amount, c_nationkey AS zone FROM customer""",
    # quadrilaterals: a slanted box with a smaller box as a hole, one per customer
    "plots": """SELECT c_custkey AS id, 77.0 + CAST((c_custkey*7919) % 1000 AS DOUBLE)/1e3 AS x,
        8.0 + CAST((c_custkey*6007) % 1000 AS DOUBLE)/1e3 AS y,
        CAST(1 + c_custkey % 7 AS DOUBLE)/1e2 AS w, CAST(1 + c_custkey % 5 AS DOUBLE)/1e2 AS h FROM customer""",
    # texts that exercise coercion
    "texts": """SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 5 ' WHEN 3 THEN '1d'
        WHEN 4 THEN '0x10' WHEN 5 THEN 'NaN' WHEN 6 THEN 'abc' WHEN 7 THEN 'true' WHEN 8 THEN '-2.5' WHEN 9 THEN '1e3'
        WHEN 10 THEN 'No' ELSE CAST(event_id % 1000 AS VARCHAR(10)) END AS raw FROM events""",
}
USES = {
    "pts": ["events"], "facilities": ["supplier"], "zones": ["nation"], "dem": ["orders"], "gfc": ["customer"],
    "plots": ["customer"], "texts": ["events"],
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when given, the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the view definitions a statement uses."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    defs = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = sql.strip()
    m = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{defs},\n{body[m.end():]}"
    return f"WITH {defs}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace('"row"', "`row`")
    for t in USES[name]:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf, t) for t in USES[name]})


def rnd(c, places: int = 6) -> Column:
    """Rounded and free of negative zero, for comparison with :func:`sql_rnd`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def sql_rnd(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0e0)"


def sql_hav(lon1: str, lat1: str, lon2: str, lat2: str, radius: str = "6378137e0") -> str:
    return (
        f"(2e0*{radius}*asin(least(1e0, sqrt(pow(sin(radians({lat2}-{lat1})/2e0),2) + "
        f"cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2e0),2)))))"
    )


def sql_tile_x(lon: str, z: int) -> str:
    return f"CAST(floor(({lon} + 180e0)/360e0*pow(2e0,{z})) AS BIGINT)"


def sql_tile_y(lat: str, z: int) -> str:
    phi = f"radians(greatest(-85.05112878e0, least(85.05112878e0, {lat})))"
    return f"CAST(floor((1e0 - ln(tan({phi}) + 1e0/cos({phi}))/pi())/2e0*pow(2e0,{z})) AS BIGINT)"


def sql_tile_lat(y: str, z: int) -> str:
    return f"degrees(atan(sinh(pi()*(1e0 - 2e0*({y})/pow(2e0,{z})))))"


def sql_mercator(lon: str, lat: str) -> tuple[str, str]:
    return (
        f"(6378137e0*radians({lon}))",
        f"(6378137e0*ln(tan(pi()/4e0 + radians(greatest(-85.05112878e0, least(85.05112878e0, {lat})))/2e0)))",
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared area for queries that read back what they wrote."""
    import uuid

    from loamgrid.session import shared_dir

    return f"{shared_dir(spark)}/loamgrid-io/{name}-{uuid.uuid4().hex}"
