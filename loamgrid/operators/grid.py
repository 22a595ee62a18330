"""Points to surfaces: grid plan, interpolation, heat.

Every sample is scattered to the grid nodes within its radius and combined
with map-side partial aggregates.  There is no sample-to-cell join, so a spot
that holds a third of the samples costs no extra shuffle: its contributions
collapse to one row per node in each map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from loamgrid.functions.crs import to_mercator
from loamgrid.functions.geometry import expand_polygon, inside_clip
from loamgrid.functions.scalar import js_number
from loamgrid.operators.hull import convex_hull
from loamgrid.plans.buckets import bucket, salted_join
from loamgrid.session import has_rows, settle

# Smallest radius and cell (metres) and the optional cap on cells per side.
MIN_RADIUS = 50.0
MIN_CELL = 25.0
MAX_SIDE = 260


@dataclass(frozen=True)
class GridOptions:
    radius: float = 2000.0
    cell: float = 250.0
    min_samples: int = 2
    clip: str = "hull"  # hull | bbox
    fit_side: int | None = None  # e.g. 260 enlarges cells until each side fits


def samples(df: DataFrame, value: str | None = None, seq: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Point rows to ``seq, x, y, value`` in web mercator; non-numeric values drop out."""
    v = F.lit(1.0) if value is None else js_number(F.col(f"`{value}`"))
    m = to_mercator(lon, lat)
    return (
        df.select(F.col(seq).alias("seq"), m.alias("m"), v.alias("value"))
        .select("seq", "m.x", "m.y", "value")
        .filter("x IS NOT NULL AND y IS NOT NULL AND value IS NOT NULL")
    )


def grid_plan(points: DataFrame, o: GridOptions) -> DataFrame:
    """One row ``minx, maxy, cell, width, height``."""
    r = max(o.radius, MIN_RADIUS)
    base = max(o.cell, MIN_CELL)
    b = points.agg(
        (F.min("x") - r).alias("minx"), (F.max("x") + r).alias("maxx"), (F.min("y") - r).alias("miny"), (F.max("y") + r).alias("maxy")
    )
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.lit(base))
    high = F.greatest(F.col("maxy") - F.col("miny"), F.lit(base))
    cell = F.lit(base)
    if o.fit_side:
        ratio = F.greatest(F.ceil(wide / base), F.ceil(high / base)) / F.lit(float(o.fit_side))
        cell = F.lit(base) * F.greatest(F.lit(1.0), ratio)
    return b.select(
        "minx",
        "miny",
        "maxx",
        "maxy",
        cell.alias("cell"),
        F.greatest(F.lit(2), F.ceil(wide / cell)).cast("bigint").alias("width"),
        F.greatest(F.lit(2), F.ceil(high / cell)).cast("bigint").alias("height"),
    )


def clip_ring(points: DataFrame, o: GridOptions) -> Column:
    """The padded hull as a scalar array, or an empty array for no clipping."""
    if o.clip != "hull":
        return F.array().cast("array<struct<x:double,y:double>>")
    hull = convex_hull(points.select("x", "y").distinct())
    return hull.select(expand_polygon("hull", max(o.radius, MIN_RADIUS) * 0.25).alias("h")).scalar()


def _scatter(points: DataFrame, plan: Row, radius: float) -> DataFrame:
    """``seq, value, row, col, nx, ny, d``: every node within the radius of every sample."""
    p = {k: F.lit(v) for k, v in plan.asDict().items()}
    s, x0, y0 = p["cell"], p["minx"], p["maxy"]
    r = F.lit(float(radius))

    def steps(lo: Column, hi: Column, size: Column) -> Column:
        lo = F.greatest(F.lit(0), F.ceil(lo).cast("bigint"))
        hi = F.least(size - 1, F.floor(hi).cast("bigint"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    rows = points.withColumn(
        "row", F.explode(steps((y0 - F.col("y") - r) / s - 1e-6, (y0 - F.col("y") + r) / s + 1e-6, p["height"]))
    )
    dy = y0 - F.col("row") * s - F.col("y")
    half = F.sqrt(F.greatest(F.lit(0.0), r * r - dy * dy))
    nodes = rows.withColumn(
        "col", F.explode(steps((F.col("x") - half - x0) / s - 1e-6, (F.col("x") + half - x0) / s + 1e-6, p["width"]))
    )
    nx, ny = x0 + F.col("col") * s, y0 - F.col("row") * s
    placed = nodes.select(
        "seq", "value", "row", "col", nx.alias("nx"), ny.alias("ny"),
        F.hypot(F.col("x") - nx, F.col("y") - ny).alias("d"),
    )
    return placed.filter(F.col("d") <= radius)


def interpolate(points: DataFrame, o: GridOptions = GridOptions(), method: str = "idw", power: float = 2.0) -> DataFrame:
    """``row, col, x, y, value, neighbor_count``; nodes without a value are absent.

    ``idw`` weights 1/d^power, ``gaussian`` uses sigma = radius/3, ``nearest``
    takes the closest sample (first by ``seq``).  A sample exactly on a node
    wins outright, and the count is then the number of samples before it.
    """
    radius = max(o.radius, MIN_RADIUS)
    plan = grid_plan(points, o).first()  # one row
    if plan["minx"] is None:
        return points.select(*[F.lit(0).alias(c) for c in ("row", "col")], "x", "y", "value", F.lit(0).alias("neighbor_count")).limit(0)
    scattered = _scatter(points, plan, radius)
    d, v = F.col("d"), F.col("value")
    off = d > 0
    if method == "gaussian":
        w = F.exp(-(d * d) / (2 * (radius / 3) ** 2))
    elif method == "idw":
        w = F.try_divide(F.lit(1.0), F.pow(d, F.lit(float(power))))
    elif method != "nearest":
        raise ValueError(f"unknown method: {method}")
    keys = ["row", "col"]
    first = [F.first("nx").alias("x"), F.first("ny").alias("y"), F.count_if(off).alias("near")]
    if method == "nearest":
        # plain numbers add up by hash in each task; the closest samples are then picked out of a second scatter
        stats = settle(scattered.groupBy(*keys).agg(*first, F.min("d").alias("least")))
        closest = scattered.join(stats.select(*keys, "least"), keys).filter(d == F.col("least"))
        picked = closest.groupBy(*keys).agg(F.min_by("value", F.struct("seq")).alias("estimate"))
        stats = stats.drop("least").join(picked, keys, "left")
    else:
        stats = scattered.groupBy(*keys).agg(
            *first, F.sum(F.when(off, v * w)).alias("vw"), F.sum(F.when(off, w)).alias("w")
        ).withColumn("estimate", F.try_divide("vw", "w"))
    hits = settle(_scatter(points, plan, 0.0).groupBy(*keys).agg(F.min(F.struct("seq", "value")).alias("hit"), F.first("nx").alias("nx"), F.first("ny").alias("ny")))
    if has_rows(hits):
        full = stats.join(_before_hits(points, hits, radius), keys, "left")
    else:
        full = stats.withColumns({"hit": F.lit(None).cast(hits.schema["hit"].dataType), "before": F.lit(None).cast("bigint")})
    value = F.when(F.col("hit").isNotNull(), F.col("hit.value")).when(F.col("near") >= o.min_samples, F.col("estimate"))
    count = F.when(F.col("hit").isNotNull(), F.greatest(F.lit(1), F.coalesce("before", F.lit(0)))).otherwise(F.col("near"))
    out = full.select("row", "col", "x", "y", value.alias("value"), count.cast("bigint").alias("neighbor_count"))
    return _clipped(out.filter("value IS NOT NULL"), points, o)


def _before_hits(points: DataFrame, hits: DataFrame, radius: float) -> DataFrame:
    """``row, col, hit, before``: for nodes that carry a sample, the samples in reach that come before it.

    Nodes and samples meet by bucket, so nothing is scattered for the other nodes.
    """
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = (
        hits.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around))
        .withColumns({"_by": bucket("ny", radius) + F.col("_a"), "_bx": bucket("nx", radius) + F.col("_b")}).drop("_a", "_b")
    )
    placed = points.select("seq", "x", "y").withColumns({"_by": bucket("y", radius), "_bx": bucket("x", radius)})
    close = (F.col("seq") < F.col("hit.seq")) & (F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) <= radius)
    met = salted_join(placed, near, ["_by", "_bx"], "seq").filter(close).groupBy("row", "col").agg(F.count(F.lit(1)).alias("before"))
    return hits.select("row", "col", "hit").join(met, ["row", "col"], "left")


def heatmap(points: DataFrame, o: GridOptions = GridOptions(1500.0, 200.0, 1)) -> DataFrame:
    """Weighted Gaussian density per node; nodes at or below zero are absent."""
    radius = max(o.radius, MIN_RADIUS)
    w = F.exp(-(F.col("d") * F.col("d")) / (2 * (radius / 3) ** 2))
    plan = grid_plan(points, o).first()  # one row
    if plan["minx"] is None:
        return points.select(*[F.lit(0).alias(c) for c in ("row", "col")], "x", "y", "value", F.lit(0).alias("neighbor_count")).limit(0)
    cells = (
        _scatter(points, plan, radius)
        .groupBy("row", "col")
        .agg(
            F.first("nx").alias("x"),
            F.first("ny").alias("y"),
            F.sum(F.col("value") * w).alias("value"),
            F.count(F.lit(1)).alias("neighbor_count"),
        )
        .filter((F.col("neighbor_count") >= o.min_samples) & (F.col("value") > 0))
    )
    return _clipped(cells, points, o)


def _clipped(cells: DataFrame, points: DataFrame, o: GridOptions) -> DataFrame:
    if o.clip != "hull":
        return cells
    return clip_cells(cells, clip_ring(points, o))


def clip_cells(cells: DataFrame, ring: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Keep nodes inside a ring (a scalar array of vertices)."""
    return cells.withColumn("_ring", ring).filter(inside_clip(x, y, "_ring")).drop("_ring")


def surface_summary(cells: DataFrame) -> DataFrame:
    """R05; an empty surface is an error."""
    n = F.count(F.lit(1))
    empty = F.raise_error(F.lit("no cell within the radius and sample threshold"))
    return cells.agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.when(n > 0, n).otherwise(empty.cast("bigint")).alias("valid_cells"),
        F.avg("neighbor_count").alias("mean_neighbors"),
    )


def rescale(cells: DataFrame, intensity: float = 1.2, out: str = "ratio") -> DataFrame:
    """Min-max ratio raised to 1/intensity."""
    span = cells.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    width = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - lo) / width))
    return cells.withColumn("_span", span).withColumn(out, F.pow(ratio, F.lit(1.0 / intensity))).drop("_span")
