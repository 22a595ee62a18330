"""Measured paths and areas over ordered point rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamgrid.functions.geometry import RADIUS_MEASURE, haversine, segments
from loamgrid.plans.ranks import in_ranges


def _pieces(points: DataFrame, path: str, order: tuple[str, ...], lon: str, lat: str, leg) -> tuple[DataFrame, DataFrame]:
    """Points in ranges of (path, order) with ``_leg`` from the point before in the range; and one row for each range of a
    path: its first and last point, the sum of its legs, ``_joint`` from the range before and ``_start``, the sum before it."""
    placed = in_ranges(points, path, *order)
    w = Window.partitionBy("_range", path).orderBy(*order)
    at = F.struct(F.col(lon).alias("x"), F.col(lat).alias("y"))
    before = F.lag(at).over(w)
    placed = placed.withColumn("_leg", F.when(before.isNotNull(), leg(before, at)))
    key = F.struct(*order)
    pieces = placed.groupBy("_range", path).agg(
        F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("_sum"), F.min_by(at, key).alias("_a"), F.max_by(at, key).alias("_z"), F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy(path).orderBy("_range")  # one row a range
    last = F.lag("_z").over(along)
    pieces = pieces.withColumn("_joint", F.when(last.isNotNull(), leg(last, F.col("_a"))))
    done = F.sum(F.col("_sum") + F.coalesce("_joint", F.lit(0.0))).over(along)
    return placed, pieces.withColumn("_start", done - F.col("_sum"))


def measure_path(points: DataFrame, path: str, *order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``leg`` and running ``distance`` along each path.

    A path is spread over ranges of its order, each of which takes the last point and the total of those before.
    """
    placed, pieces = _pieces(points, path, order, lon, lat, lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"], RADIUS_MEASURE))
    late = pieces.filter("_joint IS NOT NULL").select(F.struct("_range", path).alias("_piece"), "_joint", "_start")
    same = (F.col("_range") == F.col("_piece._range")) & F.col(path).eqNullSafe(F.col(f"_piece.{path}"))
    running = Window.partitionBy("_range", path).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce(F.sum("_leg").over(running), F.lit(0.0))
    return (
        placed.withColumn("_inside", inside)
        .join(late, same, "left")
        .withColumns({"leg": F.coalesce("_leg", "_joint", F.lit(0.0)), "distance": F.coalesce("_start", F.lit(0.0)) + F.col("_inside")})
        .drop("_range", "_leg", "_inside", "_piece", "_joint", "_start")
    )


def measure_area(points: DataFrame, path: str, *order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Spherical area enclosed by each ordered path, 0 below three points.

    Ranges of a path add up their own terms; the joints between them and the wrap-around need their ends only.
    """

    def term(a, b):
        return F.radians(b["x"] - a["x"]) * (F.lit(2.0) + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))

    _, pieces = _pieces(points, path, order, lon, lat, term)
    rings = pieces.groupBy(path).agg(
        F.sum(F.col("_sum") + F.coalesce("_joint", F.lit(0.0))).alias("_s"), F.min_by("_a", "_range").alias("_a"), F.max_by("_z", "_range").alias("_z"),
        F.sum("_n").alias("points"),
    )
    total = F.col("_s") + term(F.col("_z"), F.col("_a"))
    area = F.when(F.col("points") < 3, F.lit(0.0)).otherwise(F.abs(total * (RADIUS_MEASURE**2 / 2)))
    return rings.select(path, "points", area.alias("area"))


def explode_segments(df: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """One row per segment ``id, seq, x1, y1, x2, y2``."""
    return df.select(id_col, F.posexplode(segments(geometry)).alias("seq", "s")).select(
        id_col, "seq", F.col("s.s.x").alias("x1"), F.col("s.s.y").alias("y1"), F.col("s.e.x").alias("x2"), F.col("s.e.y").alias("y2")
    )
