"""Layer aggregates, summaries and tile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.functions.crs import tile_bounds, tile_x, tile_y
from loamgrid.functions.geometry import box
from loamgrid.functions.scalar import js_number, js_string, parse_float, truthy
from loamgrid.plans.ranks import global_rank

# Fixed value: zoom of the density bins.
BIN_ZOOM = 8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def layer_aggregate(kind: str, value, where=None, null_as_zero: bool = False) -> Column:
    """An aggregate expression for ``agg`` or ``over``.

    Non-numeric values drop out; nulls drop out too unless ``null_as_zero``.
    """
    v = _col(value)
    keep = truthy(where) if where is not None else None

    def guarded(c: Column) -> Column:
        return c if keep is None else F.when(keep, c)

    if kind in ("sum", "mean", "minimum", "maximum"):
        number = guarded(js_number(v, null_as_zero=null_as_zero))
        fn = {"sum": F.sum, "mean": F.avg, "minimum": F.min, "maximum": F.max}[kind]
        return F.coalesce(fn(number), F.lit(0.0)) if kind == "sum" else fn(number)
    if kind == "count":
        return F.count(guarded(v))
    if kind == "count_distinct":
        return F.count_distinct(guarded(js_string(v)))
    if kind == "count_distinct_approx":
        return F.approx_count_distinct(guarded(js_string(v)))
    raise ValueError(f"not a scalar aggregate: {kind}")


def aggregate(
    df: DataFrame, kind: str, value, where=None, by: list[str] | None = None, null_as_zero=False,
    seq: str | None = None, order_by=None, delimiter: str = ", ",
) -> DataFrame:
    """One row for the layer, or one per group.

    A grouped distinct count is planned as two partial aggregates, so a group
    holding most rows is combined map-side first.  ``concatenate`` and
    ``array_agg`` need ``seq`` and give the whole of each group as one value;
    :func:`ordered_values` and :func:`concatenate_chunks` have groups of any size.
    A group without a row that counts has no row.
    """
    if kind in ("concatenate", "array_agg"):
        if seq is None:
            raise ValueError(f"{kind} needs seq, the order of the rows")
        by = by or []
        if kind == "concatenate":
            rows = concatenate_chunks(df, value, seq, order_by, where, delimiter, by=by).withColumnsRenamed({"part": "rank", "text": "value"})
        else:
            rows = ordered_values(df, value, seq, order_by, where, by=by)
        held = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        return rows.groupBy(*by).agg((F.array_join(held, delimiter) if kind == "concatenate" else held).alias("value"))
    expr = layer_aggregate(kind, value, where, null_as_zero).alias("value")
    return df.groupBy(*by).agg(expr) if by else df.agg(expr)


def layer_scalar(df: DataFrame, kind: str, value, where=None, null_as_zero: bool = False) -> Column:
    """An aggregate of another layer as a scalar subquery, computed once per query."""
    return aggregate(df, kind, value, where, null_as_zero=null_as_zero).scalar()


def ordered_values(
    df: DataFrame, value, seq: str, order_by=None, where=None, keep_nulls: bool = True, by: list[str] | None = None
) -> DataFrame:
    """The values of a layer, or of each group ``by``, in order, as ``[by], rank, value`` rows.

    Ascending by ``order_by`` with nulls last, ties by ``seq``.  Works on layers
    and groups of any size: ranks come from range-partitioned running counts.
    """
    v = _col(value)
    by = list(by or [])
    out = df if where is None else df.filter(truthy(where))
    if not keep_nulls:
        out = out.filter(v.isNotNull())
    keys = [F.col("_seq")]
    if order_by is not None:
        keys = [F.col("_order").isNull(), F.col("_order"), F.col("_seq")]
    slim = out.select(
        *by,
        v.alias("value"),
        F.col(seq).alias("_seq"),
        (_col(order_by) if order_by is not None else F.lit(0)).alias("_order"),
    )
    return global_rank(slim, *keys, by=by).select(*by, "rank", "value")


def concatenate_chunks(
    df: DataFrame, value, seq: str, order_by=None, where=None, delimiter: str = ", ", chunk: int = 10_000, by: list[str] | None = None
) -> DataFrame:
    """The concatenation of a layer, or of each group ``by``, as ordered text pieces ``[by], part, text``.

    Joining the pieces in order with ``delimiter`` gives the whole text; no
    task ever holds more than ``chunk`` values of a group.
    """
    by = list(by or [])
    ranked = ordered_values(df, js_string(value), seq, order_by, where, keep_nulls=False, by=by)
    part = F.floor((F.col("rank") - 1) / F.lit(float(chunk))).cast("bigint")
    return (
        ranked.groupBy(*by, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
        .select(*by, "part", F.array_join(F.transform("v", lambda s: s["value"]), delimiter).alias("text"))
    )


def tile_bins(df: DataFrame, lon: str = "lon", lat: str = "lat", zoom: int = BIN_ZOOM, geometry: bool = True) -> DataFrame:
    """Points per web tile with their mean position and the tile polygon."""
    bins = (
        df.groupBy(tile_x(lon, zoom).alias("tile_x"), tile_y(lat, zoom).alias("tile_y"))
        .agg(
            F.count(F.lit(1)).alias("point_count"),
            F.avg(lat).alias("sample_lat"),
            F.avg(lon).alias("sample_lon"),
        )
        .withColumn("id", F.concat(F.lit("grid-"), "tile_x", F.lit(":"), "tile_y"))
        .withColumn("bounds", tile_bounds(F.col("tile_x"), F.col("tile_y"), zoom))
    )
    if not geometry:
        return bins
    b = F.col("bounds")
    return bins.withColumn("geometry", box(b["west"], b["south"], b["east"], b["north"]))


def field_summaries(df: DataFrame, fields: list[str]) -> DataFrame:
    """Min, max and count of the numeric prefixes of every field, in one pass."""
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.min(parse_float(F.col(f"`{f}`"))).alias("min"),
                    F.max(parse_float(F.col(f"`{f}`"))).alias("max"),
                    F.count(parse_float(F.col(f"`{f}`"))).alias("count"),
                )
                for f in fields
            ]
        ).alias("s")
    )
    return row.select(F.inline("s")).filter("count > 0")


def extent(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Bounds of a point layer; nulls when it is empty."""
    return df.agg(
        F.min(lon).alias("minx"), F.min(lat).alias("miny"), F.max(lon).alias("maxx"), F.max(lat).alias("maxy")
    )


def ingest_statistics(triaged: DataFrame, status: str = "status", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counters and bounds of a triaged point table in one row."""
    s = F.col(status)
    ok = s == "point"
    return triaged.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(ok).alias("point_count"),
        F.count_if(s == "skipped").alias("skipped_rows"),
        F.count_if(s == "invalid").alias("invalid_rows"),
        F.min(F.when(ok, F.col(lon))).alias("minx"),
        F.min(F.when(ok, F.col(lat))).alias("miny"),
        F.max(F.when(ok, F.col(lon))).alias("maxx"),
        F.max(F.when(ok, F.col(lat))).alias("maxy"),
    )
