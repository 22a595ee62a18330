"""Summits of an elevation table.

Cells are rows ``row, col, z``; nodata cells are rows with a null ``z`` or absent.
Windows are running sums and block maxima over the array of a tile and its halo,
so their work does not grow with the radius and the raster is shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from loamgrid.functions.scalar import round_half_up
from loamgrid.plans.lattice import TILE, with_halo, with_tile
from loamgrid.session import settle_counting

# Elevation tolerance of a maximum, inner ring share and quantile of local relief.
TOLERANCE = 0.05
INNER_SHARE = 0.35
BASE_QUANTILE = 0.25


def _box_sum(a: np.ndarray, reach: int) -> np.ndarray:
    """Sum over the box of ``2 * reach + 1`` cells a side, by running sums: the same work whatever the reach."""
    for _ in range(2):
        total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        ends = np.arange(a.shape[0])
        a = (total[np.minimum(ends + reach + 1, len(ends))] - total[np.maximum(ends - reach, 0)]).T
    return a


def _smooth(grid: np.ndarray, radius: int) -> np.ndarray:
    """Mean of what is known in each box.  Heights are taken from the middle of the tile, which keeps running sums small."""
    if not radius:
        return grid
    known = ~np.isnan(grid)
    middle = np.round(np.mean(grid[known])) if known.any() else 0.0
    n = np.rint(_box_sum(known.astype(float), radius))
    total = _box_sum(np.where(known, grid - middle, 0.0), radius)
    return np.where(n > 0, total / np.maximum(n, 1) + middle, np.nan)


def _extremes(grid: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    lost = np.isnan(grid)
    high, low = _box_max(np.where(lost, -np.inf, grid), radius), -_box_max(np.where(lost, -np.inf, -grid), radius)
    return {"window_max": np.where(np.isinf(high), np.nan, high), "window_min": np.where(np.isinf(low), np.nan, low)}


def _grid_of(rows: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """A tile's cells as an array (missing: NaN), the place of each row in it, and the cell of its corner."""
    r, c = rows["row"].to_numpy(), rows["col"].to_numpy()
    corner = int(r.min()), int(c.min())
    r, c = r - corner[0], c - corner[1]
    grid = np.full((r.max() + 1, c.max() + 1), np.nan)
    grid[r, c] = rows[value].cast("double").to_numpy()
    return grid, r, c, corner


def _in_tiles(cells: DataFrame, reach: int, tile: int, value: str, made: list[str], fn) -> DataFrame:
    """``cells`` with the columns ``made`` that ``fn`` finds from each tile and the cells within ``reach`` of it."""
    haloed = with_halo(cells, reach, tile)
    kept = [f for f in cells.schema.fields if f.name not in made]
    schema = StructType([*kept, *[StructField(m, DoubleType()) for m in made]])

    def run(rows: pa.Table) -> pa.Table:
        grid, r, c, _ = _grid_of(rows, value)
        found = fn(grid)
        core = rows["core"].combine_chunks()
        cols = [rows[f.name].filter(core) for f in kept]
        at = core.to_numpy(zero_copy_only=False)
        cols += [pa.array(found[m][r[at], c[at]], from_pandas=True) for m in made]
        return pa.table(cols, names=schema.names).cast(to_arrow_schema(schema))

    return haloed.groupBy("tr", "tc").applyInArrow(run, schema)


def box_smooth(cells: DataFrame, radius: int, value: str = "z", out: str = "smooth", tile: int = TILE) -> DataFrame:
    """Mean of the (2r+1)^2 box; nodata cells are left out of sum and count."""
    return _in_tiles(cells, radius, tile, value, [out], lambda grid: {out: _smooth(grid, radius)})


def window_extremes(cells: DataFrame, radius: int, value: str = "z", tile: int = TILE) -> DataFrame:
    """Maximum and minimum of the (2r+1)^2 box."""
    return _in_tiles(cells, radius, tile, value, ["window_max", "window_min"], lambda grid: _extremes(grid, radius))


def smoothed_extremes(cells: DataFrame, smooth: int, search: int, tile: int = TILE) -> DataFrame:
    """T01 + T02 in one exchange: the halo covers both windows."""

    def both(grid: np.ndarray) -> dict[str, np.ndarray]:
        even = _smooth(grid, smooth)
        return {"smooth": even, **_extremes(even, search)}

    return _in_tiles(cells.select("row", "col", "z"), smooth + search, tile, "z", ["smooth", "window_max", "window_min"], both)


def _ring_bases(candidates: pa.Table, rows: pa.Table, value: str, radius: int) -> pa.Table:
    """``row, col, _base``: the lower quartile, by rank, of the lower cells in each candidate's ring."""
    inner = max(1, int(np.floor(radius * INNER_SHARE)))
    found = []
    if candidates.num_rows and rows.num_rows:
        grid, _, _, corner = _grid_of(rows, value)
        grid = np.pad(np.where(np.isnan(grid), np.inf, grid), radius, constant_values=np.inf)
        y, x = np.indices((2 * radius + 1, 2 * radius + 1)) - radius
        ring = (y * y + x * x > inner * inner) & (y * y + x * x <= radius * radius)
        for row, col, top in zip(candidates["row"].to_pylist(), candidates["col"].to_pylist(), candidates[value].to_pylist()):
            r, c = row - corner[0], col - corner[1]
            around = grid[r : r + 2 * radius + 1, c : c + 2 * radius + 1][ring]
            around = around[around < top]
            if len(around):
                nth = int(np.floor(len(around) * BASE_QUANTILE))
                found.append((row, col, float(np.partition(around, nth)[nth])))
    cols = zip(*found) if found else ([], [], [])
    return pa.table([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["row", "col", "_base"])


def local_relief(candidates: DataFrame, cells: DataFrame, radius: int, value: str = "smooth", tile: int = TILE) -> DataFrame:
    """Height above the lower quartile of lower cells in the ring (0.35 r, r]; 0 if there are none.

    Tiles with a candidate get the cells within the radius; a candidate's ring is a slice of the tile's array, so what a
    task holds is a tile of ``max(tile, 2 r)`` cells and its halo, and no row is made for a candidate and a cell.
    """
    side = max(tile, 2 * radius)
    tops = with_tile(candidates.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col(value).cast("double").alias(value)), side).drop("rim")
    around = with_halo(cells.select("row", "col", value), radius, side).join(tops.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    base = tops.groupBy("tr", "tc").cogroup(around.groupBy("tr", "tc")).applyInArrow(
        lambda some, rows: _ring_bases(some, rows, value, radius), "row long, col long, _base double"
    )
    return candidates.join(base, ["row", "col"], "left").withColumn(
        "relief", F.coalesce(F.col(value) - F.col("_base"), F.lit(0.0))
    ).drop("_base")


def summit_candidates(stats: DataFrame, min_elevation: float | None = None) -> DataFrame:
    """T04 (before relief): cells within 0.05 m of their window maximum that have a lower neighbour."""
    keep = (
        F.col("z").isNotNull()
        & F.col("smooth").isNotNull()
        & (F.col("smooth") >= F.col("window_max") - TOLERANCE)
        & (F.col("window_min") < F.col("smooth") - TOLERANCE)
    )
    if min_elevation is not None:
        keep = keep & (F.col("z") >= min_elevation)
    return stats.filter(keep)


# ------------------------------------------------------------------ suppression
def _moving_max(a: np.ndarray, reach: int) -> np.ndarray:
    """Maximum over [i-reach, i+reach] along axis 0, by block prefix and suffix maxima; less than all outside."""
    width = 2 * reach + 1
    n = a.shape[0]
    pad = reach + (-(n + 2 * reach)) % width
    b = np.pad(a, ((reach, pad), (0, 0)), constant_values=-np.inf if a.dtype.kind == "f" else -1)
    blocks = b.reshape(-1, width, b.shape[1])
    ahead = np.maximum.accumulate(blocks, axis=1).reshape(b.shape)
    back = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(b.shape)
    return np.maximum(back[:n], ahead[width - 1 : width - 1 + n])


def _box_max(a: np.ndarray, reach: int) -> np.ndarray:
    return _moving_max(_moving_max(a, reach).T, reach).T


def _suppress(pdf: pd.DataFrame, reach: int) -> pd.DataFrame:
    """One round in a haloed tile: accept window maxima, drop what they cover."""
    order = np.lexsort((-pdf["col"], -pdf["row"], pdf["score"]))
    rank = np.empty(len(pdf), np.int64)
    rank[order] = np.arange(len(pdf))
    r, c = (pdf["row"] - pdf["row"].min()).to_numpy(), (pdf["col"] - pdf["col"].min()).to_numpy()
    field = np.full((r.max() + 1, c.max() + 1), -1, np.int64)
    field[r, c] = rank
    won = _box_max(field, reach)[r, c] == rank
    taken = np.full(field.shape, -1, np.int64)
    taken[r[won], c[won]] = 1
    covered = _box_max(taken, reach)[r, c] > 0
    status = np.where(won, "accepted", np.where(covered, "dropped", "live"))
    out = pdf[["row", "col", "score"]].assign(status=status)
    return out[pdf["core"].to_numpy(bool)]


def suppress_neighbours(candidates: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """Greedy suppression by score (ties: row, col) in a square window.

    Rounds over live candidates only; a halo of two windows makes each tile's
    decision exact, so the result equals the sequential walk.
    """
    live, n = settle_counting(candidates.select("row", "col", "score").withColumn("status", F.lit("live")), "true")
    accepted = None
    while n:
        haloed = with_halo(live.filter("status = 'live'").drop("status"), 2 * reach, tile)
        live, n = settle_counting(
            haloed.groupBy("tr", "tc").applyInPandas(
                lambda p: _suppress(p, reach), "row long, col long, score double, status string"
            ),
            "status = 'live'",
        )
        won = live.filter("status = 'accepted'").select("row", "col")
        accepted = won if accepted is None else accepted.unionByName(won)
    return candidates.join(accepted, ["row", "col"], "left_semi") if accepted is not None else candidates


def rank_summits(accepted: DataFrame, max_count: int, peak_cutoff: float) -> DataFrame:
    """Top ``max_count`` by score with rank, kind, rounded values and label."""
    order = [F.col("score").desc(), F.col("row"), F.col("col")]
    top = accepted.orderBy(*order).limit(max_count)
    # at most max_count rows reach this window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    kind = F.when(F.col("relief") >= peak_cutoff, "peak").otherwise("hill")
    whole = F.floor(F.col("z") + 0.5).cast("bigint")
    return ranked.select(
        "rank",
        kind.alias("kind"),
        round_half_up("z", 1).alias("elevation_m"),
        round_half_up("relief", 1).alias("relief_m"),
        F.concat(
            F.when(kind == "peak", "Peak").otherwise("Hill"), F.lit(" #"), F.col("rank").cast("string"), F.lit(" ("), whole.cast("string"), F.lit(" m)")
        ).alias("label"),
        "row",
        "col",
    )


def summits(
    cells: DataFrame,
    search: int = 15,
    smooth: int = 1,
    min_relief: float = 10.0,
    peak_cutoff: float = 50.0,
    min_elevation: float | None = None,
    max_count: int = 500,
    tile: int = TILE,
) -> DataFrame:
    """Smooth -> window maxima -> relief -> suppression -> ranked summits."""
    _check_summit_options(search, smooth, min_relief, peak_cutoff, max_count)
    stats, _ = settle_counting(smoothed_extremes(cells, smooth, search, tile), "true")
    found = local_relief(summit_candidates(stats, min_elevation), stats, max(search * 3, search + 4), tile=tile)
    scored = found.filter(F.col("relief") >= min_relief).withColumn("score", F.col("relief") * 100000.0 + F.col("z"))
    scored, _ = settle_counting(scored.select("row", "col", "z", "relief", "score"), "true")
    return rank_summits(suppress_neighbours(scored, search, tile), max_count, peak_cutoff)


def _check_summit_options(search, smooth, min_relief, peak_cutoff, max_count) -> None:
    if search < 1 or smooth < 0 or max_count < 1:
        raise ValueError("search radius and max results must be at least 1, smoothing at least 0")
    if min_relief < 0 or peak_cutoff < 0:
        raise ValueError("relief limits must not be negative")
