"""Drainage of an elevation table: sinks, flow, accumulation, basins, streams.

Cells are ``row, col, z`` rows (nodata absent or null).  Iterative steps run on
tiles or by pointer doubling (:mod:`loamgrid.plans.forest`); every round is
written to the shared folder, never kept only on executors.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.functions.geometry import line, vertex
from loamgrid.plans.buckets import bucket
from loamgrid.plans.forest import accumulate, resolve
from loamgrid.plans.lattice import D8, STRIDE, TILE, cell_id, div, id_col, id_row, neighbours, with_halo, with_tile
from loamgrid.plans.ranks import global_rank
from loamgrid.session import settle, settle_counting

FAR = np.inf


# ------------------------------------------------------------------ W01 filling
def _relax(z: np.ndarray, f: np.ndarray, straight: float, diagonal: float) -> np.ndarray:
    """Least surface f >= z in which every cell has a neighbour at most one step lower.

    ``f`` is padded by one ring that stays fixed; NaN cells of ``z`` are closed.
    """
    open_ = ~np.isnan(z)
    floor_ = np.where(open_, z, FAR)
    f = f.copy()
    while True:
        best = np.minimum.reduce(
            [
                np.minimum.reduce([f[:-2, 1:-1], f[2:, 1:-1], f[1:-1, :-2], f[1:-1, 2:]]) + straight,
                np.minimum.reduce([f[:-2, :-2], f[:-2, 2:], f[2:, :-2], f[2:, 2:]]) + diagonal,
            ]
        )
        new = np.where(open_, np.minimum(f[1:-1, 1:-1], np.maximum(floor_, best)), FAR)
        if np.array_equal(new, f[1:-1, 1:-1]):
            return f
        f[1:-1, 1:-1] = new


def _rims(core: np.ndarray) -> list:
    """Border strips of a tile as its 8 neighbours see them: N, S, W, E, NW, NE, SW, SE."""
    return [
        core[0], core[-1], core[:, 0], core[:, -1],
        core[0, :1], core[0, -1:], core[-1, :1], core[-1, -1:],
    ]


# Strip k of a tile goes to the neighbour at this (row, column) tile offset, and lands in its ring at RING[k].
TO = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]
RING = [
    (-1, slice(1, -1)), (0, slice(1, -1)), (slice(1, -1), -1), (slice(1, -1), 0),
    (-1, slice(-1, None)), (-1, slice(0, 1)), (0, slice(-1, None)), (0, slice(0, 1)),
]
TILE_STATE = "tr long, tc long, z array<double>, f array<double>, strips array<array<double>>, moved boolean"


def _start_tile(pdf: pd.DataFrame, tile: int, straight: float, diagonal: float) -> pd.DataFrame:
    tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
    wide = np.full((tile + 2, tile + 2), np.nan)
    wide[(pdf["row"] - tr * tile + 1).to_numpy(int), (pdf["col"] - tc * tile + 1).to_numpy(int)] = pdf["z"].to_numpy(float)
    z = wide[1:-1, 1:-1]
    gap = np.isnan(wide)
    seed = np.zeros_like(z, bool)
    for dr, dc, _ in D8:
        seed |= gap[1 + dr : 1 + dr + tile, 1 + dc : 1 + dc + tile]
    f = np.full_like(wide, FAR)
    done = pdf["drained"].to_numpy(bool)
    f[(pdf["row"] - tr * tile + 1).to_numpy(int)[done], (pdf["col"] - tc * tile + 1).to_numpy(int)[done]] = pdf["z"].to_numpy(float)[done]
    f[1:-1, 1:-1] = np.where(seed & ~np.isnan(z), z, f[1:-1, 1:-1])
    f = _relax(z, f, straight, diagonal)
    return _tile_row(tr, tc, z, f, not np.isnan(z).all())


def _tile_row(tr, tc, z, f, moved) -> pd.DataFrame:
    return pd.DataFrame(
        {"tr": [tr], "tc": [tc], "z": [z.ravel()], "f": [f.ravel()], "strips": [[s.tolist() for s in _rims(f[1:-1, 1:-1])]], "moved": [moved]}
    )


#: Tiles along a side of a block; a block's tiles exchange strips inside one task.
BLOCK = 8


def _solve_block(pdf: pd.DataFrame, tile: int, straight: float, diagonal: float) -> pd.DataFrame:
    """Tiles of a block with the strips that reach it, solved until nothing moves inside; only tiles that did come back."""
    z, f, moved, open_ = {}, {}, set(), []
    for t in pdf.itertuples(index=False):
        at = (t.tr, t.tc)
        z[at] = np.asarray(t.z, float).reshape(tile, tile)
        f[at] = np.array(t.f, float).reshape(tile + 2, tile + 2)
        if t.sides is not None:
            for k, strip in zip(t.sides, t.incoming):
                f[at][RING[int(k)]] = np.minimum(f[at][RING[int(k)]], np.asarray(strip, float))
            open_.append(at)
    while open_:
        at = open_.pop(0)
        g = _relax(z[at], f[at], straight, diagonal)
        if np.array_equal(g[1:-1, 1:-1], f[at][1:-1, 1:-1]):
            continue
        f[at] = g
        moved.add(at)
        for k, strip in enumerate(_rims(g[1:-1, 1:-1])):
            to = (at[0] + TO[k][0], at[1] + TO[k][1])
            if to in f and (strip < f[to][RING[k]]).any():
                f[to][RING[k]] = np.minimum(f[to][RING[k]], strip)
                if to not in open_:
                    open_.append(to)
    if not moved:
        return pd.DataFrame(columns=["tr", "tc", "z", "f", "strips", "moved"], dtype=object)
    return pd.concat([_tile_row(*at, z[at], f[at], True) for at in sorted(moved)], ignore_index=True)


def _drained_cells(known: DataFrame, step: float, diagonal: float, cell_x: float, cell_y: float, tile: int) -> DataFrame:
    """``row, col`` of cells whose steepest path falls by at least the minimum all the way to an outlet.

    Such cells keep their height.  Pointer doubling finds them in logarithmic
    rounds, which leaves only depressions to the tile exchange.
    """
    flow = flow_direction(known, cell_x, cell_y, tile)
    need = F.when(F.col("fd").isin(2, 8, 32, 128), F.lit(diagonal)).otherwise(F.lit(step))
    nodes = flow.select(
        "row", "col", "id",
        F.when(F.col("drop") >= need, F.col("down")).alias("down"),
        F.when((F.col("fd") > 0) & F.col("down").isNull(), F.lit(1)).alias("label"),
    )
    return resolve(with_tile(nodes, tile)).filter("label IS NOT NULL").select(id_row().alias("row"), id_col().alias("col"))


def fill_sinks(cells: DataFrame, min_slope: float, cell_x: float, cell_y: float, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``row, col, z`` with every depression raised to drain at ``min_slope`` or more.

    The surface is the least one in which each cell is an outlet (raster edge
    or next to nodata) or has a neighbour at least the minimum drop lower.
    Cells that drain as they are keep their height; tiles without others take
    no further part.  The rest solve themselves and exchange border strips, many
    tiles at a time: those of a block inside one task, blocks shifted by half from
    round to round.  A round reads the blocks that a strip reached and writes the
    tiles that moved; it takes an eighth of a depression's extent in tiles to end.
    """
    step = (cell_x + cell_y) / 2 * min_slope
    diagonal = step * math.sqrt(2)
    known = cells.filter(F.col("z").isNotNull() & ~F.isnan("z"))
    known = known.select("row", "col", F.col("z").cast("double").alias("z"))
    done = _drained_cells(known, step, diagonal, cell_x, cell_y, tile).withColumn("drained", F.lit(True))
    known = settle(known.join(done, ["row", "col"], "left").withColumn("drained", F.coalesce("drained", F.lit(False))))
    wet = settle(with_tile(known.filter("NOT drained"), tile).select("tr", "tc").distinct())
    dry = with_tile(known, tile).join(wet, ["tr", "tc"], "left_anti").select("row", "col", "z")
    haloed = with_halo(known, 1, tile).join(wet, ["tr", "tc"], "left_semi")
    state, moving = settle_counting(
        haloed.groupBy("tr", "tc").applyInPandas(lambda p: _start_tile(p, tile, step, diagonal), TILE_STATE), "moved"
    )
    versions, latest = [state], wet.withColumn("version", F.lit(0))
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(TO)])
    rounds = 0
    while moving:
        rounds += 1
        shift = block // 2 * (rounds % 2)
        held = latest.withColumns({"br": div(F.col("tr") + shift, block), "bc": div(F.col("tc") + shift, block)})
        sent = (
            state.filter("moved")
            .select("tr", "tc", "strips", F.explode(offsets).alias("o"))
            .select(
                (F.col("tr") + F.col("o.a")).alias("tr"), (F.col("tc") + F.col("o.b")).alias("tc"),
                F.col("o.k").alias("k"), F.get("strips", F.col("o.k")).alias("strip"),
            )
            .groupBy("tr", "tc")
            .agg(F.collect_list(F.struct("k", "strip")).alias("m"))  # at most 8 per tile
            .select("tr", "tc", F.transform("m", lambda v: v["k"]).alias("sides"), F.transform("m", lambda v: v["strip"]).alias("incoming"))
        )
        reached = held.join(sent.select("tr", "tc"), ["tr", "tc"], "left_semi").select("br", "bc").distinct()
        called = settle(held.join(reached, ["br", "bc"], "left_semi"))
        arrays = _versions(versions, called).select("tr", "tc", "br", "bc", "z", "f").join(sent, ["tr", "tc"], "left")
        state, moving = settle_counting(
            arrays.groupBy("br", "bc").applyInPandas(lambda p: _solve_block(p, tile, step, diagonal), TILE_STATE), "moved"
        )
        if moving:
            versions.append(state)
            newer = state.select("tr", "tc", F.lit(len(versions) - 1).alias("version"))
            latest = settle(latest.join(newer.select("tr", "tc"), ["tr", "tc"], "left_anti").unionByName(newer))
        if len(versions) > 8:  # what moved at all becomes one table again
            often = latest.filter("version > 0")
            versions = [versions[0], settle(_versions(versions, often).drop("version"))]
            latest = settle(latest.withColumn("version", F.least("version", F.lit(1))))
    width = tile + 2
    i = F.col("i")
    spread = _versions(versions, latest).select("tr", "tc", F.posexplode("f").alias("i", "z"))
    r, c = F.floor(i / width) - 1, i % width - 1
    filled = spread.filter(r.between(0, tile - 1) & c.between(0, tile - 1) & (F.col("z") < float("inf"))).select(
        (F.col("tr") * tile + r).cast("bigint").alias("row"), (F.col("tc") * tile + c).cast("bigint").alias("col"), "z"
    )
    return filled.unionByName(dry)


def _versions(versions: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """The tiles ``wanted(tr, tc, version)`` as their versions hold them."""
    parts = [v.join(wanted.filter(F.col("version") == k), ["tr", "tc"]) for k, v in enumerate(versions)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --------------------------------------------------------------------- W02, W03
def flow_direction(cells: DataFrame, cell_x: float, cell_y: float, tile: int = TILE) -> DataFrame:
    """``row, col, z, fd, id, down, drop``: code of the steepest of 8 slopes, first in E,SE,S... order on ties.

    A missing neighbour is an outlet (infinite slope); ``down`` is null there
    and in pits (``fd`` 0).
    """
    near = neighbours(cells.select("row", "col", F.col("z").cast("double").alias("z")), "z", tile)
    slopes = []
    for k, (dr, dc, _) in enumerate(D8):
        reach = math.hypot(dc * cell_x, dr * cell_y)
        slopes.append(F.when(F.col(f"n{k}").isNull(), F.lit(float("inf"))).otherwise((F.col("z") - F.col(f"n{k}")) / reach))
    best = F.greatest(*slopes)
    fd, down, drop = None, None, None
    for k, (dr, dc, code) in enumerate(D8):
        hit = F.col(f"s{k}") == F.col("best")
        target = F.when(F.col(f"n{k}").isNotNull(), cell_id(F.col("row") + dr, F.col("col") + dc))
        fd = F.when(hit, code) if fd is None else fd.when(hit, code)
        down = F.when(hit, target) if down is None else down.when(hit, target)
        fall = F.col("z") - F.col(f"n{k}")
        drop = F.when(hit, fall) if drop is None else drop.when(hit, fall)
    flows = F.col("best") > 0
    return (
        near.withColumns({f"s{k}": s for k, s in enumerate(slopes)})
        .withColumn("best", best)
        .select(
            "row", "col", "z",
            F.when(flows, fd).otherwise(0).cast("int").alias("fd"),
            cell_id().alias("id"),
            F.when(flows, down).alias("down"),
            F.when(flows, drop).alias("drop"),
        )
    )


def flow_accumulation(flow: DataFrame, tile: int = TILE, weight: Column | None = None) -> DataFrame:
    """Add ``accum``, the number (or weight) of cells draining through each cell, itself included."""
    nodes = with_tile(flow.select("row", "col", "id", "down", (weight if weight is not None else F.lit(1.0)).alias("w")), tile)
    total = accumulate(nodes)
    whole = F.col("acc").cast("bigint") if weight is None else F.col("acc")
    return flow.join(total.select("id", whole.alias("accum")), "id")


def channels(flow: DataFrame, threshold: int) -> DataFrame:
    """Cells with at least ``threshold`` upstream cells."""
    return flow.filter(F.col("accum") >= max(1, threshold))


def require_channels(flow: DataFrame, threshold: int) -> DataFrame:
    """:func:`channels`, or an error when there are none."""
    out = channels(flow, threshold)
    if not out.limit(1).take(1):
        raise ValueError("no channels: lower the threshold or use a larger area")
    return out


def snap_pour_points(points: DataFrame, flow: DataFrame, threshold: int, reach: int = 40) -> DataFrame:
    """Move each ``pour_id, row, col`` to the largest accumulation of the first square ring that holds a channel.

    Points without a channel inside ``reach`` stay.  A point meets only the
    (2*reach+1)^2 cells around it, by bucket.
    """
    size = float(2 * reach + 1)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = (
        points.select("pour_id", F.col("row").alias("prow"), F.col("col").alias("pcol"))
        .withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around))
        .withColumns({"_by": bucket("prow", size) + F.col("_a"), "_bx": bucket("pcol", size) + F.col("_b")})
    )
    c = flow.select("row", "col", "accum").withColumns({"_by": bucket("row", size), "_bx": bucket("col", size)})
    dr, dc = F.col("row") - F.col("prow"), F.col("col") - F.col("pcol")
    met = p.join(c, ["_by", "_bx"]).withColumns({"dr": dr, "dc": dc}).withColumn("ring", F.greatest(F.abs("dr"), F.abs("dc")))
    met = met.filter(F.col("ring") <= reach)
    first = F.min(F.when(F.col("accum") >= threshold, F.col("ring"))).over(Window.partitionBy("pour_id"))
    kept = met.withColumn("_first", F.greatest(F.lit(1), first)).filter("_first IS NOT NULL AND ring <= _first")
    best = kept.groupBy("pour_id").agg(
        F.max_by(F.struct("row", "col", "accum"), F.struct("accum", -F.col("ring"), -F.col("dr"), -F.col("dc"))).alias("_s"), F.max("_first").alias("_f")
    ).filter(F.col("_s.accum") >= threshold)
    return points.join(best, "pour_id", "left").select(
        "pour_id",
        F.coalesce("_s.row", "row").alias("row"),
        F.coalesce("_s.col", "col").alias("col"),
        F.col("_s").isNotNull().alias("snapped"),
    )


# -------------------------------------------------------------------------- W06
def delineate_basins(flow: DataFrame, pours: DataFrame, tile: int = TILE) -> DataFrame:
    """``row, col, pour_id`` of the cells above each pour point; the first pour point downstream wins."""
    marks = pours.groupBy(cell_id().alias("id")).agg(F.min("pour_id").cast("long").alias("label"))
    nodes = with_tile(flow.select("row", "col", "id", "down"), tile).join(marks, "id", "left")
    found = resolve(nodes).filter("label IS NOT NULL")
    return found.select(id_row().alias("row"), id_col().alias("col"), F.col("label").alias("pour_id"))


def basin_of(flow: DataFrame, row: int, col: int, tile: int = TILE) -> DataFrame:
    one = flow.filter((F.col("row") == row) & (F.col("col") == col)).select("row", "col", F.lit(1).alias("pour_id"))
    return delineate_basins(flow, one, tile)


# --------------------------------------------------------------------- reaches
def _inflows(ch: DataFrame) -> DataFrame:
    """Channel cells with the number of channel cells that flow into each: ``id, down, accum, n_in``."""
    own = ch.select(F.col("id").alias("down"))
    kept = ch.select("id", "down", "accum").join(own, "down", "left_semi")  # links that stay in the channel
    n_in = kept.groupBy(F.col("down").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n_in"))
    base = ch.select("id", "accum").join(kept.select("id", "down"), "id", "left")
    return base.join(n_in, "id", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


def reach_labels(ch: DataFrame) -> DataFrame:
    """W07 steps 1-3: ``id, start``, the first cell of the reach each channel cell belongs to.

    A cell passes its label down unless it is a junction that received one; a
    junction takes the arriving label whose start has the least (accum, id).
    Only junctions fed by nothing but junctions need a loop.
    """
    net = settle(_inflows(ch))
    links = net.filter("down IS NOT NULL").select("id", "down", (F.col("n_in") >= 2).alias("from_junction"))
    feeds = links.groupBy(F.col("down").alias("id")).agg(F.max(~F.col("from_junction")).alias("plain_feed"))
    # received: null = not decided yet
    state, left = settle_counting(
        net.join(feeds, "id", "left").select(
            "id", "down", "accum", "n_in",
            F.when(F.col("n_in") == 0, False).when(F.col("plain_feed"), True).when(F.col("n_in") == 1, F.lit(None).cast("boolean")).alias("received"),
        ),
        "received IS NULL",
    )
    while left:
        # a feed passes when it is not a junction, or is one that received nothing
        says = state.filter("down IS NOT NULL").select(
            F.col("down").alias("id"),
            F.when(F.col("n_in") < 2, True).otherwise(~F.col("received")).alias("passes"),
        )
        heard = says.groupBy("id").agg(F.max("passes").alias("any"), F.count_if(F.col("passes").isNull()).alias("unknown"))
        new = F.when(F.col("received").isNotNull(), F.col("received")).when(F.col("any"), True).when(F.col("unknown") == 0, False)
        state, left = settle_counting(
            state.join(heard, "id", "left").select("id", "down", "accum", "n_in", new.alias("received")), "received IS NULL"
        )
    passes = (F.col("n_in") < 2) | ~F.col("received")
    sent = state.filter("down IS NOT NULL").filter(passes).select(F.col("id").alias("source"), F.col("down").alias("id"))
    merged = (F.col("n_in") >= 2) & F.col("received")
    # all but receiving junctions have at most one passing feed: follow it up to the start
    chain = state.filter(~merged).select("id").join(sent, "id", "left").select(
        "id", F.col("source").alias("down"), F.when(F.col("source").isNull(), F.col("id")).alias("label")
    )
    # a chain that comes out of a receiving junction starts below it, as that junction passes nothing
    starts = settle(resolve(chain).withColumnRenamed("label", "start"))
    rank = state.select(F.col("id").alias("start"), F.col("accum").alias("start_accum"))
    arriving = (
        sent.join(state.filter(merged).select("id"), "id", "left_semi")
        .join(starts.select(F.col("id").alias("source"), "start"), "source")
        .join(rank, "start")
    )
    joined = arriving.groupBy("id").agg(F.min_by("start", F.struct("start_accum", "start")).alias("start"))
    return starts.unionByName(joined)


def _merge_small(reach: DataFrame, min_cells: int) -> DataFrame:
    """W07 step 5: ``reach, down_reach, cells`` -> ``reach, kept``.

    A reach below ``min_cells`` (own cells plus those merged into it) joins the
    reach its outlet drains to.  Totals are decided from the top down; a round
    settles every reach whose upstream neighbours are settled.
    """
    state, left = settle_counting(
        reach.select("reach", "down_reach", "cells", F.lit(None).cast("bigint").alias("total")), "total IS NULL"
    )
    while left:
        feed = state.filter("down_reach IS NOT NULL").select(F.col("down_reach").alias("reach"), F.col("total").alias("t"), F.col("cells").alias("c"))
        # a feed that is large by itself never merges, so its exact total does not matter
        undecided = F.col("t").isNull() & (F.col("c") < min_cells)
        got = feed.groupBy("reach").agg(
            F.count_if(undecided).alias("wait"), F.coalesce(F.sum(F.when(F.col("t") < min_cells, F.col("t"))), F.lit(0)).alias("gain")
        )
        new = F.when(F.col("total").isNotNull(), F.col("total")).when(F.coalesce("wait", F.lit(0)) == 0, F.col("cells") + F.coalesce("gain", F.lit(0)))
        state, left = settle_counting(state.join(got, "reach", "left").select("reach", "down_reach", "cells", new.alias("total")), "total IS NULL")
    stays = (F.col("total") >= min_cells) | F.col("down_reach").isNull()
    nodes = state.select(F.col("reach").alias("id"), F.col("down_reach").alias("down"), F.when(stays, F.col("reach")).alias("label"))
    return resolve(nodes).select(F.col("id").alias("reach"), F.col("label").alias("kept"))


def sub_basins(flow: DataFrame, threshold: int, min_cells: int = 1, tile: int = TILE) -> DataFrame:
    """``row, col, basin_id`` (1..K in row-major order of first cell) for ``flow`` with ``accum``.

    Channel reaches, hillslope cells by the first reach downstream, small
    basins merged downstream.  Cells that reach no channel are left out.
    """
    flow = settle(flow.select("row", "col", "id", "down", "accum"))
    ch = channels(flow, threshold)
    label = settle(reach_labels(ch))
    nodes = with_tile(flow.select("row", "col", "id", "down"), tile).join(label.withColumnRenamed("start", "label"), "id", "left")
    cells = settle(resolve(nodes).filter("label IS NOT NULL").select("id", F.col("label").alias("reach")))
    if min_cells > 1:
        size = cells.groupBy("reach").agg(F.count(F.lit(1)).alias("cells"))
        outlet = (
            ch.select("id", "down", "accum").join(label.withColumnRenamed("start", "reach"), "id")
            .groupBy("reach").agg(F.max_by(F.struct("down"), F.struct("accum", -F.col("id"))).alias("o"))
            .select("reach", F.col("o.down").alias("id"))
        )
        below = outlet.join(cells.select("id", F.col("reach").alias("down_reach")), "id", "left")
        net = below.select("reach", F.expr("nullif(down_reach, reach)").alias("down_reach")).join(size, "reach")
        kept = _merge_small(net, min_cells)
        cells = cells.join(kept, "reach").select("id", F.col("kept").alias("reach"))
    firsts = cells.groupBy("reach").agg(F.min("id").alias("first"))
    numbered = global_rank(firsts, F.col("first"), out="basin_id").select("reach", "basin_id")
    return cells.join(numbered, "reach").select(id_row().alias("row"), id_col().alias("col"), "basin_id")


# --------------------------------------------------------------------- W08, W09
def strahler_order(ch: DataFrame) -> DataFrame:
    """``id, strahler`` of channel cells.

    A cell has order above k exactly when at or above it two branches of order
    k or more meet.  Each order is therefore one weighted accumulation over the
    cells left from the order before; the number of rounds is the highest order.
    """
    net = _inflows(ch).select("id", "down")
    level = settle(net)
    out = settle(net.select("id", F.lit(1).alias("strahler")))
    k = 1
    while True:
        meets = level.filter("down IS NOT NULL").groupBy(F.col("down").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
        joint, n = settle_counting(meets.select("id", F.lit(1.0).alias("w")), "true")
        if not n:
            return out
        weighed = level.join(joint, "id", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        above = accumulate(weighed).filter("acc > 0").select("id")
        level = settle(level.join(above, "id", "left_semi"))
        k += 1
        out = settle(out.join(level.select("id", F.lit(k).alias("_k")), "id", "left").select("id", F.coalesce("_k", "strahler").alias("strahler")))


def channel_segments(ch: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """``segment, order, accumulation, seq, row, col``: vertices of each stream line.

    Lines start at heads and confluences (the only places where the order can
    change) and share the end vertex with the line below.
    """
    orders = strahler_order(ch) if orders is None else orders
    net = settle(_inflows(ch))
    up = net.filter("down IS NOT NULL").select(F.col("id").alias("source"), F.col("down").alias("id"))
    starts = F.col("n_in") != 1
    # above a non-start cell there is exactly one feed, so upstream links form a forest too
    feed = up.join(net.filter(~starts).select("id"), "id", "left_semi")
    chain = net.select("id", starts.alias("is_start")).join(feed, "id", "left").select(
        "id", F.col("source").alias("down"), F.when(F.col("is_start"), F.col("id")).alias("label")
    )
    seg = resolve(chain).withColumnRenamed("label", "segment")
    own = seg.join(net.select("id", "down", "accum"), "id")
    heads = net.filter(starts).select(F.col("id").alias("down"))
    tail = own.join(heads, "down", "left_semi").select("segment", F.col("down").alias("id"))
    tail = tail.join(net.select("id", "accum"), "id")
    points = own.select("segment", "id", "accum").unionByName(tail.select("segment", "id", "accum"))
    w = Window.partitionBy("segment")
    first = net.select(F.col("id").alias("segment"), F.col("accum").alias("accumulation")).join(
        orders.select(F.col("id").alias("segment"), F.col("strahler").alias("order")), "segment"
    )
    ranked = points.withColumns({"seq": F.row_number().over(w.orderBy("accum")), "_n": F.count(F.lit(1)).over(w)})
    return ranked.filter("_n >= 2").join(first, "segment").select(
        "segment", "order", "accumulation", "seq", id_row().alias("row"), id_col().alias("col")
    )


def channel_lines(segments: DataFrame, x: Column, y: Column) -> DataFrame:
    """One line feature per segment; ``x, y`` place a cell centre from ``row, col``."""
    placed = segments.select("segment", "order", "accumulation", "seq", vertex(x, y).alias("v"))
    return placed.groupBy("segment", "order", "accumulation").agg(
        line(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda p: p["v"])).alias("geometry")
    )


# -------------------------------------------------------------------- W11, W13
def min_basin_cells(cell_x: float, cell_y: float, area_km2: float = 1.0) -> int:
    """Cells that make up the least basin area."""
    return max(1, math.ceil(area_km2 * 1e6 / (cell_x * cell_y)))


def watershed(
    cells: DataFrame,
    cell_x: float,
    cell_y: float,
    threshold: int = 500,
    pour: tuple[int, int] | None = None,
    mask: DataFrame | None = None,
    min_slope: float = 0.0001,
    min_area_km2: float = 1.0,
    split: bool = True,
    tile: int = TILE,
) -> dict[str, DataFrame]:
    """Fill, flow, accumulate, then basins and streams of an area.

    The area is the basin of a snapped pour point, a cell ``mask``, or the
    whole raster.  Returns ``flow`` (cells), ``basins`` (row, col, basin_id) and
    ``streams`` (segment vertices).
    """
    filled = fill_sinks(cells, min_slope, cell_x, cell_y, tile)
    flow = settle(flow_accumulation(settle(flow_direction(filled, cell_x, cell_y, tile)), tile))
    require_channels(flow, threshold)
    area = flow
    if pour is not None:
        spark = cells.sparkSession
        at = spark.createDataFrame([(1, pour[0], pour[1])], "pour_id long, row long, col long")
        snapped = snap_pour_points(at, flow, threshold)
        area = flow.join(delineate_basins(flow, snapped, tile).select("row", "col"), ["row", "col"], "left_semi")
    elif mask is not None:
        area = flow.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    area = settle(area)
    if not area.limit(1).take(1):
        raise ValueError("the area holds no cells")
    # links that leave the area end there
    inside = area.select(F.col("id").alias("down"))
    kept = area.join(inside, "down", "left_semi").select("id", "down")
    area = settle(area.drop("down").join(kept, "id", "left"))
    basins = None
    if split:
        basins = settle(sub_basins(area, threshold, min_basin_cells(cell_x, cell_y, min_area_km2), tile))
        if not basins.limit(1).take(1):
            basins = None
    if basins is None:
        basins = area.select("row", "col", F.lit(1).cast("bigint").alias("basin_id"))
    return {"flow": area, "basins": basins, "streams": channel_segments(channels(area, threshold))}


