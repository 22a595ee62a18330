"""Cells to polygon rings.

Every cell side that faces another value is a directed unit edge with the cell
on its right.  Which edge comes next is decided by the 3x3 cells around, so a
tile with a rim of one cell links its own edges.  What is left are chains that
cross a tile: one row each, with its number of corners, its least corner and
its share of the signed area.  Only chains meet by pointer doubling, which finds
a ring's least corner and the way there at once; a corner's place in its ring is
then arithmetic.  No task ever holds a whole ring, so a region may cover any
share of the raster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.functions.geometry import vertex
from loamgrid.plans.forest import resolve
from loamgrid.plans.lattice import STRIDE, TILE, with_halo
from loamgrid.session import settle, settle_counting

#: Greater than any edge or position: "none yet" where a least one is looked for.
NONE = (1 << 63) - 1

#: Kinds of row that a tile gives.
CORNER, CHAIN, WALL = 0, 1, 2

# Per side (top, right, bottom, left = walking E, S, W, N), as (row, col) offsets of the cell: the edge's end corner,
# the cells ahead on the right and on the left, the cell that the side faces.
SIDES = [
    {"end": (0, 1), "right": (0, 1), "left": (-1, 1), "out": (-1, 0)},
    {"end": (1, 1), "right": (1, 0), "left": (1, 1), "out": (0, 1)},
    {"end": (1, 0), "right": (0, -1), "left": (1, -1), "out": (1, 0)},
    {"end": (0, 0), "right": (-1, 0), "left": (-1, -1), "out": (0, -1)},
]


def _linked(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """All edges of a tile's own cells, with ``link``, the place of the next one or -1 where it is another tile's."""
    row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    codes, values = pd.factorize(pdf["value"])
    y0, x0 = row.min() - 1, col.min() - 1
    ground = np.full((row.max() - y0 + 2, col.max() - x0 + 2), -1)
    ground[row - y0, col - x0] = codes
    own = pdf["core"].to_numpy(bool)
    i, j, code = (row - y0)[own], (col - x0)[own], codes[own]
    place = np.full((4, *ground.shape), -1)
    found = []
    for side, s in enumerate(SIDES):
        at = np.flatnonzero(ground[i + s["out"][0], j + s["out"][1]] != code)
        y, x, c = i[at], j[at], code[at]
        around = ground[y + s["left"][0], x + s["left"][1]] == c
        straight = ground[y + s["right"][0], x + s["right"][1]] == c
        turn = np.where(~straight, 1, np.where(~around, 0, -1))
        step_y = np.where(turn == 1, 0, np.where(turn == 0, s["right"][0], s["left"][0]))
        step_x = np.where(turn == 1, 0, np.where(turn == 0, s["right"][1], s["left"][1]))
        found.append((np.full(len(at), side), y, x, c, turn, (side + turn) % 4, y + step_y, x + step_x))
    side, y, x, c, turn, then, ny, nx = (np.concatenate(f) for f in zip(*found))
    place[side, y, x] = np.arange(len(side))
    ends = np.array([s["end"] for s in SIDES])[side]

    def name(y, x, side):
        return ((y + y0) * STRIDE + (x + x0)) * 4 + side

    return {
        "edge": name(y, x, side), "next": name(ny, nx, then), "link": place[then, ny, nx], "side": side, "corner": turn != 0,
        "row": y + y0, "col": x + x0, "y": y + y0 + ends[:, 0], "x": x + x0 + ends[:, 1], "value": np.asarray(values)[c],
    }


def _cut_cycles(e: dict[str, np.ndarray]) -> None:
    """Rings within the tile begin at their least corner: the link into it goes, nothing follows their last edge."""
    link, n = e["link"], len(e["link"])
    rounds = int(n).bit_length()
    last = np.where(link >= 0, link, np.arange(n))
    for _ in range(rounds):
        last = last[last]
    closed = np.flatnonzero(link[last] >= 0)
    number = np.full(n, -1)
    number[closed] = np.arange(len(closed))
    hop = number[link[closed]]
    least = np.where(e["corner"][closed], e["edge"][closed], NONE)
    for _ in range(rounds):
        least = np.minimum(least, least[hop])
        hop = hop[hop]
    into = closed[e["edge"][link[closed]] == least]
    link[into] = -1
    e["next"][into] = -1


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's corners, chains and left walls; see :func:`_tiles`."""
    e = _linked(pdf)
    _cut_cycles(e)
    link, corner, n = e["link"], e["corner"], len(e["link"])
    before = np.arange(n)
    inner = np.flatnonzero(link >= 0)
    before[link[inner]] = inner
    pos = np.where(before == np.arange(n), 0, corner[before]).astype(np.int64)
    head = before
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        pos, head = pos + pos[head], further
    tails = np.flatnonzero(link < 0)
    starts = head[tails]
    number = np.full(n, -1)
    number[starts] = np.arange(len(starts))
    chain = number[head]

    def lowest(rows, by):
        """Per chain, which of ``rows`` has the least ``by``; the row or -1."""
        order = rows[np.lexsort((by[rows], chain[rows]))]
        first = np.flatnonzero(np.diff(chain[order], prepend=-1))
        out = np.full(len(starts), -1)
        out[chain[order[first]]] = order[first]
        return out

    turning, right, left = np.flatnonzero(corner), np.flatnonzero(e["side"] == 1), np.flatnonzero(e["side"] == 3)
    least = lowest(turning, e["edge"])
    place = e["col"] * STRIDE + e["row"]
    probe = lowest(right, place)
    area = np.zeros(len(starts), np.int64)
    np.add.at(area, chain[right], e["col"][right] + 1)
    np.subtract.at(area, chain[left], e["col"][left])
    names = e["edge"][starts]
    corners = pd.DataFrame({"kind": CORNER, "value": e["value"][turning], "chain": names[chain[turning]], "pos": pos[turning], "x": e["x"][turning], "y": e["y"][turning]})
    chains = pd.DataFrame({
        "kind": CHAIN, "value": e["value"][starts], "chain": names, "next": e["next"][tails], "corners": np.bincount(chain[turning], minlength=len(starts)),
        "least": np.where(least < 0, NONE, e["edge"][least]), "pos": np.where(least < 0, 0, pos[least]), "area": area,
        "probe": np.where(probe < 0, NONE, place[probe]),
    })
    walls = pd.DataFrame({"kind": WALL, "value": e["value"][left], "chain": names[chain[left]], "x": e["col"][left], "y": e["row"][left]})
    columns = ["kind", "value", "chain", "pos", "x", "y", "next", "corners", "least", "area", "probe"]
    parts = [f.reindex(columns=columns, fill_value=0) for f in (corners, chains, walls)]
    return pd.concat(parts, ignore_index=True)


def _tiles(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """One table of three kinds of rows, ``chain`` being a chain's first edge.

    CORNER: ``value, chain, pos, x, y``, pos counting the chain's corners from 0.
    CHAIN:  ``next`` the chain that follows (-1: a ring by itself), ``corners``, ``least`` corner and its ``pos``,
            ``area`` (sum of x dy), ``probe`` (col and row of the leftmost cell whose right side is in the chain).
    WALL:   cells (``x, y`` = col, row) whose left side is in the chain.
    """
    kinds = cells.schema[value].dataType.simpleString()
    spread = with_halo(cells.select("row", "col", F.col(value).alias("value")), 1, tile)
    owned = spread.groupBy("tr", "tc").applyInPandas(
        lambda p: _chains(p),
        f"kind int, value {kinds}, chain long, pos long, x long, y long, next long, corners long, least long, area long, probe long",
    )
    return settle(owned)


def _ring_of_chains(chains: DataFrame) -> DataFrame:
    """``chain, ring, pos, dist``: a ring's least corner, its place in its chain, and the corners from ``chain`` to that chain.

    After a round a chain knows four times as many ahead; a ring is known when none of them is lower.
    """
    closed = chains.filter("next = -1").select("chain", F.col("least").alias("ring"), "pos", F.lit(0).cast("long").alias("dist"))
    state = chains.filter("next <> -1").select("chain", "next", "least", "pos", F.lit(0).cast("long").alias("dist"), F.col("corners").alias("total"))
    state, moving = settle_counting(state, "true")
    while moving:
        ahead = state.select(F.col("chain").alias("next"), *[F.col(c).alias(f"_{c}") for c in ("next", "least", "pos", "dist", "total")])
        wide = state.withColumn("lower", F.lit(False))
        for _ in range(3):
            low = F.col("_least") < F.col("least")
            wide = wide.join(ahead, "next").select(
                "chain", F.col("_next").alias("next"), F.least("least", "_least").alias("least"),
                F.when(low, F.col("_pos")).otherwise(F.col("pos")).alias("pos"),
                F.when(low, F.col("total") + F.col("_dist")).otherwise(F.col("dist")).alias("dist"),
                (F.col("total") + F.col("_total")).alias("total"), (F.col("lower") | low).alias("lower"),
            )
        state, moving = settle_counting(wide, "lower")
        state = state.drop("lower")
    return closed.unionByName(state.select("chain", F.col("least").alias("ring"), "pos", "dist"))


def ring_vertices(cells: DataFrame, value: str = "basin_id", tile: int = TILE) -> DataFrame:
    """``value, ring, parent, is_hole, seq, x, y`` in corner units (x = column, y = row).

    Rings carry only their corners, the first one repeated at the end; they begin
    at their least corner.  Exteriors run clockwise on screen; ``parent`` is the
    exterior a ring belongs to (itself for exteriors).  Cells touching only at a
    corner stay apart.  Cells without a value, and an empty table, have no rings.
    """
    tiles = _tiles(cells.filter(F.col(value).isNotNull()), value, tile)
    chains = tiles.filter(F.col("kind") == CHAIN)
    found = settle(_ring_of_chains(chains))
    facts = chains.select("chain", "value", "corners", "area", "probe").join(found, "chain")
    rings = settle(
        facts.groupBy("ring").agg(
            F.first("value").alias("value"), F.sum("corners").alias("size"), (F.sum("area") < 0).alias("is_hole"), F.min("probe").alias("probe")
        )
    )
    parent = _parents(tiles.filter(F.col("kind") == WALL), found, rings)
    placed = found.withColumn("ahead", F.col("pos") + F.col("dist")).select("chain", "ring", "ahead")
    known = placed.join(rings.select("ring", "size", "is_hole"), "ring").join(parent, "ring")
    corners = tiles.filter(F.col("kind") == CORNER).select("chain", "value", "pos", "x", "y").join(known, "chain")
    at = F.pmod(F.col("pos") - F.col("ahead"), F.col("size")) + 1
    seq = F.explode(F.when(at == 1, F.array(at, F.col("size") + 1)).otherwise(F.array(at)))
    return corners.select("value", "ring", "parent", "is_hole", seq.alias("seq"), "x", "y")


def _parents(walls: DataFrame, found: DataFrame, rings: DataFrame) -> DataFrame:
    """``ring, parent``: the ring met first to the left of a hole, followed up to an exterior.

    To the left of a hole's leftmost side lie cells of the same region up to
    its own boundary, so the nearest left wall of that lattice row belongs to
    the enclosing ring or to another hole of the same part.  Only lattice rows
    that a hole asks about are looked at.
    """
    asks = rings.filter("is_hole").select(
        "ring", "value", F.expr(f"probe div {STRIDE}").alias("x"), (F.col("probe") % STRIDE).alias("y"), F.lit(None).cast("long").alias("wall")
    )
    near = walls.select("chain", "value", "x", "y").join(asks.select("value", "y").distinct(), ["value", "y"], "left_semi")
    marks = near.join(found.select("chain", F.col("ring").alias("wall")), "chain").select(
        F.lit(None).cast("long").alias("ring"), "value", "x", "y", "wall"
    )
    line = Window.partitionBy("value", "y").orderBy("x", F.col("wall").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(asks).withColumn("down", F.last("wall", ignorenulls=True).over(line)).filter("ring IS NOT NULL").select("ring", "down")
    nodes = rings.select("ring", "is_hole").join(seen, "ring", "left").select(
        F.col("ring").alias("id"), F.when(F.col("is_hole"), F.col("down")).alias("down"), F.when(~F.col("is_hole"), F.col("ring")).alias("label")
    )
    return resolve(nodes).select(F.col("id").alias("ring"), F.col("label").alias("parent"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """``value, ring, area``: signed areas from :func:`ring_vertices`, holes negative; each corner meets the next by a join."""
    ahead = rings.select("ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    term = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    return rings.join(ahead, ["ring", "seq"]).groupBy("value", "ring").agg((F.sum(term) / 2).alias("area"))


def polygons(rings: DataFrame, x: Column, y: Column) -> DataFrame:
    """Polygon parts ``value, part, geometry``: one row per exterior with its holes.

    A feature is a value, so its vertices are gathered here; stay with
    :func:`ring_vertices` where single regions are too large for a row.
    """
    v = rings.select("value", "parent", "ring", "is_hole", "seq", vertex(x, y).alias("v"))
    ring = v.groupBy("value", "parent", "ring", "is_hole").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda p: p["v"]).alias("vs")
    )
    part = ring.groupBy("value", F.col("parent").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("is_hole", "ring", "vs"))), lambda r: r["vs"]).alias("rings")
    )
    return part.select(
        "value", "part", F.struct(F.lit("Polygon").alias("type"), F.array("rings").alias("parts")).alias("geometry")
    )


def basin_polygons(cells: DataFrame, value: str, x: Column, y: Column, tile: int = TILE) -> DataFrame:
    """``basin_id, cell_count, geometry``: Polygon, or MultiPolygon for separate parts."""
    rings = ring_vertices(cells, value, tile)
    counts = cells.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cell_count"))
    merged = polygons(rings, x, y).groupBy("value").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", F.col("geometry.parts").alias("p")))), lambda g: F.get(g["p"], F.lit(0))).alias("parts")
    )
    kind = F.when(F.size("parts") > 1, "MultiPolygon").otherwise("Polygon")
    return merged.join(counts, "value").select(
        F.col("value").alias("basin_id"), "cell_count", F.struct(kind.alias("type"), "parts").alias("geometry")
    )
