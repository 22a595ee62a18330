"""Line of sight and radio diffraction over an elevation table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions.crs import cell_size_m
from loamgrid.functions.scalar import js_number, js_string
from loamgrid.plans import rays
from loamgrid.plans.lattice import TILE, div, with_tile
from loamgrid.session import settle

# Earth radius for curvature, refraction share, the usual limit of knife edges per path (a choice, no default), speed of light as used.
CURVATURE_RADIUS = 6371000.0
REFRACTION = 0.13
MAX_EDGES = 20
LIGHT_SPEED = 3e8
LABEL_FIELDS = ["name", "Name", "label", "Label", "id", "ID"]


# -------------------------------------------------------------------- observers
def batch_observers(
    features: DataFrame,
    seq: str,
    radius_field: str | None = None,
    height_field: str | None = None,
    radius: float = 5000.0,
    height: float = 2.0,
    max_radius: float | None = None,
) -> DataFrame:
    """One row per observer position with validity in ``status`` (ok / skipped).

    ``features`` has ``geometry`` (point or multipoint) or ``lon, lat``, and a
    unique ``seq``; ids run over the valid positions in order.
    """
    from loamgrid.plans.ranks import global_rank

    def number(field, common):
        return js_number(F.col(f"`{field}`")) if field else F.lit(float(common))

    if "geometry" in features.columns:
        pts = F.filter(
            F.flatten(F.flatten(F.col("geometry.parts"))), lambda v: F.col("geometry.type").isin("Point", "MultiPoint")
        )
        src = features.select("*", F.posexplode(pts).alias("_part", "_v")).withColumns(
            {"lon": F.col("_v.x"), "lat": F.col("_v.y")}
        )
    else:
        src = features.withColumn("_part", F.lit(0))
    src = global_rank(src, F.col(seq), F.col("_part"), out="_pos")
    found = [js_string(F.col(f"`{c}`")) for c in LABEL_FIELDS if c in features.columns]
    label = F.coalesce(*found, F.concat(F.lit("Point "), F.col("source_index").cast("string")))
    r, h = number(radius_field, radius), number(height_field, height)
    ok = (r > 0) & (h >= 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    if max_radius is not None:
        ok = ok & (r <= max_radius)
    out = src.withColumns(
        {"radius_m": r, "height_m": h, "status": F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("skipped")}
    )
    index = global_rank(features.select(F.col(seq).alias("_seq")).distinct(), F.col("_seq"), out="source_index")
    out = out.join(index.withColumnRenamed("_seq", seq), seq).withColumn("source_label", label)
    valid = global_rank(out.filter("status = 'ok'").select("_pos"), F.col("_pos"), out="observer_id")
    return out.join(valid, "_pos", "left").select(
        "observer_id", "lon", "lat", "radius_m", "height_m", "source_index", (F.col("_part") + 1).alias("source_point_index"), "source_label", "status"
    )


def locate_observers(observers: DataFrame, cells: DataFrame, meta: dict) -> DataFrame:
    """Cell, ground height and cell size of each observer; ``note`` says why one is skipped.

    ``meta``: minx, miny, maxx, maxy, width, height of the raster.
    """
    m = {k: F.lit(v) for k, v in meta.items()}
    px = (F.col("lon") - m["minx"]) / ((m["maxx"] - m["minx"]) / m["width"])
    py = (m["maxy"] - F.col("lat")) / ((m["maxy"] - m["miny"]) / m["height"])
    inside = (px >= 0) & (px < m["width"]) & (py >= 0) & (py < m["height"])

    def clamp(v, n):
        return F.least(n - 1, F.greatest(F.lit(0), F.floor(v + 0.5))).cast("bigint")

    size = cell_size_m(m["minx"], m["miny"], m["maxx"], m["maxy"], m["width"], m["height"], F.col("lat"))
    placed = observers.withColumns(
        {"row": clamp(py, m["height"]), "col": clamp(px, m["width"]), "_in": inside, "_size": size}
    ).withColumns({"cell_x": F.col("_size.x"), "cell_y": F.col("_size.y")})
    ground = cells.select("row", "col", F.col("z").alias("ground"))
    note = F.when(~F.col("_in"), "outside the raster").when(F.col("ground").isNull(), "no elevation").otherwise("")
    return (
        placed.join(ground, ["row", "col"], "left")
        .withColumn("note", note)
        .withColumn("status", F.when(F.col("note") == "", F.lit("ok")).otherwise("skipped"))
        .drop("_in", "_size")
    )


# --------------------------------------------------------------- line of sight
SPOT = ["observer_id", "row", "col", "eye", "reach", "cell_x", "cell_y"]
SPOT_TYPES = "observer_id long, row long, col long, eye double, reach double, cell_x double, cell_y double"
#: Steps of rays that are walked at once.
WALKED = 2_000_000
#: Cells of an observer's window whose rays are one row of arrays.
BLOCK = 1 << 20


def packed_tiles(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``tr, tc, z``: the cells of a tile as the bytes of doubles by row and column, NaN where there is none."""

    def pack(rows: pa.Table) -> pa.Table:
        tr, tc = rows["tr"][0].as_py(), rows["tc"][0].as_py()
        z = np.full((tile, tile), np.nan)
        z[rows["row"].to_numpy() - tr * tile, rows["col"].to_numpy() - tc * tile] = rows["z"].to_numpy()
        return pa.table({"tr": [tr], "tc": [tc], "z": [z.tobytes()]})

    known = cells.filter("z IS NOT NULL").select("row", "col", F.col("z").cast("double").alias("z"))
    return with_tile(known, tile).drop("rim").groupBy("tr", "tc").applyInArrow(pack, "tr long, tc long, z binary")


def viewshed(
    cells: DataFrame, observers: DataFrame, width: int, height: int, target_height: float = 0.0, curvature: bool = True, tile: int = TILE
) -> DataFrame:
    """Visible cells ``observer_id, row, col`` of each observer.

    ``observers``: ``observer_id, row, col, ground, height_m, radius_m, cell_x,
    cell_y`` (radius 0 = unlimited).  A cell crossed by several rays takes the
    answer of the last one.  Nodata cells neither block nor show.

    Only rays that are the last through some cell are traced.  A ray is cut
    where it leaves a tile; a tile answers for each of its pieces with the
    greatest angle, the pieces of a ray pass that on from the observer outwards
    (rays move as arrays, a block of an observer's rays in a row), and with the angle at its entry each tile marks its own cells.  Windows of
    any size are done so; what a task holds is one tile and the pieces in it.
    """
    mean = (F.col("cell_x") + F.col("cell_y")) / 2
    reach = F.when(F.col("radius_m") > 0, F.col("radius_m") / mean).otherwise(F.lit(1e9))
    spots = observers.select(
        "observer_id", "row", "col", (F.col("ground") + F.col("height_m")).alias("eye"), reach.alias("reach"), "cell_x", "cell_y"
    )
    tiles = settle(packed_tiles(cells, tile))
    r, c, far = F.col("row"), F.col("col"), F.floor("reach")
    near = spots.withColumn(
        "tr", F.explode(F.sequence(div(F.greatest(r - far, F.lit(0)), tile), div(F.least(r + far, F.lit(height - 1)), tile)))
    ).withColumn("tc", F.explode(F.sequence(div(F.greatest(c - far, F.lit(0)), tile), div(F.least(c + far, F.lit(width - 1)), tile))))
    # few rows that mean much work each: the number of tasks is given, so that they are not put together by size
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    useful = near.repartition(tasks, "observer_id", "tr", "tc").mapInPandas(
        lambda b: _together(_useful_rays(b, width, height, tile), 500), f"{SPOT_TYPES}, block long, ray array<long>, steps array<long>"
    )
    useful = _gathered(useful.repartition(tasks, "observer_id", "block"), ["block"], ["ray", "steps"])
    part = f"{SPOT_TYPES}, block long, tr long, tc long, ray array<long>, k0 array<long>, k1 array<long>"
    pieces = settle(useful.mapInPandas(lambda b: _together(_cut_rays(b, width, height, tile), 500), part))
    tops = _with_ground(pieces.repartition(tasks, "observer_id", "tr", "tc"), tiles, tile).mapInPandas(lambda b: _together(_top_angles(b, width, height, tile, curvature), 500), f"{part}, top array<double>")
    whole = _gathered(tops.repartition(tasks, "observer_id", "block"), ["block"], ["ray", "k0", "k1", "top"], each=["tr", "tc"])
    entered = whole.mapInPandas(lambda b: _together(_passed_on(b), 500), f"{part}, horizon array<double>")
    seen = _with_ground(_gathered(entered.repartition(tasks, "observer_id", "tr", "tc"), ["tr", "tc"], ["ray", "k0", "k1", "horizon"]), tiles, tile).mapInPandas(
        lambda b: _together(_seen_cells(b, width, height, tile, target_height, curvature)), "observer_id long, row long, col long"
    )
    return observers.select("observer_id", "row", "col").unionByName(seen)


def _gathered(rows: DataFrame, by: list[str], fields: list[str], each: list[str] = ()) -> DataFrame:
    """The rows of an observer and ``by`` as one: arrays ``fields`` put together, and ``each`` with the ``size`` of each row's part."""
    one = rows.groupBy(*SPOT, *by).agg(F.collect_list(F.struct(*each, *fields)).alias("m"))
    sizes = [F.transform(f"m.{fields[0]}", F.size).alias("size")] if each else []
    return one.select(*SPOT, *by, *[F.col(f"m.{c}").alias(c) for c in each], *sizes, *[F.flatten(f"m.{f}").alias(f) for f in fields])


def _with_ground(pieces: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """``pieces`` with the heights ``z`` of the rows of their tile that the reach meets, and ``z0``, the first of them."""
    far, top = F.floor("reach").cast("long"), F.col("tr") * tile
    z0 = F.greatest(F.col("row") - far - top, F.lit(0))
    z1 = F.least(F.col("row") + far - top, F.lit(tile - 1))
    some = F.substring("z", (z0 * tile * 8 + 1).cast("int"), ((z1 - z0 + 1) * tile * 8).cast("int"))
    return pieces.join(tiles, ["tr", "tc"]).withColumn("z0", z0).withColumn("z", some)


def _spot_rows(spot, n: int, **columns) -> pd.DataFrame:
    return pd.DataFrame({**{f: np.repeat(getattr(spot, f), n) for f in SPOT}, **columns})


def _together(frames: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Small frames as fewer ones."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _useful_rays(batches: Iterator[pd.DataFrame], width: int, height: int, tile: int) -> Iterator[pd.DataFrame]:
    """The rays that are last through some cell of a tile within the reach, and how far they are of use there."""
    for pdf in batches:
        for spot in pdf.itertuples(index=False):
            far = math.floor(spot.reach)
            rows = np.arange(max(spot.tr * tile, spot.row - far), min((spot.tr + 1) * tile, height, spot.row + far + 1)) - spot.row
            cols = np.arange(max(spot.tc * tile, spot.col - far), min((spot.tc + 1) * tile, width, spot.col + far + 1)) - spot.col
            y, x = (a.ravel() for a in np.meshgrid(rows, cols, indexing="ij"))
            d2 = y * y + x * x
            y, x = y[(d2 > 0) & (d2 <= spot.reach * spot.reach)], x[(d2 > 0) & (d2 <= spot.reach * spot.reach)]
            ray = rays.last_rays(y, x, spot.row, spot.col, width, height)
            y, x, ray = y[ray >= 0], x[ray >= 0], ray[ray >= 0]
            by_row = rays.directions(ray, spot.row, spot.col, width, height)[2]
            k = np.where(by_row, np.abs(y), np.abs(x))
            some, number = np.unique(ray, return_inverse=True)
            steps = np.zeros(len(some), np.int64)
            np.maximum.at(steps, number, k)
            # rays that a task puts together: as many blocks as the window needs, the same for all its tiles
            window = min(2 * far + 1, width) * min(2 * far + 1, height)
            block = some % (1 + window // BLOCK)
            yield _parts(spot, {"block": block}, {"ray": some, "steps": steps})


def _parts(spot, keys: dict[str, np.ndarray], values: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row of arrays for each combination of ``keys``, in the order of the values."""
    first = next(iter(keys.values()))
    order = np.lexsort(tuple(keys.values()))
    if not len(order):
        return _spot_rows(spot, 0, **keys, **values)
    new = np.zeros(len(first), bool)
    for v in keys.values():
        new[1:] |= np.diff(v[order]) != 0
    at = np.flatnonzero(new)
    begin = np.r_[0, at]
    return _spot_rows(spot, len(begin), **{k: v[order][begin] for k, v in keys.items()}, **{k: np.split(v[order], at) for k, v in values.items()})


def _cut_rays(batches: Iterator[pd.DataFrame], width: int, height: int, tile: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for spot in pdf.itertuples(index=False):
            ray, number = np.unique(spot.ray, return_inverse=True)
            steps = np.zeros(len(ray), np.int64)
            np.maximum.at(steps, number, spot.steps)
            part = np.cumsum(steps) // WALKED
            found = [rays.segments(ray[part == i], steps[part == i], spot.row, spot.col, width, height, spot.reach, tile) for i in np.unique(part)]
            if found:
                own, tr, tc, k0, k1 = (np.concatenate(f) for f in zip(*found))
                yield _parts(spot, {"tr": tr, "tc": tc}, {"ray": own, "k0": k0, "k1": k1}).assign(block=spot.block)[[*SPOT, "block", "tr", "tc", "ray", "k0", "k1"]]


def _passed_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The horizon at the entry of each piece: the greatest angle of the pieces of its ray before it."""
    for pdf in batches:
        for spot in pdf.itertuples(index=False):
            ray, k0, k1, top = (np.asarray(v) for v in (spot.ray, spot.k0, spot.k1, spot.top))
            tr, tc = np.repeat(spot.tr, spot.size), np.repeat(spot.tc, spot.size)
            order = np.lexsort((k0, ray))
            starts = np.flatnonzero(np.r_[True, np.diff(ray[order]) != 0])
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            horizon = np.full(len(order), -np.inf)
            turn = np.argsort(place, kind="stable")
            for at in np.split(turn, np.flatnonzero(np.diff(place[turn])) + 1)[1:]:  # the second pieces, the third, ...
                horizon[order[at]] = np.maximum(horizon[order[at - 1]], top[order[at - 1]])
            yield _parts(spot, {"tr": tr, "tc": tc}, {"ray": ray, "k0": k0, "k1": k1, "horizon": horizon}).assign(block=spot.block)[
                [*SPOT, "block", "tr", "tc", "ray", "k0", "k1", "horizon"]
            ]


def _angles(piece, width: int, height: int, tile: int, curvature: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Step by step along the pieces in a tile: which of them, row and column in the tile, height, distance, and drop."""
    z = np.frombuffer(piece.z).reshape(-1, tile)
    k0, k1 = np.asarray(piece.k0), np.asarray(piece.k1)
    way = rays.directions(np.asarray(piece.ray), piece.row, piece.col, width, height)
    for k in range(int(k0.min()), int(k1.max()) + 1):
        at = np.flatnonzero((k0 <= k) & (k <= k1))
        y, x = rays.offsets(np.full(len(at), k), tuple(w[at] for w in way))
        r, c = piece.row + y - piece.tr * tile, piece.col + x - piece.tc * tile
        here = z[r - piece.z0, c]
        known = ~np.isnan(here)
        at, y, x, r, c, here = at[known], y[known], x[known], r[known], c[known], here[known]
        dist = np.sqrt((x * piece.cell_x) ** 2 + (y * piece.cell_y) ** 2)
        drop = dist * dist / (2 * CURVATURE_RADIUS) * (1 - REFRACTION) if curvature else np.zeros(len(at))
        yield at, r, c, here, np.where(dist == 0, 0.001, dist), drop


def _top_angles(batches: Iterator[pd.DataFrame], width: int, height: int, tile: int, curvature: bool) -> Iterator[pd.DataFrame]:
    """The greatest terrain angle of each piece; none where it meets no known cell."""
    for pdf in batches:
        for piece in pdf.itertuples(index=False):
            n = len(piece.ray)
            top = np.full(n, -np.inf)
            for at, _, _, z, dist, drop in _angles(piece, width, height, tile, curvature):
                top[at] = np.maximum(top[at], (z - drop - piece.eye) / dist)
            yield _spot_rows(piece, 1, **{f: [getattr(piece, f)] for f in ("block", "tr", "tc", "ray", "k0", "k1")}, top=[top])


def _seen_cells(batches: Iterator[pd.DataFrame], width: int, height: int, tile: int, target_height: float, curvature: bool) -> Iterator[pd.DataFrame]:
    """The cells whose last ray sees them.  Pieces are put in order by ray, and a cell is met at one step, so the last answer stays."""
    for pdf in batches:
        for piece in pdf.itertuples(index=False):
            order = np.lexsort((piece.k0, piece.ray))
            piece = piece._replace(**{f: getattr(piece, f)[order] for f in ("ray", "k0", "k1")}, horizon=piece.horizon[order])
            horizon = np.array(piece.horizon, float)
            answer = np.zeros((tile, tile), bool)
            for at, r, c, z, dist, drop in _angles(piece, width, height, tile, curvature):
                answer[r, c] = (z + target_height - drop - piece.eye) / dist >= horizon[at]
                horizon[at] = np.maximum(horizon[at], (z - drop - piece.eye) / dist)
            r, c = np.nonzero(answer)
            yield pd.DataFrame({"observer_id": np.repeat(piece.observer_id, len(r)), "row": r + piece.tr * tile, "col": c + piece.tc * tile})


# ------------------------------------------------------------------ diffraction
def _edge_loss(nu: np.ndarray) -> np.ndarray:
    """Lee's piecewise approximation of single knife-edge loss, in dB."""
    field = np.ones_like(nu)
    a, b, c, d = (nu >= -0.7) & (nu < 0), (nu >= 0) & (nu < 1), (nu >= 1) & (nu < 2.4), nu >= 2.4
    field[a] = 0.5 - 0.62 * nu[a]
    field[b] = 0.5 * np.exp(-0.95 * nu[b])
    field[c] = 0.4 - np.sqrt(np.maximum(0.0, 0.1184 - (0.38 - 0.1 * nu[c]) ** 2))
    field[d] = 0.225 / nu[d]
    loss = -20 * np.log10(np.maximum(field, 1e-10))
    loss[nu < -0.7] = 0.0
    return loss


def _profile_loss(dist: np.ndarray, elev: np.ndarray, n: np.ndarray, eye: np.ndarray, target_height: float, wavelength: np.ndarray,
                  max_edges: int | None = None) -> np.ndarray:
    """Epstein-Peterson loss of a batch of profiles, padded to one width (n = true lengths)."""
    rows, width = dist.shape
    at = np.arange(width)[None, :]
    last = np.maximum(n - 1, 0)[:, None]
    inside = at < n[:, None]
    level = elev.copy()  # heights as seen by the line of sight: ends raised to antenna and target
    ends = elev[np.arange(rows), last[:, 0]] + target_height
    level[:, 0] = eye
    level[np.arange(rows), last[:, 0]] = ends
    edge = (at == 0) | (at == last)

    def sides(edge):
        rows = len(edge)
        left = np.maximum.accumulate(np.where(edge, at, 0), axis=1)
        left = np.concatenate([np.zeros((rows, 1), int), left[:, :-1]], axis=1)
        right = np.minimum.accumulate(np.where(edge, at, width - 1)[:, ::-1], axis=1)[:, ::-1]
        right = np.concatenate([right[:, 1:], np.full((rows, 1), width - 1)], axis=1)
        return left, right

    def clearance(left, right, dist, level, elev):
        da, db = np.take_along_axis(dist, left, 1), np.take_along_axis(dist, right, 1)
        ea, eb = np.take_along_axis(level, left, 1), np.take_along_axis(level, right, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (dist - da) / (db - da)
        return ea + share * (eb - ea) - elev, dist - da, db - dist

    live = np.arange(rows)  # a profile without a new edge is done
    for _ in range(width if max_edges is None else max_edges):
        some = edge[live]
        h, _d1, _d2 = clearance(*sides(some), dist[live], level[live], elev[live])
        block = np.where(inside[live] & ~some, -h, -np.inf)
        block[np.isnan(block)] = -np.inf
        best = block.argmax(axis=1)
        hit = block[np.arange(len(live)), best] > 0
        if not hit.any():
            break
        live = live[hit]
        edge[live, best[hit]] = True
    h, d1, d2 = clearance(*sides(edge), dist, level, elev)
    knife = edge & inside & (at > 0) & (at < last) & (d1 > 0) & (d2 > 0)
    total = np.zeros(rows)
    i, j = np.nonzero(knife)
    nu = -h[i, j] * np.sqrt(2 * (d1[i, j] + d2[i, j]) / (wavelength[i] * d1[i, j] * d2[i, j]))
    np.add.at(total, i, _edge_loss(nu))
    total[(n < 2) | (dist[np.arange(rows), last[:, 0]] <= 0)] = 0.0
    return total


def knife_edge_loss(dist, elev, eye, wavelength, target_height: float, max_edges: int | None = None) -> Column:
    """Loss in dB of profiles held as sorted arrays, one numpy pass per Arrow batch; ``max_edges`` None: until no edge blocks."""

    @F.pandas_udf("double")
    def loss(dist: pd.Series, elev: pd.Series, eye: pd.Series, wavelength: pd.Series) -> pd.Series:
        n = dist.map(len).to_numpy(int)
        width = max(2, int(n.max())) if len(n) else 2
        d, e = np.zeros((len(n), width)), np.zeros((len(n), width))
        fill = np.arange(width)[None, :] < n[:, None]
        if n.sum():
            d[fill] = np.concatenate(dist.to_numpy())
            e[fill] = np.concatenate(elev.to_numpy())
        return pd.Series(_profile_loss(d, e, n, eye.to_numpy(float), target_height, wavelength.to_numpy(float), max_edges))

    return loss(dist, elev, eye, wavelength)


#: Side of the blocks of target cells and of the tiles of ground that profiles are cut from.
SIDE = 64
#: Samples of profiles that are worked on at once.
SAMPLED = 500_000


def diffraction(
    cells: DataFrame,
    observers: DataFrame,
    target_height: float = 1.5,
    freq_mhz: float = 900.0,
    tx_dbm: float = 43.0,
    n_samples: int = 64,
    curvature: bool = True,
    max_edges: int | None = None,
    tile: int = SIDE,
) -> DataFrame:
    """Received level ``observer_id, row, col, rx_dbm`` at every known cell within each radius (0 = unlimited).

    Targets are taken by blocks of ``tile`` x ``tile`` cells.  A block is routed to the tiles that its profiles cross, each
    with the range of samples that may lie there; a tile answers with the heights of those samples as one packed piece, and
    the pieces of a block are put together again.  A task holds one tile or the profiles of one block, whatever the radius.
    The only key is the tile, met by one row a block, so an observer's own cell is no hot key.  Samples without elevation
    drop out of a profile.  ``max_edges`` None takes every edge that blocks; MAX_EDGES is the usual limit.
    """
    n = max(2, n_samples)
    mean = (F.col("cell_x") + F.col("cell_y")) / 2
    reach = F.when(F.col("radius_m") > 0, F.col("radius_m") / mean).otherwise(F.lit(1e9))
    spots = observers.select(
        "observer_id", "row", "col", (F.col("ground") + F.col("height_m")).alias("eye"), reach.alias("reach"), "cell_x", "cell_y"
    )
    tiles = settle(packed_tiles(cells, tile))
    box = tiles.agg(F.struct(F.min("tr").alias("r0"), F.max("tr").alias("r1"), F.min("tc").alias("c0"), F.max("tc").alias("c1"))).scalar()
    spots = spots.withColumn("b", box)
    far = F.floor("reach").cast("bigint")
    for out, at, lo, hi in (("br", "row", "b.r0", "b.r1"), ("bc", "col", "b.c0", "b.c1")):
        first, last = F.greatest(div(F.col(at) - far, tile), F.col(lo)), F.least(div(F.col(at) + far, tile), F.col(hi))
        spots = spots.withColumn(out, F.explode(F.when(first <= last, F.sequence(first, last))))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = f"{SPOT_TYPES}, br long, bc long"
    routes = spots.drop("b").repartition(tasks, "observer_id", "br", "bc").mapInPandas(
        lambda b: _together(_routes(b, n, tile)), f"{block}, tr long, tc long, s0 long, s1 long"
    )
    pieces = routes.join(tiles, ["tr", "tc"]).mapInPandas(
        lambda b: _profile_pieces(b, n, tile), f"{block}, tr long, tc long, s0 long, s1 long, heights binary"
    )
    return pieces.groupBy(*SPOT, "br", "bc").applyInPandas(
        lambda p: _block_levels(p, n, tile, target_height, freq_mhz, tx_dbm, curvature, max_edges),
        "observer_id long, row long, col long, rx_dbm double",
    )


def _block_targets(spot, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from the observer of a block's cells within the reach."""
    y, x = np.meshgrid(np.arange(tile) + spot.br * tile - spot.row, np.arange(tile) + spot.bc * tile - spot.col, indexing="ij")
    near = np.sqrt(y.astype(float) ** 2 + x.astype(float) ** 2) <= spot.reach
    return y[near], x[near]


def _sample_cells(spot, y: np.ndarray, x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.floor(spot.row + np.outer(y, t) + 0.5).astype(np.int64), np.floor(spot.col + np.outer(x, t) + 0.5).astype(np.int64)


def _routes(batches: Iterator[pd.DataFrame], n: int, tile: int) -> Iterator[pd.DataFrame]:
    """Per block the tiles that its profiles may cross and the first and last sample there.  The samples of one step are the
    block drawn together towards the observer, so they lie in at most two rows and two columns of tiles."""
    t = np.arange(n + 1) / n
    for pdf in batches:
        for spot in pdf.itertuples(index=False):
            y, x = _block_targets(spot, tile)
            if not len(y):
                continue
            r, c = _sample_cells(spot, np.array([y.min(), y.max()]), np.array([x.min(), x.max()]), t)
            met = np.concatenate([np.stack([r[i] // tile, c[j] // tile], 1) for i in (0, 1) for j in (0, 1)])
            some, number = np.unique(met, axis=0, return_inverse=True)
            s, number = np.tile(np.arange(n + 1), 4), number.ravel()
            s0, s1 = np.full(len(some), n), np.zeros(len(some), np.int64)
            np.minimum.at(s0, number, s)
            np.maximum.at(s1, number, s)
            yield _spot_rows(spot, len(some), br=spot.br, bc=spot.bc, tr=some[:, 0], tc=some[:, 1], s0=s0, s1=s1)


def _profile_pieces(batches: Iterator[pd.DataFrame], n: int, tile: int) -> Iterator[pd.DataFrame]:
    """The heights of a block's samples in one tile, by target and sample."""
    t = np.arange(n + 1) / n
    for pdf in batches:
        for start in range(0, len(pdf), 32):
            part = pdf.iloc[start : start + 32]
            heights = []
            for piece in part.itertuples(index=False):
                r, c = _sample_cells(piece, *_block_targets(piece, tile), t[piece.s0 : piece.s1 + 1])
                here = (r // tile == piece.tr) & (c // tile == piece.tc)
                z = np.frombuffer(piece.z).reshape(tile, tile)
                heights.append(z[r[here] - piece.tr * tile, c[here] - piece.tc * tile].tobytes())
            yield part.drop(columns="z").assign(heights=heights)


def _block_levels(pdf: pd.DataFrame, n: int, tile: int, target_height, freq_mhz, tx_dbm, curvature, max_edges) -> pd.DataFrame:
    """Received levels of one block of targets."""
    spot = next(pdf.itertuples(index=False))
    t = np.arange(n + 1) / n
    y, x = _block_targets(spot, tile)
    r, c = _sample_cells(spot, y, x, t)
    ground = np.full(r.shape, np.nan)
    for piece in pdf.itertuples(index=False):
        part = slice(piece.s0, piece.s1 + 1)
        here = (r[:, part] // tile == piece.tr) & (c[:, part] // tile == piece.tc)
        ground[:, part][here] = np.frombuffer(piece.heights)
    known = ~np.isnan(ground[:, n])
    y, x, ground = y[known], x[known], ground[known]
    wavelength = LIGHT_SPEED / (freq_mhz * 1e6)
    free = 20 * math.log10(freq_mhz * 1e6) - 20 * math.log10(LIGHT_SPEED / (4 * math.pi))
    out = [np.empty(0)]
    step = max(1, SAMPLED // (n + 1))
    for start in range(0, len(y), step):
        dy, dx, e = y[start : start + step], x[start : start + step], ground[start : start + step]
        d = np.sqrt((np.outer(dx, t) * spot.cell_x) ** 2 + (np.outer(dy, t) * spot.cell_y) ** 2)
        if curvature:
            e = e + d * d / (2 * CURVATURE_RADIUS) * (1 - REFRACTION)
        # samples without elevation drop out: close the gaps to the left
        order = np.argsort(np.isnan(e), axis=1, kind="stable")
        count = (~np.isnan(e)).sum(axis=1)
        e, d = np.take_along_axis(e, order, 1), np.take_along_axis(d, order, 1)
        loss = _profile_loss(d, np.nan_to_num(e), count, np.full(len(dy), spot.eye), target_height, np.full(len(dy), wavelength), max_edges)
        dist = np.sqrt((dx * spot.cell_x) ** 2 + (dy * spot.cell_y) ** 2)
        level = tx_dbm - (20 * np.log10(np.maximum(dist, 1)) + free) - loss
        out.append(np.where(dist < 0.1, tx_dbm, level))
    return pd.DataFrame({"observer_id": spot.observer_id, "row": y + spot.row, "col": x + spot.col, "rx_dbm": np.concatenate(out)})


def level_statistics(levels: DataFrame, threshold_dbm: float | None = None) -> DataFrame:
    """Weakest and strongest level per observer, and how many cells reach the threshold."""
    good = F.lit(None).cast("bigint") if threshold_dbm is None else F.count_if(F.col("rx_dbm") >= threshold_dbm)
    return levels.groupBy("observer_id").agg(
        F.min("rx_dbm").alias("min_dbm"), F.max("rx_dbm").alias("max_dbm"), F.count(F.lit(1)).alias("cells"), good.alias("usable_cells")
    )


# ----------------------------------------------------------------------- output
def visible_rings(seen: DataFrame, width: int, height: int, tile: int = 256) -> DataFrame:
    """Polygon rings of each observer's visible cells, in raster corner units.

    Views overlap, so each observer is laid out on a block of its own in one
    large lattice (about as many blocks across as down) and moved back after.
    Blocks are numbered by rank, so ids may be of any size.
    """
    from loamgrid.operators.polygonize import ring_vertices
    from loamgrid.plans.ranks import global_rank

    seen = settle(seen.select("observer_id", "row", "col"))
    blocks = settle(global_rank(seen.select("observer_id").distinct(), F.col("observer_id"), out="block"))
    across = math.isqrt(blocks.count()) + 1
    h, w = height + 2, width + 2
    down_by = F.floor(F.col("block") / across).cast("bigint") * h
    right_by = (F.col("block") % across) * w
    laid = seen.join(blocks, "observer_id").select((F.col("row") + down_by).alias("row"), (F.col("col") + right_by).alias("col"), "observer_id")
    rings = ring_vertices(laid, "observer_id", tile).withColumnRenamed("value", "observer_id").join(blocks, "observer_id")
    return rings.withColumns({"y": F.col("y") - down_by, "x": F.col("x") - right_by}).drop("block")


def viewshed_parts(rings: DataFrame, x: Column, y: Column) -> DataFrame:
    """``observer_id, part_index, geometry`` from :func:`visible_rings`."""
    from loamgrid.operators.polygonize import polygons

    parts = polygons(rings.withColumnRenamed("observer_id", "value"), x, y)
    order = Window.partitionBy("value").orderBy("part")
    return parts.select(F.col("value").alias("observer_id"), F.row_number().over(order).alias("part_index"), "geometry")


def viewshed_features(parts: DataFrame, observers: DataFrame) -> DataFrame:
    """One row per visible polygon part, and one ``view_point`` row per observer.

    ``parts``: ``observer_id, part_index, geometry``.
    """
    facts = ["observer_id", "radius_m", F.col("height_m").alias("observer_height_m"), "source_index", "source_point_index", "source_label"]
    areas = parts.join(observers.select(*facts), "observer_id").select(
        F.lit("viewshed_area").alias("type"),
        F.concat(F.lit("Observer "), F.col("observer_id").cast("string"), F.lit(" visible area "), F.col("part_index").cast("string")).alias("label"),
        "observer_id", "part_index", "radius_m", "observer_height_m", "source_index", "source_point_index", "source_label",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("note"), "geometry",
    )
    points = observers.select(*facts, "lat", F.col("lon").alias("lng"), "status", "note", G.point("lon", "lat").alias("geometry")).select(
        F.lit("view_point").alias("type"),
        F.concat(F.lit("Observer "), F.col("observer_id").cast("string")).alias("label"),
        "observer_id", F.lit(None).cast(parts.schema["part_index"].dataType).alias("part_index"),
        "radius_m", "observer_height_m", "source_index", "source_point_index", "source_label", "lat", "lng", "status", "note", "geometry",
    )
    return areas.unionByName(points)
