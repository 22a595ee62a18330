import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from loamgrid.operators import hydrology as H
from loamgrid.operators import polygonize as P
from loamgrid.operators import terrain as T
from loamgrid.operators import viewshed as V
from loamgrid.plans import rays as R
from loamgrid.plans.lattice import STRIDE


def cells_of(spark, z):
    r, c = np.indices(z.shape)
    pdf = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "z": z.ravel()})
    pdf["z"] = pdf["z"].astype(object).where(pdf["z"].notna(), None)
    return spark.createDataFrame(pdf, "row long, col long, z double")


def grid_of(df, shape, value, fill=np.nan):
    out = np.full(shape, fill, float)
    for row in df.select("row", "col", value).collect():
        out[row[0], row[1]] = np.nan if row[2] is None else row[2]
    return out


@pytest.fixture(scope="module")
def rough():
    rng = np.random.default_rng(7)
    z = rng.integers(0, 60, (34, 41)).astype(float) + 3 * np.indices((34, 41))[0]
    z[10:13, 20:22] = np.nan
    return z


@pytest.mark.parametrize(("tile", "block"), [(8, 8), (5, 2), (64, 1)])
def test_fill_equals_dijkstra(spark, rough, tile, block):
    filled = H.fill_sinks(cells_of(spark, rough), 0.001, 10.0, 12.0, tile=tile, block=block)
    got = grid_of(filled, rough.shape, "z", np.inf)
    want = brute.fill(rough, 0.001, 10.0, 12.0)
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize(("slope", "block", "most"), [(0.001, 8, 9), (0.5, 4, 16)])
def test_fill_of_a_wide_depression(spark, monkeypatch, slope, block, most):
    """A lake over 22 tiles with islands and a winding wall: rounds follow its extent in blocks, dry tiles are left alone."""
    rng = np.random.default_rng(3)
    z = rng.integers(0, 9, (20, 90)).astype(float)
    z[0], z[-1], z[:, 0], z[:, -1] = 50, 50, 50, 50
    z[:, 1:5] = 60 - 10 * np.arange(4)
    for k in range(8, 80, 8):
        z[slice(1, 14) if k % 16 else slice(6, 19), k] = 70.0
    z[9, 89], z[5, 44] = 20.0, np.nan
    rounds = []
    settled = H.settle_counting
    monkeypatch.setattr(H, "settle_counting", lambda df, test: rounds.append(test) or settled(df, test))
    got = grid_of(H.fill_sinks(cells_of(spark, z), slope, 10.0, 10.0, tile=4, block=block), z.shape, "z", np.inf)
    assert np.allclose(got, brute.fill(z, slope, 10.0, 10.0), atol=1e-9)
    assert len(rounds) <= most


def test_fill_of_dry_and_empty_tables(spark):
    z = np.add.outer(np.arange(9.0), np.arange(9.0))
    assert np.allclose(grid_of(H.fill_sinks(cells_of(spark, z), 0.001, 10.0, 10.0, tile=4), z.shape, "z"), z)
    assert H.fill_sinks(cells_of(spark, z).limit(0), 0.001, 10.0, 10.0).count() == 0


def moved(df, by):
    return df.withColumn("row", F.col("row") + by)


def test_answers_do_not_depend_on_the_row(spark):
    """Cell ids above 2^53 must come through whole (row 2^23), as must four times an id."""
    z = np.add.outer(np.arange(7.0), 2.0 * np.arange(7.0))
    z[3, 3] = 40.0
    hole = np.ones((7, 7))
    hole[3, 3] = 2
    got = []
    for by in (0, 1 << 23):
        flow = H.flow_accumulation(H.flow_direction(moved(cells_of(spark, z), by), 10.0, 10.0, tile=4), tile=4).cache()
        acc = {(r["row"] - by, r["col"]): r["accum"] for r in flow.collect()}
        subs = {(r["row"] - by, r["col"]): r["basin_id"] for r in H.sub_basins(flow, 3, 4, tile=4).collect()}
        rings = P.ring_vertices(moved(cells_of(spark, hole), by), "z", tile=4).collect()
        assert all(r["parent"] is not None for r in rings)
        got.append((acc, subs, sorted((r["value"], r["is_hole"], r["seq"], r["x"], r["y"] - by) for r in rings)))
    assert got[0] == got[1] and max(got[0][0].values()) > 5


def test_flow_and_basins(spark, rough):
    want = brute.fill(rough, 0.001, 10.0, 12.0)
    z = np.where(np.isinf(want), np.nan, want)
    flow = H.flow_accumulation(H.flow_direction(cells_of(spark, z), 10.0, 12.0, tile=8), tile=8).cache()
    fd, down = brute.flow(z, 10.0, 12.0)
    assert np.array_equal(grid_of(flow, z.shape, "fd", 0), fd)
    acc = brute.accum(down)
    for row in flow.collect():
        assert row["accum"] == acc[row["row"], row["col"]]

    thr = 12
    ch, up, label = brute.reaches(down, acc, thr)
    channels = H.channels(flow, thr)
    key = lambda u: u[0] * STRIDE + u[1]
    got = {r["id"]: r["start"] for r in H.reach_labels(channels).collect()}
    assert got == {key(u): key(s) for u, s in label.items()}

    orders = {r["id"]: r["strahler"] for r in H.strahler_order(channels).collect()}
    assert orders == {key(u): k for u, k in brute.strahler(down, ch).items()}

    # segments: every head and confluence starts one line; a line ends on the next start
    seg = H.channel_segments(channels).toPandas().sort_values(["segment", "seq"])
    starts = {key(u) for u in ch if up[u] != 1}
    assert set(seg["segment"]) <= starts
    for s, g in seg.groupby("segment"):
        path = list(zip(g["row"], g["col"]))
        assert key(path[0]) == s
        for a, b in zip(path, path[1:]):
            assert down[a] == b

    # pour point basin against an upstream walk
    pour = max(acc, key=lambda u: (acc[u], u))
    basin = {(r["row"], r["col"]) for r in H.basin_of(flow, *pour, tile=8).collect()}
    def drains(u):
        while u is not None:
            if u == pour:
                return True
            u = down[u]
        return False
    assert basin == {u for u in down if drains(u)}

    subs = H.sub_basins(flow, thr, 1, tile=8).toPandas()
    first = subs.sort_values(["row", "col"]).drop_duplicates("basin_id")["basin_id"].tolist()
    assert first == list(range(1, len(first) + 1))
    assert subs["basin_id"].nunique() == len(set(label.values()))
    merged = H.sub_basins(flow, thr, 40, tile=8).toPandas()
    assert len(merged) == len(subs) and merged["basin_id"].nunique() < subs["basin_id"].nunique()
    group = {(r.row, r.col): r.basin_id for r in subs.itertuples()}
    size = subs["basin_id"].value_counts().to_dict()
    outlet = {}
    for u in ch:
        b = group[u]
        if b not in outlet or acc[u] > acc[outlet[b]]:
            outlet[b] = u
    into = {}
    for b in sorted(outlet, key=lambda b: acc[outlet[b]]):
        below = group.get(down[outlet[b]])
        if size[b] < 40 and below is not None and below != b:
            into[b] = below
            size[below] += size[b]

    def final(b):
        while b in into:
            b = into[b]
        return b

    pairs = {(r.basin_id, final(group[r.row, r.col])) for r in merged.itertuples()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

    rings = P.ring_vertices(spark.createDataFrame(subs), "basin_id", tile=8).toPandas()
    area = 0.0
    for _, g in rings.sort_values("seq").groupby("ring"):
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        assert (x[0], y[0]) == (x[-1], y[-1])
        area += 0.5 * np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])
    assert area == len(subs)


def test_polygon_with_nested_hole(spark):
    z = np.ones((9, 9))
    z[2:7, 2:7] = 2
    z[4, 4] = 1
    cells = cells_of(spark, z)
    rings = P.ring_vertices(cells, "z", tile=4)
    n = {(r["value"], r["is_hole"]): r["count"] for r in rings.select("value", "ring", "is_hole").distinct().groupBy("value", "is_hole").count().collect()}
    assert n == {(1.0, False): 2, (1.0, True): 1, (2.0, False): 1, (2.0, True): 1}
    shapes = P.basin_polygons(cells, "z", F.col("x"), F.col("y"), tile=4).collect()
    by = {r["basin_id"]: r for r in shapes}
    assert by[1.0]["geometry"]["type"] == "MultiPolygon" and by[1.0]["cell_count"] == 57
    assert by[2.0]["geometry"]["type"] == "Polygon" and len(by[2.0]["geometry"]["parts"][0]) == 2


def _parts(z):
    """Least cell of each cell's 4-connected part."""
    part = {}
    for start in np.ndindex(z.shape):
        todo = [] if start in part or np.isnan(z[start]) else [start]
        while todo:
            u = todo.pop()
            if u in part:
                continue
            part[u] = start
            for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                v = (u[0] + d[0], u[1] + d[1])
                if 0 <= v[0] < z.shape[0] and 0 <= v[1] < z.shape[1] and z[v] == z[u]:
                    todo.append(v)
    return part


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_rings_equal_a_walk(spark, tile):
    rng = np.random.default_rng(11)
    z = np.where(rng.random((17, 23)) < 0.55, 1.0, 2.0)
    z[2:15, 1] = z[2, 1:22] = z[14, 1:22] = 3.0  # a part that encloses others over many tiles
    z[2:15, 21] = 3.0
    z[8, 8:11] = np.nan
    got = P.ring_vertices(cells_of(spark, z), "z", tile=tile).toPandas().sort_values("seq")
    rings = {k: (g["value"].iloc[0], g["is_hole"].iloc[0], g["parent"].iloc[0], list(zip(g["x"], g["y"]))) for k, g in got.groupby("ring")}
    assert all(g["seq"].tolist() == list(range(1, len(g) + 1)) for _, g in got.groupby("ring"))
    want = {k: v for k, v in brute.rings(z).items()}
    assert {k: (v, hole, pts) for k, (v, hole, _, pts) in rings.items()} == want
    part = _parts(z)
    where = {k: part[divmod(k // 4, STRIDE)] for k in rings}
    assert all(where[k] == where[up] and not rings[up][1] and (hole or up == k) for k, (_, hole, up, _) in rings.items())
    areas = P.ring_areas(P.ring_vertices(cells_of(spark, z), "z", tile=tile)).groupBy("value").agg(F.sum("area").alias("area")).collect()
    assert {r["value"]: r["area"] for r in areas} == {v: float((z == v).sum()) for v in (1.0, 2.0, 3.0)}


def test_rings_of_an_empty_table(spark):
    assert P.ring_vertices(cells_of(spark, np.full((3, 3), np.nan)), "z", tile=2).count() == 0


def test_last_rays_equal_a_walk_of_all():
    rng = np.random.default_rng(0)
    for _ in range(150):
        height, width = rng.integers(1, 14, 2)
        r0, c0 = int(rng.integers(0, height)), int(rng.integers(0, width))
        want = np.full((height, width), -1)
        for ray in range(2 * width + 2 * max(0, height - 2)):
            way = R.directions(np.array([ray]), r0, c0, width, height)
            for k in range(1, 14 if way[3][0] else 1):
                y, x = R.offsets(np.array([k]), way)
                if 0 <= r0 + y[0] < height and 0 <= c0 + x[0] < width:
                    want[r0 + y[0], c0 + x[0]] = max(ray, want[r0 + y[0], c0 + x[0]])
        y, x = np.indices(want.shape)
        other = (y != r0) | (x != c0)
        got = np.full(want.shape, -1)
        got[other] = R.last_rays(y[other] - r0, x[other] - c0, r0, c0, int(width), int(height))
        assert np.array_equal(got, want), (height, width, r0, c0)


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_viewshed_equals_sweep(spark, rough, monkeypatch, tile):
    monkeypatch.setattr(V, "WALKED", 40)
    observers = [(1, 5, 7, 2.0, 150.0, 10.0, 12.0), (2, 30, 39, 10.0, 0.0, 10.0, 12.0), (3, 0, 0, 5.0, 90.0, 10.0, 12.0), (4, 5, 7, 20.0, 0.0, 10.0, 12.0)]
    rows = [(i, r, c, float(rough[r, c]), h, rad, x, y) for i, r, c, h, rad, x, y in observers]
    o = spark.createDataFrame(rows, "observer_id long, row long, col long, ground double, height_m double, radius_m double, cell_x double, cell_y double")
    got = V.viewshed(cells_of(spark, rough), o, rough.shape[1], rough.shape[0], 1.0, True, tile=tile).toPandas()
    assert not got.duplicated().any()
    for i, r, c, h, rad, x, y in observers:
        want = brute.viewshed(rough, r, c, rough[r, c] + h, 1.0, x, y, rad, True)
        mine = np.zeros(rough.shape, int)
        g = got[got["observer_id"] == i]
        mine[g["row"], g["col"]] = 1
        assert np.array_equal(mine, want), i


@pytest.mark.parametrize("tile", [3, 16])
def test_diffraction_equals_walk(spark, rough, monkeypatch, tile):
    monkeypatch.setattr(V, "SAMPLED", 1000)
    z = rough[:14, :24]
    observers = [(1, 3, 4, 10.0, 90.0), (2, 13, 23, 3.0, 0.0), (3, 0, 0, 1.0, 5.0)]
    rows = [(i, r, c, float(z[r, c]), h, rad, 10.0, 12.0) for i, r, c, h, rad in observers]
    o = spark.createDataFrame(rows, "observer_id long, row long, col long, ground double, height_m double, radius_m double, cell_x double, cell_y double")
    got = V.diffraction(cells_of(spark, z), o, 1.5, 900.0, 43.0, 32, True, max_edges=20, tile=tile).toPandas()
    got = {(r.observer_id, r.row, r.col): r.rx_dbm for r in got.itertuples()}
    lam, want = 3e8 / 900e6, {}
    for i, r0, c0, h, rad in observers:
        for r, c in np.ndindex(z.shape):
            if np.isnan(z[r, c]) or (rad and math.hypot(r - r0, c - c0) > rad / 11.0):
                continue
            far = math.hypot((c - c0) * 10.0, (r - r0) * 12.0)
            if far < 0.1:
                want[i, r, c] = 43.0
                continue
            dist, elev = [], []
            for s in range(33):
                y, x = s / 32 * (r - r0), s / 32 * (c - c0)
                ground, k = z[math.floor(r0 + y + 0.5), math.floor(c0 + x + 0.5)], math.hypot(x * 10.0, y * 12.0)
                if not np.isnan(ground):
                    dist.append(k)
                    elev.append(ground + k * k / (2 * 6371000.0) * 0.87)
            loss = brute.profile_loss(dist, elev, z[r0, c0] + h, 1.5, lam)
            free = 20 * math.log10(max(far, 1)) + 20 * math.log10(900e6) - 20 * math.log10(3e8 / (4 * math.pi))
            want[i, r, c] = 43.0 - free - loss
    assert len(want) > 400 and got == pytest.approx(want, abs=1e-6)


def test_diffraction_without_ground_or_observers(spark, rough):
    kind = "observer_id long, row long, col long, ground double, height_m double, radius_m double, cell_x double, cell_y double"
    one = spark.createDataFrame([(1, 900, 900, 5.0, 1.0, 20.0, 10.0, 12.0)], kind)
    assert V.diffraction(cells_of(spark, rough), one, tile=16).count() == 0
    assert V.diffraction(cells_of(spark, rough), one.limit(0), tile=16).count() == 0
    assert V.diffraction(cells_of(spark, np.full((3, 3), np.nan)), one, tile=16).count() == 0


@pytest.mark.parametrize("search,smooth", [(2, 0), (3, 1)])
def test_summits_equal_greedy(spark, search, smooth):
    rng = np.random.default_rng(3)
    z = np.round(rng.random((30, 33)) * 40 + 30 * np.sin(np.indices((30, 33))[1] / 4.0), 0)
    z[5, 5] = np.nan
    got = T.summits(cells_of(spark, z), search, smooth, 5.0, 40.0, max_count=50, tile=8).orderBy("rank").collect()
    want = brute.summits(z, search, smooth, 5.0, 40.0, 50)
    assert [(r["row"], r["col"], r["kind"]) for r in got] == [(a, b, k) for a, b, k, _ in want]


def test_plateau_keeps_one_summit_per_window(spark):
    z = np.zeros((20, 20))
    z[8:12, 8:12] = 50.0
    got = T.summits(cells_of(spark, z), 3, 0, 5.0, 40.0, tile=8).collect()
    assert [(r["row"], r["col"]) for r in got] == [(a, b) for a, b, _, _ in brute.summits(z, 3, 0, 5.0, 40.0, 500)]


def test_diffraction_counts_every_edge():
    """A dome of 60 samples blocks with each of them: the reference's limit of 20 edges gives less than the whole loss."""
    x = np.linspace(0, 6000, 61)[None, :]
    z = 400 - (x - 3000) ** 2 / 30000
    args = x, z, np.array([61]), np.array([z[0, 0] + 1]), 1.0, np.array([0.3])
    whole = V._profile_loss(*args, max_edges=None)[0]
    assert V._profile_loss(*args, max_edges=20)[0] < whole == V._profile_loss(*args)[0] == V._profile_loss(*args, max_edges=61)[0]


def windows(z, radius):
    """Mean, maximum and minimum of each box, cell by cell."""
    out = np.full((3, *z.shape), np.nan)
    for r, c in np.ndindex(z.shape):
        box = z[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
        if not np.isnan(box).all():
            out[:, r, c] = np.nanmean(box), np.nanmax(box), np.nanmin(box)
    return out


@pytest.mark.parametrize("radius", [0, 1, 3, 11, 40])
def test_windows_wider_than_a_tile(spark, radius):
    rng = np.random.default_rng(radius)
    z = np.round(rng.random((19, 23)) * 9000 - 400, 2)
    z[rng.random(z.shape) < 0.2] = np.nan
    z[:8, :8] = np.nan
    want = windows(z, radius)
    cells = cells_of(spark, z).withColumn("tag", F.col("row") * 100 + F.col("col"))
    for rows in (cells, cells.where("z IS NOT NULL")):  # nodata as rows, or absent
        smooth = T.box_smooth(rows, radius, tile=4)
        there = ~np.isnan(grid_of(rows, z.shape, "tag"))
        assert np.allclose(grid_of(smooth, z.shape, "smooth"), np.where(there, want[0], np.nan), atol=1e-9, equal_nan=True)
        assert smooth.where("tag <> row * 100 + col").count() == 0 and smooth.columns == [*rows.columns, "smooth"]
        ends = T.window_extremes(rows, radius, tile=4)
        for k, name in ((1, "window_max"), (2, "window_min")):
            assert np.array_equal(grid_of(ends, z.shape, name), np.where(there, want[k], np.nan), equal_nan=True)


@pytest.mark.parametrize("radius", [2, 9, 30])
def test_relief_of_rings_over_tiles(spark, radius):
    rng = np.random.default_rng(8)
    z = np.round(rng.random((24, 21)) * 50)
    z[rng.random(z.shape) < 0.1] = np.nan
    cells = cells_of(spark, z).withColumnRenamed("z", "smooth")
    got = grid_of(T.local_relief(cells.where("smooth > 30"), cells, radius, tile=4), z.shape, "relief")
    inner = max(1, int(radius * 0.35))
    y, x = np.indices(z.shape)
    for r, c in np.argwhere(z > 30):
        d2 = (y - r) ** 2 + (x - c) ** 2
        lower = np.sort(z[(d2 > inner * inner) & (d2 <= radius * radius) & (z < z[r, c])])
        assert got[r, c] == (z[r, c] - lower[int(len(lower) * 0.25)] if len(lower) else 0.0)
    assert T.local_relief(cells.limit(0), cells, radius).count() == 0


def test_loss_of_profile_arrays(spark):
    rng = np.random.default_rng(5)
    profiles = [(np.cumsum(rng.random(n) * 90).tolist(), (rng.random(n) * 60).tolist(), 40.0 + n, 0.4) for n in (2, 3, 9, 40)] + [([], [], 1.0, 0.4), ([0.0], [5.0], 6.0, 0.4)]
    df = spark.createDataFrame(profiles, "d array<double>, e array<double>, eye double, lam double").coalesce(1)
    for most in (1, 20):
        got = [r[0] for r in df.select(V.knife_edge_loss(F.col("d"), F.col("e"), F.col("eye"), F.col("lam"), 1.5, most)).collect()]
        if most == 20:
            assert got == pytest.approx([brute.profile_loss(*p[:3], 1.5, p[3]) if len(p[0]) > 1 else 0.0 for p in profiles], abs=1e-9)
        assert len(got) == len(profiles) and all(x >= 0 for x in got)


def test_rays_of_an_observer_move_as_few_rows(monkeypatch):
    spot = dict(observer_id=[1, 1], row=[9, 9], col=[9, 9], eye=[5.0, 5.0], reach=[7.0, 7.0], cell_x=[1.0, 1.0], cell_y=[1.0, 1.0], tr=[0, 1], tc=[0, 0])
    found = {}
    for block in (1 << 20, 30):
        monkeypatch.setattr(V, "BLOCK", block)
        useful = pd.concat(V._useful_rays(iter([pd.DataFrame(spot)]), 40, 400, 10))
        merged = useful.groupby([*V.SPOT, "block"])[["ray", "steps"]].agg(lambda a: np.concatenate(a.to_list())).reset_index()
        cut = pd.concat(V._cut_rays(iter([merged]), 40, 400, 10))
        assert len(merged) == 1 + (15 * 15) // block and sum(map(len, useful["ray"])) > 2 * len(useful)
        assert len(cut) == len(cut.drop_duplicates(["block", "tr", "tc"]))
        found[block] = sorted(zip(*(np.concatenate(cut[c].to_list()) for c in ("ray", "k0", "k1")), np.repeat(cut["tr"], cut["ray"].map(len))))
    assert found[1 << 20] == found[30] and len(found[30]) > 40
