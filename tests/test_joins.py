import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import aggregates as A
from loamgrid.operators import classify as C
from loamgrid.operators import edits as E
from loamgrid.operators import grid as GR
from loamgrid.operators import hull as HU
from loamgrid.operators import joins as J
from loamgrid.plans.buckets import salted_join


def hav(a, b):
    lon1, lat1, lon2, lat2 = np.radians(a[:, :1]), np.radians(a[:, 1:]), np.radians(b[:, 0][None]), np.radians(b[:, 1][None])
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6378137.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def layer(spark, xy):
    pdf = pd.DataFrame({"id": np.arange(len(xy)), "lon": xy[:, 0], "lat": xy[:, 1]})
    return spark.createDataFrame(pdf, "id long, lon double, lat double")


def test_nearest_anywhere_on_earth(spark):
    rng = np.random.default_rng(5)
    far = np.column_stack([rng.uniform(-180, 180, 60), rng.uniform(-85, 85, 60)])
    crowd = np.tile([[0.0, 0.0]], (40, 1))  # many rows at one spot
    left = np.vstack([far, crowd])
    right = np.column_stack([rng.uniform(10, 40, 25), rng.uniform(30, 60, 25)])
    right = np.vstack([right, right[:3]])  # ties: the first row wins
    got = J.nearest(layer(spark, left), layer(spark, right), start_m=200_000.0).toPandas().sort_values("id")
    d = hav(left, right)
    assert np.allclose(got["distance"], d.min(axis=1), rtol=1e-12)
    assert (got["right_id"].to_numpy() == d.argmin(axis=1)).all()


def test_distance_join_near_the_pole_and_hot_bucket(spark):
    rng = np.random.default_rng(6)
    left = np.column_stack([rng.uniform(-5, 5, 200), rng.uniform(84, 86, 200)])
    right = np.column_stack([rng.uniform(-5, 5, 50), rng.uniform(84, 86, 50)])
    got = J.distance_pairs(layer(spark, left), layer(spark, right), 20_000.0)
    want = {(i, j) for i, j in zip(*np.nonzero(hav(left, right) <= 20_000.0))}
    assert {(r["l_id"], r["r_id"]) for r in got.collect()} == want and want


@pytest.mark.parametrize("metres", [500.0, 50_000.0])
def test_date_line_and_poles(spark, metres):
    left = np.array([[179.999, 10.0], [0.0, 89.9], [-180.0, -10.0], [12.0, 90.0]])
    right = np.array([[-179.999, 10.0], [180.0, 89.9], [180.0, -10.0], [-77.0, 89.99], [179.9, 10.0]])
    d = hav(left, right)
    got = {(r["l_id"], r["r_id"]) for r in J.distance_pairs(layer(spark, left), layer(spark, right), metres).collect()}
    assert got == set(zip(*(i.tolist() for i in np.nonzero(d <= metres)))) and got
    near = J.nearest(layer(spark, left), layer(spark, right)).toPandas().sort_values("id")
    assert (near["right_id"].to_numpy() == d.argmin(axis=1)).all()


def test_copied_right_rows_do_not_go_through_the_driver(spark):
    rng = np.random.default_rng(9)
    left, right = rng.uniform(0, 2, (300, 2)), rng.uniform(0, 2, (5000, 2))
    met = J.distance_pairs(layer(spark, left), layer(spark, right), 4000.0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    want = {(int(i), int(k)) for i, k in zip(*np.nonzero(hav(left, right) <= 4000.0))}
    got = [(r["l_id"], r["r_id"]) for r in met.select("l_id", "r_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_salting_changes_nothing(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 20).alias("k"))
    right = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("r"))
    salted = salted_join(left, right, ["k"], "id", hot_rows=50).select("id", "r")
    plain = left.join(right, "k").select("id", "r")
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hull_of_skewed_partitions(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(size=(3000, 2)), np.tile([[9.0, 9.0]], (2000, 1)), [[-9, 0], [0, -9]]])
    h = HU.convex_hull(spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"]))).first()["hull"]
    pts = np.array([[v["x"], v["y"]] for v in h])
    nxt = np.roll(pts, -1, axis=0)
    for a, b in zip(pts, nxt):  # every point lies left of every edge
        assert ((b[0] - a[0]) * (xy[:, 1] - a[1]) - (b[1] - a[1]) * (xy[:, 0] - a[0]) >= -1e-9).all()
    assert tuple(pts[0]) == (-9.0, 0.0)


def test_interpolation_coincident_sample(spark):
    # nodes start at min - radius: the lower-left sample sits on a node
    rows = [(1, 300.0, 0.0, 5.0), (2, 0.0, 300.0, 9.0), (3, 0.0, 300.0, 100.0), (4, 600.0, 600.0, 1.0)]
    pts = spark.createDataFrame(rows, "seq long, x double, y double, value double")
    o = GR.GridOptions(600.0, 100.0, 2, "bbox")
    got = {(r["x"], r["y"]): (r["value"], r["neighbor_count"]) for r in GR.interpolate(pts, o).collect()}
    assert got[(0.0, 300.0)] == (9.0, 1)  # first of two coincident samples, one earlier sample in reach
    assert got[(600.0, 600.0)] == (1.0, 1 if np.hypot(600, 300) > 600 else 3)
    x, y = 100.0, 100.0
    d = np.array([np.hypot(a - x, b - y) for _, a, b, _ in rows])
    v = np.array([r[3] for r in rows])
    near = d <= 600
    assert got[(x, y)][0] == pytest.approx((v[near] / d[near] ** 2).sum() / (1 / d[near] ** 2).sum()) and got[(x, y)][1] == near.sum()
    nearest = {(r["x"], r["y"]): r["value"] for r in GR.interpolate(pts, o, "nearest").collect()}
    assert nearest[(x, y)] == v[d.argmin()]


def test_quantiles_with_a_dominant_value(spark):
    values = [1.0] * 500 + list(np.arange(2.0, 502.0))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = [(r["min"], r["max"]) for r in C.quantile_breaks(df, "v", 4).orderBy("class").collect()]
    s, n = sorted(values), len(values)
    assert got == [(s[i * n // 4], s[min(n - 1, -(-(i + 1) * n // 4) - 1)]) for i in range(4)]


def test_ordered_values_keep_nulls_last_and_ties_in_order(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, 2.0, "b"), (2, 1.0, None), (3, 1.0, "d")], "id long, k double, v string")
    got = [r["value"] for r in A.ordered_values(df, "v", "id", "k").orderBy("rank").collect()]
    assert got == [None, "d", "b", "a"]
    chunks = A.concatenate_chunks(df, "v", "id", "k", delimiter="|", chunk=2).orderBy("part").collect()
    assert "|".join(r["text"] for r in chunks) == "d|b|a"


def test_merge_edits_keeps_hidden_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    edits = spark.createDataFrame([(2, "B"), (9, "new")], "id long, v string")
    got = {(r["id"], r["v"]) for r in E.merge_edits(base, edits, base.filter("id >= 2")).collect()}
    assert got == {(1, "a"), (2, "B"), (9, "new")}


def boxes_of(spark, rows):
    from loamgrid.functions import geometry as G

    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    return df.select("id", G.box("a", "b", "c", "d").alias("geometry"))


def test_boxes_of_all_sizes_meet(spark):
    """From a point to the world, negative and touching: each pair once, and few rows for a large one."""
    from loamgrid.plans.buckets import box_level, cells

    rng = np.random.default_rng(11)

    def some(n, first):
        size = 2.0 ** rng.integers(-12, 9, n)
        x, y = rng.integers(-180, 180, n) / 2.0, rng.integers(-90, 90, n) / 2.0
        rows = [(first + i, float(x[i]), float(y[i]), float(x[i] + size[i]), float(y[i] + size[i] * rng.integers(0, 2))) for i in range(n)]
        return [*rows, (first + n, -180.0, -90.0, 180.0, 90.0), (first + n + 1, 0.0, 0.0, 0.0, 0.0), (first + n + 2, -1.0, -1.0, 0.0, 0.0)]

    left, right = some(60, 0), some(50, 1000)
    want = {(a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    l, r = boxes_of(spark, left), boxes_of(spark, right)
    got = [tuple(p) for p in J._met(J._bounds(l.select(F.col("id").alias("left_id"), "geometry"), "geometry"), J._bounds(r.select(F.col("id").alias("right_id"), "geometry"), "geometry"), "left_id").collect()]
    assert set(got) == want and len(got) == len(want)
    world = J._bounds(boxes_of(spark, left[60:61]), "geometry")
    assert cells(world.withColumn("_level", box_level("_box")), "_box", "_level", list(range(-20, 20)), None).count() < 100


def test_layers_without_rows_or_bounds(spark):
    l, none = boxes_of(spark, [(1, 0.0, 0.0, 1.0, 1.0)]), boxes_of(spark, [(2, None, None, None, None)])
    assert J.intersecting(l, l.limit(0)).count() == 0 and J.intersecting(l, l.limit(0), keep=False).count() == 1
    assert J.overlay_intersects(l, none).first()["hit"] is False
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.1, 1.0)], "id long, lon double, lat double")
    assert sorted(r.id for r in J.within_join(points, l.unionByName(none)).collect()) == [1, 2]
    assert J.within_join(points, l.limit(0)).count() == 0


def test_union_of_fields(spark):
    a, b = spark.range(2).withColumn("x", F.lit(1)), spark.range(3).withColumn("a", F.lit("t"))
    assert E.field_union(a, b) == ["a", "id", "x"]
    both = E.union_layers(a, b)
    assert sorted(both.columns) == ["a", "id", "x"] and both.where("x IS NULL").count() == 3


def test_ordered_values_of_groups(spark):
    """A hot group over many ranges, small ones and a null one; nulls last, ties by seq."""
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", None if i % 11 == 0 else int(rng.integers(0, 30)), None if i % 13 == 0 else f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, k int, v string")
    want = {}
    for i, g, k, v in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want.setdefault(g, []).append(v)
    got = {}
    for r in sorted(A.ordered_values(df, "v", "id", "k", by=["g"]).collect(), key=lambda r: (str(r.g), r["rank"])):
        got.setdefault(r.g, []).append(r.value)
        assert r["rank"] == len(got[r.g])
    assert got == want
    assert {r.g: r.value for r in A.aggregate(df, "array_agg", "v", by=["g"], seq="id", order_by="k").collect()} == want
    texts = {r.g: r.value for r in A.aggregate(df, "concatenate", "v", by=["g"], seq="id", order_by="k", delimiter="|").collect()}
    assert texts == {g: "|".join(v for v in vs if v is not None) for g, vs in want.items()}
    assert A.aggregate(df, "concatenate", "v", seq="id", delimiter="").first().value == "".join(r[3] for r in rows if r[3])
    assert A.aggregate(df.limit(0), "array_agg", "v", by=["g"], seq="id").count() == 0
    with pytest.raises(ValueError):
        A.aggregate(df, "concatenate", "v", by=["g"])


def test_one_path_over_many_ranges(spark):
    from loamgrid.functions.geometry import RADIUS_MEASURE
    from loamgrid.operators import measure as M

    rng = np.random.default_rng(4)
    n = 400
    xy = np.column_stack([rng.uniform(-10, 10, n), rng.uniform(40, 50, n)])
    rows = [(i, "long", *xy[i].tolist()) for i in range(n)] + [(0, None, 1.0, 1.0), (1, None, 2.0, 1.0), (0, "one", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "seq long, path string, lon double, lat double").repartition(5)
    got = M.measure_path(df, "path", "seq").toPandas()
    legs = np.concatenate([[0.0], [hav(xy[i : i + 1], xy[i + 1 : i + 2])[0, 0] * RADIUS_MEASURE / 6378137.0 for i in range(n - 1)]])
    one = got[got["path"] == "long"].sort_values("seq")
    assert np.allclose(one["leg"], legs) and np.allclose(one["distance"], np.cumsum(legs)) and len(got) == n + 3
    none = got[got["path"].isna()].sort_values("seq")
    assert none["leg"].iloc[0] == 0 and none["distance"].iloc[1] == none["leg"].iloc[1] > 0
    x, y = np.radians(xy).T
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    area = abs(np.sum((x2 - x) * (2 + np.sin(y) + np.sin(y2)))) * RADIUS_MEASURE**2 / 2
    areas = {r.path: (r.points, r.area) for r in M.measure_area(df, "path", "seq").collect()}
    assert areas["long"][0] == n and areas["long"][1] == pytest.approx(area, rel=1e-9) and areas["one"] == (1, 0.0) and areas[None] == (2, 0.0)
    assert M.measure_path(df.limit(0), "path", "seq").count() == 0
