import math

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import crs as X
from loamgrid.functions import geometry as G
from loamgrid.functions import scalar as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_number_coercion(spark):
    cases = {None: 0.0, "": 0.0, " 5 ": 5.0, "1d": None, "0x10": 16.0, "NaN": None, "abc": None, "true": None, "-2.5": -2.5, "1e3": 1000.0, ".5": 0.5, "Infinity": None, "0b101": 5.0}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", S.js_number("v").alias("n"))
    assert {r["v"]: r["n"] for r in df.collect()} == cases
    assert list(one(spark, S.js_number(F.lit(True)), S.js_number(F.lit(3)), S.js_number(F.lit(None).cast("double"), null_as_zero=False))) == [1.0, 3.0, None]


def test_arithmetic_edges(spark):
    r = one(
        spark, S.divide(F.lit(-1), F.lit(0)), S.divide(F.lit(0), F.lit(0)), S.modulo(F.lit(-5), F.lit(3)), S.round_half_up(F.lit(-2.5)),
        S.round_half_up(F.lit(1250), -2), S.power(S.negate(F.lit(2)), F.lit(2)), S.add(F.lit("x"), F.lit(1)),
    )
    assert r[0] == -math.inf and math.isnan(r[1]) and r[2] == -2.0 and r[3] == -2.0 and r[4] == 1300.0 and r[5] == 4.0 and math.isnan(r[6])


def test_comparison_rules(spark):
    r = one(
        spark, S.compare(F.lit("10"), ">", F.lit(9)), S.compare(F.lit(None).cast("string"), "=", F.lit("")), S.compare(F.lit("b"), ">", F.lit("a")),
        S.compare(F.lit("abc"), "=", F.lit(0)), S.compare(F.lit("abc"), "!=", F.lit("abc")), S.compare(F.lit(5), "<", F.lit("abc")),
    )
    assert list(r) == [True, True, True, False, False, False]


def test_text(spark):
    r = one(spark, S.replace_text(F.lit("abc"), "", "-"), S.replace_text(F.lit("a.b.c"), ".", ""), S.js_string(F.lit(5.0)), S.js_string(F.lit(12345678.5)), S.concat_text(F.lit(None).cast("string"), F.lit(1.0)))
    assert list(r) == ["a-b-c", "abc", "5", "12345678.5", "1"]


@pytest.mark.parametrize("value", [12.8005, 1.97975, 0.05, 925.25, 999.95, 12.8125])
def test_fixed_uses_the_exact_binary_value(spark, value):
    from decimal import ROUND_HALF_UP, Decimal

    for places in (1, 3, 4):
        want = str(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
        assert one(spark, S.to_fixed(F.lit(value), places))[0] == want


def test_crs_round_trips(spark):
    for code in ("EPSG:3857", "EPSG:32643", "32743"):
        p = X.project(F.lit(76.5), F.lit(-12.25), "EPSG:4326", code)
        b = one(spark, X.project(p["x"], p["y"], code, "WGS84"))[0]
        assert b["x"] == pytest.approx(76.5, abs=1e-6) and b["y"] == pytest.approx(-12.25, abs=1e-6)
    with pytest.raises(ValueError):
        X.project(F.lit(1.0), F.lit(1.0), "EPSG:4326", "EPSG:2154")


def square(x0, y0, x1, y1):
    return F.array(*[G.vertex(F.lit(float(a)), F.lit(float(b))) for a, b in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])


def test_polygon_relations(spark):
    ring = G.polygon(square(0, 0, 10, 10), square(4, 4, 6, 6))
    pt = lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    line = lambda *xy: G.line(F.array(*[G.vertex(F.lit(float(a)), F.lit(float(b))) for a, b in xy]))
    inside, hole, edge, hole_edge, out, vertex = (G.within(pt(*p), ring) for p in [(1, 1), (5, 5), (10, 5), (4, 5), (11, 5), (0, 0)])
    r = one(
        spark, inside, hole, edge, hole_edge, out, vertex, G.intersects(ring, line((-1, 5), (11, 5))), G.intersects(line((0, 0), (5, 5)), line((5, 5), (9, 9))),
        G.intersects(ring, line((20, 0), (20, 9))), G.intersects(line((0, 0), (4, 0)), pt(2, 0)), G.within(G.polygon(square(1, 1, 3, 3)), ring), G.intersects(G.polygon(square(10, 0, 12, 2)), ring),
    )
    assert list(r) == [True, False, True, False, False, True, True, True, False, True, True, True]


def test_long_digits_and_positions(spark):
    r = one(spark, S.js_number(F.lit("0x" + "f" * 17)), S.js_number(F.lit("0b1" + "0" * 70)), S.js_number(F.lit("0x" + "f" * 400)))
    assert list(r) == [float(16**17 - 1), 2.0**70, None]
    texts = {"8.5, 77": (8.5, 77.0), "-8 , -77.25": (-8.0, -77.25), "1e1, 2": None, "91, 0": None, "+1, 2": None, "1, 2, 3": None, "1.,2": None, "": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.parse_lat_lng("t").alias("p")).collect()
    assert {r["t"]: r["p"] and tuple(r["p"]) for r in got} == texts


def test_crs_spellings_agree_with_the_argument_form(spark):
    texts = {
        "urn:ogc:def:crs:EPSG:6.9:4326": "EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84": "EPSG:4326", "http://www.opengis.net/def/crs/OGC/1.3/CRS84": "EPSG:4326",
        "https://www.opengis.net/def/crs/EPSG/0/32643": "EPSG:32643", "srid=3857": "EPSG:3857", "epsg 32743": "EPSG:32743", "EPSG4326": "EPSG:4326",
        "WGS 84 (EPSG:4326)": "EPSG:4326", "900913": "EPSG:3857", "WGS 84": "EPSG:4326", "crs:84": "EPSG:4326", "Local grid 7": "LOCAL GRID 7",
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize_crs("t").alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == texts == {t: X.normalize_crs_text(t) for t in texts}


def test_multipoints_and_segments(spark):
    xy = lambda *p: F.array(*[G.vertex(F.lit(float(a)), F.lit(float(b))) for a, b in p])
    dots = lambda *p: G.make_geometry("MultiPoint", F.array(*[F.array(xy(q)) for q in p]))
    seg = lambda a, b, c, d: F.struct(G.vertex(F.lit(float(a)), F.lit(float(b))).alias("s"), G.vertex(F.lit(float(c)), F.lit(float(d))).alias("e"))
    hits = one(
        spark, G.intersects(dots((9, 9), (2, 0)), G.line(xy((0, 0), (4, 0)))), G.intersects(dots((9, 9), (1, 1)), dots((5, 5), (1, 1))), G.intersects(dots((9, 9), (1, 1)), dots((5, 5), (9, 8))),
        *[G.segments_intersect(seg(*a), seg(*b)) for a, b in [
            ((0, 0, 4, 4), (0, 4, 4, 0)), ((0, 0, 4, 0), (4, 0, 6, 3)), ((0, 0, 4, 0), (2, 0, 9, 0)), ((0, 0, 4, 0), (5, 0, 9, 0)), ((0, 0, 4, 0), (0, 1, 4, 1)), ((0, 0, 0, 0), (-1, -1, 1, 1)), ((0, 0, 4, 0), (6, -1, 6, 1)),
        ]],
    )
    assert list(hits) == [True, True, False, True, True, True, False, False, True, False]


def test_measures_against_plain_formulas(spark):
    g = G.box(F.lit(77.0), F.lit(8.0), F.lit(77.2), F.lit(8.2))
    r = one(spark, G.area(g), G.perimeter(g), G.centroid(g), G.area(G.point(F.lit(1.0), F.lit(2.0))))
    rad = math.radians
    want = rad(0.2) * (2 + 2 * math.sin(rad(8.2))) - rad(0.2) * (2 + 2 * math.sin(rad(8.0)))
    assert r[0] == pytest.approx(want * 6378137.0**2 / 2)
    assert r[2]["x"] == pytest.approx(77.1) and r[2]["y"] == pytest.approx(8.1) and r[3] == 0.0
