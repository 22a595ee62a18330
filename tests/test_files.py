import json
import os

import pytest
from pyspark.sql import functions as F

from loamgrid.sources import features as FT
from loamgrid.sources import points as PT
from loamgrid.sources import writers as W
from loamgrid.streaming import ingest as ST


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_points(spark, tmp_path, sep):
    text = "﻿ Name{0}LAT{0}Lng{0}\n\"two\nlines \"\"q\"\"\"{0}8.5N{0}77.25{0}x\n{0}{0}{0}\nblank{0}{0}{0}y\nbad{0}north{0}77{0}z\n".format(sep)
    p = PT.read_points_csv(spark, put(tmp_path, "a.csv", text))
    assert p.columns == ["name", "column_4", "status", "lat", "lon"]
    rows = {r["name"]: (r["status"], r["lat"], r["lon"]) for r in p.collect()}
    assert rows == {'two\nlines "q"': ("point", 8.5, 77.25), "blank": ("skipped", None, None), "bad": ("invalid", None, 77.0)}


def test_combined_column_falls_back(spark, tmp_path):
    path = put(tmp_path, "c.csv", "location,coords\nCity Hall,\"8.42, 77.04\"\nPort,100.5/12.25\n")
    rows = [(r["lat"], r["lon"]) for r in PT.read_points_csv(spark, path).orderBy("location").collect()]
    assert rows == [(8.42, 77.04), (12.25, 100.5)]
    with pytest.raises(ValueError):
        PT.read_points_csv(spark, put(tmp_path, "d.csv", "a,b\n1,2\n"))


FEATURE = {"type": "Feature", "id": 5, "properties": {"n": 1, "s": "t"}, "geometry": {"type": "Point", "coordinates": [77, 8, 30]}}
POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}


@pytest.mark.parametrize(
    "doc,types",
    [
        ({"type": "FeatureCollection", "features": [FEATURE, {"type": "Feature", "properties": None, "geometry": POLYGON}]}, ["Point", "Polygon"]),
        (FEATURE, ["Point"]),
        (POLYGON, ["Polygon"]),
        ([FEATURE, FEATURE], ["Point", "Point"]),
        ({"type": "MultiPolygon", "coordinates": [POLYGON["coordinates"]] * 2}, ["MultiPolygon"]),
    ],
)
def test_geojson_roots(spark, tmp_path, doc, types):
    path = put(tmp_path, "g.json", "﻿" + json.dumps(doc))
    rows = FT.read_geojson(spark, path).collect()
    assert sorted(r["geometry"]["type"] for r in rows) == types
    assert all(r["id"] for r in rows)
    points = [r for r in rows if r["geometry"]["type"] == "Point"]
    assert all(r["properties"] == {"n": "1", "s": "t"} and r["geometry"]["parts"][0][0][0]["x"] == 77.0 for r in points)


def test_geojson_declared_crs(spark, tmp_path):
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [8571600.791082066, 893463.751]}}]}
    v = FT.read_geojson(spark, put(tmp_path, "m.json", json.dumps(doc))).first()["geometry"]["parts"][0][0][0]
    assert v["x"] == pytest.approx(77.0, abs=1e-6) and v["y"] == pytest.approx(8.0, abs=1e-3)


def test_kml_and_gpx(spark, tmp_path):
    kml = """<kml><Document><Placemark><name>p</name><Point><coordinates>77,8,0</coordinates></Point></Placemark>
      <Placemark><name>l</name><LineString><coordinates>0,0 1,1
      2,0</coordinates></LineString></Placemark>
      <Placemark><name>m</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark></Document></kml>"""
    rows = {r["properties"]["name"]: r["geometry"] for r in FT.read_kml(spark, put(tmp_path, "a.kml", kml)).collect()}
    assert {k: g["type"] for k, g in rows.items()} == {"p": "Point", "l": "LineString", "m": "MultiPoint"} and len(rows["l"]["parts"][0][0]) == 3
    gpx = """<gpx><wpt lat="8" lon="77"><name>w</name></wpt><trk><name>t</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg></trk>
      <rte><name>r</name><rtept lat="1" lon="2"/><rtept lat="5" lon="6"/></rte></gpx>"""
    rows = {r["properties"]["gpx"]: r["geometry"]["type"] for r in FT.read_gpx(spark, put(tmp_path, "a.gpx", gpx)).collect()}
    assert rows == {"wpt": "Point", "trk": "LineString", "rte": "LineString"}


def test_feature_lines_are_valid_json(spark, tmp_path):
    path = put(tmp_path, "g.json", json.dumps({"type": "FeatureCollection", "features": [FEATURE, {"type": "Feature", "id": 'q"', "properties": {"a": 'x"y'}, "geometry": None}]}))
    out = [json.loads(r["value"]) for r in W.feature_json(FT.read_geojson(spark, path)).collect()]
    assert {f["id"] for f in out} == {"5", 'q"'} and {json.dumps(f["geometry"]) for f in out} == {'{"type": "Point", "coordinates": [77.0, 8.0, 30.0]}', "null"}


def test_project_round_trip_skips_a_broken_layer(spark, tmp_path):
    d = str(tmp_path / "proj")
    pts = spark.range(5).select("id", F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    W.save_layers(spark, {"My Layer!": pts, "Gone": pts}, d)
    gone = next(n for n in os.listdir(d) if n.startswith("layer-gone"))
    os.rename(f"{d}/{gone}", f"{d}/elsewhere")
    layers, messages = W.load_layers(spark, d)
    assert list(layers) == ["My Layer!"] and layers["My Layer!"].count() == 5 and messages[0].startswith("Gone: skipped")


def test_running_sample_replays(spark, tmp_path):
    k = ST.RunningSample(str(tmp_path / "s"), 7, "id")
    a, b = spark.range(0, 50), spark.range(50, 120)
    k.merge(a, 0)
    k.merge(b, 1)
    k.merge(b, 1)  # a replayed batch overwrites its own version
    from loamgrid.operators.filters import uniform_sample

    want = {r["id"] for r in uniform_sample(spark.range(120), 7, "id").collect()}
    assert {r["id"] for r in k.read(spark, 1).collect()} == want


def test_running_tables_replay(spark, tmp_path):
    """A batch that comes twice counts once, and the state equals one pass over all rows."""
    rows = [(i, 8.0 + i % 5, 77.0 + i % 7, "point" if i % 9 else "skipped", 3600 * (i % 4)) for i in range(90)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    parts = [points.where("id < 30"), points.where("id BETWEEN 30 AND 69"), points.where("id > 69")]
    from loamgrid.operators.aggregates import ingest_statistics

    for name, keeper, whole in (
        ("bins", ST.RunningBins(str(tmp_path / "b"), zoom=9), ST.running_bins(points, zoom=9)),
        ("windows", ST.RunningBins(str(tmp_path / "w"), zoom=9, event_time="ts"), ST.running_bins(points, zoom=9, event_time="ts")),
        ("statistics", ST.RunningStatistics(str(tmp_path / "s")), ingest_statistics(points)),
    ):
        for batch, part in enumerate(parts):
            keeper.merge(part, batch)
            keeper.merge(part, batch)
        keeper.merge(parts[2], 2)
        got = keeper.read(spark, 2)
        shown = [c for c in whole.columns if c in got.columns]
        text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*shown).collect())
        assert text(got) == text(whole) and len(shown) >= 5, name
    assert keeper.read(spark, 0).first()["row_count"] == 30
