"""Large single files over many tasks: quoted CSV and JSON documents cut at every kind of place."""

import csv
import io
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamgrid.sources import features as FT
from loamgrid.sources import points as PT
from loamgrid.sources import ranges as R
from loamgrid.sources import writers as W


@pytest.fixture
def split(spark):
    """Files come in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    kept = {n: spark.conf.get(n, None) for n in names}

    def at(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield at
    for n, v in kept.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def n_ranges(spark, path, sep="\n"):
    return R.ranges(spark, path, sep).select("file", "block").distinct().count()


def csv_text(rows, newline):
    out = io.StringIO()
    csv.writer(out, lineterminator=newline).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("newline", "size"), [("\n", 90), ("\r\n", 113), ("\n", 1_000_000), ("\r", 200)])
def test_quoted_breaks_over_ranges(spark, split, tmp_path, newline, size):
    rng = random.Random(size)
    rows = [["Na me", "two\nlines", "v"]]
    for i in range(160):
        rows.append(["".join(rng.choice('ab ",\n\ré') for _ in range(rng.randint(1, 14))) + "x", f"k{i}", "" if i % 5 else "y\n" * 40 + "z"])
    path = tmp_path / "a.csv"
    path.write_bytes(csv_text(rows, newline).encode())
    split(size)
    got = PT.read_delimited(spark, str(path), ",")
    assert got.columns == ["na_me", "two_lines", "v"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows[1:]))
    assert n_ranges(spark, str(path)) > 20 or size > 1000 or newline == "\r"


def test_a_break_at_each_edge(spark, split, tmp_path):
    """One record with breaks inside quotes, in ranges of every size, is one record."""
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"x\n""\n\ny"\n2,z\n')
    for size in range(1, 23, 2):
        split(size)
        assert sorted(map(tuple, PT.read_delimited(spark, str(path), ",").collect())) == [("1", 'x\n"\n\ny'), ("2", "z")]


def test_each_file_has_its_header(spark, split, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'id,"te\nxt"\n{k},"a\nb"\n\n{k}{k},c' + "\n" * k)
    split(8)
    got = PT.read_delimited(spark, str(tmp_path), ",").collect()
    assert sorted(map(tuple, got)) == sorted([x for k in "012" for x in ((k, "a\nb"), (k + k, "c"))])


def test_unmatched_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,lat\n"x,1\ny,2\n')
    with pytest.raises(ValueError, match="unmatched quote"):
        PT.read_delimited(spark, str(tmp_path / "a.csv"), ",")
    (tmp_path / "b.csv").write_text("")
    assert PT.read_delimited(spark, str(tmp_path / "b.csv"), ",").collect() == []


ODD = ['{"a":[1]}', "}", '"', "\\", '\\"}]', '"features":[{', "plain", "é}]{", "\n"]


def made(rng, i):
    shape = rng.choice([
        {"type": "Point", "coordinates": [i, i / 2, 100 + i]},
        {"type": "LineString", "coordinates": [[0, 0, 1, 2], [i, 1, 5, 6]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [i + 1, 0], [1, 1], [0, 0]]]},
        None,
    ])
    return {"type": "Feature", "id": f"f{i}", "properties": {rng.choice(ODD): rng.choice(ODD), "n": i, "features": [{"b": 1}]}, "geometry": shape}


def seen(df):
    rows = df.select("id", "properties.n", F.col("geometry.type").alias("t"), F.flatten(F.flatten("geometry.parts")).alias("v")).collect()
    return sorted((r.id, r.n, r.t, [(v.x, v.y, v.more) for v in r.v] if r.v else None) for r in rows)


def wanted(features):
    out = []
    for f in features:
        g = f["geometry"]
        at = g and {"Point": [g["coordinates"]], "LineString": g["coordinates"], "Polygon": g["coordinates"][0]}[g["type"]]
        out.append((f["id"], str(f["properties"]["n"]), g and g["type"], at and [(float(c[0]), float(c[1]), list(map(float, c[2:])) or None) for c in at]))
    return sorted(out)


@pytest.mark.parametrize("size", [61, 400, 100_000])
@pytest.mark.parametrize("root", ["collection", "members first", "members last", "list", "spaced"])
def test_collections_over_ranges(spark, split, tmp_path, root, size):
    rng = random.Random(size)
    features = [made(rng, i) for i in range(60)]
    other = {"name": "a } b", "meta": [{"features": [1]}, {"x": [[2], {"y": "]"}]}]}
    doc = {
        "collection": {"type": "FeatureCollection", "features": features},
        "members first": {**other, "type": "FeatureCollection", "features": features},
        "members last": {"features": features, "type": "FeatureCollection", **other},
        "list": features,
        "spaced": {"type": "FeatureCollection", "bbox": [[0], [1]], "features": features, "x": []},
    }[root]
    path = tmp_path / "g.json"
    path.write_text("﻿" + json.dumps(doc, ensure_ascii=False, indent=2 if root == "spaced" else None) + "\n" * (size % 2), encoding="utf-8")
    split(size)
    assert seen(FT.read_geojson(spark, str(path))) == wanted(features)
    assert n_ranges(spark, str(path), "}") > 5 or size > 1000


@pytest.mark.parametrize("first", [True, False])
def test_declared_system_over_ranges(spark, split, tmp_path, first):
    crs = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}
    features = [{"type": "Feature", "id": str(i), "properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [8571600.791082066, 893463.751, i]}} for i in range(20)]
    doc = {**(crs if first else {}), "type": "FeatureCollection", "features": features, **({} if first else crs)}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    (tmp_path / "plain.json").write_text(json.dumps({"type": "Feature", "id": "p", "properties": {"n": 99}, "geometry": {"type": "Point", "coordinates": [1, 2]}}))
    split(150)
    rows = {i: v for i, _, _, v in seen(FT.read_geojson(spark, str(tmp_path)))}
    assert len(rows) == 21 and rows["p"] == [(1.0, 2.0, None)]
    assert all(rows[str(i)][0][0] == pytest.approx(77.0, abs=1e-6) and rows[str(i)][0][2] == [float(i)] for i in range(20))


def test_ordinates_and_properties_round_trip(spark, tmp_path):
    rng = random.Random(2)
    features = [f for i in range(30) if (f := made(rng, i))["geometry"]]
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    g = FT.read_geojson(spark, str(path))
    W.write_geojson(g, str(tmp_path / "lines"))
    assert seen(FT.read_geojson(spark, str(tmp_path / "lines"), lines=True)) == wanted(features)
    table = g.select("id", "geometry", F.concat(F.lit("n&"), "id").alias("name"), F.col("properties.n").cast("int").alias("n"), F.lit("a < b").alias("description"))
    W.write_kml(table, str(tmp_path / "kml"))
    back = FT.read_kml(spark, str(tmp_path / "kml")).collect()
    kept = {r.properties["name"][2:]: (r.properties, [(v.x, v.y, v.more) for p in r.geometry.parts for ring in p for v in ring]) for r in back}
    for i, n, _, at in wanted(features):
        properties, vertices = kept[i]
        assert properties == {"name": "n&" + i, "n": n, "description": "a < b"} and {r.id for r in back} == set(kept)
        assert vertices == [(x, y, more and more[:1]) for x, y, more in at]


def test_gpx_elevations(spark, tmp_path):
    (tmp_path / "a.gpx").write_text("""<gpx><wpt lat="8" lon="77"><ele>12.5</ele><name>w</name></wpt><wpt lat="1" lon="2"/>
      <trk><name>t</name><trkseg><trkpt lat="1" lon="2"><ele>3</ele></trkpt><trkpt lat="3" lon="4"/></trkseg></trk></gpx>""")
    rows = FT.read_gpx(spark, str(tmp_path / "a.gpx")).collect()
    found = sorted((r.properties["gpx"], [(v.x, v.y, v.more) for p in r.geometry.parts for ring in p for v in ring]) for r in rows)
    assert found == [("trk", [(2.0, 1.0, [3.0]), (4.0, 3.0, None)]), ("wpt", [(2.0, 1.0, None)]), ("wpt", [(77.0, 8.0, [12.5])])]


def test_reprojection_keeps_further_ordinates(spark):
    from loamgrid.functions import crs as X
    from loamgrid.functions import geometry as G

    g = G.make_geometry("Point", F.array(F.array(F.array(G.vertex(F.lit(77.0), F.lit(8.0), F.array(F.lit(5.0), F.lit(6.0)))))))
    v = spark.range(1).select(X.transform(X.transform(g, "EPSG:4326", "EPSG:32643"), "EPSG:32643", "EPSG:3857").alias("g")).first().g.parts[0][0][0]
    assert v.more == [5.0, 6.0] and v.x == pytest.approx(8571600.79, abs=0.01)
