"""GeoJSON, KML and GPX to feature tables."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamgrid.functions.crs import crs_info, from_mercator, from_utm
from loamgrid.functions.geometry import GEOMETRY_TYPE, VERTEX, geometry_kind, let, vertex
from loamgrid.functions.scalar import js_number
from loamgrid.sources.ranges import collection_features

log = logging.getLogger(__name__)

FEATURE = "type string, id string, geometry struct<type string, coordinates string>, properties map<string,string>"
ROOT = (
    f"{FEATURE}, coordinates string, features array<struct<{FEATURE.replace('type string, id', 'type: string, id')}>>, "
    "crs struct<properties struct<name string>>"
)
# Nesting of the coordinate arrays per geometry type.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def parse_coordinates(kind: Column, coordinates: Column) -> Column:
    """Coordinate JSON text -> geometry struct; ordinates after the first two are each vertex's ``more``."""

    def at(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    def v(c):
        return vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.when(F.size(c) > 2, F.slice(c, F.lit(3), F.size(c) - 2)))

    def ring(c):
        return F.transform(c, v)

    shapes = {
        "Point": F.array(F.array(F.array(v(at(1))))),
        "MultiPoint": F.transform(at(2), lambda p: F.array(F.array(v(p)))),
        "LineString": F.array(F.array(ring(at(2)))),
        "MultiLineString": F.transform(at(3), lambda l: F.array(ring(l))),
        "Polygon": F.array(F.transform(at(3), ring)),
        "MultiPolygon": F.transform(at(4), lambda p: F.transform(p, ring)),
    }
    parts = None
    for name, shape in shapes.items():
        parts = F.when(kind == name, shape) if parts is None else parts.when(kind == name, shape)
    return F.when(
        kind.isin(*DEPTH) & coordinates.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts"))
    ).cast(GEOMETRY_TYPE)


def read_geojson(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """``id, geometry, properties map<string,string>`` in longitude/latitude.

    Accepts a FeatureCollection, a Feature, a bare geometry or an array of features per document, of any size: a document
    is read by many tasks (:mod:`loamgrid.sources.ranges`).  ``lines=True`` reads one such document per line instead.
    """
    if lines:
        docs = spark.read.schema(ROOT).json(path)
        items = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type").isNotNull(), F.array(_feature(F.struct("*"))))
        return _features(docs.select(F.col("crs.properties.name").alias("crs"), F.explode(items).alias("f")))
    records, rest = collection_features(spark, path)
    parsed = records.select("file", F.from_json("record", f"{FEATURE}, coordinates string, crs struct<properties: struct<name: string>>").alias("d"))
    parsed = parsed.where("d.type IS NOT NULL")
    # one row for each collection that names its reference system
    named = rest.select("file", F.get_json_object("rest", "$.crs.properties.name").alias("crs")).where("crs IS NOT NULL").collect()
    own = F.col("d.crs.properties.name")
    if not named:
        return _features(parsed.select(own.alias("crs"), _feature(F.col("d")).alias("f")))
    declared = spark.createDataFrame([(r.file, r.crs) for r in named], "file long, declared string")
    return _features(parsed.join(F.broadcast(declared), "file", "left").select(F.coalesce("declared", own).alias("crs"), _feature(F.col("d")).alias("f")))


def _feature(d: Column) -> Column:
    """A feature as it is, a bare geometry as a feature."""
    whole = d["type"] == "Feature"
    return F.struct(
        F.lit("Feature").alias("type"), d["id"].alias("id"),
        F.when(whole, d["geometry"]).otherwise(F.struct(d["type"].alias("type"), d["coordinates"].alias("coordinates"))).alias("geometry"),
        d["properties"].alias("properties"),
    )


def _features(rows: DataFrame) -> DataFrame:
    g = F.col("f.geometry")
    content = F.sha2(F.to_json(F.struct(g.alias("g"), F.col("f.properties").alias("p"))), 256)
    out = rows.select(
        F.coalesce("f.id", content).alias("id"),
        parse_coordinates(g["type"], g["coordinates"]).alias("geometry"),
        F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        "crs",
    )
    return normalize_layer(out)


def normalize_layer(df: DataFrame, crs: str = "crs") -> DataFrame:
    """Bring geometries with a declared CRS column to longitude/latitude; unknown ones are taken as such."""
    info = crs_info(F.col(crs))
    df = df.withColumn("_crs", F.when(F.col(crs).isNotNull(), info))

    def move(v: Column) -> Column:
        moved = (
            F.when(F.col("_crs.kind") == "mercator", from_mercator(v["x"], v["y"]))
            .when(F.col("_crs.kind") == "utm", from_utm(v["x"], v["y"], F.col("_crs.zone"), F.col("_crs.south")))
            .otherwise(v)
        )
        return let(moved, lambda p: vertex(p["x"], p["y"], v["more"]))

    g = F.col("geometry")
    moved = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, move)))
    plain = F.col("_crs").isNull() | F.col("_crs.kind").isin("geographic", "unknown")
    fixed = F.when(plain, g).otherwise(F.struct(g["type"].alias("type"), moved.alias("parts")))
    return df.withColumn("geometry", F.when(g.isNotNull(), fixed)).drop("_crs", crs)


# ---------------------------------------------------------------------- KML/GPX
LINEAR = "struct<coordinates: string>"
POLY = f"struct<outerBoundaryIs: struct<LinearRing: {LINEAR}>, innerBoundaryIs: array<struct<LinearRing: {LINEAR}>>>"
KML = (
    "_id string, name string, description string, "
    f"Point {LINEAR}, LineString {LINEAR}, Polygon {POLY}, "
    f"MultiGeometry struct<Point: array<{LINEAR}>, LineString: array<{LINEAR}>, Polygon: array<{POLY}>>, "
    "ExtendedData struct<Data: array<struct<_name: string, value: string>>>"
)


def _kml_ring(text: Column) -> Column:
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    tuples = F.transform(words, lambda w: F.transform(F.split(w, ","), lambda n: n.try_cast("double")))
    return F.transform(tuples, lambda c: vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.when(F.size(c) > 2, F.slice(c, F.lit(3), F.size(c) - 2))))


def _kml_polygon(p: Column) -> Column:
    outer = F.array(_kml_ring(p["outerBoundaryIs"]["LinearRing"]["coordinates"]))
    inner = F.transform(p["innerBoundaryIs"], lambda h: _kml_ring(h["LinearRing"]["coordinates"]))
    return F.concat(outer, F.coalesce(inner, F.array().cast(f"array<array<{VERTEX}>>")))


def _shape(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts")).cast(GEOMETRY_TYPE)


def read_kml(spark: SparkSession, path) -> DataFrame:
    """Placemarks to features, altitudes as third ordinates; a multigeometry of one kind becomes a multi shape."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(KML).load(path)
    m = F.col("MultiGeometry")
    geometry = (
        F.when(F.col("Point").isNotNull(), _shape("Point", F.array(F.array(_kml_ring(F.col("Point.coordinates"))))))
        .when(F.col("LineString").isNotNull(), _shape("LineString", F.array(F.array(_kml_ring(F.col("LineString.coordinates"))))))
        .when(F.col("Polygon").isNotNull(), _shape("Polygon", F.array(_kml_polygon(F.col("Polygon")))))
        .when(m["Polygon"].isNotNull(), _shape("MultiPolygon", F.transform(m["Polygon"], _kml_polygon)))
        .when(m["LineString"].isNotNull(), _shape("MultiLineString", F.transform(m["LineString"], lambda l: F.array(_kml_ring(l["coordinates"])))))
        .when(m["Point"].isNotNull(), _shape("MultiPoint", F.transform(m["Point"], lambda p: F.array(_kml_ring(p["coordinates"])))))
    )
    extra = F.map_from_entries(
        F.transform(F.coalesce("ExtendedData.Data", F.array().cast("array<struct<_name:string,value:string>>")), lambda d: F.struct(d["_name"], d["value"]))
    )
    base = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description")), lambda k, v: v.isNotNull())
    content = F.sha2(F.to_json(F.struct("*")), 256)
    return raw.select(F.coalesce("_id", content).alias("id"), geometry.alias("geometry"), F.map_concat(base, F.map_filter(extra, lambda k, v: ~k.isin("name", "description"))).alias("properties"))


GPX_POINT = "struct<_lat: double, _lon: double, ele: double>"
GPX = {
    "wpt": "_lat double, _lon double, name string, ele double",
    "trk": f"name string, trkseg array<struct<trkpt: array<{GPX_POINT}>>>",
    "rte": f"name string, rtept array<{GPX_POINT}>",
}


def read_gpx(spark: SparkSession, path) -> DataFrame:
    """Waypoints, tracks and routes to features (property ``gpx`` tells which); elevations are third ordinates."""

    def high(ele: Column) -> Column:
        return F.when(ele.isNotNull(), F.array(ele))

    def vertices(points: Column) -> Column:
        return F.transform(points, lambda p: vertex(p["_lon"], p["_lat"], high(p["ele"])))

    segs = F.transform("trkseg", lambda s: F.array(vertices(s["trkpt"])))
    shape = {
        "wpt": _shape("Point", F.array(F.array(F.array(vertex("_lon", "_lat", high(F.col("ele"))))))),
        "trk": F.when(F.size("trkseg") == 1, _shape("LineString", segs)).otherwise(_shape("MultiLineString", segs)),
        "rte": _shape("LineString", F.array(F.array(vertices(F.col("rtept"))))),
    }
    tables = []
    for tag, schema in GPX.items():
        raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        props = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("gpx"), F.lit(tag)), lambda k, v: v.isNotNull())
        tables.append(raw.select(F.sha2(F.to_json(F.struct("*")), 256).alias("id"), shape[tag].alias("geometry"), props.alias("properties")))
    return reduce(lambda a, b: a.unionByName(b), tables)


# --------------------------------------------------------------------- any layer
def _points_as_features(spark: SparkSession, path) -> DataFrame:
    from loamgrid.functions.geometry import point
    from loamgrid.sources.points import read_points_csv

    df = read_points_csv(spark, path).filter("status = 'point'")
    fields = [c for c in df.columns if c not in ("status", "lat", "lon")]
    pairs = [x for c in fields for x in (F.lit(c), F.col(f"`{c}`"))]
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.sha2(F.to_json(F.struct("*")), 256).alias("id"), point("lon", "lat").alias("geometry"), props.alias("properties"))


READERS = {
    "csv": _points_as_features,
    "tsv": _points_as_features,
    "txt": _points_as_features,
    "geojson": read_geojson,
    "json": read_geojson,
    "geojsonl": lambda s, p: read_geojson(s, p, lines=True),
    "kml": read_kml,
    "gpx": read_gpx,
}


def read_layer(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Read files of mixed formats into one feature table; failures are reported per file."""
    tables, problems = [], {}
    for path in paths:
        reader = READERS.get(path.rsplit(".", 1)[-1].lower())
        if reader is None:
            problems[path] = "unknown format"
            continue
        try:
            df = reader(spark, path).withColumn("source", F.lit(path))
            df.limit(1).take(1)
        except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
            log.warning("cannot read %s: %s", path, error)
            problems[path] = str(error).splitlines()[0]
            continue
        tables.append(df)
    layer = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None
    return layer, problems


def layer_kind(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row ``kind``: the only kind of the layer, mixed, or unknown."""
    kinds = F.collect_set(F.when(geometry_kind(geometry) != "unknown", geometry_kind(geometry)))
    return df.agg(kinds.alias("k")).select(
        F.when(F.size("k") == 0, "unknown").when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise("mixed").alias("kind")
    )


def property_fields(df: DataFrame, properties: str = "properties") -> DataFrame:
    """Sorted names of all properties, and whether each has a numeric value, in one pass."""
    kv = df.select(F.explode(properties).alias("field", "value"))
    number = js_number("value", null_as_zero=False)
    return kv.groupBy("field").agg(F.max(number.isNotNull()).alias("is_numeric")).orderBy("field")


def numeric_fields(df: DataFrame) -> DataFrame:
    """S13 for typed columns: ``field, is_numeric`` from one aggregate over all columns."""
    tests = [
        F.struct(F.lit(c).alias("field"), F.coalesce(F.max(js_number(F.col(f"`{c}`"), null_as_zero=False).isNotNull()), F.lit(False)).alias("is_numeric"))
        for c in sorted(df.columns)
    ]
    return df.agg(F.array(*tests).alias("t")).select(F.inline("t"))


