"""GeoJSON and KML output, and saved projects."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamgrid.functions.scalar import js_string, slug
from loamgrid.session import has_rows

log = logging.getLogger(__name__)

PROJECT_VERSION = 1
INTERNAL_FIELDS = ["__geometryType"]


def ordinates(v: Column) -> Column:
    return F.concat(F.array(v["x"], v["y"]), F.coalesce(v["more"], F.array().cast("array<double>")))


def geometry_json(geometry: str | Column = "geometry") -> Column:
    """Geometry struct -> GeoJSON geometry text."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    parts = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, ordinates)))
    first = F.get(parts, F.lit(0))
    kind = g["type"]
    body = (
        F.when(kind == "Point", F.to_json(F.get(F.get(first, F.lit(0)), F.lit(0))))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: F.get(F.get(p, F.lit(0)), F.lit(0)))))
        .when(kind == "LineString", F.to_json(F.get(first, F.lit(0))))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: F.get(p, F.lit(0)))))
        .when(kind == "Polygon", F.to_json(first))
        .when(kind == "MultiPolygon", F.to_json(parts))
    )
    text = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))
    return F.coalesce(text, F.lit("null"))


def _property_columns(df: DataFrame, geometry: str) -> list[str]:
    return [c for c in df.columns if c not in (geometry, "id", *INTERNAL_FIELDS)]


def feature_json(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature per row as ``value``; internal fields are left out."""
    names = _property_columns(df, geometry)
    if names == ["properties"]:
        props = F.to_json(F.map_filter("properties", lambda k, v: ~k.isin(*INTERNAL_FIELDS)), {"ignoreNullFields": "false"})
    elif names:
        props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    else:
        props = F.lit("{}")
    head = F.lit('{"type":"Feature",')
    if "id" in df.columns:
        listed = F.to_json(F.array(F.col("id").cast("string")))  # a JSON string between brackets
        head = F.concat(head, F.lit('"id":'), F.substring(listed, F.lit(2), F.length(listed) - 2), F.lit(","))
    return df.select(F.concat(head, F.lit('"geometry":'), geometry_json(geometry), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry", collections: bool = False) -> None:
    """One feature per line, written in parallel; with ``collections`` each file is one FeatureCollection."""
    features = feature_json(df, geometry)
    if collections:
        features = features.mapInPandas(_collection, "value string")
    features.write.mode("errorifexists").text(path)


def _collection(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of one file between the head and the end of a collection."""
    comma = ""
    yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[']})
    for batch in batches:
        if len(batch):
            lines = "," + batch["value"]
            lines.iloc[0] = comma + batch["value"].iloc[0]
            comma = ","
            yield lines.to_frame()
    yield pd.DataFrame({"value": ["]}"]})


def write_kml(df: DataFrame, path: str, name: str = "name", geometry: str = "geometry") -> None:
    """Placemarks through the XML writer with their ids; all properties but the name and ``description`` are extended data."""
    g = F.col(geometry)

    def coords(ring):
        return F.array_join(F.transform(ring, lambda v: F.array_join(F.transform(F.slice(ordinates(v), 1, 3), lambda n: n.cast("string")), ",")), " ")

    def ring(r):
        return F.struct(coords(r).alias("coordinates"))

    def shell(p):
        return F.struct(
            F.struct(ring(F.get(p, F.lit(0))).alias("LinearRing")).alias("outerBoundaryIs"),
            F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: F.struct(ring(r).alias("LinearRing"))).alias("innerBoundaryIs"),
        )

    first = F.get(g["parts"], F.lit(0))
    line0 = F.get(first, F.lit(0))
    kind = g["type"]
    if _property_columns(df, geometry) == ["properties"]:
        held = F.col("properties")
    else:
        pairs = [x for c in _property_columns(df, geometry) for x in (F.lit(c), js_string(F.col(f"`{c}`")))]
        held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    held = F.map_filter(held, lambda k, v: v.isNotNull() & ~k.isin(*INTERNAL_FIELDS))
    others = F.transform(F.map_entries(F.map_filter(held, lambda k, v: ~k.isin(name, "description"))), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("value")))
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    out = df.select(
        own.alias("_id"),
        F.try_element_at(held, F.lit(name)).alias("name"),
        F.try_element_at(held, F.lit("description")).alias("description"),
        F.when(F.size(others) > 0, F.struct(others.alias("Data"))).alias("ExtendedData"),
        F.when(kind == "Point", ring(line0)).alias("Point"),
        F.when(kind == "LineString", ring(line0)).alias("LineString"),
        F.when(kind == "Polygon", shell(first)).alias("Polygon"),
        F.when(
            kind.isin("MultiPoint", "MultiLineString", "MultiPolygon"),
            F.struct(
                F.when(kind == "MultiPoint", F.transform(g["parts"], lambda p: ring(F.get(p, F.lit(0))))).alias("Point"),
                F.when(kind == "MultiLineString", F.transform(g["parts"], lambda p: ring(F.get(p, F.lit(0))))).alias("LineString"),
                F.when(kind == "MultiPolygon", F.transform(g["parts"], shell)).alias("Polygon"),
            ),
        ).alias("MultiGeometry"),
    )
    out.write.mode("errorifexists").format("xml").option("rowTag", "Placemark").option("rootTag", "kml").save(path)


def save_layers(spark: SparkSession, layers: dict[str, DataFrame], path: str, configs: dict[str, dict] | None = None) -> DataFrame:
    """One dataset per layer and a manifest ``id, name, kind, fields, file_name, configs, version``."""
    from loamgrid.sources.features import layer_kind

    rows = []
    names = spark.createDataFrame([(n,) for n in layers], "name string")
    info = {r["name"]: r for r in names.select("name", slug("name").alias("slug"), F.substring(F.sha2("name", 256), 1, 8).alias("key")).collect()}
    for name, df in layers.items():
        file_name = f"layer-{info[name]['slug']}-{info[name]['key']}"
        df.write.mode("overwrite").parquet(f"{path}/{file_name}")
        kind = "point"
        if "geometry" in df.columns:
            kind = layer_kind(spark.read.parquet(f"{path}/{file_name}")).first()["kind"]
        rows.append((info[name]["key"], name, kind, [c for c in df.columns if c != "geometry"], file_name, json.dumps((configs or {}).get(name, {})), PROJECT_VERSION))
    manifest = spark.createDataFrame(rows, "id string, name string, kind string, fields array<string>, file_name string, configs string, version int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def load_layers(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Layers by name and messages; an unreadable layer is skipped, another version only warned about."""
    schema = "id string, name string, kind string, fields array<string>, file_name string, configs string, version int"
    layers, messages = {}, []
    for entry in spark.read.schema(schema).json(f"{path}/manifest").collect():  # one row per layer
        if entry["version"] != PROJECT_VERSION:
            messages.append(f"{entry['name']}: saved by version {entry['version']}")
        try:
            df = spark.read.parquet(f"{path}/{entry['file_name']}")
            has_rows(df)
            layers[entry["name"]] = df
        except Exception as error:  # noqa: BLE001
            messages.append(f"{entry['name']}: skipped, {str(error).splitlines()[0]}")
    return layers, messages
