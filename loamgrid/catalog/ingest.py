"""Queries that write layers, read them back, and stream them (S, K, ST families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.catalog.base import query, rnd, scratch, sql_rnd, sql_tile_x, sql_tile_y, view
from loamgrid.catalog.shapes import plots, zones
from loamgrid.functions import geometry as G
from loamgrid.functions.crs import to_mercator, to_utm
from loamgrid.operators.aggregates import ingest_statistics
from loamgrid.sources import features as FT
from loamgrid.sources import points as PT
from loamgrid.sources import writers as W
from loamgrid.streaming import ingest as ST


#: Records of one GPX file: a file is read by one task, so a large layer is several of them.
GPX_RECORDS = 50_000


def messy_points(spark, sf):
    t = F.col("event_type")

    def text(c):
        return F.when(t == "error", "").when(t == "signup", "n/a").otherwise(F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("N")))

    return view(spark, sf, "pts").select(
        F.col("id").cast("string").alias(" Id "), text("lat").alias("LATITUDE"), text("lon").alias("Lng"),
        F.concat(F.lit('say "'), t, F.lit('", twice')).alias("Event  Type"),
    )


def written_csv(df, spark, name, sep=","):
    path = scratch(spark, name)
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


STATUS = "CASE event_type WHEN 'error' THEN 'skipped' WHEN 'signup' THEN 'invalid' ELSE 'point' END"


@query("s01_s06_points_csv", f"""SELECT CAST(id AS VARCHAR) AS id, 'say "' || event_type || '", twice' AS event_type, {STATUS} AS status,
  {sql_rnd(f"CASE WHEN {STATUS} = 'point' THEN lat ELSE -1e0 END")} AS lat, {sql_rnd(f"CASE WHEN {STATUS} = 'point' THEN lon ELSE -1e0 END")} AS lon FROM pts""")
def s01(spark, sf):
    path = written_csv(messy_points(spark, sf), spark, "points")
    p = PT.read_points_csv(spark, path, multiline=False)
    return p.select("id", "event_type", "status", *[rnd(F.coalesce(c, F.lit(-1.0))).alias(c) for c in ("lat", "lon")])


@query("s01_quoted_line_breaks", f"""SELECT CAST(id AS VARCHAR) AS id, 'say' || chr(10) || '"' || event_type || '"' || chr(10) || chr(10) || ', twice' AS note, {sql_rnd('lat')} AS lat, {sql_rnd('lon')} AS lon FROM pts""")
def s01_breaks(spark, sf):
    note = F.concat(F.lit('say\n"'), "event_type", F.lit('"\n\n, twice'))
    path = written_csv(view(spark, sf, "pts").select("id", note.alias("Note"), "lat", "lon"), spark, "breaks")
    return PT.read_points_csv(spark, path).filter("status = 'point'").select("id", "note", rnd("lat").alias("lat"), rnd("lon").alias("lon"))


@query("s02_s04_combined_column", f"""SELECT CAST(id AS VARCHAR) AS id, {sql_rnd('lat')} AS lat, {sql_rnd('lon')} AS lon FROM pts""")
def s04(spark, sf):
    p = view(spark, sf, "pts")
    pair = F.when(F.col("event_type") == "click", F.concat_ws(" / ", F.col("lon").cast("string"), F.col("lat").cast("string"))).otherwise(
        F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))
    )
    df = p.select("id", F.lit("somewhere").alias("position"), pair.alias("Location"))
    # both orders occur: a longitude of 77 reads as a latitude too, so keep only pairs that are lat first
    df = df.withColumn("Location", F.when(F.col("Location").startswith("7"), F.concat_ws(" ", F.split("Location", " / ")[1], F.split("Location", " / ")[0])).otherwise(F.col("Location")))
    path = written_csv(df, spark, "combined", ";")
    out = PT.read_points_csv(spark, path, multiline=False)
    return out.filter("status = 'point'").select("id", rnd("lat").alias("lat"), rnd("lon").alias("lon"))


@query("s05_a14_ingest_statistics", f"""SELECT count(*) AS row_count, count(CASE WHEN {STATUS} = 'point' THEN 1 END) AS point_count, count(CASE WHEN {STATUS} = 'skipped' THEN 1 END) AS skipped_rows,
  count(CASE WHEN {STATUS} = 'invalid' THEN 1 END) AS invalid_rows, {sql_rnd(f"min(CASE WHEN {STATUS} = 'point' THEN lon END)")} AS minx, {sql_rnd(f"max(CASE WHEN {STATUS} = 'point' THEN lat END)")} AS maxy FROM pts""")
def s05(spark, sf):
    df = messy_points(spark, sf).toDF(*PT.sanitize_header(messy_points(spark, sf).columns))
    s = ingest_statistics(PT.triage(df, PT.coordinate_columns(df)))
    return s.select("row_count", "point_count", "skipped_rows", "invalid_rows", rnd("minx").alias("minx"), rnd("maxy").alias("maxy"))


@query("s07_k01_geojson_round_trip", f"SELECT CAST(id AS VARCHAR) AS id, 'Polygon' AS type, 2 AS rings, {sql_rnd('x')} AS x, {sql_rnd('y')} AS y, CAST(id * 2 AS VARCHAR) AS twice FROM plots")
def s07(spark, sf):
    path = scratch(spark, "geojson")
    W.write_geojson(plots(spark, sf).select("id", "geometry", (F.col("id") * 2).alias("twice")), path)
    g = FT.read_geojson(spark, path, lines=True)
    v = F.col("geometry.parts")[0][0][0]
    return g.select("id", F.col("geometry.type").alias("type"), F.size(F.col("geometry.parts")[0]).alias("rings"), rnd(v["x"]).alias("x"), rnd(v["y"]).alias("y"), F.col("properties.twice").alias("twice"))


@query("s07_k01_collections", f"""SELECT CAST(id AS VARCHAR) AS id, 'LineString' AS type, {sql_rnd('x')} AS x, {sql_rnd('y')} AS y, CAST(id % 100 AS DOUBLE) AS z, 2 AS more, '{{"[' || id || '"]}}' AS note FROM plots""")
def s07_collections(spark, sf):
    """Each file is one collection, read by byte range; braces in strings, and positions with four ordinates."""
    p = view(spark, sf, "plots")
    at = lambda dx: G.vertex(F.col("x") + dx, "y", F.array((F.col("id") % 100).cast("double"), F.lit(7.0)))
    path = scratch(spark, "collections")
    note = F.concat(F.lit('{"['), F.col("id").cast("string"), F.lit('"]}'))
    W.write_geojson(p.select("id", G.line(F.array(at(F.lit(0.0)), at(F.col("w")))).alias("geometry"), note.alias("note")).coalesce(2), path, collections=True)
    v = F.col("geometry.parts")[0][0][0]
    return FT.read_geojson(spark, path).select("id", F.col("geometry.type").alias("type"), rnd(v["x"]).alias("x"), rnd(v["y"]).alias("y"), v["more"][0].alias("z"), F.size(v["more"]).alias("more"), F.col("properties.note").alias("note"))


@query("s08_k02_kml_properties", f"""SELECT name, CAST(id AS VARCHAR) AS id, 'radius & ' || CAST(CAST(radius_m AS BIGINT) AS VARCHAR) AS radius, {sql_rnd('lon')} AS x, {sql_rnd('lat')} AS y, height_m AS z FROM facilities""")
def s08_properties(spark, sf):
    path = scratch(spark, "kml")
    site = G.make_geometry("Point", F.array(F.array(F.array(G.vertex("lon", "lat", F.array(F.col("height_m")))))))
    radius = F.concat(F.lit("radius & "), F.col("radius_m").cast("bigint").cast("string"))
    W.write_kml(view(spark, sf, "facilities").select("name", "id", radius.alias("radius"), site.alias("geometry")), path)
    v = F.col("geometry.parts")[0][0][0]
    p = F.col("properties")
    return FT.read_kml(spark, path).select(p["name"].alias("name"), "id", p["radius"].alias("radius"), rnd(v["x"]).alias("x"), rnd(v["y"]).alias("y"), v["more"][0].alias("z"))


@query("s08_k02_kml_round_trip", f"SELECT name, 'Polygon' AS type, {sql_rnd('maxx')} AS x, {sql_rnd('miny')} AS y FROM zones UNION ALL SELECT name, 'Point', {sql_rnd('lon')}, {sql_rnd('lat')} FROM facilities")
def s08(spark, sf):
    path = scratch(spark, "kml")
    sites = view(spark, sf, "facilities").select("name", G.point("lon", "lat").alias("geometry"))
    W.write_kml(zones(spark, sf).select("name", "geometry").unionByName(sites), path)
    ring = F.col("geometry.parts")[0][0]
    v = F.when(F.col("geometry.type") == "Polygon", ring[1]).otherwise(ring[0])
    return FT.read_kml(spark, path).select(F.col("properties.name").alias("name"), F.col("geometry.type").alias("type"), rnd(v["x"]).alias("x"), rnd(v["y"]).alias("y"))


@query("s09_gpx_waypoints_and_routes", f"""SELECT name, 'wpt' AS gpx, 1 AS n, {sql_rnd('lon')} AS x, {sql_rnd('lat')} AS y FROM facilities UNION ALL
  SELECT 'plot ' || CAST(id AS VARCHAR), 'rte', 3, {sql_rnd('x')}, {sql_rnd('y')} FROM plots""")
def s09(spark, sf):
    path = scratch(spark, "gpx")
    f = view(spark, sf, "facilities").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "name")
    f.write.format("xml").option("rowTag", "wpt").option("rootTag", "gpx").option("maxRecordsPerFile", GPX_RECORDS).save(f"{path}/w")
    at = lambda dx, dy: F.struct((F.col("y") + dy).alias("_lat"), (F.col("x") + dx).alias("_lon"))
    r = view(spark, sf, "plots").select(
        F.concat(F.lit("plot "), F.col("id").cast("string")).alias("name"), F.array(at(F.lit(0), F.lit(0)), at(F.col("w"), F.lit(0)), at(F.col("w"), F.col("h"))).alias("rtept")
    )
    r.write.format("xml").option("rowTag", "rte").option("rootTag", "gpx").option("maxRecordsPerFile", GPX_RECORDS).save(f"{path}/r")
    g = FT.read_gpx(spark, [f"{path}/w", f"{path}/r"])
    v = G.vertices("geometry")
    return g.select(F.col("properties.name").alias("name"), F.col("properties.gpx").alias("gpx"), F.size(v).alias("n"), rnd(v[0]["x"]).alias("x"), rnd(v[0]["y"]).alias("y"))


@query("s09_gpx_tracks", f"""SELECT 'plot ' || CAST(id AS VARCHAR) AS name, CASE WHEN id % 2 = 0 THEN 'MultiLineString' ELSE 'LineString' END AS type, 2 + 2 * (1 - id % 2) AS n,
  {sql_rnd('x')} AS x, {sql_rnd('y')} AS y, CAST(id % 50 AS DOUBLE) AS z FROM plots""")
def s09_tracks(spark, sf):
    path = scratch(spark, "gpx")
    ele = (F.col("id") % 50).cast("double")
    at = lambda dx, dy: F.struct((F.col("y") + dy).alias("_lat"), (F.col("x") + dx).alias("_lon"), ele.alias("ele"))
    seg = F.struct(F.array(at(F.lit(0), F.lit(0)), at(F.col("w"), F.col("h"))).alias("trkpt"))
    name = F.concat(F.lit("plot "), F.col("id").cast("string"))
    t = view(spark, sf, "plots").select(name.alias("name"), F.when(F.col("id") % 2 == 0, F.array(seg, seg)).otherwise(F.array(seg)).alias("trkseg"))
    t.write.format("xml").option("rowTag", "trk").option("rootTag", "gpx").option("maxRecordsPerFile", GPX_RECORDS).save(path)
    v = G.vertices("geometry")
    g = FT.read_gpx(spark, path).where("properties.gpx = 'trk'")
    return g.select(F.col("properties.name").alias("name"), F.col("geometry.type").alias("type"), F.size(v).cast("bigint").alias("n"), rnd(v[0]["x"]).alias("x"), rnd(v[0]["y"]).alias("y"), v[1]["more"][0].alias("z"))


@query("s10_mixed_layer", "SELECT 'Point' AS type, count(*) AS n FROM pts UNION ALL SELECT 'Polygon', count(*) FROM zones")
def s10(spark, sf):
    path = scratch(spark, "mixed")
    view(spark, sf, "pts").select("id", "lon", "lat").write.option("header", True).csv(f"{path}/a.csv")
    W.write_geojson(zones(spark, sf).select("id", "name", "geometry"), f"{path}/b.geojsonl")
    layer, problems = FT.read_layer(spark, [f"{path}/a.csv", f"{path}/b.geojsonl", f"{path}/missing.kml", f"{path}/odd.xyz"])
    if len(problems) != 2:
        raise RuntimeError(f"expected two unreadable files, got {problems}")
    return layer.groupBy(F.col("geometry.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("s11_declared_crs", f"SELECT id, {sql_rnd('lon', 5)} AS lon, {sql_rnd('lat', 5)} AS lat FROM pts")
def s11(spark, sf):
    p = view(spark, sf, "pts")
    m, u = to_mercator("lon", "lat"), to_utm("lon", "lat", 43, F.lit(False))
    t = F.col("event_type")
    x = F.when(t == "click", m["x"]).when(t == "view", u["x"]).otherwise(F.col("lon"))
    y = F.when(t == "click", m["y"]).when(t == "view", u["y"]).otherwise(F.col("lat"))
    crs = F.when(t == "click", "urn:ogc:def:crs:EPSG::3857").when(t == "view", "EPSG:32643").when(t == "error", "LOCAL:1")
    g = FT.normalize_layer(p.select("id", G.point(x, y).alias("geometry"), crs.alias("crs")))
    a = G.representative_point("geometry")
    return g.select("id", rnd(a["x"], 5).alias("lon"), rnd(a["y"], 5).alias("lat"))


@query("s12_layer_kind", "SELECT 'polygon' AS zones, 'mixed' AS both FROM (SELECT count(*) AS n FROM zones) WHERE n > 0")
def s12(spark, sf):
    z = zones(spark, sf).select("geometry")
    both = z.unionByName(view(spark, sf, "pts").select(G.point("lon", "lat").alias("geometry")))
    return FT.layer_kind(z).select(F.col("kind").alias("zones"), FT.layer_kind(both).scalar().alias("both"))


@query("s13_property_fields", "SELECT DISTINCT unnest(json_keys(props)) AS field, true AS is_numeric FROM events")
def s13(spark, sf):
    from loamgrid.catalog.base import table

    props = table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("properties"))
    return FT.property_fields(props)


@query("s13_numeric_fields", """SELECT * FROM (VALUES ('amount', true), ('category', false), ('id', true), ('zone', true)) t(field, is_numeric) WHERE EXISTS (SELECT 1 FROM gfc)""")
def s13_typed(spark, sf):
    return FT.numeric_fields(view(spark, sf, "gfc"))


@query("f05_geometry_types", "SELECT 'point' AS kind, count(*) AS n FROM facilities UNION ALL SELECT 'polygon', count(*) FROM plots")
def f05(spark, sf):
    from loamgrid.operators.filters import allowed_for_kind, only_types

    both = plots(spark, sf).select("geometry").unionByName(view(spark, sf, "facilities").select(G.point("lon", "lat").alias("geometry")))
    n = F.count(F.lit(1)).alias("n")
    return only_types(both, "Point", "MultiPoint").agg(F.lit("point").alias("kind"), n).unionByName(
        allowed_for_kind(both, "polygon").agg(F.lit("polygon").alias("kind"), n)
    )


@query("k03_saved_layers", "SELECT 'Event points' AS layer, count(*) AS n FROM pts UNION ALL SELECT 'Zones', count(*) FROM zones")
def k03(spark, sf):
    path = scratch(spark, "project")
    W.save_layers(spark, {"Event points": view(spark, sf, "pts").select("id", "lon", "lat"), "Zones": zones(spark, sf)}, path, {"Zones": {"label": "name"}})
    layers, _ = W.load_layers(spark, path)
    parts = [df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n")) for name, df in layers.items()]
    return parts[0].unionByName(parts[1])


# -------------------------------------------------------------------- streaming
def _stream(spark, sf, name):
    """A folder of small files to stream from."""
    path = scratch(spark, name)
    view(spark, sf, "pts").select("id", "lat", "lon", "value", F.col("ts").cast("timestamp").alias("ts")).repartition(4).write.option("header", True).csv(path)
    return ST.stream_points(spark, path, "id long, lat string, lon string, value double, ts timestamp")


def _finish(keeper, points, spark):
    """Run a bounded stream to its end and return the last version of the state."""
    keeper.start(points, scratch(spark, "cp")).awaitTermination()
    return keeper.read(spark, keeper.latest)


@query("st1_stream_triage", "SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, 'point' AS status FROM pts")
def st1(spark, sf):
    path = scratch(spark, "st1-out")
    q = _stream(spark, sf, "st1").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.parquet(path).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "status")


@query("st2_stream_bins", f"SELECT {sql_tile_x('lon', 8)} AS tile_x, {sql_tile_y('lat', 8)} AS tile_y, count(*) AS point_count, {sql_rnd('avg(lat)', 5)} AS sample_lat FROM pts GROUP BY 1, 2")
def st2(spark, sf):
    b = _finish(ST.RunningBins(scratch(spark, "bins")), _stream(spark, sf, "st2"), spark)
    return b.select("tile_x", "tile_y", "point_count", rnd("sample_lat", 5).alias("sample_lat"))


@query("st2_stream_windowed_bins", f"SELECT date_trunc('hour', ts) AS hour, {sql_tile_x('lon', 8)} AS tile_x, {sql_tile_y('lat', 8)} AS tile_y, count(*) AS point_count FROM pts GROUP BY 1, 2, 3")
def st2_windowed(spark, sf):
    b = _finish(ST.RunningBins(scratch(spark, "wbins"), event_time="ts"), _stream(spark, sf, "st2w"), spark)
    return b.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "tile_x", "tile_y", "point_count")


@query("st3_stream_statistics", "SELECT count(*) AS row_count, count(*) AS point_count, round(min(lon), 6) AS minx, round(max(lat), 6) AS maxy FROM pts")
def st3(spark, sf):
    s = _finish(ST.RunningStatistics(scratch(spark, "stats")), _stream(spark, sf, "st3"), spark)
    return s.select("row_count", "point_count", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


@query("st4_stream_sample", "SELECT id, value FROM pts ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 300")
def st4(spark, sf):
    return _finish(ST.RunningSample(scratch(spark, "sample"), 300, "id"), _stream(spark, sf, "st4"), spark).select("id", "value")
