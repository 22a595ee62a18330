"""Queries over rasters, surfaces, terrain and drainage (S14-S17, A22-A24, R, J06-J08, V, T, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.catalog.base import query, rnd, sql_hav, sql_mercator, sql_rnd, sql_tile_lat, table, view
from loamgrid.operators import grid as GR
from loamgrid.operators import hydrology as H
from loamgrid.operators import polygonize as P
from loamgrid.operators import raster as R
from loamgrid.operators import terrain as T
from loamgrid.operators import viewshed as V
from loamgrid.plans.lattice import with_halo

CELL = 100.0


def dem(spark, sf):
    return view(spark, sf, "dem")


def height_of(spark, sf) -> int:
    """Rows of the elevation raster (100 columns wide); one aggregate row."""
    return dem(spark, sf).agg(F.max("row").alias("h")).first()["h"] + 1


# ----------------------------------------------------------------- R01-R06: grid
MX, MY = sql_mercator("lon", "lat")
SPTS = f"p AS (SELECT id, {MX} AS x, {MY} AS y, value AS v FROM pts WHERE value IS NOT NULL)"


def plan_sql(radius: int, cell: int) -> str:
    return f"""g AS (SELECT x0, y1, {cell}e0 AS s, CAST(greatest(2, ceil(greatest(x1-x0, {cell}e0)/{cell}e0)) AS BIGINT) AS w, CAST(greatest(2, ceil(greatest(y1-y0, {cell}e0)/{cell}e0)) AS BIGINT) AS h
  FROM (SELECT min(x) - {radius}e0 AS x0, max(x) + {radius}e0 AS x1, min(y) - {radius}e0 AS y0, max(y) + {radius}e0 AS y1 FROM p))"""


def scatter_sql(radius: int, cell: int) -> str:
    return f"""{SPTS}, {plan_sql(radius, cell)},
 r AS (SELECT p.*, g.*, unnest(generate_series(CAST(greatest(0, ceil((y1-y-{radius}e0)/s)) AS BIGINT), CAST(least(h-1, floor((y1-y+{radius}e0)/s)) AS BIGINT))) AS rw FROM p, g),
 n AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((x-{radius}e0-x0)/s)) AS BIGINT), CAST(least(w-1, floor((x+{radius}e0-x0)/s)) AS BIGINT))) AS cl FROM r),
 q AS (SELECT *, sqrt(pow(x-(x0+cl*s),2)+pow(y-(y1-rw*s),2)) AS d FROM n), k AS (SELECT * FROM q WHERE d <= {radius})"""


OPT = GR.GridOptions(4000.0, 1000.0, 2, "bbox")


@query("r01_j06_idw", f"""WITH {scatter_sql(4000, 1000)} SELECT rw AS "row", cl AS col, {sql_rnd('sum(v/pow(d,2))/sum(1e0/pow(d,2))', 5)} AS value, count(*) AS neighbor_count
  FROM k WHERE d > 0 GROUP BY rw, cl HAVING count(*) >= 2""")
def r01(spark, sf):
    c = GR.interpolate(GR.samples(view(spark, sf, "pts"), "value"), OPT)
    return c.select("row", "col", rnd("value", 5).alias("value"), "neighbor_count")


@query("r01_gaussian", f"""WITH {scatter_sql(4000, 1000)}, wq AS (SELECT *, exp(-(d*d)/(2e0*pow(4000e0/3e0,2))) AS wt FROM k)
  SELECT rw AS "row", cl AS col, {sql_rnd('sum(v*wt)/sum(wt)', 5)} AS value, count(*) AS neighbor_count FROM wq GROUP BY rw, cl HAVING count(*) >= 2""")
def r01_gaussian(spark, sf):
    c = GR.interpolate(GR.samples(view(spark, sf, "pts"), "value"), OPT, "gaussian")
    return c.select("row", "col", rnd("value", 5).alias("value"), "neighbor_count")


@query("r01_nearest", f"""WITH {scatter_sql(4000, 1000)} SELECT "row", col, v AS value FROM (SELECT rw AS "row", cl AS col, v, count(*) OVER (PARTITION BY rw, cl) AS n,
  row_number() OVER (PARTITION BY rw, cl ORDER BY round(d, 6), id) AS i FROM k) WHERE i = 1 AND n >= 2""")
def r01_nearest(spark, sf):
    s = GR.samples(view(spark, sf, "pts"), "value")
    return GR.interpolate(s, OPT, "nearest").select("row", "col", "value")


# hull-clipped at the default of the toolbox; the clip ring has its own query (g16), so only totals are compared
@query("r01_r04_hull_clipped")
def r01_hull(spark, sf):
    c = GR.interpolate(GR.samples(view(spark, sf, "pts"), "value"), GR.GridOptions(4000.0, 1000.0, 2, "hull"))
    return c.select("row", "col", rnd("value", 5).alias("value"), "neighbor_count")


HEAT_SQL = f"""{scatter_sql(3000, 1000)}, ht AS (SELECT rw, cl, sum(exp(-(d*d)/(2e0*pow(1000e0,2)))) AS v, count(*) AS n FROM k GROUP BY rw, cl)"""
HEAT = GR.GridOptions(3000.0, 1000.0, 1, "bbox")


@query("r02_heatmap", f"""WITH {HEAT_SQL} SELECT rw AS "row", cl AS col, {sql_rnd('v', 5)} AS value FROM ht WHERE v > 0""")
def r02(spark, sf):
    return GR.heatmap(GR.samples(view(spark, sf, "pts")), HEAT).select("row", "col", rnd("value", 5).alias("value"))


@query("r02_weighted_heatmap", f"""WITH {scatter_sql(3000, 1000)} SELECT rw AS "row", cl AS col, {sql_rnd('sum(v*exp(-(d*d)/(2e0*pow(1000e0,2))))', 4)} AS value FROM k GROUP BY rw, cl HAVING sum(v*exp(-(d*d)/(2e0*pow(1000e0,2)))) > 0""")
def r02_weighted(spark, sf):
    return GR.heatmap(GR.samples(view(spark, sf, "pts"), "value"), HEAT).select("row", "col", rnd("value", 4).alias("value"))


@query("r03_grid_plan", f"""WITH {SPTS}, {plan_sql(4000, 1000)} SELECT {sql_rnd('x0', 3)} AS minx, {sql_rnd('y1', 3)} AS maxy, s AS cell, w AS width, h AS height FROM g""")
def r03(spark, sf):
    g = GR.grid_plan(GR.samples(view(spark, sf, "pts"), "value"), OPT)
    return g.select(rnd("minx", 3).alias("minx"), rnd("maxy", 3).alias("maxy"), "cell", "width", "height")


@query("r05_surface_summary", f"""WITH {HEAT_SQL} SELECT {sql_rnd('min(v)', 5)} AS min_value, {sql_rnd('max(v)', 5)} AS max_value, count(*) AS valid_cells, {sql_rnd('avg(n)', 5)} AS mean_neighbors FROM ht WHERE v > 0""")
def r05(spark, sf):
    s = GR.surface_summary(GR.heatmap(GR.samples(view(spark, sf, "pts")), HEAT))
    return s.select(rnd("min_value", 5).alias("min_value"), rnd("max_value", 5).alias("max_value"), "valid_cells", rnd("mean_neighbors", 5).alias("mean_neighbors"))


@query("r06_heat_rescale", f"""WITH {HEAT_SQL} SELECT rw AS "row", cl AS col, {sql_rnd('pow((v - (SELECT min(v) FROM ht))/((SELECT max(v) FROM ht) - (SELECT min(v) FROM ht)), 1e0/12e-1)', 5)} AS ratio FROM ht WHERE v > 0""")
def r06(spark, sf):
    h = GR.heatmap(GR.samples(view(spark, sf, "pts")), HEAT)
    return GR.rescale(h, 1.2).select("row", "col", rnd("ratio", 5).alias("ratio"))


# -------------------------------------------------------- S14-S17: tiles, georef
PIX = """SELECT 12 AS z, CAST(2924 + floor(c/50) AS INTEGER) AS x, CAST(1950 + floor(r/50) AS INTEGER) AS y, CAST(c % 50 AS INTEGER) AS px, CAST(r % 50 AS INTEGER) AS py,
  CAST(131 + v % 3 AS INTEGER) AS r, CAST((v*7) % 256 AS INTEGER) AS g, CAST((v*13) % 256 AS INTEGER) AS b FROM (SELECT CAST(floor(o_orderkey/1e2) AS BIGINT) AS r, o_orderkey % 100 AS c, o_custkey AS v FROM {orders}) AS o"""


def pixels(spark, sf):
    return spark.sql(PIX, orders=table(spark, sf, "orders"))


@query("s14_s15_tile_assembly", f"""WITH pix AS ({PIX.replace('{orders}', 'orders')}) SELECT (y - (SELECT min(y) FROM pix))*256 + py AS "row", (x - (SELECT min(x) FROM pix))*256 + px AS col,
  r*256e0 + g + b/256e0 - 32768e0 AS value FROM pix""")
def s15(spark, sf):
    p = pixels(spark, sf)
    return R.assemble_tiles(p, R.tile_range(p))


@query("s15_tile_extent", f"""WITH pix AS ({PIX.replace('{orders}', 'orders')}), t AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM pix)
  SELECT {sql_rnd('a/4096e0*360e0-180e0')} AS minx, {sql_rnd('(b+1)/4096e0*360e0-180e0')} AS maxx, {sql_rnd(sql_tile_lat('c', 12))} AS maxy, {sql_rnd(sql_tile_lat('d+1', 12))} AS miny,
  {sql_rnd('((b+1)/4096e0*360e0-a/4096e0*360e0)/((b-a+1)*256e0)*111320e0*cos(radians(8e0))', 4)} AS cell_x FROM t""")
def s15_extent(spark, sf):
    t = R.tile_cell_size(R.tile_range(pixels(spark, sf)), 8.0)
    return t.select(*[rnd(c).alias(c) for c in ("minx", "maxx", "maxy", "miny")], rnd("cell_x", 4).alias("cell_x"))


@query("s16_tile_cover", """WITH z AS (SELECT id, lat, lon, radius_m, CAST(greatest(2, least(12, floor(log2(156543e0*cos(radians(lat))/(radius_m/512e0)) + 5e-1))) AS INTEGER) AS z FROM facilities),
 b AS (SELECT *, pow(2e0, z) AS n, radius_m/111320e0 AS dy, radius_m/(111320e0*cos(radians(lat))) AS dx FROM z),
 t AS (SELECT id, z, CAST(floor(n*(lon-dx+180e0)/360e0) AS BIGINT) AS x0, CAST(floor(n*(lon+dx+180e0)/360e0) AS BIGINT) AS x1,
  CAST(floor(n*(5e-1 - ln((1e0+sin(radians(lat+dy)))/(1e0-sin(radians(lat+dy))))/(4e0*pi()))) AS BIGINT) AS y0, CAST(floor(n*(5e-1 - ln((1e0+sin(radians(lat-dy)))/(1e0-sin(radians(lat-dy))))/(4e0*pi()))) AS BIGINT) AS y1 FROM b)
 SELECT id, z, x, unnest(generate_series(y0, y1)) AS y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM t)""")
def s16(spark, sf):
    return R.tile_cover(view(spark, sf, "facilities")).select("id", "z", "x", "y")


META = {"origin_x": 77.0, "origin_y": 9.0, "res_x": 0.01, "res_y": -0.01}


def meta():
    return F.struct(*[F.lit(v).alias(k) for k, v in META.items()])


@query("s17_j07_raster_sampling", """SELECT p.id, floor((p.lat - 9e0)/-1e-2) AS r_, coalesce(d.z, -1e0) AS band1, coalesce(d.z*2e0, -1e0) AS band2 FROM pts p
  LEFT JOIN dem d ON d."row" = CAST(floor((p.lat - 9e0)/-1e-2) AS BIGINT) AND d.col = CAST(floor((p.lon - 77e0)/1e-2) AS BIGINT)""")
def j07(spark, sf):
    d = dem(spark, sf)
    bands = d.select("row", "col", F.lit(1).alias("band"), F.col("z").alias("value")).unionByName(
        d.select("row", "col", F.lit(2).alias("band"), (F.col("z") * 2).alias("value"))
    )
    s = R.sample_at_points(view(spark, sf, "pts"), bands, meta())
    b = lambda i: F.coalesce(F.try_element_at("bands", F.lit(i)), F.lit(-1.0))
    return s.select("id", F.col("row").cast("double").alias("r_"), b(1).alias("band1"), b(2).alias("band2"))


# ------------------------------------------------------------ A22-A24: statistics
@query("a22_band_statistics", """SELECT CAST(1 + col % 3 AS INTEGER) AS band, min(CASE WHEN z <> 990 THEN z END) AS min, max(CASE WHEN z <> 990 THEN z END) AS max, count(CASE WHEN z <> 990 THEN 1 END) AS valid FROM dem GROUP BY 1""")
def a22(spark, sf):
    d = dem(spark, sf).select((1 + F.col("col") % 3).cast("int").alias("band"), F.col("z").alias("value"))
    return R.band_statistics(d, 990)


@query("a23_raster_tone", """SELECT "row", col, CASE WHEN z = 990 THEN 0 ELSE CAST(greatest(0e0, least(255e0, floor((259e0*295e0)/(255e0*219e0)*(least(1e0, greatest(0e0, (z-800e0)/250e0))*255e0 - 128e0) + 138e0 + 5e-1))) AS INTEGER) END AS gray,
  CASE WHEN z = 990 THEN 0 ELSE 217 END AS a FROM dem""")
def a23(spark, sf):
    c = R.raster_color("z", 800.0, 1050.0, nodata=990, brightness=10, contrast=40)
    return dem(spark, sf).select("row", "col", c.alias("c")).select("row", "col", F.col("c.r").alias("gray"), F.col("c.a").alias("a"))


@query("a24_raster_metadata", """SELECT raster_id, 1 AS bands, min(z) AS min, max(z) AS max, 77e0 AS minx, 8e0 AS miny FROM (SELECT 'r' || CAST(floor("row"/50e0) AS BIGINT) AS raster_id, z FROM dem) GROUP BY raster_id""")
def a24(spark, sf):
    d = dem(spark, sf).select(F.concat(F.lit("r"), F.floor(F.col("row") / 50).cast("string")).alias("raster_id"), F.lit(1).alias("band"), F.col("z").alias("value"))
    m = d.select("raster_id").distinct().select(
        "raster_id", F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(77.0).alias("origin_x"), F.lit(9.0).alias("origin_y"),
        F.lit(0.01).alias("res_x"), F.lit(-0.01).alias("res_y"), F.lit(None).cast("double").alias("nodata"),
    )
    return R.raster_metadata(d, m).select("raster_id", "bands", "min", "max", rnd("minx").alias("minx"), rnd("miny").alias("miny"))


# ----------------------------------------------------------------- R07-R12: cells
@query("r07_crop", 'SELECT "row", col, z FROM dem WHERE col >= 10 AND col < 61 AND "row" >= 2 AND "row" < 140')
def r07(spark, sf):
    w = R.pixel_window(10.4, 2.7, 60.2, 139.5, 100, 1500)
    return R.crop(dem(spark, sf), w)


@query("r08_resample_nearest", """WITH t AS (SELECT * FROM (SELECT unnest(generate_series(0, CAST((SELECT floor((max("row")+1)/3e0+5e-1) FROM dem) AS BIGINT) - 1)) AS rr), (SELECT unnest(generate_series(0, 32)) AS cc)),
 h AS (SELECT max("row") + 1 AS n, floor((max("row")+1)/3e0+5e-1) AS m FROM dem)
 SELECT t.rr AS "row", t.cc AS col, d.z FROM t, h JOIN dem d ON true WHERE d."row" = CAST(greatest(0, least(n-1, floor((t.rr+5e-1)*(n/m) - 5e-1 + 5e-1))) AS BIGINT) AND d.col = CAST(greatest(0, least(99, floor((t.cc+5e-1)*(100e0/33e0) - 5e-1 + 5e-1))) AS BIGINT)""")
def r08(spark, sf):
    h = height_of(spark, sf)
    return R.resample_nearest(dem(spark, sf), 100, h, 33, int(h / 3 + 0.5))


BIL = """WITH h AS (SELECT CAST(max("row") + 1 AS DOUBLE) AS n FROM dem), t AS (SELECT rr, cc, rr*5e-1 AS y, cc*4e-1 AS x FROM (SELECT unnest(generate_series(0, CAST((SELECT n*2 FROM h) AS BIGINT) - 1)) AS rr), (SELECT unnest(generate_series(0, 249)) AS cc)),
 c AS (SELECT rr, cc, CAST(least((SELECT n FROM h) - 1, floor(y) + dy) AS BIGINT) AS sr, CAST(least(99, floor(x) + dx) AS BIGINT) AS sc,
  (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END)*(CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM t, (VALUES (0,0),(0,1),(1,0),(1,1)) o(dy, dx))"""


@query("r08_resample_bilinear", f"""{BIL} SELECT c.rr AS "row", c.cc AS col, {sql_rnd('sum(d.z*c.w)', 5)} AS z FROM c JOIN dem d ON d."row" = c.sr AND d.col = c.sc WHERE c.w > 0 GROUP BY 1, 2""")
def r08_bilinear(spark, sf):
    h = height_of(spark, sf)
    b = R.resample_bilinear(dem(spark, sf), 100, h, 250, 2 * h)
    return b.select("row", "col", rnd("z", 5).alias("z"))


@query("r09_radius_mask", f"""SELECT "row", col FROM dem WHERE {sql_hav('775e-1', '89e-1', '77e0 + (col + 5e-1)*1e-2', '9e0 - ("row" + 5e-1)*1e-2', '63710088e-1')} <= 20000e0""")
def r09(spark, sf):
    c = R.coordinate_of("row", "col", meta())
    return R.radius_mask(dem(spark, sf), 77.5, 8.9, 20000.0, c["x"], c["y"]).select("row", "col")


@query("r10_polygon_mask", """WITH z AS (SELECT id, CAST(id % 80 AS DOUBLE) + 25e-2 AS x, CAST((id*7) % 120 AS DOUBLE) + 25e-2 AS y, CAST(2 + id % 9 AS DOUBLE) AS w, CAST(2 + id % 6 AS DOUBLE) AS h FROM gfc)
  SELECT id AS poly, r AS "row", unnest(generate_series(CAST(ceil(x + (r - y)/h*w) AS BIGINT), CAST(floor(x + w + (r - y)/h*w) AS BIGINT))) AS col
  FROM (SELECT *, unnest(generate_series(CAST(floor(y) AS BIGINT) + 1, CAST(floor(y + h) AS BIGINT))) AS r FROM z)""")
def r10(spark, sf):
    g = view(spark, sf, "gfc").select(
        F.col("id").alias("poly"), ((F.col("id") % 80).cast("double") + 0.25).alias("x"), ((F.col("id") * 7 % 120).cast("double") + 0.25).alias("y"),
        (2 + F.col("id") % 9).cast("double").alias("w"), (2 + F.col("id") % 6).cast("double").alias("h"),
    )
    x, y, w, h = (F.col(c) for c in "xywh")
    e = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    edges = g.select("poly", F.inline(F.array(e(x, y, x + w, y), e(x + w, y, x + w + w, y + h), e(x + w + w, y + h, x + w, y + h), e(x + w, y + h, x, y))))
    return R.polygon_mask(edges, 200, 400)


@query("r11_interior", """SELECT "row", col FROM dem WHERE "row" > 0 AND "row" < (SELECT max("row") FROM dem) AND col > 0 AND col < 99""")
def r11(spark, sf):
    return R.interior(dem(spark, sf), 100, height_of(spark, sf)).select("row", "col")


@query("r12_lat_lng_extent", f"""SELECT id, {sql_rnd('minx')} AS west, {sql_rnd('miny')} AS south, {sql_rnd('maxx')} AS east, {sql_rnd('maxy')} AS north FROM zones""")
def r12(spark, sf):
    from loamgrid.functions.crs import to_mercator

    z = view(spark, sf, "zones").select("id", to_mercator("minx", "miny").alias("a"), to_mercator("maxx", "maxy").alias("b"))
    e = z.select("id", F.col("a.x").alias("minx"), F.col("a.y").alias("miny"), F.col("b.x").alias("maxx"), F.col("b.y").alias("maxy"))
    return R.lat_lng_extent(e, "EPSG:3857", ["id"]).select("id", *[rnd(c).alias(c) for c in ("west", "south", "east", "north")])


@query("w12_aoi_circles", """SELECT user_id, round((min(lon)+max(lon))/2e0, 6) + 0e0 AS lon, round((min(lat)+max(lat))/2e0, 6) + 0e0 AS lat,
  CAST(greatest(5000, least(200000, ceil(12e-1*sqrt(pow((max(lat)-min(lat))*55660e0,2) + pow((max(lon)-min(lon))*55660e0*cos(radians((min(lat)+max(lat))/2e0)),2))))) AS BIGINT) AS radius_m FROM pts GROUP BY user_id""")
def w12(spark, sf):
    c = R.aoi_circle(view(spark, sf, "pts"), by=["user_id"])
    return c.select("user_id", rnd("lon").alias("lon"), rnd("lat").alias("lat"), "radius_m")


# ------------------------------------------------------------------- T: terrain
def box_sql(r: int) -> str:
    return f"""b AS (SELECT a."row", a.col, a.z, sum(d.z)/count(d.z) AS s FROM dem a JOIN dem d ON d."row" BETWEEN a."row" - {r} AND a."row" + {r} AND d.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY 1, 2, 3)"""


@query("t01_box_smooth", f"""WITH {box_sql(2)} SELECT "row", col, {sql_rnd('s')} AS smooth FROM b""")
def t01(spark, sf):
    return T.box_smooth(dem(spark, sf), 2).select("row", "col", rnd("smooth").alias("smooth"))


@query("t02_window_extremes", """SELECT a."row", a.col, max(d.z) AS hi, min(d.z) AS lo FROM dem a JOIN dem d ON d."row" BETWEEN a."row" - 4 AND a."row" + 4 AND d.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY 1, 2""")
def t02(spark, sf):
    return T.window_extremes(dem(spark, sf), 4).select("row", "col", F.col("window_max").alias("hi"), F.col("window_min").alias("lo"))


CAND_SQL = f"""{box_sql(1)}, x AS (SELECT a."row", a.col, a.z, a.s, max(d.s) AS hi, min(d.s) AS lo FROM b a JOIN b d ON d."row" BETWEEN a."row" - 4 AND a."row" + 4 AND d.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY 1, 2, 3, 4),
 c AS (SELECT * FROM x WHERE s >= hi - 5e-2 AND lo < s - 5e-2),
 rg AS (SELECT c."row", c.col, c.z, c.s, b.s AS v, row_number() OVER (PARTITION BY c."row", c.col ORDER BY b.s) AS k, count(b.s) OVER (PARTITION BY c."row", c.col) AS n FROM c LEFT JOIN b ON
   b."row" BETWEEN c."row" - 12 AND c."row" + 12 AND b.col BETWEEN c.col - 12 AND c.col + 12 AND b.s < c.s
   AND pow(b."row" - c."row", 2) + pow(b.col - c.col, 2) <= 144 AND pow(b."row" - c."row", 2) + pow(b.col - c.col, 2) > 16)"""


@query("t03_t04_summit_candidates", f"""WITH {CAND_SQL} SELECT "row", col, {sql_rnd('s')} AS smooth, {sql_rnd('coalesce(s - v, 0e0)')} AS relief FROM rg WHERE n = 0 OR k = floor(n*25e-2) + 1""")
def t03(spark, sf):
    stats = T.smoothed_extremes(dem(spark, sf), 1, 4)
    c = T.local_relief(T.summit_candidates(stats), stats, 12)
    return c.select("row", "col", rnd("smooth").alias("smooth"), rnd("relief").alias("relief"))


@query("t05_t07_summits", f"""WITH RECURSIVE {CAND_SQL}, ca AS (SELECT "row", col, z, coalesce(s - v, 0e0) AS relief FROM rg WHERE n = 0 OR k = floor(n*25e-2) + 1),
 od AS (SELECT *, row_number() OVER (ORDER BY relief*1e5 + z DESC, "row", col) AS k FROM ca WHERE relief >= 2),
 nm(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(r BIGINT, c BIGINT)[]) UNION ALL SELECT od.k, CASE WHEN len(list_filter(kept, lambda a: abs(a.r - od."row") <= 4 AND abs(a.c - od.col) <= 4)) > 0 THEN kept
   ELSE list_append(kept, {{'r': od."row", 'c': od.col}}) END FROM nm JOIN od ON od.k = nm.k + 1),
 ac AS (SELECT od.*, CAST(row_number() OVER (ORDER BY od.k) AS INTEGER) AS rank FROM od WHERE list_contains((SELECT kept FROM nm ORDER BY nm.k DESC LIMIT 1), {{'r': od."row", 'c': od.col}}))
 SELECT rank, CASE WHEN relief >= 25 THEN 'peak' ELSE 'hill' END AS kind, floor(z*10e0 + 5e-1)/10e0 AS elevation_m, floor(relief*10e0 + 5e-1)/10e0 AS relief_m,
  CASE WHEN relief >= 25 THEN 'Peak' ELSE 'Hill' END || ' #' || rank || ' (' || CAST(floor(z + 5e-1) AS BIGINT) || ' m)' AS label, "row", col FROM ac""")
def t07(spark, sf):
    return T.summits(dem(spark, sf), search=4, smooth=1, min_relief=2.0, peak_cutoff=25.0)


# ---------------------------------------------------------------- V: visibility
def observers(spark, sf):
    """Supplier sites as observers on the raster, cell size 100 m."""
    h = height_of(spark, sf)
    f = view(spark, sf, "facilities").select(
        F.col("id").alias("observer_id"), (F.col("id") * 613 % h).alias("row"), (F.col("id") * 37 % 100).alias("col"), "radius_m", "height_m",
        F.lit(CELL).alias("cell_x"), F.lit(CELL).alias("cell_y"),
    )
    return f.join(dem(spark, sf).select("row", "col", F.col("z").alias("ground")), ["row", "col"])


VIEW_SQL = """WITH hh AS (SELECT max("row") + 1 AS h FROM dem),
 ob AS (SELECT f.id AS oid, f.id*613 % hh.h AS r0, f.id*37 % 100 AS c0, f.radius_m/1e2 AS reach, d.z + f.height_m AS eye FROM facilities f, hh, dem d WHERE d."row" = f.id*613 % hh.h AND d.col = f.id*37 % 100),
 pe AS (SELECT 2*c + e AS ray, e*(h-1) AS r1, c AS c1 FROM (SELECT unnest(generate_series(0, 99)) AS c), (SELECT unnest([0, 1]) AS e), hh
   UNION ALL SELECT 200 + 2*(r-1) + e, r, e*99 FROM (SELECT unnest(generate_series(1, (SELECT h - 2 FROM hh))) AS r), (SELECT unnest([0, 1]) AS e)),
 ra AS (SELECT ob.*, ray, CASE WHEN r1 > r0 THEN 1 ELSE -1 END AS sr, CASE WHEN c1 > c0 THEN 1 ELSE -1 END AS sc, abs(c1-c0) AS a, abs(r1-r0) AS b FROM ob, pe WHERE r1 <> r0 OR c1 <> c0),
 st AS (SELECT *, unnest(generate_series(1, CAST(floor(reach) AS BIGINT))) AS k, greatest(a, b) AS lg, least(a, b) AS sh FROM ra),
 po AS (SELECT oid, ray, k, eye, reach, sr*(CASE WHEN a >= b THEN k ELSE (2*sh*k + lg - 1)//(2*lg) END) AS dy, sc*(CASE WHEN a >= b THEN (2*sh*k + lg - 1)//(2*lg) ELSE k END) AS dx, r0, c0 FROM st),
 an AS (SELECT oid, ray, k, po.r0 + dy AS r, po.c0 + dx AS c, sqrt(pow(dx*1e2,2) + pow(dy*1e2,2)) AS dist, d.z, eye FROM po JOIN dem d ON d."row" = po.r0 + dy AND d.col = po.c0 + dx WHERE dx*dx + dy*dy <= reach*reach),
 tg AS (SELECT *, (z - dist*dist/(2e0*6371000e0)*87e-2 - eye)/dist AS t, (z + 15e-1 - dist*dist/(2e0*6371000e0)*87e-2 - eye)/dist AS g FROM an),
 vi AS (SELECT oid, ray, r, c, g >= coalesce(max(t) OVER (PARTITION BY oid, ray ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS v FROM tg),
 fi AS (SELECT oid, r, c, arg_max(v, ray) AS v FROM vi GROUP BY 1, 2, 3)
 SELECT oid AS observer_id, r AS "row", c AS col FROM fi WHERE v UNION ALL SELECT oid, r0, c0 FROM ob"""


@query("v01_v02_viewshed", VIEW_SQL)
def v01(spark, sf):
    return V.viewshed(dem(spark, sf), observers(spark, sf), 100, height_of(spark, sf), 1.5, True)


@query("v02_v03_batch_observers", """SELECT id + 1 AS source_index, lon, lat, radius_m, name AS source_label, CASE WHEN radius_m > 2500 THEN 'skipped' ELSE 'ok' END AS status FROM facilities""")
def v02(spark, sf):
    f = view(spark, sf, "facilities").withColumnsRenamed({"id": "seq_no"})
    o = V.batch_observers(f, "seq_no", "radius_m", "height_m", max_radius=2500.0)
    return o.select("source_index", "lon", "lat", "radius_m", "source_label", "status")


@query("v03_located_observers", """SELECT id AS observer_id, CAST(least((SELECT max("row") FROM dem), greatest(0, floor((9e0-lat)/(1e0/((SELECT max("row") FROM dem)+1)) + 5e-1))) AS BIGINT) AS "row",
  CAST(least(99, greatest(0, floor((lon-77e0)/(1e0/100) + 5e-1))) AS BIGINT) AS col, CASE WHEN lat > 8 AND lat <= 9 AND lon >= 77 AND lon < 78 THEN '' ELSE 'outside the raster' END AS note FROM facilities""")
def v03(spark, sf):
    f = view(spark, sf, "facilities").withColumnRenamed("id", "observer_id")
    m = {"minx": 77.0, "miny": 8.0, "maxx": 78.0, "maxy": 9.0, "width": 100, "height": height_of(spark, sf)}
    return V.locate_observers(f, dem(spark, sf), m).select("observer_id", "row", "col", "note")


@query("v05_v07_diffraction")
def v05(spark, sf):
    return V.diffraction(dem(spark, sf), observers(spark, sf), freq_mhz=450.0, n_samples=32, max_edges=V.MAX_EDGES).select("observer_id", "row", "col", rnd("rx_dbm", 4).alias("rx_dbm"))


# every profile in SQL, with the one edge that blocks most
@query("v05_single_edge", """WITH hh AS (SELECT max("row") + 1 AS h FROM dem),
  ob AS (SELECT f.id AS oid, d."row" AS r0, d.col AS c0, f.radius_m/1e2 AS reach, d.z + f.height_m AS eye FROM facilities f, hh, dem d WHERE d."row" = f.id*613 % hh.h AND d.col = f.id*37 % 100),
  ta AS (SELECT oid, r0, c0, eye, d."row" AS r, d.col AS c, d."row" - r0 AS dy, d.col - c0 AS dx FROM ob, dem d WHERE d.z IS NOT NULL AND (reach <= 0 OR sqrt(((d."row"-r0)*(d."row"-r0) + (d.col-c0)*(d.col-c0))::DOUBLE) <= reach)),
  sa AS (SELECT ta.*, s, dy*(s/32e0) AS y, dx*(s/32e0) AS x FROM ta, (SELECT unnest(generate_series(0, 32)) AS s)),
  el AS (SELECT sa.oid, sa.r, sa.c, sa.eye, sa.dy, sa.dx, sa.s, sqrt(sa.x*1e2*sa.x*1e2 + sa.y*1e2*sa.y*1e2) AS d,
      g.z + (sa.x*1e2*sa.x*1e2 + sa.y*1e2*sa.y*1e2)/(2*6371000e0)*0.87e0 AS e
    FROM sa JOIN dem g ON g."row" = CAST(floor(r0 + y + 0.5e0) AS BIGINT) AND g.col = CAST(floor(c0 + x + 0.5e0) AS BIGINT) WHERE g.z IS NOT NULL),
  en AS (SELECT oid, r, c, any_value(eye) AS a, any_value(dy) AS dy, any_value(dx) AS dx, arg_min(d, s) AS d0, arg_max(d, s) AS d1, arg_max(e, s) + 1.5e0 AS b, min(s) AS s0, max(s) AS s1 FROM el GROUP BY 1, 2, 3),
  ed AS (SELECT el.oid, el.r, el.c, el.d - d0 AS da, d1 - el.d AS db, el.e - (a + (el.d - d0)/(d1 - d0)*(b - a)) AS up FROM el JOIN en USING (oid, r, c) WHERE s > s0 AND s < s1 AND d1 > d0),
  mo AS (SELECT oid, r, c, arg_max(up*sqrt(2*(da + db)/((3e8/450e6)*da*db)), up) AS nu FROM ed WHERE up > 0 AND da > 0 AND db > 0 GROUP BY 1, 2, 3),
  lo AS (SELECT oid, r, c, -20*log10(greatest(CASE WHEN nu < 1 THEN 0.5e0*exp(-0.95e0*nu) WHEN nu < 2.4e0 THEN 0.4e0 - sqrt(greatest(0, 0.1184e0 - (0.38e0 - 0.1e0*nu)*(0.38e0 - 0.1e0*nu))) ELSE 0.225e0/nu END, 1e-10)) AS loss FROM mo)
  SELECT oid AS observer_id, r AS "row", c AS col, round(CASE WHEN dy = 0 AND dx = 0 THEN 43e0
    ELSE 43e0 - (20*log10(greatest(sqrt(dx*1e2*dx*1e2 + dy*1e2*dy*1e2), 1)) + 20*log10(450e6) - 20*log10(3e8/(4*pi()))) - coalesce(loss, 0) END, 4) AS rx_dbm
  FROM en LEFT JOIN lo USING (oid, r, c)""")
def v05_single(spark, sf):
    levels = V.diffraction(dem(spark, sf), observers(spark, sf), freq_mhz=450.0, n_samples=32, max_edges=1)
    return levels.select("observer_id", "row", "col", rnd("rx_dbm", 4).alias("rx_dbm"))


# ------------------------------------------------------------------ W: drainage
STEP = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1), 4: (0, -1), 5: (-1, -1), 6: (-1, 0), 7: (-1, 1)}
_LEN = {k: "sqrt(2e4)" if a and b else "1e2" for k, (a, b) in STEP.items()}
FLOW_SQL = f"""fl AS (SELECT "row", col, z, CASE WHEN m > 0 THEN [1, 2, 4, 8, 16, 32, 64, 128][list_position(s, m)] ELSE 0 END AS fd,
  CASE WHEN m > 0 AND m < 'infinity'::DOUBLE THEN "row" + [0, 1, 1, 1, 0, -1, -1, -1][list_position(s, m)] END AS dr, CASE WHEN m > 0 AND m < 'infinity'::DOUBLE THEN col + [1, 1, 0, -1, -1, -1, 0, 1][list_position(s, m)] END AS dc
  FROM (SELECT *, list_max(s) AS m FROM (SELECT d."row", d.col, d.z, [{', '.join(f"coalesce((d.z - n{k}.z)/{_LEN[k]}, 'infinity'::DOUBLE)" for k in STEP)}] AS s FROM dem d
  {' '.join(f'LEFT JOIN dem n{k} ON n{k}."row" = d."row" + ({a}) AND n{k}.col = d.col + ({b})' for k, (a, b) in STEP.items())})))"""


@query("w02_j08_flow_direction", f"""WITH {FLOW_SQL} SELECT "row", col, CAST(fd AS INTEGER) AS fd FROM fl""")
def w02(spark, sf):
    return H.flow_direction(dem(spark, sf), CELL, CELL).select("row", "col", "fd")


WALK_SQL = f"""WITH RECURSIVE {FLOW_SQL}, wk AS (SELECT "row" AS r, col AS c, "row" AS cr, col AS cc FROM fl UNION ALL SELECT wk.r, wk.c, fl.dr, fl.dc FROM wk JOIN fl ON fl."row" = wk.cr AND fl.col = wk.cc WHERE fl.dr IS NOT NULL)"""


@query("w03_flow_accumulation", f"""{WALK_SQL} SELECT cr AS "row", cc AS col, count(*) AS accum FROM wk GROUP BY 1, 2""")
def w03(spark, sf):
    return H.flow_accumulation(H.flow_direction(dem(spark, sf), CELL, CELL)).select("row", "col", "accum")


@query("w04_channels", f"""{WALK_SQL} SELECT cr AS "row", cc AS col, count(*) AS accum FROM wk GROUP BY 1, 2 HAVING count(*) >= 8""")
def w04(spark, sf):
    return H.channels(H.flow_accumulation(H.flow_direction(dem(spark, sf), CELL, CELL)), 8).select("row", "col", "accum")


@query("w06_basins", f"""{WALK_SQL}, po AS (SELECT id, id*613 % (SELECT max("row") + 1 FROM dem) AS pr, id*37 % 100 AS pc FROM facilities),
 pu AS (SELECT pr, pc, min(id) AS pour FROM po GROUP BY 1, 2), ln AS (SELECT r, c, cr, cc, row_number() OVER (PARTITION BY r, c ORDER BY z DESC) AS i FROM wk JOIN dem d ON d."row" = cr AND d.col = cc)
 SELECT r AS "row", c AS col, pour AS pour_id FROM (SELECT ln.r, ln.c, pu.pour, row_number() OVER (PARTITION BY ln.r, ln.c ORDER BY i) AS k FROM ln JOIN pu ON pu.pr = ln.cr AND pu.pc = ln.cc) WHERE k = 1""")
def w06(spark, sf):
    pours = observers(spark, sf).select("row", "col", F.col("observer_id").alias("pour_id"))
    return H.delineate_basins(H.flow_direction(dem(spark, sf), CELL, CELL), pours)


@query("w05_snapped_pour_points", f"""{WALK_SQL}, ac AS (SELECT cr, cc, count(*) AS a FROM wk GROUP BY 1, 2), po AS (SELECT id, id*613 % (SELECT max("row") + 1 FROM dem) AS pr, id*37 % 100 AS pc FROM facilities),
 nr AS (SELECT id, pr, pc, cr, cc, a, greatest(abs(cr-pr), abs(cc-pc)) AS ring FROM po JOIN ac ON cr BETWEEN pr-10 AND pr+10 AND cc BETWEEN pc-10 AND pc+10),
 fr AS (SELECT id, greatest(1, min(ring)) AS f FROM nr WHERE a >= 8 GROUP BY id),
 be AS (SELECT nr.id, cr, cc, row_number() OVER (PARTITION BY nr.id ORDER BY a DESC, ring, cr-pr, cc-pc) AS k FROM nr JOIN fr ON fr.id = nr.id AND ring <= f)
 SELECT po.id AS pour_id, coalesce(be.cr, pr) AS "row", coalesce(be.cc, pc) AS col, be.cr IS NOT NULL AS snapped FROM po LEFT JOIN be ON be.id = po.id AND be.k = 1""")
def w05(spark, sf):
    flow = H.flow_accumulation(H.flow_direction(dem(spark, sf), CELL, CELL))
    pours = observers(spark, sf).select(F.col("observer_id").alias("pour_id"), "row", "col")
    return H.snap_pour_points(pours, flow, 8, 10)


CHANNEL_SQL = f"""{WALK_SQL}, ch AS (SELECT a.cr AS r, a.cc AS c, a.n AS accum, fl.dr, fl.dc FROM (SELECT cr, cc, count(*) AS n FROM wk GROUP BY 1, 2 HAVING count(*) >= 8) a JOIN fl ON fl."row" = a.cr AND fl.col = a.cc),
 lk AS (SELECT a.r, a.c, b.r AS pr, b.c AS pc FROM ch a JOIN ch b ON b.r = a.dr AND b.c = a.dc)"""
STRAHLER_SQL = """od(r, c, o) USING KEY (r, c) AS (SELECT r, c, CAST(1 AS BIGINT) FROM ch
  UNION SELECT p.pr, p.pc, p.new FROM (SELECT g.pr, g.pc, g.cur, g.hi + CASE WHEN g.n > 1 THEN 1 ELSE 0 END AS new FROM (SELECT k.pr, k.pc, own.o AS cur, max(kid.o) AS hi, count(*) FILTER (kid.o = top.m) AS n
   FROM (SELECT DISTINCT lk.pr, lk.pc FROM od JOIN lk ON lk.r = od.r AND lk.c = od.c) k JOIN lk s ON s.pr = k.pr AND s.pc = k.pc JOIN recurring.od kid ON kid.r = s.r AND kid.c = s.c JOIN recurring.od own ON own.r = k.pr AND own.c = k.pc
   JOIN (SELECT l2.pr, l2.pc, max(q.o) AS m FROM lk l2 JOIN recurring.od q ON q.r = l2.r AND q.c = l2.c GROUP BY 1, 2) top ON top.pr = k.pr AND top.pc = k.pc GROUP BY 1, 2, 3) g) p WHERE p.new > p.cur)"""


def raw_channels(spark, sf):
    from loamgrid.session import settle

    return settle(H.channels(H.flow_accumulation(H.flow_direction(dem(spark, sf), CELL, CELL)), 8))


@query("w08_strahler_order", f"""{CHANNEL_SQL}, {STRAHLER_SQL} SELECT r AS "row", c AS col, o AS strahler FROM od""")
def w08_order(spark, sf):
    from loamgrid.plans.lattice import id_col, id_row

    o = H.strahler_order(raw_channels(spark, sf))
    return o.select(id_row().alias("row"), id_col().alias("col"), F.col("strahler").cast("bigint").alias("strahler"))


@query("w09_channel_segments", f"""{CHANNEL_SQL}, st AS (SELECT r, c, accum FROM ch WHERE (SELECT count(*) FROM lk WHERE lk.pr = ch.r AND lk.pc = ch.c) <> 1),
 sg AS (SELECT r AS sr, c AS sc, r, c, CAST(1 AS BIGINT) AS seq FROM st UNION ALL SELECT sg.sr, sg.sc, lk.pr, lk.pc, seq + 1 FROM sg JOIN lk ON lk.r = sg.r AND lk.c = sg.c
   WHERE seq = 1 OR NOT EXISTS (SELECT 1 FROM st WHERE st.r = sg.r AND st.c = sg.c)),
 ln AS (SELECT sr, sc FROM sg GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT sg.sr AS start_row, sg.sc AS start_col, st.accum AS accumulation, seq, sg.r AS "row", sg.c AS col FROM sg JOIN ln USING (sr, sc) JOIN st ON st.r = sg.sr AND st.c = sg.sc""")
def w09(spark, sf):
    from loamgrid.plans.lattice import id_col, id_row

    s = H.channel_segments(raw_channels(spark, sf))
    return s.select(id_row("segment").alias("start_row"), id_col("segment").alias("start_col"), "accumulation", F.col("seq").cast("bigint").alias("seq"), "row", "col")


@query("w09_channel_lines")
def w09_lines(spark, sf):
    at = coordinate("row", "col")
    lines = H.channel_lines(H.channel_segments(raw_channels(spark, sf)), at["x"], at["y"])
    return lines.select("segment", "order", "accumulation", F.size(F.col("geometry.parts")[0][0]).alias("vertices"))


def coordinate(row, col):
    return R.coordinate_of(row, col, meta())


def drained(spark, sf):
    from loamgrid.session import settle

    filled = H.fill_sinks(dem(spark, sf), 0.001, CELL, CELL)
    return settle(H.flow_accumulation(settle(H.flow_direction(filled, CELL, CELL))))


@query("w01_fill_sinks", """WITH RECURSIVE nb AS (SELECT a."row" AS r, a.col AS c, b."row" AS br, b.col AS bc, b.z AS bz, CASE WHEN a."row" <> b."row" AND a.col <> b.col THEN 1e-1*sqrt(2e0) ELSE 1e-1 END AS d
  FROM dem a JOIN dem b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a."row" <> b."row" OR a.col <> b.col)),
 f(r, c, v) USING KEY (r, c) AS (SELECT "row", col, z FROM dem WHERE ("row", col) IN (SELECT (r, c) FROM nb GROUP BY r, c HAVING count(*) < 8)
  UNION SELECT nb.br, nb.bc, min(greatest(nb.bz, f.v + nb.d)) FROM f JOIN nb ON nb.r = f.r AND nb.c = f.c LEFT JOIN recurring.f AS cur ON cur.r = nb.br AND cur.c = nb.bc
  GROUP BY nb.br, nb.bc, cur.v HAVING cur.v IS NULL OR min(greatest(nb.bz, f.v + nb.d)) < cur.v)
 SELECT r AS "row", c AS col, round(v, 6) + 0e0 AS z FROM f""")
def w01(spark, sf):
    return H.fill_sinks(dem(spark, sf), 0.001, CELL, CELL).select("row", "col", rnd("z").alias("z"))


@query("w07_w11_sub_basins")
def w07(spark, sf):
    return H.sub_basins(drained(spark, sf), 20, H.min_basin_cells(CELL, CELL, 0.5))


@query("w08_w09_streams")
def w08(spark, sf):
    return H.channel_segments(H.channels(drained(spark, sf), 20))


@query("w10_v08_basin_rings")
def w10(spark, sf):
    subs = H.sub_basins(drained(spark, sf), 20, 1)
    return P.ring_vertices(subs, "basin_id")


# bands of equal elevation as features: counts and part kinds
@query("w10_region_polygons", """SELECT floor(z/5e1) AS basin_id, count(*) AS cell_count FROM dem GROUP BY 1""")
def w10_polygons(spark, sf):
    bands = dem(spark, sf).select("row", "col", F.floor(F.col("z") / 50).cast("double").alias("band"))
    at = R.coordinate_of("y", "x", meta(), offset=0.0)
    return P.basin_polygons(bands, "band", at["x"], at["y"]).select("basin_id", "cell_count")


# total ring area of an observer equals its number of visible cells
@query("v04_visible_area", VIEW_SQL.replace('SELECT oid AS observer_id, r AS "row", c AS col FROM fi WHERE v UNION ALL SELECT oid, r0, c0 FROM ob',
  'SELECT observer_id, CAST(count(*) AS DOUBLE) AS area FROM (SELECT oid AS observer_id FROM fi WHERE v UNION ALL SELECT oid FROM ob) GROUP BY 1'))
def v04_area(spark, sf):
    h = height_of(spark, sf)
    rings = V.visible_rings(V.viewshed(dem(spark, sf), observers(spark, sf), 100, h, 1.5, True), 100, h)
    areas = P.ring_areas(rings.withColumnRenamed("observer_id", "value"))
    return areas.groupBy(F.col("value").alias("observer_id")).agg(F.sum("area").alias("area"))


@query("v04_viewshed_features")
def v04(spark, sf):
    o = observers(spark, sf)
    h = height_of(spark, sf)
    rings = V.visible_rings(V.viewshed(dem(spark, sf), o, 100, h, 1.5, True), 100, h)
    at = R.coordinate_of("y", "x", meta(), offset=0.0)
    numbered = V.viewshed_parts(rings, at["x"], at["y"])
    c = coordinate("row", "col")
    facts = o.select(
        "observer_id", "radius_m", "height_m", (F.col("observer_id") + 1).alias("source_index"), F.lit(1).alias("source_point_index"),
        F.concat(F.lit("Point "), F.col("observer_id").cast("string")).alias("source_label"), c["x"].alias("lon"), c["y"].alias("lat"), F.lit("ok").alias("status"), F.lit("").alias("note"),
    )
    return V.viewshed_features(numbered, facts).drop("geometry")


@query("v07_level_statistics")
def v07(spark, sf):
    s = V.level_statistics(V.diffraction(dem(spark, sf), observers(spark, sf), freq_mhz=450.0, n_samples=32, max_edges=V.MAX_EDGES), -70.0)
    return s.select("observer_id", rnd("min_dbm", 4).alias("min_dbm"), rnd("max_dbm", 4).alias("max_dbm"), "cells", "usable_cells")


@query("w13_watershed")
def w13(spark, sf):
    out = H.watershed(dem(spark, sf), CELL, CELL, threshold=20, min_slope=0.001, min_area_km2=0.5)
    return out["basins"]


# bands of equal elevation as regions: ring area adds up to the cells of the band
@query("v08_polygon_area", """SELECT floor(z/2e1) AS value, CAST(count(*) AS DOUBLE) AS area FROM dem GROUP BY 1""")
def v08(spark, sf):
    bands = dem(spark, sf).select("row", "col", F.floor(F.col("z") / 20).cast("double").alias("band"))
    return P.ring_areas(P.ring_vertices(bands, "band")).groupBy("value").agg(F.sum("area").alias("area"))


# a lattice point is a corner of a value's rings by which of its four cells hold the value: one or three, or two that only touch
@query("v08_ring_corners", """WITH b AS (SELECT "row" AS r, col AS c, floor(z/2e1) AS value FROM dem),
  p AS (SELECT value, c + dx AS x, r + dy AS y, count(*) AS n, sum((dx + dy) % 2) AS odd
    FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(dy, dx) WHERE value IS NOT NULL GROUP BY 1, 2, 3)
  SELECT value, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(CASE WHEN n = 2 THEN 2 ELSE 1 END AS BIGINT) AS corners
  FROM p WHERE n IN (1, 3) OR (n = 2 AND odd IN (0, 2))""")
def v08_corners(spark, sf):
    bands = dem(spark, sf).select("row", "col", F.floor(F.col("z") / 20).cast("double").alias("band"))
    return P.ring_vertices(bands, "band").filter("seq > 1").groupBy("value", "x", "y").agg(F.count("*").alias("corners"))


# the halo copies every cell to each tile within reach
@query("j08_halo_copies", """SELECT CAST(tr AS BIGINT) AS tr, CAST(tc AS BIGINT) AS tc, count(*) AS cells FROM (SELECT unnest(generate_series(CAST(floor(("row"-2)/64e0) AS BIGINT), CAST(floor(("row"+2)/64e0) AS BIGINT))) AS tr, col FROM dem),
  LATERAL (SELECT unnest(generate_series(CAST(floor((col-2)/64e0) AS BIGINT), CAST(floor((col+2)/64e0) AS BIGINT))) AS tc) GROUP BY 1, 2""")
def j08(spark, sf):
    return with_halo(dem(spark, sf), 2, 64).groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("cells"))


