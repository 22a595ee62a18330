"""Queries over geometries and spatial joins (G, J families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.catalog.base import query, rnd, sql_hav, sql_rnd, view
from loamgrid.functions import geometry as G
from loamgrid.operators import aggregates as A
from loamgrid.operators import hull as HU
from loamgrid.operators import joins as J
from loamgrid.operators import measure as M

# Plot outline: (x,y) (x+w,y) (x+w+h,y+h) (x,y+h); hole: the middle third of the box, closed.
OUTER = "(0, x, y), (1, x + w, y), (2, x + w + h, y + h), (3, x, y + h)"
HOLE = "(0, x + w/4e0, y + h/4e0), (1, x + w/2e0, y + h/4e0), (2, x + w/2e0, y + h/2e0), (3, x + w/4e0, y + h/2e0)"


def plot_polygon():
    x, y, w, h = (F.col(c) for c in "xywh")
    v = G.vertex
    outer = F.array(v(x, y), v(x + w, y), v(x + w + h, y + h), v(x, y + h), v(x, y))
    a, b = F.col("w") / 4, F.col("h") / 4
    hole = F.array(v(x + a, y + b), v(x + a * 2, y + b), v(x + a * 2, y + b * 2), v(x + a, y + b * 2), v(x + a, y + b))
    return G.polygon(outer, hole)


def plots(spark, sf):
    return view(spark, sf, "plots").select("id", "x", "y", "w", "h", plot_polygon().alias("geometry"))


def zones(spark, sf):
    z = view(spark, sf, "zones")
    return z.select("id", "name", "grp", G.box("minx", "miny", "maxx", "maxy").alias("geometry"))


def _pts_sql(points: str) -> str:
    rows = [p.strip(" ()").split(",") for p in points.split("), (")]
    return " UNION ALL ".join(f"SELECT id, {i} AS i, {x} AS px, {y} AS py FROM plots" for i, x, y in rows)


def _ring(points: str, tag: str) -> str:
    nxt = lambda c: f"coalesce(lead({c}) OVER s, first_value({c}) OVER s)"
    return f"{tag} AS (SELECT id, i, px, py, {nxt('px')} AS qx, {nxt('py')} AS qy FROM ({_pts_sql(points)}) WINDOW s AS (PARTITION BY id ORDER BY i))"


AREA = "abs(sum(radians(qx-px)*(2e0+sin(radians(py))+sin(radians(qy)))))*6378137e0*6378137e0/2e0"
LEN = f"sum({sql_hav('px', 'py', 'qx', 'qy')})"
SHAPE_SQL = f"""WITH {_ring(OUTER, 'o')}, {_ring(HOLE, 'hl')},
 oa AS (SELECT id, {AREA} AS a, {LEN} AS l FROM o GROUP BY id), ha AS (SELECT id, {AREA} AS a, {LEN} AS l FROM hl GROUP BY id),
 cc AS (SELECT id, sum((px+qx)*(px*qy-qx*py))/(3e0*sum(px*qy-qx*py)) AS cx, sum((py+qy)*(px*qy-qx*py))/(3e0*sum(px*qy-qx*py)) AS cy FROM o GROUP BY id)
"""


@query("g02_g07_shape_measures", f"""{SHAPE_SQL} SELECT oa.id, {sql_rnd('greatest(0e0, oa.a - ha.a)/1e6', 4)} AS km2, {sql_rnd('oa.l + ha.l', 2)} AS length, {sql_rnd('oa.l + ha.l', 2)} AS perimeter,
  {sql_rnd('cx', 5)} AS cx, {sql_rnd('cy', 5)} AS cy FROM oa JOIN ha USING (id) JOIN cc USING (id)""")
def g02(spark, sf):
    p = plots(spark, sf).withColumn("c", G.centroid("geometry"))
    return p.select(
        "id", rnd(G.area("geometry") / 1e6, 4).alias("km2"), rnd(G.length("geometry"), 2).alias("length"), rnd(G.perimeter("geometry"), 2).alias("perimeter"),
        rnd("c.x", 5).alias("cx"), rnd("c.y", 5).alias("cy"),
    )


@query("g03_g07_line_measures", f"""{SHAPE_SQL}, seg AS (SELECT id, i, (px+qx)/2e0 AS mx, (py+qy)/2e0 AS my, {sql_hav('px', 'py', 'qx', 'qy')} AS l FROM o WHERE i < 3)
  SELECT id, {sql_rnd('sum(l)', 3)} AS length, {sql_rnd('sum(mx*l)/sum(l)')} AS cx, {sql_rnd('sum(my*l)/sum(l)')} AS cy, 0e0 AS area FROM seg GROUP BY id""")
def g03(spark, sf):
    p = plots(spark, sf)
    line = G.line(F.slice(F.col("geometry.parts")[0][0], 1, 4))
    p = p.select("id", line.alias("geometry")).withColumn("c", G.centroid("geometry"))
    return p.select("id", rnd(G.length("geometry"), 3).alias("length"), rnd("c.x").alias("cx"), rnd("c.y").alias("cy"), G.area("geometry").alias("area"))


@query("p19_p20_geometry_variables", f"""{SHAPE_SQL} SELECT oa.id, {sql_rnd('(oa.a - ha.a)/1e6', 4)} AS km2, {sql_rnd('oa.l + ha.l', 2)} AS length, {sql_rnd('cx', 5)} AS x, {sql_rnd('cy', 5)} AS y
  FROM oa JOIN ha USING (id) JOIN cc USING (id)""")
def p20(spark, sf):
    v = G.geometry_variables("geometry")
    return plots(spark, sf).select("id", rnd(v["area"] / 1e6, 4).alias("km2"), rnd(v["length"], 2).alias("length"), rnd(v["x"], 5).alias("x"), rnd(v["y"], 5).alias("y"))


@query("g08_bounds", f"SELECT id, {sql_rnd('x')} AS minx, {sql_rnd('y')} AS miny, {sql_rnd('x+w+h')} AS maxx, {sql_rnd('y+h')} AS maxy FROM plots")
def g08(spark, sf):
    p = plots(spark, sf).select("id", G.bbox("geometry").alias("b"))
    return p.select("id", *[rnd(f"b.{k}").alias(k) for k in ("minx", "miny", "maxx", "maxy")])


@query("g12_segments", f"""WITH {_ring(OUTER, 'o')}, {_ring(HOLE, 'hl')} SELECT id, CAST(i AS INTEGER) AS seq, {sql_rnd('px')} AS x1, {sql_rnd('py')} AS y1, {sql_rnd('qx')} AS x2, {sql_rnd('qy')} AS y2 FROM o
  UNION ALL SELECT id, CAST(5 + i AS INTEGER), {sql_rnd('px')}, {sql_rnd('py')}, {sql_rnd('qx')}, {sql_rnd('qy')} FROM hl
  UNION ALL SELECT id, 4, {sql_rnd('x')}, {sql_rnd('y')}, {sql_rnd('x')}, {sql_rnd('y')} FROM plots
  UNION ALL SELECT id, 9, {sql_rnd('x+w/4e0')}, {sql_rnd('y+h/4e0')}, {sql_rnd('x+w/4e0')}, {sql_rnd('y+h/4e0')} FROM plots""")
def g12(spark, sf):
    s = M.explode_segments(plots(spark, sf))
    return s.select("id", "seq", *[rnd(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("g10_g11_point_in_polygon", """SELECT p.id, z.id AS zone FROM pts p JOIN zones z ON p.lon >= z.minx AND p.lon <= z.maxx AND p.lat >= z.miny AND p.lat <= z.maxy""")
def g10(spark, sf):
    z = J.within_join(view(spark, sf, "pts").select("id", "lon", "lat"), zones(spark, sf).select("id", "geometry"))
    return z.select("id", F.col("zone_id").alias("zone"))


# a point is a hull vertex when, seen from it, all other points lie in less than a half turn
HULL_SQL = """WITH p AS (SELECT DISTINCT round((lon - 77e0)*1e4) AS x, round((lat - 8e0)*1e4) AS y FROM pts),
 e AS (SELECT DISTINCT x, y FROM p WHERE (x, y) IN (SELECT (x, max(y)) FROM p GROUP BY x) OR (x, y) IN (SELECT (x, min(y)) FROM p GROUP BY x)),
 t AS (SELECT a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS g FROM e a JOIN e b ON a.x <> b.x OR a.y <> b.y),
 w AS (SELECT x, y, coalesce(lead(g) OVER s, first_value(g) OVER s + 2e0*pi()) - g AS gap FROM t WINDOW s AS (PARTITION BY x, y ORDER BY g))
 SELECT round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y FROM w GROUP BY x, y HAVING max(gap) > pi() + 1e-9"""


@query("g16_convex_hull", HULL_SQL)
def g16(spark, sf):
    grid = [F.round((F.col(c) - o) * 1e4).alias(n) for c, o, n in (("lon", 77, "x"), ("lat", 8, "y"))]
    h = HU.convex_hull(view(spark, sf, "pts").select(*grid))
    return h.select(F.explode("hull").alias("v")).select(rnd("v.x").alias("x"), rnd("v.y").alias("y"))


@query("g17_expanded_ring", """WITH m AS (SELECT *, (x*4e0 + 2e0*w + h)/4e0 AS cx, (y*4e0 + 2e0*h)/4e0 AS cy FROM plots), d AS (SELECT *, sqrt(pow(x-cx,2)+pow(y-cy,2)) AS r FROM m)
  SELECT id, round(cx + (x-cx)*((r+5e-1)/r), 6) + 0e0 AS x0, round(cy + (y-cy)*((r+5e-1)/r), 6) + 0e0 AS y0 FROM d""")
def g17(spark, sf):
    ring = F.slice(F.col("geometry.parts")[0][0], 1, 4)
    p = plots(spark, sf).select("id", G.expand_polygon(ring, 0.5).alias("r"))
    return p.select("id", rnd(F.col("r")[0]["x"]).alias("x0"), rnd(F.col("r")[0]["y"]).alias("y0"))


# Axis-parallel boxes: overlap of closed boxes is the exact intersect test.
BOX_HIT = "b.x <= z.maxx AND b.x + b.w >= z.minx AND b.y <= z.maxy AND b.y + b.h >= z.miny"


def boxes(spark, sf):
    return view(spark, sf, "plots").select("id", G.box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("geometry"))


# The same boxes moved up and right by half the zones' extent, so that some meet no zone.
MOVED = "(SELECT id, x + 5e-1 AS x, y + 5e-1 AS y, w, h FROM plots)"


def moved_boxes(spark, sf):
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    return view(spark, sf, "plots").select("id", G.box(x, y, x + F.col("w"), y + F.col("h")).alias("geometry"))


@query("j01_overlay_intersects", f"""SELECT b.id, EXISTS (SELECT 1 FROM zones z WHERE {BOX_HIT}) AS hit FROM {MOVED} b""")
def j01(spark, sf):
    return J.overlay_intersects(moved_boxes(spark, sf), zones(spark, sf)).select("id", "hit")


@query("j02_semi", f"SELECT b.id FROM {MOVED} b WHERE EXISTS (SELECT 1 FROM zones z WHERE {BOX_HIT})")
def j02(spark, sf):
    return J.intersecting(moved_boxes(spark, sf), zones(spark, sf)).select("id")


@query("j02_anti", f"SELECT b.id FROM {MOVED} b WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE {BOX_HIT})")
def j02_anti(spark, sf):
    return J.intersecting(moved_boxes(spark, sf), zones(spark, sf), keep=False).select("id")


@query("g14_g15_box_relations", f"""SELECT b.id, z.id AS zone, b.x >= z.minx - 1e-12 AND b.x + b.w <= z.maxx + 1e-12 AND b.y >= z.miny - 1e-12 AND b.y + b.h <= z.maxy + 1e-12 AS inside
  FROM plots b JOIN zones z ON {BOX_HIT}""")
def g14(spark, sf):
    b, z = boxes(spark, sf), zones(spark, sf)
    pairs = J.intersect_pairs(b, z)
    full = pairs.join(b.select(F.col("id").alias("left_id"), F.col("geometry").alias("g")), "left_id").join(
        z.select(F.col("id").alias("right_id"), F.col("geometry").alias("k")), "right_id"
    )
    return full.select(F.col("left_id").alias("id"), F.col("right_id").alias("zone"), G.within("g", "k").alias("inside"))


@query("j03_within_counts", """SELECT z.name, count(*) AS n, round(sum(p.value), 4) + 0e0 AS total FROM pts p JOIN zones z ON p.lon >= z.minx AND p.lon <= z.maxx AND p.lat >= z.miny AND p.lat <= z.maxy GROUP BY z.name""")
def j03(spark, sf):
    z = J.within_join(view(spark, sf, "pts"), zones(spark, sf))
    return z.groupBy(F.col("zone_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("g13_segment_crossings", """SELECT p.id, (p.id % 10) < 7 AS crosses FROM pts p""")
def g13(spark, sf):
    # a diagonal from the point against a short horizontal bar that it meets for 7 of 10 ids
    x, y = F.col("lon"), F.col("lat")
    seg = lambda a, b, c, d: F.struct(G.vertex(a, b).alias("s"), G.vertex(c, d).alias("e"))
    start = x + F.when(F.col("id") % 10 < 7, F.lit(0.2)).otherwise(F.lit(0.75))
    return view(spark, sf, "pts").select("id", G.segments_intersect(seg(x, y, x + 1, y + 1), seg(start, y + 0.5, x + 0.9, y + 0.5)).alias("crosses"))


def _near(limit: str) -> str:
    d = sql_hav("p.lon", "p.lat", "f.lon", "f.lat")
    return f"""SELECT p.id, f.id AS fid, f.name, {d} AS d FROM pts p JOIN facilities f ON abs(p.lat - f.lat) <= {limit}/110000e0 AND {d} <= {limit}"""


@query("j05_distance_within", f"SELECT id, fid, {sql_rnd('d', 3)} AS distance FROM ({_near('5000e0')})")
def j05(spark, sf):
    d = J.distance_pairs(view(spark, sf, "pts").select("id", "lon", "lat"), view(spark, sf, "facilities"), 5000.0)
    return d.select(F.col("l_id").alias("id"), F.col("r_id").alias("fid"), rnd("distance", 3).alias("distance"))


@query("j04_nearest_within", f"""SELECT p.id, coalesce(n.fid, -1) AS fid, {sql_rnd('coalesce(n.d, -1e0)', 3)} AS distance FROM pts p LEFT JOIN (
  SELECT id, fid, d, row_number() OVER (PARTITION BY id ORDER BY d, fid) AS k FROM ({_near('5000e0')})) n ON n.id = p.id AND n.k = 1""")
def j04_within(spark, sf):
    n = J.nearest_within(view(spark, sf, "pts").select("id", "lon", "lat"), view(spark, sf, "facilities"), 5000.0)
    return n.select("id", F.coalesce("right_id", F.lit(-1)).alias("fid"), rnd(F.coalesce("distance", F.lit(-1.0)), 3).alias("distance"))


@query("j04_nearest", f"""SELECT id, fid, {sql_rnd('d', 3)} AS distance FROM (SELECT p.id, f.id AS fid, {sql_hav('p.lon', 'p.lat', 'f.lon', 'f.lat')} AS d,
  row_number() OVER (PARTITION BY p.id ORDER BY {sql_hav('p.lon', 'p.lat', 'f.lon', 'f.lat')}, f.id) AS k FROM pts p, facilities f) WHERE k = 1""")
def j04(spark, sf):
    n = J.nearest(view(spark, sf, "pts").select("id", "lon", "lat"), view(spark, sf, "facilities"), start_m=4000.0)
    return n.select("id", F.col("right_id").alias("fid"), rnd("distance", 3).alias("distance"))


@query("j10_zip_by_position", "SELECT f.id, g.category FROM facilities f JOIN (SELECT category, row_number() OVER (ORDER BY id) - 1 AS k FROM gfc) g ON g.k = f.id")
def j10(spark, sf):
    f = view(spark, sf, "facilities").select("id")
    g = view(spark, sf, "gfc").select(F.col("id").alias("gid"), "category")
    return J.zip_by_position(f, g, "id", "gid").select("id", "category")


@query("j09_filtered_scalar_per_row", """SELECT id, n FROM gfc, (SELECT count(*) AS n FROM facilities WHERE radius_m > 1500)""")
def j09_count(spark, sf):
    n = A.layer_scalar(view(spark, sf, "facilities"), "count", "id", F.col("radius_m") > 1500)
    return view(spark, sf, "gfc").select("id", n.alias("n"))
