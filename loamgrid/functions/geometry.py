"""Geometry Column functions (G family) over nested-array geometries.

A geometry is ``struct<type, parts: array<array<array<struct<x,y,more>>>>>``:
parts -> rings -> vertices; ``more`` holds a vertex's further ordinates (altitude first), null if it has none.  A point has one part with one ring with one
vertex; a multipoint has one part per point; lines have one ring per part.
All measures are higher-order-function expressions, so no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The earth radii (metres) used by layer measures, the measure tool / line of sight, and the summit mask.
RADIUS_LAYER = 6378137.0
RADIUS_MEASURE = 6371000.0
RADIUS_MASK = 6371008.8
EDGE_TOLERANCE = 1e-9

VERTEX = "struct<x:double,y:double,more:array<double>>"
GEOMETRY_TYPE = f"struct<type:string,parts:array<array<array<{VERTEX}>>>>"
ZERO = 0.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- constructors
def vertex(x, y, more: Column | None = None) -> Column:
    rest = F.lit(None) if more is None else more
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"), rest.cast("array<double>").alias("more"))


def make_geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))


def point(x, y) -> Column:
    return make_geometry("Point", F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    return make_geometry("LineString", F.array(F.array(vertices)))


def polygon(*rings: Column) -> Column:
    return make_geometry("Polygon", F.array(F.array(*rings)))


def box(minx, miny, maxx, maxy) -> Column:
    """Closed counter-clockwise rectangle."""
    a, b, c, d = _col(minx), _col(miny), _col(maxx), _col(maxy)
    return polygon(F.array(vertex(a, b), vertex(c, b), vertex(c, d), vertex(a, d), vertex(a, b)))


# --------------------------------------------------------------------- helpers
def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once: a lambda over a one-element array.

    Without it every mention of a nested value is a copy of its whole expression.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def let2(a: Column, b: Column, fn) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda t: fn(t["a"], t["b"]))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(ZERO), lambda acc, v: acc + v)


def _tail(arr: Column) -> Column:
    return F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0)))


def _rotated(arr: Column) -> Column:
    """Each element's successor, the last one wrapping to the first."""
    return F.concat(_tail(arr), F.slice(arr, 1, 1))


def _pairs(arr: Column) -> Column:
    """Consecutive vertex pairs as array<struct<s,e>>."""
    starts = F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.zip_with(starts, _tail(arr), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def closed(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(F.size(ring) < 2, ring).when(
        (first["x"] == last["x"]) & (first["y"] == last["y"]), ring
    ).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _is(geom: Column, *types: str) -> Column:
    return geom["type"].isin(*types)


# --------------------------------------------------------------------- measures
def haversine(lon1, lat1, lon2, lat2, radius: float = RADIUS_LAYER) -> Column:
    """Great-circle distance; 0 where a coordinate is missing."""
    lon1, lat1, lon2, lat2 = (_col(v) for v in (lon1, lat1, lon2, lat2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    d = F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return F.coalesce(F.nanvl(d, F.lit(ZERO)), F.lit(ZERO))


def _segment_length(s: Column, e: Column, radius: float) -> Column:
    return haversine(s["x"], s["y"], e["x"], e["y"], radius)


def line_length(vertices, radius: float = RADIUS_LAYER) -> Column:
    """Length along an array of vertices."""
    v = _col(vertices)
    return F.coalesce(
        _sum(F.transform(_pairs(v), lambda p: _segment_length(p["s"], p["e"], radius))), F.lit(ZERO)
    )


def ring_area(ring: Column, radius: float = RADIUS_LAYER) -> Column:
    """Signed spherical ring area."""
    terms = F.zip_with(
        ring,
        _rotated(ring),
        lambda a, b: F.radians(b["x"] - a["x"])
        * (F.lit(2.0) + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))),
    )
    return F.when(F.size(ring) < 3, F.lit(ZERO)).otherwise(_sum(terms) * F.lit(radius * radius / 2))


def _part_area(rings: Column, radius: float) -> Column:
    outer = F.abs(ring_area(F.get(rings, F.lit(0)), radius))
    holes = _sum(F.transform(_tail(rings), lambda r: F.abs(ring_area(r, radius))))
    return F.greatest(F.lit(ZERO), outer - holes)


def area(geom, radius: float = RADIUS_LAYER) -> Column:
    """Polygon area, holes removed; 0 for anything else."""
    return let(_col(geom), lambda g: _area(g, radius))


def _area(g: Column, radius: float) -> Column:
    total = _sum(F.transform(g["parts"], lambda p: _part_area(p, radius)))
    return F.coalesce(F.when(_is(g, "Polygon", "MultiPolygon"), total), F.lit(ZERO))


def _ring_sum(g: Column, fn) -> Column:
    return _sum(F.transform(g["parts"], lambda p: _sum(F.transform(p, fn))))


def length(geom, radius: float = RADIUS_LAYER) -> Column:
    """Line length, or the closed perimeter of every ring of a polygon."""
    return let(_col(geom), lambda g: _length(g, radius))


def _length(g: Column, radius: float) -> Column:
    return F.coalesce(
        F.when(_is(g, "LineString", "MultiLineString"), _ring_sum(g, lambda r: line_length(r, radius))).when(
            _is(g, "Polygon", "MultiPolygon"), _ring_sum(g, lambda r: line_length(closed(r), radius))
        ),
        F.lit(ZERO),
    )


def perimeter(geom, radius: float = RADIUS_LAYER) -> Column:
    """Polygons only."""
    return let(_col(geom), lambda g: _perimeter(g, radius))


def _perimeter(g: Column, radius: float) -> Column:
    return F.coalesce(
        F.when(_is(g, "Polygon", "MultiPolygon"), _ring_sum(g, lambda r: line_length(closed(r), radius))),
        F.lit(ZERO),
    )


def representative_point(geom) -> Column:
    """The point, or the first of a multipoint, else null."""
    g = _col(geom)
    first = F.get(F.get(F.get(g["parts"], F.lit(0)), F.lit(0)), F.lit(0))
    return F.when(_is(g, "Point", "MultiPoint"), first)


def _mean_vertex(vertices: Column) -> Column:
    def mean(ok: Column) -> Column:
        n = F.size(ok)
        return F.when(
            n > 0,
            vertex(
                _sum(F.transform(ok, lambda v: v["x"])) / n,
                _sum(F.transform(ok, lambda v: v["y"])) / n,
            ),
        )

    return let(F.filter(vertices, lambda v: v["x"].isNotNull() & v["y"].isNotNull()), mean)


def _weighted(items: Column) -> Column:
    """Weighted mean of array<struct<x,y,w>>; the first item when all weights are 0."""
    return let(items, _weighted_mean)


def _weighted_mean(items: Column) -> Column:
    w = _sum(F.transform(items, lambda i: i["w"]))
    first = F.get(items, F.lit(0))
    return F.when(
        F.size(items) > 0,
        F.when(w == 0, vertex(first["x"], first["y"])).otherwise(
            vertex(
                F.try_divide(_sum(F.transform(items, lambda i: i["x"] * i["w"])), w),
                F.try_divide(_sum(F.transform(items, lambda i: i["y"] * i["w"])), w),
            )
        ),
    )


def _triple(x: Column, y: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"))


def _line_centroid(vertices: Column) -> Column:
    return let(vertices, _line_mean)


def _line_mean(vertices: Column) -> Column:
    mids = F.transform(
        _pairs(vertices),
        lambda p: _triple(
            (p["s"]["x"] + p["e"]["x"]) / 2,
            (p["s"]["y"] + p["e"]["y"]) / 2,
            _segment_length(p["s"], p["e"], RADIUS_LAYER),
        ),
    )
    return let(
        mids,
        lambda m: F.when(_sum(F.transform(m, lambda i: i["w"])) > 0, _weighted(m)).otherwise(F.get(vertices, F.lit(0))),
    )


def _polygon_centroid(rings: Column) -> Column:
    return let(F.get(rings, F.lit(0)), _ring_centroid)


def _ring_centroid(ring: Column) -> Column:
    terms = F.zip_with(
        ring,
        _rotated(ring),
        lambda a, b: _triple(a["x"] + b["x"], a["y"] + b["y"], a["x"] * b["y"] - b["x"] * a["y"]),
    )
    return let(terms, lambda t: _planar_centroid(ring, t))


def _planar_centroid(ring: Column, terms: Column) -> Column:
    area2 = _sum(F.transform(terms, lambda t: t["w"]))
    planar = vertex(
        F.try_divide(_sum(F.transform(terms, lambda t: t["x"] * t["w"])), area2 * 3),
        F.try_divide(_sum(F.transform(terms, lambda t: t["y"] * t["w"])), area2 * 3),
    )
    return F.when((F.size(ring) < 3) | (area2 == 0), _mean_vertex(ring)).otherwise(planar)


def _with_weight(c: Column, w: Column) -> Column:
    return F.when(c.isNotNull(), _triple(c["x"], c["y"], w))


def centroid(geom) -> Column:
    """Centroid by geometry type (see SURVEY G07)."""
    return let(_col(geom), _centroid)


def _centroid(g: Column) -> Column:
    parts = g["parts"]
    all_first = F.flatten(F.flatten(parts))
    lines = F.filter(
        F.transform(
            parts,
            lambda p: _with_weight(_line_centroid(F.get(p, F.lit(0))), line_length(F.get(p, F.lit(0)))),
        ),
        lambda i: i.isNotNull(),
    )
    polys = F.filter(
        F.transform(parts, lambda p: _with_weight(_polygon_centroid(p), _part_area(p, RADIUS_LAYER))),
        lambda i: i.isNotNull(),
    )
    return (
        F.when(_is(g, "Point"), representative_point(g))
        .when(_is(g, "MultiPoint"), _mean_vertex(all_first))
        .when(_is(g, "LineString"), _line_centroid(F.get(F.get(parts, F.lit(0)), F.lit(0))))
        .when(_is(g, "MultiLineString"), _weighted(lines))
        .when(_is(g, "Polygon"), _polygon_centroid(F.get(parts, F.lit(0))))
        .when(_is(g, "MultiPolygon"), _weighted(polys))
    )


def anchor(geom) -> Column:
    """Point coordinate if there is one, else the centroid ($x/$y and nearest-neighbour origin)."""
    return let(_col(geom), lambda g: F.coalesce(representative_point(g), _centroid(g)))


def geometry_variables(geom) -> dict[str, Column]:
    """P20: the ``$area $length $x $y`` variables of a feature."""
    a = anchor(geom)
    return {"area": area(geom), "length": length(geom), "x": a["x"], "y": a["y"]}


# ------------------------------------------------------------------ predicates
def bbox(geom) -> Column:
    """Bounds over all vertices."""
    return let(F.flatten(F.flatten(_col(geom)["parts"])), _bounds)


def _bounds(v: Column) -> Column:
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.when(
        F.size(v) > 0,
        F.struct(
            F.array_min(xs).alias("minx"),
            F.array_min(ys).alias("miny"),
            F.array_max(xs).alias("maxx"),
            F.array_max(ys).alias("maxy"),
        ),
    )


def bbox_intersects(a, b) -> Column:
    """Touching counts; false if either is missing."""
    a, b = _col(a), _col(b)
    hit = ~(
        (a["maxx"] < b["minx"]) | (a["minx"] > b["maxx"]) | (a["maxy"] < b["miny"]) | (a["miny"] > b["maxy"])
    )
    return F.coalesce(hit, F.lit(False))


def point_on_segment(px, py, sx, sy, ex, ey) -> Column:
    """The area spanned with the ends is at most 1e-9, and the point lies between them along the longer axis.

    A segment without length (the closing edge of a closed ring) holds only its own point.
    """
    area2 = (ex - sx) * (py - sy) - (px - sx) * (ey - sy)
    wide = F.abs(ex - sx) >= F.abs(ey - sy)
    between = F.when(wide, px.between(F.least(sx, ex), F.greatest(sx, ex))).otherwise(py.between(F.least(sy, ey), F.greatest(sy, ey)))
    return (F.abs(area2) <= EDGE_TOLERANCE) & between & ((sx != ex) | (sy != ey) | (py == sy))


def point_in_ring(px, py, ring) -> Column:
    """Even-odd test; a point on the boundary is inside."""
    px, py, ring = _col(px), _col(py), _col(ring)
    on_edge = F.zip_with(ring, _rotated(ring), lambda a, b: point_on_segment(px, py, a["x"], a["y"], b["x"], b["y"]))
    return F.coalesce(F.exists(on_edge, lambda hit: hit) | (_winding(px, py, ring) % 2 != 0), F.lit(False))


def _winding(px: Column, py: Column, ring: Column) -> Column:
    """Edges met by the ray from the point to the right: those going up less those going down.

    Its parity is the even-odd answer.  Which side of an edge the point lies on is the sign of an area.
    """

    def met(a, b):
        area2 = (b["x"] - a["x"]) * (py - a["y"]) - (px - a["x"]) * (b["y"] - a["y"])
        up = (a["y"] <= py) & (py < b["y"]) & (area2 > 0)
        down = (b["y"] <= py) & (py < a["y"]) & (area2 < 0)
        return F.when(up, 1).when(down, -1).otherwise(0)

    return F.aggregate(F.zip_with(ring, _rotated(ring), met), F.lit(0), lambda total, v: total + v)


def point_in_polygon(px, py, geom) -> Column:
    """Any part whose outer ring holds the point and none of whose holes does."""
    px, py, g = _col(px), _col(py), _col(geom)
    def in_part(rings):
        held = F.transform(rings, lambda r: point_in_ring(px, py, r))
        # the outer ring and no other: the list of answers starts with true and holds no second one
        return let(held, lambda f: F.coalesce(F.get(f, F.lit(0)), F.lit(False)) & (F.size(F.filter(f, lambda x: x)) == 1))

    hit = F.exists(g["parts"], in_part)
    return F.coalesce(_is(g, "Polygon", "MultiPolygon") & hit, F.lit(False))


def vertices(geom) -> Column:
    return F.flatten(F.flatten(_col(geom)["parts"]))


def segments(geom) -> Column:
    """Array of segments; polygon rings are closed."""
    g = _col(geom)
    rings = F.flatten(g["parts"])
    open_ = F.flatten(F.transform(rings, _pairs))

    def loop(r):
        back = F.array(F.struct(F.element_at(r, -1).alias("s"), F.get(r, F.lit(0)).alias("e")))
        return F.when(F.size(r) > 2, F.concat(_pairs(r), back)).otherwise(_pairs(r))

    shut = F.flatten(F.transform(rings, loop))
    return F.when(_is(g, "LineString", "MultiLineString"), open_).when(
        _is(g, "Polygon", "MultiPolygon"), shut
    ).otherwise(F.slice(open_, 1, 0))


def _straddle(line_: Column, ends: Column) -> Column:
    """Product of the signed areas that the line spans with the two ends: negative when it parts them, 0 when it meets one."""

    def area2(p):
        s, e = line_["s"], line_["e"]
        v = (e["x"] - s["x"]) * (p["y"] - s["y"]) - (p["x"] - s["x"]) * (e["y"] - s["y"])
        return F.when(F.abs(v) >= EDGE_TOLERANCE, v).otherwise(F.lit(ZERO))

    return area2(ends["s"]) * area2(ends["e"])


def segments_intersect(s1, s2) -> Column:
    """Each straddles the other's line, and their extents overlap (which decides between segments of one line)."""
    s1, s2 = _col(s1), _col(s2)

    def overlap(axis):
        a, b, c, d = s1["s"][axis], s1["e"][axis], s2["s"][axis], s2["e"][axis]
        return (F.greatest(a, b) >= F.least(c, d)) & (F.greatest(c, d) >= F.least(a, b))

    return overlap("x") & overlap("y") & (_straddle(s1, s2) <= 0) & (_straddle(s2, s1) <= 0)


def _proper_crossing(s1: Column, s2: Column) -> Column:
    """True where two segments cross at an inner point of both."""
    return (_straddle(s1, s2) < 0) & (_straddle(s2, s1) < 0)


def contains(outer, inner) -> Column:
    """Every vertex of ``inner`` lies in ``outer`` and no edge crosses out of it."""
    return let2(_col(outer), _col(inner), _contains)


def _contains(o: Column, i: Column) -> Column:
    op, ip = representative_point(o), representative_point(i)
    inside = F.forall(vertices(i), lambda v: point_in_polygon(v["x"], v["y"], o))
    cut = F.exists(segments(i), lambda a: F.exists(segments(o), lambda b: _proper_crossing(a, b)))
    same = (op["x"] == ip["x"]) & (op["y"] == ip["y"])
    return F.coalesce(
        F.when(_is(o, "Point"), same).when(
            _is(o, "Polygon", "MultiPolygon") & (F.size(vertices(i)) > 0),
            inside & F.when(_is(i, "Point", "MultiPoint"), F.lit(True)).otherwise(~cut),
        ),
        F.lit(False),
    )


def within(a, b) -> Column:
    return contains(b, a)


def intersects(a, b) -> Column:
    """Bounds first, then containment either way, then any touching segment pair."""
    return let2(_col(a), _col(b), _intersects)


def _intersects(a: Column, b: Column) -> Column:
    return let2(segments(a), segments(b), lambda sa, sb: _meet(a, b, sa, sb))


def _meet(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    points = F.exists(vertices(a), lambda v: F.exists(vertices(b), lambda w: (v["x"] == w["x"]) & (v["y"] == w["y"])))

    def touch(g, segs):
        """Any point of a point or multipoint on a line: no segment pair exists."""
        dots = F.when(_is(g, "Point", "MultiPoint"), vertices(g))
        on = lambda p, t: point_on_segment(p["x"], p["y"], t["s"]["x"], t["s"]["y"], t["e"]["x"], t["e"]["y"])
        return F.coalesce(F.exists(dots, lambda p: F.exists(segs, lambda t: F.coalesce(on(p, t), F.lit(False)))), F.lit(False))

    # a shape inside the other has its vertices there; otherwise boundaries meet
    exact = (
        F.exists(vertices(a), lambda v: point_in_polygon(v["x"], v["y"], b))
        | F.exists(vertices(b), lambda v: point_in_polygon(v["x"], v["y"], a))
        | F.exists(sa, lambda s: F.exists(sb, lambda t: segments_intersect(s, t)))
        | touch(a, sb)
        | touch(b, sa)
    )
    both_points = _is(a, "Point", "MultiPoint") & _is(b, "Point", "MultiPoint")
    return F.coalesce(
        F.when(both_points, points).when(bbox_intersects(bbox(a), bbox(b)), exact), F.lit(False)
    )


# ------------------------------------------------------------------- polygons
def expand_polygon(ring, pad: float) -> Column:
    """Push ring vertices away from their mean by ``pad``."""
    ring = _col(ring)
    if not pad or pad <= 0:
        return ring

    def moved(v, mean):
        way = F.struct((v["x"] - mean["x"]).alias("dx"), (v["y"] - mean["y"]).alias("dy"))
        return let(way, lambda w: let(F.sqrt(w["dx"] * w["dx"] + w["dy"] * w["dy"]), lambda d: pushed(mean, w, d)))

    def pushed(mean, way, d):
        d = F.when(d == 0, F.lit(1.0)).otherwise(d)
        k = (d + F.lit(float(pad))) / d
        return vertex(mean["x"] + way["dx"] * k, mean["y"] + way["dy"] * k)

    return let(ring, lambda r: let(_mean_vertex(r), lambda mean: F.transform(r, lambda v: moved(v, mean))))


def inside_clip(px, py, ring) -> Column:
    """Even-odd clip test; fewer than three vertices keep everything."""
    px, py, ring = _col(px), _col(py), _col(ring)
    return F.when(F.size(ring) < 3, F.lit(True)).otherwise(_winding(px, py, ring) % 2 != 0)


def geometry_kind(geom) -> Column:
    """Point / line / polygon / unknown of one geometry."""
    t = _col(geom)["type"] if not isinstance(geom, str) else F.col(geom)["type"]
    return (
        F.when(t.contains("Point"), "point")
        .when(t.contains("LineString"), "line")
        .when(t.contains("Polygon"), "polygon")
        .otherwise("unknown")
    )
