"""Queries over point and attribute layers (P, F, A, X, U families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.catalog.base import (
    query, rnd, sql_hav, sql_mercator, sql_rnd, sql_tile_lat, sql_tile_x, sql_tile_y, table, view,
)
from loamgrid.functions import crs as X
from loamgrid.functions import geometry as G
from loamgrid.functions import scalar as S
from loamgrid.operators import aggregates as A
from loamgrid.operators import classify as C
from loamgrid.operators import edits as E
from loamgrid.operators import filters as FL
from loamgrid.operators import measure as M

RULES = [{"field": "value", "operator": ">", "value": "50"}, {"field": "event_type", "operator": "!=", "value": "error"}]

# ------------------------------------------------------------------- flagship
BINS_SQL = f"""
SELECT 'grid-' || tx || ':' || ty AS id, count(*) AS point_count, {sql_rnd('avg(lat)')} AS sample_lat, {sql_rnd('avg(lon)')} AS sample_lon,
  {sql_rnd("tx/pow(2e0,8)*360e0 - 180e0")} AS west, {sql_rnd(sql_tile_lat('ty', 8))} AS north,
  {sql_rnd("(tx+1)/pow(2e0,8)*360e0 - 180e0")} AS east, {sql_rnd(sql_tile_lat('ty + 1', 8))} AS south
FROM (SELECT *, {sql_tile_x('lon', 8)} AS tx, {sql_tile_y('lat', 8)} AS ty FROM pts WHERE value > 50 AND event_type <> 'error')
GROUP BY tx, ty"""


def _bins(df, zoom=8):
    b = A.tile_bins(df, zoom=zoom, geometry=False)
    return b.select(
        "id", "point_count", rnd("sample_lat").alias("sample_lat"), rnd("sample_lon").alias("sample_lon"),
        *[rnd(F.col(f"bounds.{k}")).alias(k) for k in ("west", "north", "east", "south")],
    )


@query("a11_filtered_tile_bins", BINS_SQL)
def a11(spark, sf):
    return _bins(FL.filter_rules(view(spark, sf, "pts"), RULES))


@query("a11_fine_tile_bins", f"""
SELECT {sql_tile_x('lon', 14)} AS tile_x, {sql_tile_y('lat', 14)} AS tile_y, count(*) AS point_count,
  {sql_rnd('avg(lat)')} AS sample_lat, {sql_rnd('avg(lon)')} AS sample_lon FROM pts GROUP BY 1, 2""")
def a11_fine(spark, sf):
    b = A.tile_bins(view(spark, sf, "pts"), zoom=14, geometry=False)
    return b.select("tile_x", "tile_y", "point_count", rnd("sample_lat").alias("sample_lat"), rnd("sample_lon").alias("sample_lon"))


# ------------------------------------------------------------------- P: scalars
NUM = """CASE WHEN raw IS NULL OR trim(raw) = '' THEN 0e0 WHEN regexp_full_match(trim(raw), '0[xX][0-9a-fA-F]+') THEN 16e0
  WHEN regexp_full_match(trim(raw), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(raw) AS DOUBLE) END"""


@query("p02_p17_number_coercion", f"""SELECT id, {NUM} AS n,
  CASE WHEN {NUM} IS NOT NULL THEN floor(({NUM})*1e0 + 5e-1) END AS whole,
  CASE WHEN {NUM} IS NOT NULL THEN floor(({NUM})*1e-1 + 5e-1)/1e-1 END AS tens FROM texts""")
def p02(spark, sf):
    t = view(spark, sf, "texts")
    clean = lambda c: F.when(~F.isnan(c), c)
    return t.select(
        "id", S.js_number("raw").alias("n"), clean(S.round_half_up("raw")).alias("whole"), clean(S.round_half_up("raw", -1)).alias("tens")
    )


@query("p03_p10_truth", """SELECT id, t AS truth, t AND id % 2 = 0 AS both, t OR id % 2 = 0 AS either, NOT t AS negated FROM (
  SELECT id, coalesce(CASE WHEN lower(trim(raw)) IN ('true','t','yes','y','1') THEN true
  WHEN lower(trim(raw)) IN ('false','f','no','n','0','') THEN false WHEN raw IS NULL THEN false ELSE true END, false) AS t FROM texts)""")
def p03(spark, sf):
    t = view(spark, sf, "texts")
    even = F.col("id") % 2 == 0
    return t.select(
        "id", S.truthy("raw").alias("truth"), S.both("raw", even).alias("both"), S.either("raw", even).alias("either"), S.negation("raw").alias("negated")
    )


@query("p06_p07_arithmetic", """SELECT id, value + 2e0 AS plus, value - 2e0 AS minus, round(value * 2e0, 6) AS times,
  CASE WHEN id % 3 = 0 THEN 'inf' ELSE CAST(CAST(round(value / (id % 3)) AS BIGINT) AS VARCHAR) END AS ratio,
  round(CASE WHEN id % 4 = 0 THEN NULL ELSE value % (id % 4) END, 6) + 0e0 AS remainder, round(pow(-2e0, 2), 6) AS square FROM pts""")
def p06(spark, sf):
    p = view(spark, sf, "pts")
    ratio = S.divide("value", F.col("id") % 3)
    rem = S.modulo("value", F.col("id") % 4)
    return p.select(
        "id", S.add("value", F.lit(2)).alias("plus"), S.subtract("value", F.lit("2")).alias("minus"), F.round(S.multiply("value", F.lit(2)), 6).alias("times"),
        F.when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), "inf").otherwise(F.round(ratio).cast("bigint").cast("string")).alias("ratio"),
        rnd(F.when(~F.isnan(rem), rem)).alias("remainder"), F.round(S.power(S.negate(F.lit(2)), F.lit(2)), 6).alias("square"),
    )


@query("p09_compare", f"""SELECT id, {NUM} IS NOT NULL AND coalesce({NUM} = 0e0, false) AS is_zero,
  coalesce({NUM} > 4e0, false) AS above, coalesce(raw = 'abc', false) AS is_abc, coalesce(raw < 'b', false) AS before_b FROM texts""")
def p09(spark, sf):
    return view(spark, sf, "texts").select(
        "id", S.compare("raw", "=", F.lit(0)).alias("is_zero"), S.compare("raw", ">", F.lit(4)).alias("above"),
        S.compare("raw", "==", F.lit("abc")).alias("is_abc"), S.compare("raw", "<", F.lit("b")).alias("before_b"),
    )


@query("p08_p11_p16_text", """SELECT id, 'v=' || coalesce(raw, '') AS joined, raw IS NULL AS missing, coalesce(raw, 'none') AS filled,
  replace(coalesce(raw, ''), 'e', '.') AS swapped, upper(coalesce(raw, '')) AS up, lower(coalesce(raw, '')) AS low,
  CAST(length(coalesce(raw, '')) AS INTEGER) AS n, CASE WHEN raw IS NULL OR raw = '' THEN '(empty)' ELSE raw END AS shown FROM texts""")
def p08(spark, sf):
    return view(spark, sf, "texts").select(
        "id", S.concat_text(F.lit("v="), "raw").alias("joined"), F.col("raw").isNull().alias("missing"), F.coalesce("raw", F.lit("none")).alias("filled"),
        S.replace_text("raw", "e", ".").alias("swapped"), S.upper("raw").alias("up"), S.lower("raw").alias("low"),
        S.text_length("raw").alias("n"), S.display_value("raw").alias("shown"),
    )


@query("p12_p13_conditional", """SELECT id, CASE WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'mid' END AS level,
  CASE WHEN event_type = 'error' THEN -1e0 ELSE value END AS signed FROM pts""")
def p12(spark, sf):
    return view(spark, sf, "pts").select(
        "id", F.when(F.col("value") > 100, "high").when(F.col("value") > 50, "mid").alias("level"),
        S.if_(S.compare("event_type", "=", F.lit("error")), F.lit(-1.0), "value").alias("signed"),
    )


@query("p01_p24_calculate_and_fill", """SELECT id, coalesce(category, '') || '#' || CAST(zone AS VARCHAR) AS tag,
  round(amount * 2e0, 6) AS amount, 'n/a' AS note FROM gfc""")
def p01(spark, sf):
    g = view(spark, sf, "gfc")
    g = E.calculate(g, "amount", F.round(S.multiply("amount", F.lit(2)), 6))
    g = E.calculate(g, "tag", S.concat_text("category", F.lit("#"), "zone"))
    return E.add_field(g, "note", "n/a").select("id", "tag", "amount", "note")


@query("p22_labels", """SELECT id, category || ' in ' || CAST(zone AS VARCHAR) || ' ((empty))' AS label, category AS plain FROM gfc""")
def p22(spark, sf):
    g = view(spark, sf, "gfc")
    return g.select("id", S.label_text(g, "{category} in {zone}\n({nothing})").alias("label"), S.label_text(g, field="category").alias("plain"))


@query("p23_formatting", """SELECT id, CASE WHEN d < 1000 THEN printf('%.1f m', d) ELSE printf('%.3f km', d/1e3) END AS dist,
  CASE WHEN a < 10000 THEN printf('%.1f m²', a) WHEN a < 1e6 THEN printf('%.3f ha', a/1e4) ELSE printf('%.4f km²', a/1e6) END AS area
  FROM (SELECT id, CAST((id*37) % 5000 AS DOUBLE) AS d, CAST((id*7919) % 300000 * 10 + 1 AS DOUBLE) AS a FROM pts)""")
def p23(spark, sf):
    p = view(spark, sf, "pts").select("id", ((F.col("id") * 37) % 5000).cast("double").alias("d"), ((F.col("id") * 7919) % 300000 * 10 + 1).cast("double").alias("a"))
    return p.select("id", S.format_distance("d").alias("dist"), S.format_area("a").alias("area"))


@query("p25_parse_lat_lng", """SELECT id, CASE WHEN id % 5 < 3 AND (id % 200) <= 90 THEN CAST(id % 200 AS DOUBLE) END AS lat,
  CASE WHEN id % 5 < 3 AND (id % 200) <= 90 THEN -CAST(id % 170 AS DOUBLE) + 0e0 END AS lon FROM pts""")
def p25(spark, sf):
    lat, lon = (F.col("id") % 200).cast("string"), (F.col("id") % 170).cast("string")
    text = F.when(F.col("id") % 5 < 2, F.concat(F.lit(" "), lat, F.lit(", -"), lon)).when(
        F.col("id") % 5 == 2, F.concat(lat, F.lit(" -"), lon)
    ).otherwise(F.concat(lat, F.lit(" N -"), lon))
    p = view(spark, sf, "pts").select("id", S.parse_lat_lng(text).alias("p"))
    return p.select("id", F.col("p.lat").alias("lat"), (F.col("p.lon") + 0.0).alias("lon"))


@query("k04_slug", """SELECT c_custkey AS id, substr(trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) AS slug FROM customer""")
def k04(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


# -------------------------------------------------------------------- F: filters
@query("f01_f02_filter_and", "SELECT id, value, event_type FROM pts WHERE value > 50 AND event_type <> 'error'")
def f01(spark, sf):
    return FL.filter_rules(view(spark, sf, "pts"), RULES).select("id", "value", "event_type")


@query("f01_f03_filter_or", "SELECT id FROM pts WHERE lower(event_type) LIKE '%ick%' OR value <= 10 OR id = 7")
def f01_or(spark, sf):
    rules = [
        {"field": "event_type", "operator": "contains", "value": "ICK"}, {"field": "value", "operator": "<=", "value": "10"},
        {"field": "id", "operator": "==", "value": "7"},
    ]
    return FL.filter_rules(view(spark, sf, "pts"), rules, "or").select("id")


@query("f01_incomplete_rules", "SELECT id FROM pts")
def f01_incomplete(spark, sf):
    rules = [{"field": "", "operator": ">", "value": "1"}, {"field": "value", "operator": "", "value": "1"}]
    return FL.filter_rules(view(spark, sf, "pts"), rules).select("id")


@query("f04_analysis_scope", "SELECT 'all' AS scope, count(*) AS n FROM pts UNION ALL SELECT 'filtered', count(*) FROM pts WHERE value > 50 AND event_type <> 'error'")
def f04(spark, sf):
    p = view(spark, sf, "pts")
    parts = [FL.analysis_scope(p, RULES, scope=s).agg(F.lit(s).alias("scope"), F.count(F.lit(1)).alias("n")) for s in ("all", "filtered")]
    return parts[0].unionByName(parts[1])


@query("f06_search", "SELECT id FROM gfc WHERE lower(category) LIKE '%build%' OR CAST(id AS VARCHAR) LIKE '%build%'")
def f06(spark, sf):
    return FL.search(view(spark, sf, "gfc"), "Build", ["id", "category"]).select("id")


@query("f07_sort", "SELECT id, category, row_number() OVER (ORDER BY category, id) AS pos FROM gfc")
def f07(spark, sf):
    from loamgrid.plans.ranks import global_rank

    return global_rank(FL.sort(view(spark, sf, "gfc"), "category", tie="id"), F.col("category"), F.col("id"), out="pos").select("id", "category", "pos")


@query("f09_top_n", "SELECT id, value FROM pts ORDER BY value DESC, id LIMIT 25")
def f09(spark, sf):
    return FL.top_n(view(spark, sf, "pts"), 25, F.desc("value"), F.col("id")).select("id", "value")


@query("f10_preview")
def f10(spark, sf):
    return FL.preview(view(spark, sf, "pts"), 50)


@query("f11_uniform_sample", "SELECT id, value FROM pts ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 500")
def f11(spark, sf):
    return FL.uniform_sample(view(spark, sf, "pts"), 500, "id").select("id", "value")


@query("f12_presentation_mode", "SELECT CASE WHEN count(*) <= 50000 THEN 'full' WHEN count(*) <= 250000 THEN 'sample' ELSE 'grid' END AS mode FROM lineitem")
def f12(spark, sf):
    return table(spark, sf, "lineitem").agg(FL.presentation_mode(F.count(F.lit(1))).alias("mode"))


# ----------------------------------------------------------------- A: aggregates
@query("a01_a05_layer_aggregates", f"""SELECT {sql_rnd('sum(value)', 4)} AS total, {sql_rnd('avg(value)')} AS mean, min(value) AS low, max(value) AS high,
  count(value) AS n, count(DISTINCT event_type) AS kinds FROM pts""")
def a01(spark, sf):
    p = view(spark, sf, "pts")
    L = A.layer_aggregate
    return p.agg(
        rnd(L("sum", "value"), 4).alias("total"), rnd(L("mean", "value")).alias("mean"), L("minimum", "value").alias("low"),
        L("maximum", "value").alias("high"), L("count", "value").alias("n"), L("count_distinct", "event_type").alias("kinds"),
    )


@query("a08_a10_grouped_filtered", f"""SELECT event_type, {sql_rnd('coalesce(sum(CASE WHEN value > 50 THEN value END), 0e0)', 4)} AS total,
  count(CASE WHEN value > 50 THEN user_id END) AS n, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS users FROM pts GROUP BY event_type""")
def a08(spark, sf):
    w = F.col("value") > 50
    L = A.layer_aggregate
    return view(spark, sf, "pts").groupBy("event_type").agg(
        rnd(L("sum", "value", w), 4).alias("total"), L("count", "user_id", w).alias("n"), L("count_distinct", "user_id", w).alias("users")
    )


@query("a09_null_as_zero", f"""SELECT {sql_rnd(f'avg(CASE WHEN raw IS NULL THEN NULL ELSE {NUM} END)')} AS skipping,
  {sql_rnd(f'avg({NUM})')} AS counting, {sql_rnd(f'sum({NUM})')} AS total FROM texts""")
def a09(spark, sf):
    t = view(spark, sf, "texts")
    L = A.layer_aggregate
    return t.agg(rnd(L("mean", "raw")).alias("skipping"), rnd(L("mean", "raw", null_as_zero=True)).alias("counting"), rnd(L("sum", "raw")).alias("total"))


@query("a06_f08_concatenate", """SELECT CAST((rn - 1)//1000 AS BIGINT) AS part, string_agg(event_type, ', ' ORDER BY rn) AS text FROM (
  SELECT event_type, row_number() OVER (ORDER BY value IS NULL, value, id) AS rn FROM pts WHERE value > 20) GROUP BY 1""")
def a06(spark, sf):
    return A.concatenate_chunks(view(spark, sf, "pts"), "event_type", "id", order_by="value", where=F.col("value") > 20, chunk=1000)


@query("a10_grouped_concatenate", """SELECT event_type, CAST((rn - 1)//500 AS BIGINT) AS part, string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY rn) AS text FROM (
  SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value IS NULL, value, id) AS rn FROM pts WHERE user_id IS NOT NULL) GROUP BY ALL""")
def a10_concatenate(spark, sf):
    return A.concatenate_chunks(view(spark, sf, "pts"), "user_id", "id", order_by="value", chunk=500, by=["event_type"])


@query("a10_grouped_array_agg", """SELECT category, CAST(zone AS BIGINT) AS zone, md5(string_agg(coalesce(CAST(id AS VARCHAR), 'null'), ',' ORDER BY amount, id)) AS digest, count(*) AS n FROM gfc WHERE amount > 100 GROUP BY ALL""")
def a10_array(spark, sf):
    g = A.aggregate(view(spark, sf, "gfc"), "array_agg", "id", F.col("amount") > 100, ["category", "zone"], seq="id", order_by="amount")
    return g.select("category", F.col("zone").cast("bigint").alias("zone"), F.md5(F.array_join("value", ",", "null")).alias("digest"), F.size("value").cast("bigint").alias("n"))


@query("a07_f08_array_agg", "SELECT row_number() OVER (ORDER BY value IS NULL, value, id) AS rank, user_id AS value FROM pts")
def a07(spark, sf):
    return A.ordered_values(view(spark, sf, "pts"), "user_id", "id", order_by="value")


@query("a12_field_summaries", f"""SELECT 'raw' AS field, min(n) AS min, max(n) AS max, count(n) AS count FROM (SELECT CASE
  WHEN raw IS NULL OR trim(raw) = '' THEN NULL WHEN raw = '1d' THEN 1e0 WHEN raw = '0x10' THEN 0e0 ELSE {NUM} END AS n FROM texts)
  UNION ALL SELECT 'id', CAST(min(id) AS DOUBLE), CAST(max(id) AS DOUBLE), count(id) FROM texts""")
def a12(spark, sf):
    return A.field_summaries(view(spark, sf, "texts"), ["raw", "id"])


@query("a13_extent", "SELECT min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM pts")
def a13(spark, sf):
    return A.extent(view(spark, sf, "pts"))


@query("a15_categories", "SELECT DISTINCT CASE WHEN raw IS NULL OR raw = '' THEN '(empty)' ELSE raw END AS value FROM texts")
def a15(spark, sf):
    return C.categories(view(spark, sf, "texts"), "raw")


EQUAL_SQL = """SELECT k AS class, CASE WHEN k = 0 THEN lo ELSE lo + (hi-lo)/5e0*k END AS lo_, CASE WHEN k = 4 THEN hi ELSE lo + (hi-lo)/5e0*(k+1) END AS hi_
  FROM (SELECT min(amount) AS lo, max(amount) AS hi FROM gfc), (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS k)"""


@query("a16_equal_breaks", f"SELECT class, {sql_rnd('lo_')} AS min, {sql_rnd('hi_')} AS max FROM ({EQUAL_SQL})")
def a16(spark, sf):
    return C.equal_breaks(view(spark, sf, "gfc"), "amount", 5).select("class", rnd("min").alias("min"), rnd("max").alias("max"))


def quantile_sql(source: str, field: str, k: int) -> str:
    return f"""SELECT k AS class, (SELECT v FROM s WHERE i = floor(k*n/{k}e0)) AS min,
  (SELECT v FROM s WHERE i = least(n - 1, ceil((k+1)*n/{k}e0) - 1)) AS max
  FROM (SELECT count(*) AS n FROM s), (SELECT CAST(unnest(generate_series(0, {k - 1})) AS INTEGER) AS k)"""


def s_cte(source: str, field: str) -> str:
    return f"s AS (SELECT {field} AS v, row_number() OVER (ORDER BY {field}) - 1 AS i FROM {source})"


@query("a17_quantile_breaks", f"WITH {s_cte('gfc', 'amount')} {quantile_sql('gfc', 'amount', 7)}")
def a17(spark, sf):
    return C.quantile_breaks(view(spark, sf, "gfc"), "amount", 7)


@query("a17_quantile_breaks_repeated_values", f"WITH {s_cte('pts', 'CAST(user_id % 13 AS DOUBLE)')} {quantile_sql('pts', '', 5)}")
def a17_repeated(spark, sf):
    p = view(spark, sf, "pts").withColumn("u", (F.col("user_id") % 13).cast("double"))
    return C.quantile_breaks(p, "u", 5)


@query("a18_assign_class", f"""WITH {s_cte('gfc', 'amount')}, b AS ({quantile_sql('gfc', 'amount', 5)})
  SELECT g.id, (SELECT max(b.class) FROM b WHERE g.amount >= b.min) AS class FROM gfc g""")
def a18(spark, sf):
    g = view(spark, sf, "gfc")
    return C.assign_class(g, "amount", C.quantile_breaks(g, "amount", 5)).select("id", "class")


@query("a18_assign_class_compat", f"""WITH {s_cte('gfc', 'amount')}, b AS ({quantile_sql('gfc', 'amount', 5)})
  SELECT g.id, coalesce((SELECT min(b.class) FROM b WHERE g.amount >= b.min AND (g.amount < b.max OR (b.class = 4 AND g.amount <= b.max))), -1) AS class FROM gfc g""")
def a18_compat(spark, sf):
    g = view(spark, sf, "gfc")
    return C.assign_class(g, "amount", C.quantile_breaks(g, "amount", 5), compat=True).select("id", F.coalesce("class", F.lit(-1)).alias("class"))


@query("a19_a20_rule_and_category_values", """SELECT id, CASE WHEN amount > 5000 THEN '#111111' WHEN lower(category) LIKE '%auto%' THEN '#222222' ELSE '#999999' END AS by_rule,
  CASE category WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE '-' END AS by_category FROM gfc""")
def a19(spark, sf):
    g = view(spark, sf, "gfc")
    rules = [{"field": "amount", "operator": ">", "value": "5000", "color": "#111111"}, {"field": "category", "operator": "contains", "value": "auto", "color": "#222222"}]
    return g.select(
        "id", C.rule_value(g, rules, "#999999").alias("by_rule"), C.category_value(F.col("category"), {"BUILDING": "b", "MACHINERY": "m"}, "-").alias("by_category")
    )


def _sql_byte(a: int, b: int, r: str) -> str:
    return f"lower(printf('%02x', CAST(floor({a}e0 + {b - a}e0*({r}) + 5e-1) AS INTEGER)))"


@query("a21_class_colors", f"""SELECT id, '#' || {_sql_byte(0xff, 0xff, 'k/4e0')} || {_sql_byte(0xcc, 0x6b, 'k/4e0')} || {_sql_byte(0x66, 0x6b, 'k/4e0')} AS color
  FROM (SELECT id, CAST(id % 5 AS DOUBLE) AS k FROM gfc)""")
def a21(spark, sf):
    return view(spark, sf, "gfc").select("id", C.class_color(F.col("id") % 5, 5, "gold-red").alias("color"))


@query("a21_value_colors", f"""SELECT id, CASE WHEN r < 1e0 THEN '#' || {_sql_byte(0, 255, 'r')} || {_sql_byte(0, 255, 'r')} || {_sql_byte(0, 255, 'r')} ELSE '#ffffff' END AS color
  FROM (SELECT id, least(1e0, greatest(0e0, (value - 10e0)/90e0)) AS r FROM pts)""")
def a21_values(spark, sf):
    return view(spark, sf, "pts").select("id", C.value_color("value", F.lit(10.0), F.lit(100.0), "gray").alias("color"))


# ------------------------------------------------------------ J09, U: combining
@query("j09_layer_scalar", f"SELECT id, {sql_rnd('amount - (SELECT avg(value) FROM pts)')} AS over_mean FROM gfc")
def j09(spark, sf):
    return view(spark, sf, "gfc").select("id", rnd(F.col("amount") - A.layer_scalar(view(spark, sf, "pts"), "mean", "value")).alias("over_mean"))


@query("u01_u05_union", "SELECT id, name, CAST(NULL AS VARCHAR) AS category FROM facilities UNION ALL SELECT id, NULL, category FROM gfc")
def u01(spark, sf):
    return E.union_layers(view(spark, sf, "facilities").select("id", "name"), view(spark, sf, "gfc").select("id", "category"))


@query("u02_merge_edits", """SELECT id, value FROM pts WHERE event_type <> 'click' UNION ALL
  SELECT id, round(value * 2e0, 6) FROM pts WHERE event_type = 'click' AND value > 60 UNION ALL SELECT id + 100000000, value FROM pts WHERE value > 140""")
def u02(spark, sf):
    p = view(spark, sf, "pts").select("id", "value", "event_type")
    shown = p.filter("event_type = 'click'")
    kept = shown.filter("value > 60").select("id", F.round(F.col("value") * 2, 6).alias("value"))
    added = p.filter("value > 140").select((F.col("id") + 100000000).alias("id"), "value")
    return E.merge_edits(p.select("id", "value"), kept.unionByName(added), shown.select("id"))


@query("u03_u04_update_delete", "SELECT id, CASE WHEN event_type = 'error' THEN -1e0 ELSE value END AS value FROM pts WHERE event_type <> 'signup'")
def u03(spark, sf):
    p = view(spark, sf, "pts").select("id", "value", "event_type")
    updated = E.update_cells(p.select("id", "value"), p.filter("event_type = 'error'").select("id", F.lit(-1.0).alias("value")))
    return E.delete_rows(updated, p.filter("event_type = 'signup'").select("id"))


# ------------------------------------------------------------------------ X: crs
MX, MY = sql_mercator("lon", "lat")


@query("x03_x04_mercator", f"""SELECT id, {sql_rnd(MX, 4)} AS x, {sql_rnd(MY, 4)} AS y, {sql_rnd('lon')} AS lon, {sql_rnd('lat')} AS lat FROM pts""")
def x03(spark, sf):
    p = view(spark, sf, "pts").select("id", X.to_mercator("lon", "lat").alias("m"))
    p = p.withColumn("b", X.from_mercator("m.x", "m.y"))
    return p.select("id", rnd("m.x", 4).alias("x"), rnd("m.y", 4).alias("y"), rnd("b.x").alias("lon"), rnd("b.y").alias("lat"))


UTM_SQL = """WITH k AS (SELECT *, radians(lat) AS p, radians(lon) - radians(75e0) AS dl, f*(2e0-f) AS e2 FROM (SELECT id, lon, lat, 1e0/298.257223563e0 AS f FROM pts)),
 q AS (SELECT *, e2/(1e0-e2) AS ep, 6378137e0/sqrt(1e0-e2*pow(sin(p),2)) AS n, pow(tan(p),2) AS t, cos(p)*dl AS a FROM k),
 m AS (SELECT *, ep*pow(cos(p),2) AS c, 6378137e0*((1e0-e2/4e0-3e0*e2*e2/64e0-5e0*e2*e2*e2/256e0)*p-(3e0*e2/8e0+3e0*e2*e2/32e0+45e0*e2*e2*e2/1024e0)*sin(2e0*p)
   +(15e0*e2*e2/256e0+45e0*e2*e2*e2/1024e0)*sin(4e0*p)-(35e0*e2*e2*e2/3072e0)*sin(6e0*p)) AS arc FROM q)"""


@query("x05_x06_utm", f"""{UTM_SQL} SELECT id, {sql_rnd('9996e-4*n*(a+(1e0-t+c)*pow(a,3)/6e0+(5e0-18e0*t+t*t+72e0*c-58e0*ep)*pow(a,5)/120e0)+500000e0', 3)} AS x,
  {sql_rnd('9996e-4*(arc+n*tan(p)*(a*a/2e0+(5e0-t+9e0*c+4e0*c*c)*pow(a,4)/24e0+(61e0-58e0*t+t*t+600e0*c-330e0*ep)*pow(a,6)/720e0))', 3)} AS y,
  {sql_rnd('lon')} AS lon, {sql_rnd('lat')} AS lat FROM m""")
def x05(spark, sf):
    p = view(spark, sf, "pts").select("id", X.to_utm("lon", "lat", 43, F.lit(False)).alias("u"))
    p = p.withColumn("b", X.from_utm("u.x", "u.y", 43, F.lit(False)))
    return p.select("id", rnd("u.x", 3).alias("x"), rnd("u.y", 3).alias("y"), rnd("b.x").alias("lon"), rnd("b.y").alias("lat"))


@query("x01_x02_crs_texts", """SELECT id, CASE id % 8 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:32643' WHEN 3 THEN 'EPSG:3857' WHEN 4 THEN 'EPSG:4326'
  WHEN 5 THEN 'EPSG:32743' WHEN 6 THEN 'EPSG:4326' ELSE 'EPSG:3857' END AS code, CASE id % 8 WHEN 2 THEN 'utm' WHEN 5 THEN 'utm' WHEN 3 THEN 'mercator' WHEN 7 THEN 'mercator' ELSE 'geographic' END AS kind,
  true AS supported FROM pts""")
def x01(spark, sf):
    texts = [
        "urn:ogc:def:crs:EPSG::4326", "urn:ogc:def:crs:OGC:1.3:CRS84", "http://www.opengis.net/def/crs/EPSG/0/32643", "SRID=3857",
        "EPSG/4326", "32743", "WGS84", "epsg:900913",
    ]
    pick = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 8).cast("int"))
    p = view(spark, sf, "pts").select("id", X.crs_info(pick).alias("c"))
    return p.select("id", F.col("c.code").alias("code"), F.col("c.kind").alias("kind"), F.col("c.supported").alias("supported"))


@query("x07_transform_geometry", f"""SELECT id, {sql_rnd(sql_mercator('x', 'y')[0], 3)} AS x0, {sql_rnd(sql_mercator('x', 'y')[1], 3)} AS y0,
  {sql_rnd(sql_mercator('x + w', 'y + h')[0], 3)} AS x2, {sql_rnd(sql_mercator('x + w', 'y + h')[1], 3)} AS y2, true AS chained FROM plots""")
def x07(spark, sf):
    b = G.box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    p = view(spark, sf, "plots").select(
        "id", X.transform(b, "EPSG:4326", "EPSG:3857").alias("g"), X.transform(b, "EPSG:4326", "EPSG:32643").alias("u")
    ).withColumn("c", X.transform("u", "urn:ogc:def:crs:EPSG::32643", "EPSG:3857"))
    v, c = F.col("g.parts")[0][0], F.col("c.parts")[0][0]
    near = F.greatest(F.abs(v[2]["x"] - c[2]["x"]), F.abs(v[2]["y"] - c[2]["y"])) < 0.01
    return p.select("id", rnd(v[0]["x"], 3).alias("x0"), rnd(v[0]["y"], 3).alias("y0"), rnd(v[2]["x"], 3).alias("x2"), rnd(v[2]["y"], 3).alias("y2"), near.alias("chained"))


@query("x08_x10_tiles", f"""SELECT id, {sql_tile_x('lon', 12)} AS tx, {sql_tile_y('lat', 12)} AS ty, {sql_rnd('(lon + 180e0)/360e0*4096e0')} AS fx,
  CAST(greatest(2, least(12, floor(log2(156543e0*cos(radians(lat))/((1000 + id % 50 * 1000)/512e0)) + 5e-1))) AS INTEGER) AS zoom FROM pts""")
def x08(spark, sf):
    p = view(spark, sf, "pts").withColumn("r", (1000 + F.col("id") % 50 * 1000).cast("double"))
    return p.select(
        "id", X.tile_x("lon", 12).alias("tx"), X.tile_y("lat", 12).alias("ty"), rnd(X.tile_x_fraction("lon", 12)).alias("fx"), X.zoom_for_radius("lat", "r").alias("zoom")
    )


@query("x11_cell_size", f"""SELECT id, {sql_rnd('(maxx-minx)/100e0*111320e0*greatest(1e-2, cos(radians(miny)))', 4)} AS cx, {sql_rnd('(maxy-miny)/50e0*111320e0', 4)} AS cy FROM zones""")
def x11(spark, sf):
    z = view(spark, sf, "zones")
    s = X.cell_size_m(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), 100, 50, F.col("miny"))
    return z.select("id", s.alias("s")).select("id", rnd("s.x", 4).alias("cx"), rnd("s.y", 4).alias("cy"))


# ------------------------------------------------------------- G18, G19, G01
@query("g18_measure_path", f"""SELECT id, {sql_rnd('leg', 3)} AS leg, {sql_rnd('sum(leg) OVER (PARTITION BY user_id ORDER BY ts, id)', 2)} AS distance FROM (
  SELECT id, user_id, ts, CASE WHEN lag(lon) OVER w IS NULL THEN 0e0 ELSE {sql_hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat', '6371000e0')} END AS leg FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))""")
def g18(spark, sf):
    m = M.measure_path(view(spark, sf, "pts"), "user_id", "ts", "id")
    return m.select("id", rnd("leg", 3).alias("leg"), rnd("distance", 2).alias("distance"))


@query("g19_measure_area", f"""SELECT user_id, count(*) AS points, {sql_rnd('CASE WHEN count(*) < 3 THEN 0e0 ELSE abs(sum(t))*6371000e0*6371000e0/2e0/1e6 END', 3)} AS area_km2 FROM (
  SELECT user_id, radians(coalesce(lead(lon) OVER w, first_value(lon) OVER w) - lon)*(2e0+sin(radians(lat))+sin(radians(coalesce(lead(lat) OVER w, first_value(lat) OVER w)))) AS t
  FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) GROUP BY user_id""")
def g19(spark, sf):
    m = M.measure_area(view(spark, sf, "pts"), "user_id", "ts", "id")
    return m.select("user_id", "points", rnd(F.col("area") / 1e6, 3).alias("area_km2"))
