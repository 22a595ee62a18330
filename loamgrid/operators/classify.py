"""Class breaks, classes and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.functions.scalar import display_value, js_number
from loamgrid.operators.filters import rule_condition
from loamgrid.plans.ranks import running_counts, value_at_rank

# Two-colour ramps for classes and multi-stop ramps for surfaces.
CLASS_RAMPS = {
    "orange-warm": ["#F26E22", "#ffb454"],
    "gold-red": ["#ffcc66", "#ff6b6b"],
    "mint-purple": ["#71d9b6", "#9a6bff"],
}
SURFACE_RAMPS = {
    "terrain-glow": ["#123b7a", "#F26E22", "#d7d56f", "#ff7c43"],
    "viridis-edge": ["#46327e", "#365c8d", "#277f8e", "#4ac16d", "#fde725"],
    "sunset-heat": ["#2d1248", "#7c1d6f", "#d14c65", "#f28f3b", "#ffe082"],
    "ice-fire": ["#113a6b", "#2bc0c7", "#f1f5f9", "#ff8a5b", "#7b1e3f"],
    "gray": ["#000000", "#ffffff"],
}


def categories(df: DataFrame, field: str) -> DataFrame:
    """Distinct display values in order."""
    return df.select(display_value(F.col(f"`{field}`")).alias("value")).distinct().orderBy("value")


def equal_breaks(df: DataFrame, field: str, classes: int = 5) -> DataFrame:
    """``class, min, max`` of equal intervals; the last maximum is the data maximum."""
    k = max(1, classes)
    v = js_number(F.col(f"`{field}`"))
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).filter("lo IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / k if k > 1 else F.lit(0.0)
    i = F.col("class")
    return span.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "class",
        F.when(i == 0, F.col("lo")).otherwise(F.col("lo") + step * i).alias("min"),
        F.when(i == k - 1, F.col("hi")).otherwise(F.col("lo") + step * (i + 1)).alias("max"),
    )


def quantile_breaks(df: DataFrame, field: str, classes: int = 5) -> DataFrame:
    """Exact quantile classes from the ranks of the sorted values.

    Only distinct values and their counts are ordered; 2k ranks are then read
    in one aggregate.
    """
    k = max(1, classes)
    counts = running_counts(df.select(js_number(F.col(f"`{field}`")).alias("v")), "v")
    n = F.col("total")
    aggs = []
    for i in range(k):
        low = F.floor(n * i / k)
        high = F.least(n - 1, F.ceil(n * (i + 1) / k) - 1)
        aggs.append(
            F.struct(
                F.lit(i).alias("class"),
                value_at_rank(counts, "v", low).alias("min"),
                value_at_rank(counts, "v", high).alias("max"),
            )
        )
    return counts.agg(F.array(*aggs).alias("b")).select(F.inline("b")).filter("min IS NOT NULL")


def breaks_array(breaks: DataFrame) -> Column:
    """The breaks of a layer as one scalar array, read by every task."""
    ordered = F.array_sort(F.collect_list(F.struct("class", "min", "max")))
    return breaks.agg(ordered.alias("b")).scalar()


def assign_class(df: DataFrame, field: str, breaks: DataFrame, out: str = "class", compat: bool = False) -> DataFrame:
    """Class index by breaks.

    By default a value belongs to the last class whose minimum it reaches, so
    there are no gaps; ``compat=True`` uses the half-open test on [min, max)
    and leaves values that fall between classes null.
    """
    v = js_number(F.col(f"`{field}`"))
    df = df.withColumn("_breaks", breaks_array(breaks)).withColumn("_v", v)
    b = F.col("_breaks")
    n = F.size(b)
    if compat:
        hit = F.filter(
            b,
            lambda c: (F.col("_v") >= c["min"])
            & F.when(c["class"] == n - 1, F.col("_v") <= c["max"]).otherwise(F.col("_v") < c["max"]),
        )
        index = F.get(hit, F.lit(0))["class"]
    else:
        inside = (F.col("_v") >= F.get(b, F.lit(0))["min"]) & (F.col("_v") <= F.get(b, n - 1)["max"])
        reached = F.filter(b, lambda c: F.col("_v") >= c["min"])
        index = F.when(inside, F.get(reached, F.size(reached) - 1)["class"])
    return df.withColumn(out, index).drop("_breaks", "_v")


def rule_value(df: DataFrame, rules: list[dict], default, key: str = "color") -> Column:
    """Value of the first matching rule, else the default; a rule with no operator tests equality."""
    out = None
    for rule in rules:
        if not rule.get("field"):
            continue
        known = {"contains", "==", "!=", ">", "<", ">=", "<="}
        test = dict(rule, operator=rule.get("operator") if rule.get("operator") in known else "==")
        cond = rule_condition(df, test)
        value = F.lit(rule.get(key) or default)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def category_value(field: Column, mapping: dict, default) -> Column:
    """Display value -> value, with a default."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), display_value(field)), F.lit(default))


# ------------------------------------------------------------------- colours
def _rgb(color: str) -> tuple[int, int, int]:
    text = color.lstrip("#")
    return int(text[0:2], 16), int(text[2:4], 16), int(text[4:6], 16)


def _hex(channels: list[Column]) -> Column:
    byte = [
        F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("bigint"))), 2, "0")
        for c in channels
    ]
    return F.concat(F.lit("#"), *byte)


def _mix(start: tuple, end: tuple, ratio: Column) -> Column:
    return _hex([F.lit(float(a)) + F.lit(float(b - a)) * ratio for a, b in zip(start, end)])


def class_color(index, classes: int, ramp: str = "orange-warm") -> Column:
    """Colour of a class index on a two-colour ramp; null stays null."""
    index = F.col(index) if isinstance(index, str) else index
    start, end = CLASS_RAMPS.get(ramp, CLASS_RAMPS["orange-warm"])
    if classes <= 1:
        return F.when(index.isNotNull(), F.lit(start))
    return F.when(index.isNotNull(), _mix(_rgb(start), _rgb(end), index / F.lit(float(classes - 1))))


def ratio_channels(ratio, ramp: str = "terrain-glow") -> list[Column]:
    """Red, green, blue of a ratio on a multi-stop ramp, rounded as a colour code would be."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    stops = [_rgb(s) for s in SURFACE_RAMPS.get(ramp, SURFACE_RAMPS["terrain-glow"])]
    n = len(stops) - 1
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)) * n
    low = F.floor(scaled)
    part = scaled - low
    out = []
    for ch in range(3):
        value = None
        for i in range(n + 1):
            a, b = stops[i][ch], stops[min(n, i + 1)][ch]
            mixed = F.lit(float(a)) + F.lit(float(b - a)) * part
            value = F.when(low == i, mixed) if value is None else value.when(low == i, mixed)
        out.append(F.floor(value + 0.5))
    return out


def ratio_color(ratio, ramp: str = "terrain-glow") -> Column:
    return _hex(ratio_channels(ratio, ramp))


def value_color(value, lo, hi, ramp: str = "terrain-glow") -> Column:
    """Min-max position of a value on a ramp."""
    value, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, lo, hi))
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return ratio_color((value - lo) / span, ramp)
