"""Row selection: rules, search, sort, sample and preview (F family)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.functions.geometry import geometry_kind
from loamgrid.functions.scalar import js_number, js_string

# Row counts up to which a layer is shown whole, and as a sample; sample sizes.
FULL_LIMIT = 50_000
SAMPLE_LIMIT = 250_000
PREVIEW_ROWS = 20_000
ANALYSIS_ROWS = 50_000

ORDERED = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def _plain(df: DataFrame, field: str, op: str, number: float) -> Column | None:
    """A bare comparison for numeric columns, which a parquet scan can push down.

    Null coerces to 0, so it is only used where 0 itself fails the rule.
    """
    kind = df.schema[field].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "float", "double") or op not in ORDERED:
        return None
    if ORDERED[op](0.0, number):
        return None
    c = F.col(f"`{field}`")
    exact = F.lit(int(number)) if kind not in ("float", "double") and number == int(number) else F.lit(number)
    ok = ORDERED[op](c, exact)
    if kind in ("float", "double"):
        ok = ok & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def _literal_number(value) -> float | None:
    if value is None:
        return 0.0
    if isinstance(value, bool):
        return float(value)
    try:
        text = str(value).strip()
        number = float(text) if text else 0.0
    except ValueError:
        return None
    return number if abs(number) != float("inf") and number == number else None


def rule_condition(df: DataFrame, rule: dict) -> Column:
    """one rule as a Column; an incomplete rule passes every row."""
    field, op, value = rule.get("field"), rule.get("operator"), rule.get("value")
    if not field or not op:
        return F.lit(True)
    if field not in df.columns:
        left, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    else:
        left = F.col(f"`{field}`")
        # a missing value is 0 under coercion, an absent field is not a number
        number = js_number(left)
    wanted = _literal_number(value)
    text = F.coalesce(js_string(left), F.lit(""))
    right_text = "" if value is None else (str(value).lower() if isinstance(value, bool) else str(value))
    if op == "contains":
        return F.contains(F.lower(text), F.lit(right_text.lower()))
    if op in ("==", "!="):
        same = text == F.lit(right_text)
        if wanted is not None:
            same = F.when(number.isNotNull(), number == F.lit(wanted)).otherwise(same)
        return same if op == "==" else ~same
    if op not in ORDERED:
        return F.lit(True)
    if wanted is None:
        return F.lit(False)
    if field in df.columns:
        plain = _plain(df, field, op, wanted)
        if plain is not None:
            return plain
    return F.coalesce(ORDERED[op](number, F.lit(wanted)), F.lit(False))


def rules_condition(df: DataFrame, rules: Iterable[dict], logic: str = "and") -> Column:
    tests = [rule_condition(df, r) for r in rules or []]
    if not tests:
        return F.lit(True)
    join = (lambda a, b: a | b) if logic == "or" else (lambda a, b: a & b)
    return reduce(join, tests)


def filter_rules(df: DataFrame, rules: Iterable[dict], logic: str = "and") -> DataFrame:
    """keep rows that meet all (``and``) or any (``or``) of the rules."""
    return df.filter(rules_condition(df, rules, logic))


def analysis_scope(df: DataFrame, rules: Iterable[dict], logic: str = "and", scope: str = "filtered") -> DataFrame:
    """the filtered rows, or every row."""
    return df if scope == "all" else filter_rules(df, rules, logic)


def only_types(df: DataFrame, *types: str, geometry: str = "geometry") -> DataFrame:
    """keep geometries of the given types."""
    return df.filter(F.col(geometry)["type"].isin(*types))


def allowed_for_kind(df: DataFrame, layer_kind: str, geometry: str = "geometry") -> DataFrame:
    """features a layer of this kind accepts; mixed and unknown layers accept all."""
    if layer_kind in ("mixed", "unknown"):
        return df
    return df.filter(geometry_kind(geometry) == layer_kind)


def search(df: DataFrame, text: str, fields: list[str] | None = None) -> DataFrame:
    """rows in which any value contains ``text``, ignoring case."""
    wanted = F.lit(text.lower())
    tests = [
        F.contains(F.lower(F.coalesce(js_string(F.col(f"`{f}`")), F.lit(""))), wanted) for f in fields or df.columns
    ]
    return df.filter(reduce(lambda a, b: a | b, tests))


def sort(df: DataFrame, field: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """order by a field (range-partitioned), ties by ``tie``."""
    c = F.col(f"`{field}`")
    keys = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    return df.orderBy(*keys, *([F.col(tie)] if tie else []))


def top_n(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """ranked head; runs as one top-n per partition, never a full sort."""
    return df.orderBy(*keys).limit(n)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """F10."""
    return df.limit(n)


def uniform_sample(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows without replacement, the k smallest seeded digests of the id.

    Independent of row order and partitioning, so batch and stream agree; top-n
    per partition keeps k rows at most.
    """
    ranked = df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))))
    return ranked.orderBy("_h", id_col).limit(k).drop("_h")


def presentation_mode(rows: Column) -> Column:
    """full / sample / grid by row count."""
    return F.when(rows <= FULL_LIMIT, "full").when(rows <= SAMPLE_LIMIT, "sample").otherwise("grid")
