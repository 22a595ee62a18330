"""Scalar Column functions with the toolbox's coercion rules (P family).

Everything here is a Column builder: the expressions stay inside Catalyst, so
they fold, prune and push down like hand-written SQL.  ``typeof`` tests are
constant-folded at planning time, so each column pays only for its own branch.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from loamgrid.functions.geometry import let

# Spellings that count as true and false when a string is used as a condition.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0", ""]

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLAIN_DECIMAL = "^-?[0-9]+([.][0-9]+)?$"
NUMBER_PREFIX =r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
# Whitespace as an ECMAScript trim sees it.
BLANKS = r"[\s ﻿  ]+"



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_number(c: Column) -> Column:
    return F.typeof(c).isin(*NUMERIC_TYPES) | F.typeof(c).startswith("decimal")


def trim_all(c) -> Column:
    """Trim every kind of blank, not only U+0020."""
    return F.regexp_replace(_col(c).cast("string"), rf"^{BLANKS}|{BLANKS}$", "")


def finite(c) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def _digits_value(text: Column, base: int) -> Column:
    """Double value of all digits behind a two-character prefix, however many there are."""
    digits = F.regexp_extract_all(F.substr(text, F.lit(3)), F.lit("[0-9a-fA-F]"), F.lit(0))
    return F.aggregate(digits, F.lit(0.0), lambda acc, d: acc * F.lit(float(base)) + F.conv(d, 16, 10).try_cast("double"))


def js_number(c, null_as_zero: bool = True) -> Column:
    """Coerce any scalar to a finite double, or null.

    Blank text is 0, booleans are 0/1, surrounding blanks are ignored, ``0x``/``0b``/``0o``
    integers are read, anything else is null.  ``null_as_zero`` keeps null -> 0.
    """
    c = _col(c)
    raw = c.try_cast("double")
    text = trim_all(c)
    from_text = (
        F.when(text == "", F.lit(0.0))
        .when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))
        .when(text.rlike("^0[xX][0-9a-fA-F]+$"), _digits_value(text, 16))
        .when(text.rlike("^0[bB][01]+$"), _digits_value(text, 2))
        .when(text.rlike("^0[oO][0-7]+$"), _digits_value(text, 8))
    )
    value = finite(F.when(F.typeof(c) == "string", from_text).otherwise(raw))
    if null_as_zero:
        return F.when(c.isNull(), F.lit(0.0)).otherwise(value)
    return value


def parse_float(c) -> Column:
    """Read the longest numeric prefix of a text, or null."""
    return finite(_prefix_value(_number_prefix(c)))


def parse_float_once(c) -> Column:
    """:func:`parse_float` inside a lambda, where what repeats is computed again each time."""
    return let(let(_number_prefix(c), _prefix_value), finite)


def _number_prefix(c) -> Column:
    return F.regexp_extract(trim_all(c), NUMBER_PREFIX, 1)


def _prefix_value(prefix: Column) -> Column:
    return F.when(prefix != "", prefix.try_cast("double"))


def js_string(c) -> Column:
    """Text form of a scalar: whole doubles print without a fraction, no exponent for mid-range values."""
    c = _col(c)
    value = c.try_cast("double")
    plain = lambda scale: F.regexp_replace(
        value.try_cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", ""
    )
    size = F.abs(value)
    real = (
        F.when((value == F.floor(value)) & (size < 1e15), value.try_cast("bigint").cast("string"))
        .when((size >= 1e7) & (size < 1e21), plain(12))
        .when((size < 1e-3) & (size >= 1e-6), plain(24))
        .otherwise(c.cast("string"))
    )
    return F.when(F.typeof(c).isin("double", "float"), real).otherwise(c.cast("string"))


def truthy(c) -> Column:
    """Condition value of any scalar; never null."""
    c = _col(c)
    text = F.lower(trim_all(c))
    number = c.try_cast("double")
    from_text = F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False).otherwise(True)
    return F.coalesce(
        F.when(F.typeof(c) == "boolean", c.try_cast("boolean"))
        .when(_is_number(c), number != 0)
        .otherwise(from_text)
        & c.isNotNull(),
        F.lit(False),
    )


def _operand(c) -> Column:
    """Arithmetic operand: like js_number, but NaN (not null) for unreadable text."""
    return F.coalesce(js_number(c), F.lit(float("nan")))


def add(a, b) -> Column:
    return _operand(a) + _operand(b)


def subtract(a, b) -> Column:
    return _operand(a) - _operand(b)


def multiply(a, b) -> Column:
    return _operand(a) * _operand(b)


def divide(a, b) -> Column:
    """IEEE division; a zero divisor gives an infinity or NaN instead of an error."""
    x, y = _operand(a), _operand(b)
    at_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(
        F.signum(x) * F.lit(float("inf"))
    )
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def modulo(a, b) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor."""
    x, y = _operand(a), _operand(b)
    return F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y))


def power(a, b) -> Column:
    return F.pow(_operand(a), _operand(b))


def negate(a) -> Column:
    return -_operand(a)


def concat_text(*cols) -> Column:
    """Join text forms; null contributes nothing."""
    return F.concat(*[F.coalesce(js_string(c), F.lit("")) for c in cols])


def compare(left, op: str, right) -> Column:
    """Numeric comparison when both sides read as finite numbers, otherwise typed/lexical."""
    l, r = _col(left), _col(right)
    ln, rn = js_number(l), js_number(r)
    both = ln.isNotNull() & rn.isNotNull()
    ls, rs = l.cast("string"), r.cast("string")
    same_kind = (F.typeof(l) == F.typeof(r)) | (_is_number(l) & _is_number(r))
    same = F.coalesce(same_kind & (ls == rs), F.lit(False)) | (l.isNull() & r.isNull())
    # Ordering falls back to text only when both sides are text.
    both_text = (F.typeof(l) == "string") & (F.typeof(r) == "string")
    table = {
        "=": (ln == rn, same),
        "==": (ln == rn, same),
        "!=": (ln != rn, ~same),
        "<>": (ln != rn, ~same),
        "<": (ln < rn, both_text & (ls < rs)),
        "<=": (ln <= rn, both_text & (ls <= rs)),
        ">": (ln > rn, both_text & (ls > rs)),
        ">=": (ln >= rn, both_text & (ls >= rs)),
    }
    if op not in table:
        raise ValueError(f"unsupported comparison: {op}")
    numeric, other = table[op]
    return F.coalesce(F.when(both, numeric).otherwise(other), F.lit(False))


def both(a, b) -> Column:
    return truthy(a) & truthy(b)


def either(a, b) -> Column:
    return truthy(a) | truthy(b)


def negation(a) -> Column:
    return ~truthy(a)


def if_(cond, when_true, when_false) -> Column:
    """Branches are evaluated lazily, as CASE WHEN is."""
    return F.when(truthy(cond), _col(when_true)).otherwise(_col(when_false))


def replace_text(text, find: str, replacement: str) -> Column:
    """Replace every literal occurrence; an empty search text goes between characters."""
    t = F.coalesce(js_string(text), F.lit(""))
    if find == "":
        return F.array_join(F.split(t, "(?!^)(?!$)"), replacement)
    return F.replace(t, F.lit(find), F.lit(replacement))


def round_half_up(v, places=0) -> Column:
    """Halves go towards +infinity; ``places`` may be negative; a missing value is 0."""
    value = F.coalesce(js_number(v), F.lit(float("nan")))
    if isinstance(places, int):
        m = F.lit(float(10.0 ** places))
    else:
        m = F.pow(F.lit(10.0), F.coalesce(js_number(places), F.lit(0.0)))
    # Above 2^52 a double has no fraction left; floor() would overflow a bigint there.
    scaled = value * m
    whole = F.when(F.abs(scaled) < 4.5e15, F.floor(scaled + 0.5).cast("double")).otherwise(scaled)
    return whole / m


def upper(c) -> Column:
    return F.upper(F.coalesce(js_string(c), F.lit("")))


def lower(c) -> Column:
    return F.lower(F.coalesce(js_string(c), F.lit("")))


def text_length(c) -> Column:
    return F.length(F.coalesce(js_string(c), F.lit("")))


def display_value(c) -> Column:
    """Null and empty text show as ``(empty)``."""
    s = js_string(c)
    return F.when(s.isNull() | (s == ""), F.lit("(empty)")).otherwise(s)


def label_text(df, template: str | None = None, field: str | None = None) -> Column:
    """``{field}`` template, or one field, as a one-line label.

    The template is cut once on the driver; the result is one ``concat``.
    """
    columns = set(df.columns)

    def value(name: str) -> Column:
        return display_value(F.col(f"`{name}`")) if name in columns else F.lit("(empty)")

    if template and template.strip():
        parts: list[Column] = []
        last = 0
        for m in re.finditer(r"\{([^}]+)\}", template):
            if m.start() > last:
                parts.append(F.lit(template[last : m.start()]))
            parts.append(value(m.group(1).strip()))
            last = m.end()
        if last < len(template):
            parts.append(F.lit(template[last:]))
        raw = F.concat(*parts)
    elif field and field in columns:
        raw = F.coalesce(js_string(F.col(f"`{field}`")), F.lit(""))
    else:
        raw = F.lit("")
    return trim_all(F.regexp_replace(raw, r"[\r\n]+", " "))


def to_fixed(x, places: int) -> Column:
    """Decimal text of a non-negative double, rounded by its exact binary value, halves up.

    The product with 10^places is split into head and tail (Dekker), so values
    such as 12.8005 round by what the double holds, not by how it prints.
    """
    x = _col(x)
    m = float(10**places)
    big = x * 134217729.0
    head = big - (big - x)
    product = x * m
    tail = (head * m - product) + (x - head) * m
    n = F.floor(product + 0.5)
    off = (product - (n - 0.5)) + tail
    n = F.when(off < 0, n - 1).when(off >= 1, n + 1).otherwise(n).cast("bigint")
    unit = 10**places
    whole = F.floor(n / unit).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((n - whole * unit).cast("string"), places, "0"))


def format_distance(m) -> Column:
    """Metres below 1 km with one decimal, else kilometres with three."""
    m = _col(m)
    return F.when(m < 1000, F.concat(to_fixed(m, 1), F.lit(" m"))).otherwise(F.concat(to_fixed(m / 1000, 3), F.lit(" km")))


def format_area(sqm) -> Column:
    """Square metres, hectares from 1 ha, square kilometres from 1 km2."""
    a = _col(sqm)
    return (
        F.when(a < 10000, F.concat(to_fixed(a, 1), F.lit(" m²")))
        .when(a < 1e6, F.concat(to_fixed(a / 10000, 3), F.lit(" ha")))
        .otherwise(F.concat(to_fixed(a / 1e6, 4), F.lit(" km²")))
    )


def parse_lat_lng(text) -> Column:
    """P25: ``"lat, lng"`` text to struct(lat, lon), range-checked, else null."""
    halves = F.split(trim_all(text), r"[\s,]+")
    lat, lon = (F.get(halves, F.lit(i)).try_cast("double") for i in (0, 1))
    # no signs, exponents or words that a cast would take besides plain decimals
    plain = F.forall(halves, lambda h: h.rlike(PLAIN_DECIMAL))
    ok = (F.size(halves) == 2) & plain & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def slug(name, size: int = 48, default: str = "layer") -> Column:
    """Lower case, runs of other characters to ``-``, trimmed, bounded, never empty."""
    s = F.lower(F.coalesce(_col(name), F.lit("")))
    s = F.when(s == "", F.lit(default)).otherwise(s)
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, size)
    return F.when(s == "", F.lit(default)).otherwise(s)
