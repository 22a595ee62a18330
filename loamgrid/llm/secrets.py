"""Secret scans: base patterns, and weak parts that count only beside complementary parts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import documents, per_document

ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run of these characters matches whole, so a shorter run can be passed over by its length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: an identifier, a secret-like token, an endpoint.
WEAK_ID = re.compile(r"(?:[cC]lient_?[iI]d|[kK]ey_?[iI]d|[uU]ser(?:_?[nN]ame)?|[lL]ogin)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws\.com|internal|local)\b")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SPANS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def _covered(spans: list[Span]):
    """Test whether an interval meets one of ``spans`` (sorted by start; running maximum of the ends)."""
    starts = [s for s, _, _ in spans]
    most, ends = -1, []
    for _, _, e in spans:
        most = max(most, e)
        ends.append(most)

    def test(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k > 0 and ends[k - 1] > start

    return test


def _near(spans: list[Span], scope: int):
    """Test whether an interval lies within ``scope`` code points of one of ``spans``: a sorted interval join."""
    hit = _covered([(s - scope, k, e + scope) for s, k, e in sorted(spans)])
    return hit if spans else lambda start, end: False


def linked_spans(text: str, base: list[Span], scope: int) -> list[Span]:
    """Weak parts with complementary parts in their scope.

    A secret-like token needs an identifier or an endpoint, an identifier needs a secret, an endpoint needs both.
    Strong parts (the base kinds) count as partners; a weak part that overlaps a base span is that span.
    """
    ids = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)] if "=" in text or ":" in text else []
    tokens = [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if _mixed(m[0])]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "." in text else []
    if not (ids or tokens or ends):
        return []
    taken = _covered(sorted(base))
    ids, tokens, ends = ([x for x in part if not taken(x[0], x[2])] for part in (ids, tokens, ends))
    near_id = _near([x for x in base if x[1] == 1] + ids, scope)
    near_secret = _near([x for x in base if x[1] != 1] + tokens, scope)
    near_end = _near(ends, scope)
    out = [x for x in tokens if near_id(x[0], x[2]) or near_end(x[0], x[2])]
    out += [x for x in ids if near_secret(x[0], x[2])]
    return out + [x for x in ends if near_id(x[0], x[2]) and near_secret(x[0], x[2])]


def all_spans(text: str, scope: int = 300) -> tuple[list[Span], list[Span]]:
    base = sorted(base_spans(text))
    return base, sorted(base + linked_spans(text, base, scope))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: one row per row of ``docs``.

    Identifiers, secrets and endpoints of a document meet in a sorted interval join over its scopes (``scope`` code
    points around a part), so a document with many parts makes no pairs.  Null and empty texts give no spans,
    repeated rows each get a row.  No shuffle.
    """

    def row(text: str) -> tuple:
        base, spans = all_spans(text, scope)
        n = [0, 0, 0]
        for _, k, _ in base:
            n[k] += 1
        return *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

    return per_document(documents(docs), row, SPANS)


def redact(text: str, scope: int = 300, mark: str = "[secret]") -> str:
    """``text`` with every run of spans replaced by ``mark``."""
    _, spans = all_spans(text, scope)
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def without_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew where something was replaced; null texts stay null."""
    df = docs.withColumn("text__", F.coalesce("text", F.lit("")))
    df = per_document(df, lambda t: (redact(t, scope),), "clean__ string", text="text__")
    changed = F.col("text").isNotNull() & (F.col("clean__") != F.col("text"))
    made = {"text": F.when(changed, F.col("clean__")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(changed, F.length("clean__").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.withColumns(made).select(*docs.columns)
