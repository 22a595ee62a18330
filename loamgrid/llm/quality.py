"""Host-level quality rules: failure rates by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import cut, documents, per_document, same, text_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def digest(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in repeated 3-word windows."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        once: set = set()
        twice = {w for w in windows if w in once or once.add(w)}
        end = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, end)
                end = i + 3
    del seen
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def digests(docs: DataFrame, host: str = "source") -> DataFrame:
    """One settled row per document: ``doc_id, host, text_key``, the digest and ``base_failed``."""
    df = documents(docs, F.col(host).cast("string").alias("host")).withColumn("text_key", text_key())
    df = per_document(df, digest, DIGEST)
    return cut(df.withColumn("base_failed", F.expr(f"{RULES['short']} OR {RULES['repeats']}")))


def host_verdicts(rows: DataFrame, limit: float = 0.5, rules: dict[str, str] | None = None) -> DataFrame:
    """``host, host_docs, host_failed``: whether the shrunk rate of any rule passes ``limit``.

    A rule's rates over the hosts fit a beta prior by moments (mean ``m``, pseudo-documents ``s``, kept within 1
    and a million); a host's shrunk rate is ``(failures + s * m) / (documents + s)``.  Documents without a host
    take no part.  The rates of all hosts collapse to two numbers a rule, which are joined back as one row.
    """
    rules = rules or RULES
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("host_docs"), *[F.count_if(F.expr(r)).alias(f"f_{k}") for k, r in rules.items()]
    )
    rates = [F.expr(f"f_{k} / host_docs") for k in rules]
    prior = hosts.agg(*[F.struct(F.avg(p).alias("m"), F.var_pop(p).alias("v")).alias(k) for k, p in zip(rules, rates)])
    judged = hosts.join(F.broadcast(prior))  # one row
    failed = F.lit(False)
    for k in rules:
        m, v = F.col(f"{k}.m"), F.col(f"{k}.v")
        strength = F.when(v > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(1e6))
        failed = failed | ((F.col(f"f_{k}") + strength * m) / (F.col("host_docs") + strength) > limit)
    return judged.select("host", "host_docs", failed.alias("host_failed"))


def host_quality(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """``doc_id, text_key``, the digest, ``base_failed``, ``kept``: one row per row of ``docs``.

    A document is kept if it passes the base rules and its host is not rejected.  Null texts count as empty (and
    fail as short), documents without a host are judged by the base rules alone, repeated rows each get a row,
    an empty table gives an empty one.  The join on hosts brings a row per host; Spark splits a hot host's side.
    """
    rows = digests(docs, host)
    hosts = host_verdicts(rows, limit).withColumnRenamed("host", "of")
    out = rows.join(hosts, rows.host == hosts.of, "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    return out.select("doc_id", "text_key", *[c.split()[0] for c in DIGEST.split(", ")], "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`host_quality` keeps, with all their columns."""
    good = host_quality(docs, host).where("kept").select("doc_id", "text_key").distinct()
    keyed = docs.withColumn("text_key", text_key())
    return keyed.join(good, same(keyed, good, "doc_id", "text_key"), "left_semi").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS k
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) AS x WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) AS y GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) AS z
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.rid = w.rid LEFT JOIN ln ON ln.rid = w.rid),
f AS (SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 10 * n_symbols > 3 * n_words AS r3,
             word_chars < 2 * n_words OR word_chars > 15 * n_words AS r4 FROM b),
h AS (SELECT source, count(*) AS n, [count(*) FILTER (r1), count(*) FILTER (r2), count(*) FILTER (r3), count(*) FILTER (r4)] AS c
      FROM f WHERE source IS NOT NULL GROUP BY source),
u AS (SELECT source, n, unnest(c) AS c, unnest([1, 2, 3, 4]) AS r FROM h),
p AS (SELECT r, avg(c / n) AS m, var_pop(c / n) AS v FROM u GROUP BY r),
s AS (SELECT u.source, u.n, u.c, p.m, CASE WHEN p.v > 0 THEN least(1e6, greatest(1e0, p.m * (1 - p.m) / p.v - 1)) ELSE 1e6 END AS s
      FROM u JOIN p ON u.r = p.r),
q AS (SELECT source, bool_or((c + s * m) / (n + s) > 5e-1) AS bad FROM s GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
       NOT (r1 OR r2) AND NOT coalesce(q.bad, false) AS kept
FROM f LEFT JOIN q ON f.source = q.source
"""
