"""Importance resampling towards a target: hashed n-gram gains, Gumbel noise by document, an exact cutoff by bisection.

1.  Runs of 1 to ``longest`` words fall into ``buckets`` by crc32.  Each task adds up one array of counts over its texts; the
    sums of both tables give one gain a bucket, an array of ``buckets`` numbers that every task gets.
2.  A document's weight is the floored mean of its features' gains; its score adds noise from a hash of its id, so the
    highest scores are a sample without replacement.  Scores are written to the shared folder once.
3.  The cutoff is a number: repeated jobs count the rows up to ``PROBES`` thresholds, exactly, and narrow the range until one
    score is left; among its ties the same is done with ``doc_id``, and among rows that repeat one with their row number.
4.  The drawn rows are dealt by ranges of (score, doc_id); a row's rank is its place in its range plus the ranges before.

Rows: null and empty texts have no features, weight 0 and no part in the draw; a null ``doc_id`` is hashed as nothing after
the seed and loses ties; of rows that repeat an id as many are drawn as there is room for; no documents give no rows; an
empty target leaves a gain that only depends on the documents; columns but ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.llm.base import arrow_schema, cut, documents, drop_settled

#: Thresholds that one job counts at.
PROBES = 31
#: Drawn rows in a range.
RANGE_ROWS = 200_000
LAST_ID = (1 << 63) - 1


def _fold() -> bytes:
    """Lowers A-Z; all signs below 0x80 but letters and digits become blanks."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    return bytes(table)


FOLD = _fold()


def features(text: str, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to ``longest`` of them.

    The crc of a run goes on from the crc of the run one word shorter.
    """
    words = text.encode().translate(FOLD).split()
    if not words:
        return 0, np.zeros(0, np.int64)
    crcs = list(map(zlib.crc32, words))
    found = [crcs]
    more = [b" " + w for w in words[1:]]
    for k in range(1, min(longest, len(words))):
        crcs = list(map(zlib.crc32, more[k - 1 :], crcs))
        found.append(crcs)
    return len(words), np.fromiter((c for f in found for c in f), np.int64, sum(map(len, found))) % buckets


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    schema = arrow_schema("bucket int, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(features(text, buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    out = np.zeros(buckets, np.int64)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed target share over the source share, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 2, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each document.  No shuffle."""
    out = "doc_id long, n_words long, n_features long, weight long, score long"
    schema = arrow_schema(out)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n_words, at = features(text, len(gain), longest)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                rows.append((doc_id, n_words, len(at), weight, weight + noise(doc_id, seed)))
            cols = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    return documents(docs).mapInArrow(run, out)


def nth_value(rows: DataFrame, value: Column, n: int) -> tuple[int, int]:
    """The ``n``-th smallest ``value`` (long), and how many are less: by exact counts at thresholds, range by range."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    under = 0
    while low < high:
        step = (high - low) // (PROBES + 1) + 1
        at = [t for t in range(low, high, step)][: PROBES + 1]
        seen = rows.agg(*[F.count_if(value <= F.lit(t).cast("long")).alias(f"c{i}") for i, t in enumerate(at)]).first()
        for t, c in zip(at, seen):
            if c >= n:
                high = t
                break
            low, under = t + 1, c
    return low, under


def drawn(rows: DataFrame, n: int) -> Column:
    """Which of the settled ``rows(least, id, row)`` are the first ``n`` by these three, as a test on them."""
    taken = F.lit(False)
    tied = F.lit(True)
    for name in ("least", "id", "row"):
        value, under = nth_value(rows.where(tied), F.col(name), n)
        taken = taken | (tied & (F.col(name) < value))
        tied = tied & (F.col(name) == value)
        n -= under
        if rows.where(tied).count() == n:
            break
    return taken | tied


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` ``rows`` with ``rank`` from 1, by (``least``, ``id``, ``row``)."""
    dealt = cut(rows.repartitionByRange(n // RANGE_ROWS + 1, "least", "id", "row").withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = before.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("least", "id", "row"))
    return dealt.withColumn("place", place).join(before, "part").withColumn("rank", F.col("start") + F.col("place")).drop("part", "start", "place")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7
) -> DataFrame:
    """Per document ``doc_id, n_features, weight, score, rank``; ``rank`` is null where the document is not drawn.

    Drawn are the ``percent`` highest scores, rounded down, of the documents with ``min_words`` words.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = cut(
        scored(docs, gain, longest, seed).select(
            "*", (-F.col("score")).alias("least"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.monotonically_increasing_id().alias("row")
        )
    )
    fit = rows.where(F.col("n_words") >= min_words)
    n = percent * fit.count() // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if n == 0:
        return rows.select(*shown, none)
    chosen = (F.col("n_words") >= min_words) & drawn(fit, n)
    return ranked(rows.where(chosen), n).select(*shown, "rank").unionByName(rows.where(~chosen).select(*shown, none))


def importance_sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; all rows of a drawn id come."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select(F.struct("doc_id").alias("drawn")).distinct()
    mine = docs.select(F.struct(*docs.columns).alias("row"))
    return mine.join(ids, F.col("row.doc_id").cast("long").eqNullSafe(F.col("drawn.doc_id")), "left_semi").select("row.*")


ORACLE = """
WITH table8 AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(i)
  )
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), df AS (
  SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM docs) GROUP BY ALL
), bf AS (
  SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM items) GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda j: 16 * (instr('0123456789ABCDEF', substr(h, 2 * j - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * j, 1)) - 1)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, table8
), sums AS (
  SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (
    SELECT bucket, n AS s, 0 AS t FROM df JOIN hashed USING (f) UNION ALL SELECT bucket, 0, n FROM bf JOIN hashed USING (f)
  ) GROUP BY bucket
), totals AS (
  SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM docs d LEFT JOIN weights w USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS fit FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN r <= 25 * fit // 100 THEN r END AS rank
FROM scores LEFT JOIN ranks USING (doc_id)
"""
