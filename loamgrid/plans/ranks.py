"""Exact global order statistics without a one-task sort.

Values are first collapsed to distinct values with counts (a value that makes
up a third of the table becomes one row per map task), then dealt by ranges.
Range totals are few (one per range); the running count inside a range is a
partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.session import settle


def in_ranges(df: DataFrame, *names: str) -> DataFrame:
    """``df`` dealt by ranges of the columns ``names``, written once, which pins the ``_range`` of each row.

    There are as many ranges as the session has shuffle partitions; all rows equal in ``names`` share one.
    """
    k = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return settle(df.repartitionByRange(k, *names).withColumn("_range", F.spark_partition_id()))


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """``value, n, before, total``: rows strictly below each distinct non-null value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, value, "n")


def running_sum(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Add ``before`` (sum of ``measure`` over smaller keys) and ``total``; keys are unique."""
    placed = in_ranges(df, key)
    sums = placed.groupBy("_range").agg(F.sum(measure).alias("_s"))
    # one row per range
    lead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_s").over(lead), F.lit(0)).alias("_o"),
        F.sum("_s").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn("before", F.col("_o") + F.col("_in"))
        .drop("_range", "_o", "_in")
    )


def value_at_rank(counts: DataFrame, value: str, rank: Column) -> Column:
    """Aggregate: the value holding 0-based ``rank`` in a :func:`running_counts` table."""
    hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def global_rank(df: DataFrame, *keys: Column, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """1-based position of each row in the order of ``keys``, which must be unique together (within each group ``by``).

    Rows are range-partitioned (a repeated leading value or a large group is split by the later keys).  A range knows how
    many rows of each group the ranges before it hold.
    """
    by = list(by or [])
    names = [f"_k{i}" for i in range(len(keys))]
    placed = in_ranges(df.withColumns(dict(zip(names, keys))), *by, *names)
    inside = Window.partitionBy("_range", *by).orderBy(*names)
    placed = placed.withColumn("_i", F.row_number().over(inside))
    sizes = placed.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    lead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *by, F.coalesce(F.sum("_n").over(lead), F.lit(0)).alias("_start"))
    if by:  # most groups lie in one range and start at 0 there
        late = starts.filter("_start > 0").select(F.struct("_range", *by).alias("_late"), "_start")
        same = F.col("_range") == F.col("_late._range")
        for g in by:
            same = same & F.col(g).eqNullSafe(F.col(f"_late.{g}"))
        placed = placed.join(late, same, "left").drop("_late")
    else:
        placed = placed.join(F.broadcast(starts), "_range")
    return placed.withColumn(out, F.coalesce("_start", F.lit(0)) + F.col("_i")).drop("_range", "_i", "_start", *names)
