"""Structured Streaming forms of point ingest (ST1-ST4).

Each operator is the batch operator applied to a streaming table, so batch and
stream results agree by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgrid.functions.crs import tile_x, tile_y
from loamgrid.operators.aggregates import BIN_ZOOM, ingest_statistics
from loamgrid.operators.filters import uniform_sample
from loamgrid.sources.points import coordinate_columns, triage


def stream_points(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """ST1: triaged points from a folder of delimited files (stateless)."""
    raw = (
        spark.readStream.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    )
    return triage(raw, coordinate_columns(raw, probe=False))


def running_bins(points: DataFrame, zoom: int = BIN_ZOOM, event_time: str | None = None, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """ST2: running tile bins; per time window with a watermark when rows carry event time."""
    keys = [tile_x("lon", zoom).alias("tile_x"), tile_y("lat", zoom).alias("tile_y")]
    if event_time:
        points = points.withWatermark(event_time, late)
        keys = [F.window(event_time, every).alias("window"), *keys]
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"), F.avg("lat").alias("sample_lat"), F.avg("lon").alias("sample_lon")
    )


def running_statistics(triaged: DataFrame) -> DataFrame:
    """ST3: running counters and extent."""
    return ingest_statistics(triaged)


class Versions:
    """State kept across micro-batches as tables in the shared folder, one for each batch id.

    A batch merges its own rows with the version before it.  A replayed batch reads the same version and overwrites its
    own, so it counts once.  Nothing of the state stays on the driver.
    """

    latest: int

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _version(self, batch: int) -> str:
        return f"{self.path}/batch-{batch:012d}"

    def merged(self, rows: DataFrame, last: DataFrame | None) -> DataFrame:
        """The state after a batch of ``rows``, from the state before it."""
        raise NotImplementedError

    def merge(self, batch_df: DataFrame, batch: int) -> None:
        last = batch_df.sparkSession.read.parquet(self._version(batch - 1)) if batch > 0 else None
        self.merged(batch_df, last).write.mode("overwrite").parquet(self._version(batch))
        self.latest = batch

    def start(self, points: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = points.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.parquet(self._version(batch))


class RunningTable(Versions):
    """Counts, sums and extremes by key: ``measures`` names how a column of ``partial(batch)`` adds up (sum, min or max)."""

    def __init__(self, path: str, partial: Callable[[DataFrame], DataFrame], keys: list[str], measures: dict[str, str]):
        super().__init__(path)
        self.partial, self.keys, self.measures = partial, keys, measures

    def merged(self, rows: DataFrame, last: DataFrame | None) -> DataFrame:
        state = self.partial(rows).select(*self.keys, *self.measures)
        if last is not None:
            state = state.unionByName(last)
        return state.groupBy(*self.keys).agg(*[getattr(F, how)(c).alias(c) for c, how in self.measures.items()])


class RunningBins(RunningTable):
    """ST2: tile bins over all batches, by time window as well when rows carry event time; late rows count in their window."""

    def __init__(self, path: str, zoom: int = BIN_ZOOM, event_time: str | None = None, every: str = "1 hour"):
        keys = {"tile_x": tile_x("lon", zoom), "tile_y": tile_y("lat", zoom)}
        if event_time:
            keys["window"] = F.window(event_time, every)

        def partial(points: DataFrame) -> DataFrame:
            return points.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(
                F.count(F.lit(1)).alias("point_count"), F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum")
            )

        super().__init__(path, partial, list(keys), {"point_count": "sum", "lat_sum": "sum", "lon_sum": "sum"})

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        mean = [(F.col(f"{c}_sum") / F.col("point_count")).alias(f"sample_{c}") for c in ("lat", "lon")]
        return super().read(spark, batch).select(*self.keys, "point_count", *mean)


class RunningStatistics(RunningTable):
    """ST3: counters and extent over all batches."""

    def __init__(self, path: str):
        counters = ("row_count", "point_count", "skipped_rows", "invalid_rows")
        extent = {"minx": "min", "miny": "min", "maxx": "max", "maxy": "max"}
        super().__init__(path, ingest_statistics, [], {**dict.fromkeys(counters, "sum"), **extent})


class RunningSample(Versions):
    """ST4: a bounded uniform sample kept across micro-batches.

    The sample is the k smallest seeded hashes, so merging the last version with
    a batch's own k smallest is exact.
    """

    def __init__(self, path: str, k: int, id_col: str, seed: int = 42):
        super().__init__(path)
        self.k, self.id_col, self.seed = k, id_col, seed

    def merged(self, rows: DataFrame, last: DataFrame | None) -> DataFrame:
        own = uniform_sample(rows, self.k, self.id_col, self.seed)
        return own if last is None else uniform_sample(own.unionByName(last), self.k, self.id_col, self.seed)
