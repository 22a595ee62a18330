"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: str | int = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loamgrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local masters."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="loamgrid-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans with something that survives executor
    loss, and gives the optimizer true file sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counting(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """:func:`settle`, and how many rows meet ``condition`` (observed while writing)."""
    seen = Observation()
    out = settle(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"]


def has_rows(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) > 0
