"""Helpers of the text operators: document columns, per-document Arrow maps, tables that cut lineage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from loamgrid.session import settle

#: Rows that a per-document function gets at once; bounds the Python objects alive in a task.
SLICE = 500


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the columns named; further columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def per_document(df: DataFrame, fn: Callable[[str], tuple], out: str, text: str = "text", before: Callable[[list], None] | None = None) -> DataFrame:
    """Apply ``fn`` to each text; its values replace the text column, the other columns are kept.  No shuffle.

    ``before`` gets the texts of a slice first, to do once what they share.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType(kept + _parse_datatype_string(out).fields)
    made = arrow_schema(out)
    target = to_arrow_schema(schema)
    at, names = df.columns.index(text), [i for i, c in enumerate(df.columns) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                if before:
                    before(texts)
                rows = [fn(t) for t in texts]
                cols = [batch.column(i).cast(target.field(k).type) for k, i in enumerate(names)]
                cols += [pa.array(c, type=f.type) for c, f in zip(zip(*rows), made)]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)


def text_key(text: str | Column = "text") -> Column:
    """With ``doc_id`` it tells rows apart that repeat an id; rows equal in both are the same document twice."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on ``names``."""
    test = F.lit(True)
    for n in names:
        test = test & left[n].eqNullSafe(right[n])
    return test


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write to the shared folder and read back.

    ``free`` lets go of the shuffle files of what came before, if the caller holds no more of it: the driver's garbage
    is collected twice, as the second collection finds what the first released.
    """
    jvm = df.sparkSession.sparkContext._jvm
    out = settle(df)
    del df
    for _ in range(2 * free):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    return out


def drop_settled(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
