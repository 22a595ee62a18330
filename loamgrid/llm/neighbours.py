"""Permutation index: vectors as their ordered nearest pivots, inverted files by pivot, footrule ranking, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loamgrid.llm.base import arrow_schema, cut

#: The pivots are the distinct vectors with the least hash, this many at most: the one bounded sample.
PIVOTS = 192
#: Vectors of a block of an inverted file.
BLOCK = 4096


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: rows whose vector is neither null, empty nor zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & ~bad & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _choose_pivots(classes: DataFrame, rows: int, pivots: int) -> np.ndarray:
    """Distinct vectors with the least hash, a pivot for 32 vectors at most: the only rows that reach the driver."""
    want = min(pivots, max(16, rows // 32))
    return np.array([r.v for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(want).collect()], dtype=float)


def _permutations(df: DataFrame, pivots: np.ndarray, length: int, most: float, query: bool) -> DataFrame:
    """Adds ``perm``: the nearest pivots in order.  Inner product search is turned into search by angle: vectors get
    a component that brings them to the greatest norm, queries a zero there."""
    def lifted(m: np.ndarray, as_query: bool) -> np.ndarray:
        norm = (m * m).sum(axis=1)
        last = np.zeros(len(m)) if as_query else np.sqrt(np.maximum(most * most - norm, 0.0))
        return np.hstack([m, last[:, None]])

    p = lifted(pivots, False)
    length = min(length, len(p))
    out = "id long, v array<double>, perm array<int>"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                near = lifted(_matrix(batch.column(1)), query) @ p.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :length].astype("int32")
                perm = pa.ListArray.from_arrays(np.arange(0, order.size + 1, length, dtype="int32"), order.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), perm.cast(schema.field(2).type)], schema=schema)

    return df.select("id", "v").mapInArrow(run, out)


def _search(pivot_count: int, k: int, share: float):
    """Of one block: each query's ``k`` nearest among the candidates with the least footrule distance."""
    out = arrow_schema("query_id long, id long, score double")

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        queries, vectors = queries.combine_chunks(), vectors.combine_chunks().sort_by("id")
        if not queries.num_rows or not vectors.num_rows:
            return out.empty_table()

        def column(t: pa.Table, name: str) -> pa.Array:
            c = t.column(name)
            return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)

        ids, vs, perm = np.asarray(column(vectors, "id")), _matrix(column(vectors, "v")), _matrix(column(vectors, "perm"))
        m = perm.shape[1]
        place = np.full((len(ids), pivot_count), m, dtype="int16")
        np.put_along_axis(place, perm.astype(int), np.arange(m, dtype="int16")[None, :], axis=1)
        keep = max(4 * k, int(share * len(ids)))
        asked, got, scores = [], [], []
        for q, qv, qp in zip(np.asarray(column(queries, "id")), _matrix(column(queries, "v")), _matrix(column(queries, "perm"))):
            at = place[:, qp.astype(int)]
            footrule = (np.abs(at - np.arange(m)) - (m - at)).sum(axis=1)
            near = np.argsort(footrule, kind="stable")[:keep]
            score = (vs[near] * qv).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            asked.append(np.full(len(best), q))
            got.append(ids[near][best])
            scores.append(score[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (asked, got, scores)], schema=out)

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", length: int = 32,
            post: int = 12, probe: int = 16, pivots: int = PIVOTS, share: float = 0.4) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` vectors of ``df`` with the largest inner product found.

    ``df`` and ``queries`` have the columns ``key`` and ``vector``; a query is never its own candidate.  Equal vectors
    form one class, of which only the ``k + 1`` least ids can be in an answer: a group of copies of any size costs as
    much as ``k + 1`` vectors, and equal queries are searched once.  A vector is posted under its ``post`` nearest
    pivots, a query looks under its ``probe`` nearest, and long files are split into blocks by a hash.
    In a block the ``share`` with the least footrule distance over the first ``length`` pivots is scored.  Null, zero and non-finite vectors, null ids and
    rows of another length than the first pivot's take no part; an id that repeats counts once, with the least of its vectors; ties go to the lesser id.
    """
    rows = valid_vectors(df, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    asked = valid_vectors(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    one = Window.partitionBy("v").orderBy("id")
    members = cut(rows.withColumn("r", F.row_number().over(one)).where(F.col("r") <= k + 1))
    classes = members.where("r = 1").select("id", "v")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    if not stats.n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = _choose_pivots(classes, stats.n, pivots)
    size, most = pivots.shape[1], float(np.sqrt(stats.most))
    fits = F.size("v") == size
    wanted = asked.where(fits).groupBy("v").agg(F.min("id").alias("id"))
    index = _permutations(classes.where(fits), pivots, length, most, False)
    index = cut(index)
    looking = cut(_permutations(wanted, pivots, length, most, True))
    posted = index.select("id", "v", "perm", F.explode(F.slice("perm", 1, post)).alias("pivot"))
    # one row a pivot: its number of blocks
    blocks = posted.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    posted = posted.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    probing = looking.select("id", "v", "perm", F.explode(F.slice("perm", 1, probe)).alias("pivot")).join(F.broadcast(blocks), "pivot")
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (
        probing.drop("blocks").groupBy("pivot", "block").cogroup(posted.drop("blocks").groupBy("pivot", "block"))
        .applyInArrow(_search(len(pivots), k + 1, share), "query_id long, id long, score double")
    )
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.dropDuplicates(["query_id", "id"]).withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    of_class = members.join(classes.select(F.col("id").alias("class"), "v"), "v").select("class", F.col("id").alias("vec_id"))
    answers = found.join(of_class, found.id == of_class["class"]).select(F.col("query_id").alias("class"), "vec_id", "score")
    best = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    each = asked.where(fits).join(looking.select(F.col("id").alias("class"), "v"), "v").select(F.col("id").alias("query_id"), "class").distinct()
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = each.join(answers, "class").where("query_id <> vec_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
