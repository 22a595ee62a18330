"""Convex hull as a two-phase aggregate (G16): hulls of partitions, then hulls of hulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FAN_IN = 16


def _outer(xy: np.ndarray) -> np.ndarray:
    """Points that can be hull vertices: those not strictly inside the octagon of extremes."""
    if len(xy) < 64:
        return xy
    x, y = xy[:, 0], xy[:, 1]
    scores = [x, x + y, y, y - x, -x, -x - y, -y, x - y]
    corner = xy[[int(np.argmax(s)) for s in scores]]
    inside = np.ones(len(xy), bool)
    for a, b in zip(corner, np.roll(corner, -1, axis=0)):
        if (a == b).all():
            continue
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0
    return xy[~inside]


def hull_vertices(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull from the lowest-left point (Andrew's monotone chain)."""
    pts = np.unique(_outer(xy), axis=0)
    if len(pts) <= 2:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append((p[0], p[1]))
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = np.empty((0, 2))
    for pdf in batches:
        xy = pdf[["x", "y"]].to_numpy(float)
        kept = hull_vertices(np.vstack([kept, xy[np.isfinite(xy).all(axis=1)]]))
    yield pd.DataFrame(kept, columns=["x", "y"])


def convex_hull(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row ``hull array<struct<x,y>>``.  Each level of the tree merges 16 partial hulls,
    so no task sees more than the vertices of 16 hulls (plus its own input at the first level)."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    level = points.mapInPandas(lambda b: _reduce(b), "x double, y double")
    while width > 1:
        width = -(-width // FAN_IN)
        level = level.repartition(width).mapInPandas(lambda b: _reduce(b), "x double, y double")
    ordered = level.mapInPandas(lambda b: _number(b), "i int, x double, y double")
    return ordered.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "x", "y"))),
            lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")),
        ).alias("hull")
    )


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hull = hull_vertices(pdf[["x", "y"]].to_numpy(float))
        yield pd.DataFrame({"i": np.arange(len(hull)), "x": hull[:, 0], "y": hull[:, 1]})
