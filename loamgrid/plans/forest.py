"""Downstream forests: sums and labels carried along ``id -> down`` links.

A forest is a table ``id, down`` where ``down`` is null at a root.  Two
questions are answered for every node:

* :func:`accumulate` - the sum of a weight over the node and all nodes above it;
* :func:`resolve`    - the label of the first labelled node on its way down.

Both use pointer doubling: after round *k* a node looks 2^k links ahead, so the
number of rounds is the logarithm of the longest path.  For raster forests
(``tr, tc`` tile columns present) each tile is first contracted on its own, so
that only cells which receive water from another tile take part in the
doubling: about 4/T of the cells for tiles of side T.  Tile groups hold at
most T*T rows by construction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.session import settle, settle_counting


# ------------------------------------------------------------- local, one tile
def _local_links(ids: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Position of each node's successor inside the tile, -1 when it lies outside."""
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    at = np.clip(np.searchsorted(ranked, down), 0, len(ids) - 1)
    return np.where((down >= 0) & (ranked[at] == down), order[at], -1)


def _local_sum(link: np.ndarray, weight: np.ndarray) -> np.ndarray:
    total, ahead = weight.astype(float), link.copy()
    while True:
        live = np.flatnonzero(ahead >= 0)
        if not len(live):
            return total
        total = total + np.bincount(ahead[live], weights=total[live], minlength=len(total))
        ahead[live] = ahead[ahead[live]]


def _local_last(link: np.ndarray) -> np.ndarray:
    """The last node of each path that is still inside the tile."""
    last = np.where(link >= 0, link, np.arange(len(link)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def _whole(values: pd.Series) -> np.ndarray:
    """64-bit ids as they are; a column with nulls would come as doubles, which hold no more than 53 bits."""
    if values.dtype != np.int64:
        raise TypeError(f"{values.name}: ids must not be null here, got {values.dtype}")
    return values.to_numpy()


def _contract_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, down = _whole(pdf["id"]), _whole(pdf["down"])
    link = _local_links(ids, down)
    total = _local_sum(link, pdf["w"].to_numpy(float))
    leave = down[_local_last(link)]
    out = (link < 0) & (down >= 0)
    rim = pdf["rim"].to_numpy(bool)
    links = pd.DataFrame({"id": ids[rim], "next": leave[rim], "s": np.nan})
    sums = pd.DataFrame({"id": down[out], "next": -1, "s": total[out]})
    return pd.concat([links, sums], ignore_index=True)


def _finish_sums(pdf: pd.DataFrame, inflow: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({"id": np.array([], np.int64), "acc": np.array([], float)})
    ids = _whole(pdf["id"])
    weight = pdf["w"].to_numpy(float)
    if len(inflow):
        weight = weight + inflow.set_index("id")["s"].reindex(ids).fillna(0.0).to_numpy()
    return pd.DataFrame({"id": ids, "acc": _local_sum(_local_links(ids, _whole(pdf["down"])), weight)})


def _contract_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, down = _whole(pdf["id"]), _whole(pdf["down"])
    label, held = _whole(pdf["label"]), pdf["held"].to_numpy(bool)
    last = _local_last(np.where(held, -1, _local_links(ids, down)))
    return pd.DataFrame({"id": ids, "label": label[last], "held": held[last], "next": np.where(held[last], -1, down[last])})


# ------------------------------------------------------------------- doubling
def _double_sums(nodes: DataFrame) -> DataFrame:
    """``id, next, s`` -> ``id, s`` with s summed over everything above (and at) the node."""
    state, moving = settle_counting(nodes, "next IS NOT NULL")
    while moving:
        live = state.filter("next IS NOT NULL")
        # map-side combine keeps a busy confluence from becoming one hot task
        gain = live.groupBy(F.col("next").alias("id")).agg(F.sum("s").alias("gain"))
        hop = state.select(F.col("id").alias("next"), F.col("next").alias("hop"))
        moved = live.join(hop, "next", "left").select("id", F.col("hop").alias("next"), "s")
        still = state.filter("next IS NULL")
        state, moving = settle_counting(
            moved.unionByName(still)
            .join(gain, "id", "left")
            .select("id", "next", (F.col("s") + F.coalesce("gain", F.lit(0.0))).alias("s")),
            "next IS NOT NULL",
        )
    return state.select("id", "s")


def _double_labels(nodes: DataFrame) -> DataFrame:
    """``id, next, label`` -> ``id, label``; unresolved nodes keep a null label."""
    state, moving = settle_counting(nodes, "next IS NOT NULL AND label IS NULL")
    while moving:
        live = state.filter("next IS NOT NULL AND label IS NULL")
        done = state.filter("next IS NULL OR label IS NOT NULL")
        hop = state.select(
            F.col("id").alias("next"), F.col("next").alias("hop"), F.col("label").alias("found")
        )
        moved = live.select("id", "next").join(hop, "next", "left").select(
            "id", F.col("hop").alias("next"), F.col("found").alias("label")
        )
        state, moving = settle_counting(
            moved.unionByName(done.select("id", "next", "label")), "next IS NOT NULL AND label IS NULL"
        )
    return state.select("id", "label")


# --------------------------------------------------------------------- public
def _no_null(name: str) -> Column:
    """The bigint column with -1 for null."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-1).cast("bigint")).alias(name)


def accumulate(nodes: DataFrame) -> DataFrame:
    """``id, down, w [, tr, tc, rim]`` -> ``id, acc``."""
    if "tr" not in nodes.columns:
        done = _double_sums(nodes.select("id", F.col("down").alias("next"), F.col("w").cast("double").alias("s")))
        return done.select("id", F.col("s").alias("acc"))
    nodes = nodes.select("id", _no_null("down"), F.col("w").cast("double").alias("w"), "tr", "tc", "rim")
    piece = settle(
        nodes.groupBy("tr", "tc").applyInPandas(
            lambda p: _contract_sums(p), "id long, next long, s double"
        )
    )
    base = piece.filter("NOT isnan(s) AND s IS NOT NULL").groupBy("id").agg(F.sum("s").alias("s"))
    links = piece.filter("isnan(s) OR s IS NULL").select("id", F.expr("nullif(next, -1)").alias("next"))
    inflow = _double_sums(links.join(base, "id").select("id", "next", "s"))
    doors = nodes.filter("rim").select("id", F.col("tr").alias("door_tr"), F.col("tc").alias("door_tc"))
    placed = inflow.join(doors, "id")
    return (
        nodes.groupBy("tr", "tc")
        .cogroup(placed.groupBy("door_tr", "door_tc"))
        .applyInPandas(lambda p, q: _finish_sums(p, q), "id long, acc double")
    )


def resolve(nodes: DataFrame) -> DataFrame:
    """``id, down, label [, tr, tc]`` -> ``id, label``."""
    if "tr" not in nodes.columns:
        return _double_labels(nodes.select("id", F.col("down").alias("next"), F.col("label").cast("long")))
    local = settle(
        nodes.select("id", _no_null("down"), _no_null("label"), F.col("label").isNotNull().alias("held"), "tr", "tc")
        .groupBy("tr", "tc")
        .applyInPandas(lambda p: _contract_labels(p), "id long, label long, held boolean, next long")
        .select("id", F.when(F.col("held"), F.col("label")).alias("label"), F.expr("nullif(next, -1)").alias("next"))
    )
    open_ = local.filter("label IS NULL AND next IS NOT NULL")
    doors = open_.select(F.col("next").alias("id")).distinct()
    door_label = _double_labels(local.join(doors, "id", "left_semi").select("id", "next", "label"))
    late = open_.select("id", "next").join(
        door_label.select(F.col("id").alias("next"), "label"), "next", "left"
    )
    fixed = local.filter("label IS NOT NULL OR next IS NULL")
    return late.select("id", "label").unionByName(fixed.select("id", "label"))
