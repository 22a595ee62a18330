"""Raster cells as rows: ids, tiles, halos and neighbours.

A raster is a table ``row, col, <value>``.  Stencil operators shuffle cells
once, by tile, with a rim of copies for neighbouring tiles; every later window
or aggregate clusters on the tile columns and needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Cell id = row * STRIDE + col, exact in a bigint for rows and columns below 2^31.
STRIDE = 1 << 31
TILE = 256

# D8 neighbours in tie order E, SE, S, SW, W, NW, N, NE as (row step, col step, code).
D8 = [
    (0, 1, 1),
    (1, 1, 2),
    (1, 0, 4),
    (1, -1, 8),
    (0, -1, 16),
    (-1, -1, 32),
    (-1, 0, 64),
    (-1, 1, 128),
]


def cell_id(row="row", col="col") -> Column:
    row = F.col(row) if isinstance(row, str) else row
    col = F.col(col) if isinstance(col, str) else col
    return row.cast("bigint") * F.lit(STRIDE) + col.cast("bigint")


def id_row(c="id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.shiftright(c, 31)).cast("bigint")


def id_col(c="id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.bitwiseAND(F.lit(STRIDE - 1))


def div(c: Column, n: int) -> Column:
    """Floor division for possibly negative whole numbers."""
    return F.floor(c / F.lit(float(n))).cast("bigint")


def with_tile(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``tr, tc`` and ``rim`` (true on the outer ring of the tile)."""
    r, c = F.col("row"), F.col("col")
    edge = (
        r.__mod__(tile).isin(0, tile - 1) | c.__mod__(tile).isin(0, tile - 1)
    )
    return df.withColumns({"tr": div(r, tile), "tc": div(c, tile), "rim": edge})


def with_halo(df: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """Copy every cell into each tile within ``reach`` of it; ``core`` marks the owner.

    One exchange; the copies are (1 + 2*reach/tile)^2 of the input.
    """
    tile = max(tile, 2 * reach)
    r, c = F.col("row"), F.col("col")

    def span(v):
        return F.sequence(div(v - reach, tile), div(v + reach, tile))

    spread = df.withColumn("tr", F.explode(span(r))).withColumn("tc", F.explode(span(c)))
    core = (F.col("tr") == div(r, tile)) & (F.col("tc") == div(c, tile))
    return spread.withColumn("core", core).repartition("tr", "tc")


def neighbours(df: DataFrame, value: str = "z", tile: int = TILE) -> DataFrame:
    """Each non-null cell with the values of its 8 neighbours as ``n0..n7`` (null = missing).

    The offsets are exploded after the tile exchange, so the 9 contributions of
    a cell meet in memory instead of on the network.
    """
    cells = with_halo(df.filter(F.col(value).isNotNull()).select("row", "col", value), 1, tile)
    steps = F.array(
        F.struct(F.lit(-1).alias("k"), F.lit(0).alias("dr"), F.lit(0).alias("dc")),
        *[
            F.struct(F.lit(k).alias("k"), F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"))
            for k, (dr, dc, _) in enumerate(D8)
        ],
    )
    spread = cells.select("tr", "tc", "core", "row", "col", value, F.explode(steps).alias("o"))
    met = spread.groupBy(
        "tr", "tc", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")
    ).agg(
        F.max(F.when((F.col("o.k") == -1) & F.col("core"), F.col(value))).alias(value),
        *[F.max(F.when(F.col("o.k") == k, F.col(value))).alias(f"n{k}") for k in range(8)],
    )
    return met.filter(F.col(value).isNotNull()).drop("tr", "tc")


def densify(df: DataFrame, value: str = "z") -> DataFrame:
    """Add the missing positions of the bounding rectangle as rows with a null value.

    Rows of the rectangle are generated per raster row on the executors.
    """
    box = df.agg(
        F.struct(
            F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
        ).alias("b")
    )
    frame = (
        box.select(F.explode(F.sequence("b.r0", "b.r1")).alias("row"), "b")
        .repartition("row")
        .select("row", F.explode(F.sequence("b.c0", "b.c1")).alias("col"))
    )
    blank = frame.withColumn(value, F.lit(None).cast(df.schema[value].dataType))
    return (
        df.select("row", "col", value).unionByName(blank).groupBy("row", "col").agg(F.max(value).alias(value))
    )
