"""Symmetric positive definite matrices as tables of tiles: ``row, col, m`` for row <= col, ``m`` the tile's doubles row by row.

The inverse is a sweep over block columns.  With P the inverse of the pivot
tile, sweeping column k turns every tile A[i, j] elsewhere into A[i, j] -
A[i, k] P A[k, j], the column into A[i, k] P and the pivot into -P; after all
columns the matrix is minus its inverse.  Symmetry stays, so half of the tiles
is kept.  Tiles travel keyed by their place: a group of one update holds a tile
and the two tiles of the column that it needs, whatever the matrix's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import removed, written

#: Rows of a tile (2 MB of doubles): a sweep moves about three times the half matrix.
TILE_ROWS = 512
TILES = "row int, col int, m binary"


def frame(row: int, col: int, tile: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"row": [row], "col": [col], "m": [np.ascontiguousarray(tile).tobytes()]})


def column(tiles: DataFrame, k: int, n_tiles: int) -> DataFrame:
    """``at, width, old, new, kept`` of block column k: A[i, k] before and after its sweep, and the latter as it is kept. A group is a tile and the pivot."""
    mine = tiles.where((F.col("row") == k) | (F.col("col") == k))
    own = mine.select((F.col("row") + F.col("col") - k).alias("at"), F.lit(False).alias("pivot"), "m")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    pivots = mine.where((F.col("row") == k) & (F.col("col") == k)).select(every.alias("at"), F.lit(True).alias("pivot"), "m")

    def sweep(key, rows):
        at = key[0]
        pivot = np.frombuffer(rows.loc[rows["pivot"], "m"].iloc[0])
        n = round(len(pivot) ** 0.5)
        inverse = np.linalg.inv(pivot.reshape(n, n))
        inverse = (inverse + inverse.T) / 2
        m = np.frombuffer(rows.loc[~rows["pivot"], "m"].iloc[0])
        old = m.reshape(n, -1).T if at > k else m.reshape(-1, n)  # kept as A[k, i] where i is after k
        new = -inverse if at == k else old @ inverse
        return pd.DataFrame({"at": [at], "width": [n], "old": [old.tobytes()], "new": [new.tobytes()], "kept": [(new.T if at > k else new).tobytes()]})

    return own.unionByName(pivots).groupBy("at").applyInPandas(sweep, "at int, width int, old binary, new binary, kept binary")


def dealt(tiles: DataFrame, k: int, n_tiles: int) -> DataFrame:
    """``row, col, part, width, m``: what the update of each tile needs, at most three rows of a place.

    ``part``: the ``tile`` itself, ``left`` A[row, k] P and ``right`` A[col, k]; a tile of the column is ``swept`` alone.
    """
    place = lambda row, col, part: F.struct(row.alias("row"), col.alias("col"), F.lit(part).alias("part"))
    at = F.col("at")
    lefts = F.transform(F.sequence(at, F.lit(n_tiles - 1)), lambda j: place(at, j, "left"))
    rights = F.transform(F.sequence(F.lit(0), at), lambda i: place(i, at, "right"))
    others = F.filter(F.concat(lefts, rights), lambda p: (p["row"] != k) & (p["col"] != k))
    swept = F.array(place(F.least(at, F.lit(k)), F.greatest(at, F.lit(k)), "swept"))
    copies = column(tiles, k, n_tiles).select(F.explode(F.concat(others, swept)).alias("p"), "width", "old", "new", "kept")
    m = F.when(F.col("part") == "right", F.col("old")).when(F.col("part") == "left", F.col("new")).otherwise(F.col("kept"))
    rest = tiles.where((F.col("row") != k) & (F.col("col") != k)).select("row", "col", F.lit("tile").alias("part"), F.lit(None).cast("int").alias("width"), "m")
    return copies.select("p.*", "width", "old", "new", "kept").select("row", "col", "part", "width", m.alias("m")).unionByName(rest)


def swept(tiles: DataFrame, k: int, n_tiles: int) -> DataFrame:
    """``tiles`` after the sweep of block column k."""

    def update(key, rows):
        part = {name: np.frombuffer(m) for name, m in zip(rows["part"], rows["m"])}
        if "swept" in part:
            return frame(*key, part["swept"])
        width = int(rows["width"].max())
        left, right = part["left"].reshape(-1, width), part["right"].reshape(-1, width)
        return frame(*key, part["tile"].reshape(len(left), -1) - left @ right.T)

    return dealt(tiles, k, n_tiles).groupBy("row", "col").applyInPandas(update, TILES)


def negative_inverse(tiles: DataFrame, n_tiles: int) -> DataFrame:
    """Tiles of minus the inverse.

    The table after each sweep but the last is written to the shared folder and
    deleted once the next is there, so a lost executor costs one sweep at most;
    the last sweep is left to the caller's plan, with the table that it reads.
    A matrix of one tile is inverted in the plan, and nothing is written.
    """
    if n_tiles == 1:
        return column(tiles, 0, 1).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("kept").alias("m"))
    spark = tiles.sparkSession
    tiles, path = written(tiles, "tiles")
    for k in range(n_tiles - 1):
        following, new_path = written(swept(tiles, k, n_tiles), "tiles")
        removed(spark, path)
        tiles, path = following, new_path
    return swept(tiles, n_tiles - 1, n_tiles)
