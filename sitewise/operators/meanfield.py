"""Mean-field couplings: covariance of one-hot symbols, its inverse, and what follows from it.

Counting is done in Spark.  The covariance matrix has (positions x (symbols -
1)) rows, whatever the number of sequences; it is inverted tile by tile
(``linear.negative_inverse``), so that no task holds more than a few tiles, and
the couplings come back as a long table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear

#: Site frequencies of as many rows (a few MB) are broadcast, more are joined by shuffles.
BROADCAST_ROWS = 100_000


def regularized_sites(sites: DataFrame, n_symbols: int, pseudo: float = 0.5) -> DataFrame:
    return sites.withColumn("frequency", (1 - pseudo) * F.col("frequency") + pseudo / n_symbols)


def regularized_pairs(pairs: DataFrame, length: int, n_symbols: int, pseudo: float = 0.5) -> DataFrame:
    """All symbol pairs of all i < j."""
    spark = pairs.sparkSession
    sites = spark.range(1, length + 1).select(F.col("id").cast("int").alias("i"))
    symbols = F.sequence(F.lit(0), F.lit(n_symbols - 1))
    every = sites.where(F.col("i") < length).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(length))).alias("j")).select("i", "j", F.explode(symbols).alias("a")).select("i", "j", "a", F.explode(symbols).alias("b"))
    filled = every.join(pairs, ["i", "j", "a", "b"], "left")
    return filled.select("i", "j", "a", "b", ((1 - pseudo) * F.coalesce("frequency", F.lit(0.0)) + pseudo / n_symbols**2).alias("frequency"))


def covariance_blocks(pairs: DataFrame, sites: DataFrame, length: int, n_symbols: int) -> DataFrame:
    """``i, j, v`` for i <= j: the covariance of all symbols but the last at two positions, row by row, from regularised frequencies."""
    q = n_symbols - 1
    f = sites.where(F.col("sym") < q)
    at = lambda pos, sym, name: f.select(F.col("pos").alias(pos), F.col("sym").alias(sym), F.col("frequency").alias(name))
    fi, fj = at("i", "a", "fi"), at("j", "b", "fj")
    if length * q <= BROADCAST_ROWS:
        fi, fj = F.broadcast(fi), F.broadcast(fj)
    apart = pairs.where((F.col("a") < q) & (F.col("b") < q)).select("i", "j", "a", "b", "frequency")
    same = at("i", "a", "fa").join(fj.select(F.col("j").alias("i"), "b"), "i").select("i", F.col("i").alias("j"), "a", "b", F.when(F.col("a") == F.col("b"), F.col("fa")).otherwise(F.lit(0.0)).alias("frequency"))
    cells = apart.unionByName(same).join(fi, ["i", "a"]).join(fj, ["j", "b"]).select("i", "j", "a", "b", (F.col("frequency") - F.col("fi") * F.col("fj")).alias("v"))
    return cells.groupBy("i", "j").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "v"))), lambda c: c["v"]).alias("v"))


def couplings(pairs: DataFrame, sites: DataFrame, length: int, n_symbols: int, tile_rows: int = linear.TILE_ROWS) -> DataFrame:
    """``i, j, a, b, v`` with 0 for the last symbol: minus the inverse covariance."""
    q = n_symbols - 1
    wide = max(1, tile_rows // q)  # positions of a tile
    n_tiles = -(-length // wide)

    def assemble(key, frame):
        first, second = (k * wide + 1 for k in key)
        tile = np.zeros((min(wide, length + 1 - first), q, min(wide, length + 1 - second), q))
        for i, j, v in frame[["i", "j", "v"]].itertuples(index=False):
            block = np.asarray(v).reshape(q, q)
            tile[i - first, :, j - second] = block
            if first == second:
                tile[j - first, :, i - second] = block.T
        return linear.frame(*key, tile)

    def unpack(key, frame):
        first, second = (k * wide + 1 for k in key)
        tile = np.frombuffer(frame["m"].iloc[0]).reshape(min(wide, length + 1 - first), q, -1, q).transpose(0, 2, 1, 3)
        i, j = (x.ravel() for x in np.indices(tile.shape[:2]))
        i, j = (x[i + first < j + second] for x in (i, j))
        full = np.zeros((len(i), n_symbols, n_symbols))
        full[:, :q, :q] = tile[i, j]
        return pd.DataFrame({"i": i + first, "j": j + second, "v": pd.Series(list(full.reshape(len(i), n_symbols**2)), dtype=object)})

    tile_of = lambda c: F.floor((F.col(c) - 1) / wide).cast("int")
    blocks = covariance_blocks(pairs, sites, length, n_symbols).withColumns({"row": tile_of("i"), "col": tile_of("j")})
    tiles = blocks.groupBy("row", "col").applyInPandas(assemble, linear.TILES)
    blocks = linear.negative_inverse(tiles, n_tiles).groupBy("row", "col").applyInPandas(unpack, "i int, j int, v array<double>")
    cells = blocks.select("i", "j", F.posexplode("v").alias("ab", "v"))
    return cells.select("i", "j", F.floor(F.col("ab") / n_symbols).cast("int").alias("a"), (F.col("ab") % n_symbols).alias("b"), "v")


def fields(model: DataFrame, sites: DataFrame, n_symbols: int) -> DataFrame:
    """``i, a, v``: log frequency against the last symbol, less the couplings' mean field."""
    both = model.union(model.select("j", "i", "b", "a", "v"))
    f = sites.select(F.col("pos").alias("j"), F.col("sym").alias("b"), "frequency")
    mean = both.join(f, ["j", "b"]).groupBy("i", "a").agg(F.sum(F.col("v") * F.col("frequency")).alias("m"))
    last = sites.where(F.col("sym") == n_symbols - 1).select("pos", F.col("frequency").alias("last"))
    rows = sites.join(last, "pos").select(F.col("pos").alias("i"), F.col("sym").alias("a"), F.log(F.col("frequency") / F.col("last")).alias("v"))
    return rows.join(mean, ["i", "a"], "left").select("i", "a", (F.col("v") - F.coalesce("m", F.lit(0.0))).alias("v"))


def two_site_fields(e: np.ndarray, fi: np.ndarray, fj: np.ndarray, tolerance: float = 1e-4, most: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the two-site model with couplings exp(J) whose marginals are the site frequencies, by fitting either side in turn."""
    mi, mj = np.full(len(fi), 1 / len(fi)), np.full(len(fj), 1 / len(fj))
    for _ in range(most):
        new_i = fi / (e @ mj)
        new_i /= new_i.sum()
        new_j = fj / (new_i @ e)
        new_j /= new_j.sum()
        moved = max(np.abs(new_i - mi).max(), np.abs(new_j - mj).max())
        mi, mj = new_i, new_j
        if moved < tolerance:
            break
    return mi, mj


def direct_information(model: DataFrame, sites: DataFrame, n_symbols: int) -> DataFrame:
    """``i, j, di``: mutual information of each pair's two-site model. A pair is one group of symbols squared rows."""
    by_site = sites.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("sym", "frequency"))).alias("f"))
    at = lambda p, f: by_site.select(F.col("pos").alias(p), F.transform("f", lambda s: s["frequency"]).alias(f))
    rows = model.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("a", "b", "v"))).alias("m")).join(at("i", "fi"), "i").join(at("j", "fj"), "j").select("i", "j", F.transform("m", lambda m: m["v"]).alias("v"), "fi", "fj")

    def run(batches):
        for frame in batches:
            out = []
            for i, j, v, fi, fj in frame.itertuples(index=False):
                e, fi, fj = np.exp(np.asarray(v).reshape(n_symbols, n_symbols)), np.asarray(fi), np.asarray(fj)
                mi, mj = two_site_fields(e, fi, fj)
                p = e * np.outer(mi, mj)
                p /= p.sum()
                out.append((i, j, float((p * np.log(p / np.outer(fi, fj))).sum())))
            yield pd.DataFrame(out, columns=["i", "j", "di"])

    return rows.mapInPandas(run, "i int, j int, di double")


def independent_fields(sites: DataFrame, n_sequences: float, strength: float = 0.01, steps: int = 200) -> DataFrame:
    """``i, a, v``: fields of a model without couplings, of greatest likelihood less a squared penalty; each site is a group of its symbols."""
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sym")
        f, h = group["frequency"].to_numpy(), np.zeros(len(group))
        scale = strength / n_sequences
        for _ in range(steps):
            p = np.exp(h - h.max())
            p /= p.sum()
            gradient = f - p - 2 * scale * h
            step = np.linalg.solve(np.diag(p) - np.outer(p, p) + 2 * scale * np.eye(len(p)), gradient)
            h = h + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            if np.abs(gradient).max() < 1e-12:
                break
        return pd.DataFrame({"i": group["pos"], "a": group["sym"], "v": h})

    return sites.groupBy("pos").applyInPandas(fit, "i int, a int, v double")
