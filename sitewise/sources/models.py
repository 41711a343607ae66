"""Binary parameter files of pair models: read into long tables, written from them.

A file is one row of ``binaryFile``; a task decodes it with numpy and emits
blocks, so a folder of files is read by as many tasks.  Fixed layout, all little
endian: five int32 (sites, symbols, valid and invalid sequences, iterations),
five reals (theta, three penalties, effective sequences), the alphabet, a weight
per sequence, the target's letters, its numbers (int32), site frequencies,
fields, then pair frequencies and couplings of all i < j.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("num_sites", "num_symbols", "num_valid_seqs", "num_invalid_seqs", "num_iterations")
REALS = ("theta", "lambda_h", "lambda_j", "lambda_group", "n_eff")
HEADER = ", ".join(["path string", *(f"{c} int" for c in COUNTS), *(f"{c} double" for c in REALS), "alphabet string", "target string", "positions array<int>", "mean_field boolean"])


class _Layout:
    def __init__(self, data: bytes, precision: str):
        self.data, self.real, self.at = data, np.dtype(precision).newbyteorder("<"), 0
        self.counts = [int(v) for v in self.take(5, "<i4")]
        self.sites, self.symbols = self.counts[:2]
        self.reals = [float(v) for v in self.take(5)]
        self.alphabet = self.text(self.symbols)
        self.weights = self.take(self.counts[2] + self.counts[3])
        self.target = self.text(self.sites)
        self.positions = self.take(self.sites, "<i4").tolist()

    def take(self, n: int, kind=None) -> np.ndarray:
        kind = np.dtype(kind or self.real)
        if self.at + n * kind.itemsize > len(self.data):
            raise ValueError("the parameter file ends early: another precision, or another format")
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += n * kind.itemsize
        return out

    def text(self, n: int) -> str:
        return self.take(n, "S1").tobytes().decode("ascii")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_model_header(spark: SparkSession, path: str, precision: str = "float32") -> DataFrame:
    """One row per file. A negative field penalty marks a mean-field model; its pseudo count stands there."""

    def run(batches):
        for frame in batches:
            out = []
            for name, data in frame.itertuples(index=False):
                f = _Layout(data, precision)
                out.append((name, *f.counts, *f.reals, f.alphabet, f.target, f.positions, f.reals[1] < 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADER.split(", ")])

    return _files(spark, path).mapInPandas(run, HEADER)


def read_model_sites(spark: SparkSession, path: str, precision: str = "float32") -> DataFrame:
    """``path, i, a, frequency, v``: site frequencies and fields, positions from 1, symbols by number."""

    def run(batches):
        for frame in batches:
            for name, data in frame.itertuples(index=False):
                f = _Layout(data, precision)
                n = f.sites * f.symbols
                i, a = np.divmod(np.arange(n), f.symbols)
                yield pd.DataFrame({"path": name, "i": i + 1, "a": a, "frequency": f.take(n).astype(float), "v": f.take(n).astype(float)})

    return _files(spark, path).mapInPandas(run, "path string, i int, a int, frequency double, v double")


def read_model_pairs(spark: SparkSession, path: str, precision: str = "float32") -> DataFrame:
    """``path, i, j, a, b, frequency, v`` of i < j: pair frequencies and couplings."""

    def run(batches):
        for frame in batches:
            for name, data in frame.itertuples(index=False):
                f = _Layout(data, precision)
                q = f.symbols
                f.take(2 * f.sites * q)
                n = f.sites * (f.sites - 1) // 2
                both = f.take(2 * n * q * q).reshape(2, n, q * q)
                i, j = np.triu_indices(f.sites, 1)
                for at in range(0, n, 1024):
                    part = slice(at, at + 1024)
                    yield pd.DataFrame({"path": name, "i": i[part] + 1, "j": j[part] + 1, "f": list(both[0, part].astype(float)), "v": list(both[1, part].astype(float)), "q": q})

    blocks = _files(spark, path).mapInPandas(run, "path string, i int, j int, f array<double>, v array<double>, q int")
    cells = blocks.select("path", "i", "j", "q", F.posexplode(F.arrays_zip("f", "v")).alias("ab", "c"))
    return cells.select("path", "i", "j", F.floor(F.col("ab") / F.col("q")).cast("int").alias("a"), (F.col("ab") % F.col("q")).alias("b"), F.col("c.f").alias("frequency"), F.col("c.v").alias("v"))


def write_model(path: str, sites: DataFrame, pairs: DataFrame, alphabet: str, target: str, positions: list[int], n_valid: int, n_eff: float, precision: str = "float32", theta: float = 0.8, penalties: tuple = (0.01, 0.01, 0.0), weights: list[float] | None = None) -> None:
    """Writes a local file of ``i, a, frequency, v`` and ``i, j, a, b, frequency, v``; cells not given are 0.

    The format is one file of one model; its size is that of the model (sites
    squared times symbols squared), whatever the number of sequences.
    """
    length, q, real = len(target), len(alphabet), np.dtype(precision).newbyteorder("<")
    s = sites.select("i", "a", "frequency", "v").toPandas()
    p = pairs.select("i", "j", "a", "b", "frequency", "v").toPandas()
    one, two = np.zeros((2, length, q), real), np.zeros((2, length, length, q, q), real)
    at = (s["i"] - 1, s["a"])
    one[0][at], one[1][at] = s["frequency"], s["v"]
    at = (p["i"] - 1, p["j"] - 1, p["a"], p["b"])
    two[0][at], two[1][at] = p["frequency"], p["v"]
    upper = np.triu_indices(length, 1)
    with open(path, "wb") as f:
        f.write(np.array([length, q, n_valid, 0, 0], "<i4").tobytes())
        f.write(np.array([theta, *penalties, n_eff], real).tobytes())
        f.write(alphabet.encode("ascii"))
        f.write(np.array(weights if weights is not None else [1.0] * n_valid, real).tobytes())
        f.write(target.encode("ascii") + np.array(positions, "<i4").tobytes())
        for table in (*one, two[0][upper], two[1][upper]):
            f.write(np.ascontiguousarray(table, real).tobytes())


def write_mean_field_model(path: str, sites: DataFrame, pairs: DataFrame, pseudo: float, **rest) -> None:
    """As ``write_model``, with the pseudo count as a negative field penalty."""
    write_model(path, sites, pairs, penalties=(-pseudo, 0.0, 0.0), **rest)
