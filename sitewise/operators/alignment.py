"""Alignments as one row per sequence: ``seq_idx`` and ``residues``, an array of symbol numbers (0 is the gap).

Long tables have ``pos`` from 1.  Frequencies explode each row's own array, so
no join or shuffle precedes the partial aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sequences of a block of the all-pairs comparison.
BLOCK = 4096
#: Rows of a block that meet another block at a time.
SLAB = 512


def cells(rows: DataFrame) -> DataFrame:
    """``seq_idx, pos, sym`` and the other columns."""
    rest = [c for c in rows.columns if c != "residues"]
    return rows.select(*rest, F.posexplode("residues").alias("p", "sym")).select(*rest, (F.col("p") + 1).alias("pos"), "sym")


def select(rows: DataFrame, positions: list[int]) -> DataFrame:
    """Columns of the alignment, in the order given."""
    return rows.withColumn("residues", F.array(*(F.element_at("residues", p) for p in positions)))


def apply(sequences: DataFrame, change, positions: list[int] | None = None) -> DataFrame:
    """``change`` (from column to column) on each character of ``seq`` at the positions."""
    chars = F.transform(F.split("seq", ""), lambda c, i: F.when((i + 1).isin(positions), change(c)).otherwise(c) if positions is not None else change(c))
    return sequences.withColumn("seq", F.array_join(chars, ""))


def replace(sequences: DataFrame, old: str, new: str, positions: list[int] | None = None) -> DataFrame:
    return apply(sequences, lambda c: F.when(c == old, F.lit(new)).otherwise(c), positions)


def lowercase_columns(sequences: DataFrame, positions: list[int]) -> DataFrame:
    """Insert state: lower case, and ``.`` for a gap."""
    return apply(sequences, lambda c: F.translate(F.lower(c), "-", "."), positions)


def count_symbol(rows: DataFrame, symbol: int, by: str = "pos") -> DataFrame:
    """Relative frequency of a symbol per position or per sequence."""
    return cells(rows).groupBy(by).agg(F.avg((F.col("sym") == symbol).cast("double")).alias("frequency"))


def _weight(rows: DataFrame) -> Column:
    return F.col("weight") if "weight" in rows.columns else F.lit(1.0)


def site_frequencies(rows: DataFrame, n_symbols: int) -> DataFrame:
    """``pos, sym, frequency``, weighted by ``weight`` if there is one; symbols not seen at a position have 0."""
    seen = rows.select(_weight(rows).alias("w"), F.posexplode("residues").alias("p", "sym")).groupBy("p", "sym").agg(F.sum("w").alias("w"))
    by_site = seen.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("sym", "w"))).alias("m"), F.sum("w").alias("total"))
    every = by_site.select("p", "m", "total", F.explode(F.sequence(F.lit(0), F.lit(n_symbols - 1))).alias("sym"))
    return every.select((F.col("p") + 1).alias("pos"), "sym", (F.coalesce(F.col("m")[F.col("sym")], F.lit(0.0)) / F.col("total")).alias("frequency"))


def pair_frequencies(rows: DataFrame) -> DataFrame:
    """``i, j, a, b, frequency`` of symbols seen together at positions i < j.

    Tasks add up their rows' pairs as products of indicator matrices, so they
    send on a row for each pair of cells and not one for each pair of each sequence.
    """
    total = rows.agg(F.sum(_weight(rows))).first()[0]
    names, kinds = ("i", "j", "a", "b", "w"), (*[pa.int32()] * 4, pa.float64())

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            lists, weight = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for length in np.unique(size[size > 1]).astype(int).tolist():
                which = np.flatnonzero(size == length)
                values = lists.take(pa.array(which)).flatten()
                symbols = [s for s in values.unique().to_pylist() if s is not None]
                absent = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, length)
                values = values.fill_null(symbols[0] if symbols else 0).to_numpy().reshape(-1, length)
                shown = {s: (values == s) & ~absent for s in symbols} | ({None: absent} if absent.any() else {})
                for a, x in shown.items():
                    left = (x * weight[which, None]).T
                    for b, y in shown.items():
                        # weight and number of sequences: a pair that was seen may weigh nothing
                        found = np.stack([left @ y.astype(float), x.T.astype(float) @ y])
                        sums[length, a, b] = sums.get((length, a, b), 0) + found
        for (length, a, b), (w, n) in sums.items():
            i, j = np.nonzero(np.triu(n, 1))
            columns = (i + 1, j + 1, [a] * len(i), [b] * len(i), w[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    kind = rows.schema["residues"].dataType.elementType.simpleString()
    made = rows.select(F.col("residues").cast("array<int>").alias("r"), _weight(rows).cast("double").alias("w")).mapInArrow(run, "i int, j int, a int, b int, w double")
    counted = made.groupBy("i", "j", "a", "b").agg(F.sum("w").alias("w"))
    return counted.select("i", "j", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), (F.col("w") / total).alias("frequency"))


def sequence_weights(rows: DataFrame, theta: float, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``n_similar`` (sequences, itself included, of identity ``theta`` or more over the whole length) and ``weight``, its inverse.

    All pairs are compared, block against block: each block of sequences meets
    every other in one group, where identities are products of indicator
    matrices, ``SLAB`` rows at a time.
    """
    blocks = max(1, -(-rows.count() // block))

    def packed(batches):
        for batch in batches:
            found = [np.array(r, np.int32).tobytes() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["seq_idx", "r"])

    numbered = rows.where(F.size("residues") > 0).select(F.col("seq_idx").cast("long").alias("seq_idx"), F.col("residues").cast("array<int>").alias("r")).mapInArrow(packed, "seq_idx long, r binary")
    numbered = numbered.withColumn("own", F.pmod(F.xxhash64("seq_idx"), F.lit(blocks)).cast("int"))
    meets = numbered.select("seq_idx", "r", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    meets = meets.select("seq_idx", "r", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        mine = group[group["own"] == group["x"]]
        theirs = group[group["own"] == group["y"]]
        a, b = (np.frombuffer(b"".join(g["r"]), np.int32).reshape(len(g), -1) if len(g) else np.empty((0, 0), int) for g in (mine, theirs))
        if not len(a) or not len(b):
            return pd.DataFrame({"seq_idx": [], "n": []})
        symbols = np.intersect1d(a, b)
        shown = lambda x: np.concatenate([x == s for s in symbols], axis=1).astype(np.float32) if len(symbols) else np.zeros((len(x), 1), np.float32)
        second, ours, others = shown(b).T, [], np.zeros(len(b), np.int64)
        for at in range(0, len(a), SLAB):
            near = shown(a[at : at + SLAB]) @ second >= theta * a.shape[1] - 1e-6
            ours.append(near.sum(axis=1))
            others += near.sum(axis=0)
        out = [pd.DataFrame({"seq_idx": mine["seq_idx"], "n": np.concatenate(ours)})]
        if mine["own"].iloc[0] != theirs["own"].iloc[0]:
            out.append(pd.DataFrame({"seq_idx": theirs["seq_idx"], "n": others}))
        return pd.concat(out)

    counted = meets.groupBy("x", "y").applyInPandas(compare, "seq_idx long, n long").groupBy("seq_idx").agg(F.sum("n").alias("n_similar"))
    return rows.join(counted, "seq_idx").withColumn("weight", 1.0 / F.col("n_similar"))


def identities_to(rows: DataFrame, reference: list[int]) -> DataFrame:
    """``seq_idx, identity``: share of positions equal to the reference's, gaps included."""
    same = F.aggregate(F.zip_with("residues", F.array(*map(F.lit, reference)), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return rows.select("seq_idx", (same / len(reference)).alias("identity"))


def conservation(frequencies: DataFrame, n_symbols: int) -> DataFrame:
    """``pos, conservation``: 1 less the base-2 entropy over its maximum."""
    term = F.when(F.col("frequency") > 0, F.col("frequency") * F.log2("frequency")).otherwise(0.0)
    return frequencies.groupBy("pos").agg((1 + F.sum(term) / F.log2(F.lit(float(n_symbols)))).alias("conservation"))


def valid_rows(rows: DataFrame, n_symbols: int) -> DataFrame:
    """Sequences without a symbol outside the alphabet."""
    return rows.where(~F.exists("residues", lambda s: s.isNull() | (s < 0) | (s >= n_symbols)))


def covered_rows(rows: DataFrame, least_coverage: float | int, gap: int = 0) -> DataFrame:
    """Sequences whose share of non-gap positions is ``least_coverage`` or more; an integer is a percentage."""
    least = least_coverage / 100 if isinstance(least_coverage, int) else least_coverage
    gaps = F.size(F.filter("residues", lambda s: s == gap))
    return rows.where(1 - gaps / F.size("residues") >= least)


def column_coverage(rows: DataFrame, gap: int = 0) -> DataFrame:
    """``pos, coverage``: share of sequences without a gap there."""
    return cells(rows).groupBy("pos").agg(F.avg((F.col("sym") != gap).cast("double")).alias("coverage"))


def describe_coverage(rows: DataFrame, thresholds: list[float], first_index: int = 1, gap: int = 0) -> DataFrame:
    """Per threshold: sequences, length, covered and lower-case columns, first and last covered column, span, and lower-case columns inside it."""
    n = rows.count()
    sites = column_coverage(rows, gap).select("pos", "coverage", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    low = 1 - F.col("coverage") > 1 - F.col("threshold")
    at = F.col("pos") + first_index - 1
    stats = sites.groupBy("threshold").agg(
        F.lit(n).alias("num_seqs"),
        F.count("*").alias("seqlen"),
        F.sum((~low).cast("long")).alias("num_cov"),
        F.sum(low.cast("long")).alias("num_lc"),
        F.min(F.when(~low, at)).alias("first_uc"),
        F.max(F.when(~low, at)).alias("last_uc"),
    )
    span = F.col("last_uc") - F.col("first_uc") + 1
    return stats.withColumns({"perc_cov": F.col("num_cov") / F.col("seqlen"), "len_cov": span, "num_lc_cov": span - F.col("num_cov")})


def frequency_table(frequencies: DataFrame, conserved: DataFrame, alphabet: str, target: DataFrame) -> DataFrame:
    """One row per position ``i, A_i, conservation`` and a column per symbol; values are null where the target is lower-case or a gap.

    ``target`` has ``pos`` and ``letter``.
    """
    wide = frequencies.withColumn("letter", F.substring(F.lit(alphabet), F.col("sym") + 1, F.lit(1))).groupBy("pos").pivot("letter", list(alphabet)).agg(F.first("frequency"))
    joined = wide.join(conserved, "pos").join(target.select("pos", F.col("letter").alias("A_i")), "pos")
    hidden = F.lower("A_i") == F.col("A_i")
    return joined.select(F.col("pos").alias("i"), "A_i", *(F.when(~hidden, F.col(f"`{c}`")).alias(c) for c in ("conservation", *alphabet)))


def read_out(rows: DataFrame, alphabet: str) -> DataFrame:
    """``seq_idx, seq`` of symbol arrays."""
    return rows.select("seq_idx", F.array_join(F.transform("residues", lambda s: F.substring(F.lit(alphabet), s + 1, F.lit(1))), "").alias("seq"))


def logo(frequencies: DataFrame, n_symbols: int, threshold: float = 0.01) -> DataFrame:
    """``pos, sym, bits``: heights of a sequence logo, frequency times what the column's entropy lacks to its maximum."""
    entropy = -F.sum(F.when(F.col("frequency") > 0, F.col("frequency") * F.log2("frequency")).otherwise(0.0)).over(Window.partitionBy("pos"))
    return frequencies.select("pos", "sym", "frequency", (F.col("frequency") * (F.log2(F.lit(float(n_symbols))) - entropy)).alias("bits")).where(F.col("frequency") >= threshold).drop("frequency")
