"""Energies of sequences and mutants under a pair model.

The model is two long tables: fields ``i, a, v`` and couplings ``i, j, a, b, v``
with i < j.  Scores are sums of joined terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mutations

#: Couplings of a model that every task holds.
MODEL_ROWS = 500_000
#: Cells of the sequences of one task.
TASK_CELLS = 500_000


def log_odds_model(pairs: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields as log site frequencies and couplings as log odds of pairs seen."""
    fields = sites.where("frequency > 0").select(F.col("pos").alias("i"), F.col("sym").alias("a"), F.log("frequency").alias("v"))
    at = lambda i, a, f: sites.select(F.col("pos").alias(i), F.col("sym").alias(a), F.col("frequency").alias(f))
    both = pairs.where("frequency > 0").join(at("i", "a", "fa"), ["i", "a"]).join(at("j", "b", "fb"), ["j", "b"])
    return fields, both.select("i", "j", "a", "b", F.log(F.col("frequency") / (F.col("fa") * F.col("fb"))).alias("v"))


def sequence_energies(cells: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """``seq_idx, fields, couplings, energy``.

    A model of up to ``MODEL_ROWS`` couplings goes to the tasks, where each
    sequence makes its pairs of cells and adds them up: no pair travels.  For
    a larger one its cells are joined to (i, a), and the result to (j, b).
    """
    site = cells.join(fields, [cells.pos == fields.i, cells.sym == fields.a]).groupBy("seq_idx").agg(F.sum("v").alias("fields"))
    if couplings.count() <= MODEL_ROWS:
        tasks = max(cells.sparkSession.sparkContext.defaultParallelism, cells.count() // TASK_CELLS)
        rows = cells.where("pos IS NOT NULL AND sym IS NOT NULL AND seq_idx IS NOT NULL").repartition(tasks, "seq_idx").groupBy("seq_idx").agg(F.collect_list(F.struct("pos", "sym")).alias("_cells"))
        left = rows.select("seq_idx", "_cells", F.explode("_cells").alias("_l"))
        pairs = left.select("seq_idx", F.col("_l.pos").alias("i"), F.col("_l.sym").alias("a"), F.explode(F.filter("_cells", lambda c: c["pos"] > F.col("_l.pos"))).alias("_r"))
        found = pairs.select("seq_idx", "i", "a", F.col("_r.pos").alias("j"), F.col("_r.sym").alias("b")).join(F.broadcast(couplings), ["i", "a", "j", "b"])
        pair = found.groupBy("seq_idx").agg(F.sum("v").alias("couplings"))
    else:
        left = cells.select("seq_idx", F.col("pos").alias("i"), F.col("sym").alias("a"))
        right = cells.select("seq_idx", F.col("pos").alias("j"), F.col("sym").alias("b"))
        pair = left.join(couplings, ["i", "a"]).join(right, ["seq_idx", "j", "b"]).groupBy("seq_idx").agg(F.sum("v").alias("couplings"))
    both = site.join(pair, "seq_idx", "outer").na.fill(0.0)
    return both.withColumn("energy", F.col("fields") + F.col("couplings"))


def both_ways(couplings: DataFrame) -> DataFrame:
    return couplings.union(couplings.select("j", "i", "b", "a", "v"))


def single_mutants(target: DataFrame, fields: DataFrame, couplings: DataFrame, n_symbols: int, exclude_self: bool = True, gap: int = 0) -> DataFrame:
    """``i, wt, subs, effect`` of all substitutions of a target (``pos, sym``), gaps left out.

    The target's symbols are a dimension of one row per position.
    """
    every = target.select(F.col("pos").alias("i"), F.col("sym").alias("wt"), F.explode(F.sequence(F.lit(0), F.lit(n_symbols - 1))).alias("a")).where(F.col("a") != gap)
    every = every.where("a != wt") if exclude_self else every
    context = target.select(F.col("pos").alias("j"), F.col("sym").alias("b"))
    sums = both_ways(couplings).join(context, ["j", "b"]).groupBy("i", "a").agg(F.sum("v").alias("v")).unionByName(fields.select("i", "a", "v")).groupBy("i", "a").agg(F.sum("v").alias("v"))
    mutant = every.join(sums, ["i", "a"], "left").withColumnRenamed("v", "new")
    wild = sums.select("i", F.col("a").alias("wt"), F.col("v").alias("old"))
    effect = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return mutant.join(wild, ["i", "wt"], "left").select("i", "wt", F.col("a").alias("subs"), effect.alias("effect"))


def double_mutants(singles: DataFrame, couplings: DataFrame) -> DataFrame:
    """``i, j, subs_i, subs_j, effect`` of pairs that the model couples: both single effects and the four-term correction."""
    a = singles.select("i", F.col("wt").alias("wi"), F.col("subs").alias("a"), F.col("effect").alias("ei"))
    b = singles.select(F.col("i").alias("j"), F.col("wt").alias("wj"), F.col("subs").alias("b"), F.col("effect").alias("ej"))
    sites = couplings.select("i", "j").distinct()
    pairs = sites.join(a, "i").join(b, "j")
    term = lambda x, y, name: couplings.select("i", "j", F.col("a").alias(x), F.col("b").alias(y), F.col("v").alias(name))
    for x, y, name in (("a", "b", "v1"), ("a", "wj", "v2"), ("wi", "b", "v3"), ("wi", "wj", "v4")):
        pairs = pairs.join(term(x, y, name), ["i", "j", x, y], "left")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.select("i", "j", F.col("a").alias("subs_i"), F.col("b").alias("subs_j"), (F.col("ei") + F.col("ej") + part("v1") - part("v2") - part("v3") + part("v4")).alias("effect"))


def mutant_effects(mutants: DataFrame, target: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """``mutant, effect`` of lists of substitutions (``mutant, pos, wt, subs``, one row each); null if a wild-type symbol isn't the target's.

    A mutant's energy change sums, over its substitutions, the change against
    the unchanged target, and over its pairs the couplings counted amiss.
    """
    sites = mutants.join(target.select("pos", F.col("sym").alias("true")), "pos", "left")
    bad = sites.groupBy("mutant").agg(F.max((~F.col("wt").eqNullSafe(F.col("true"))).cast("int")).alias("bad"))
    context = target.select(F.col("pos").alias("j"), F.col("sym").alias("b"))
    sums = both_ways(couplings).join(context, ["j", "b"]).groupBy("i", "a").agg(F.sum("v").alias("v")).unionByName(fields.select("i", "a", "v")).groupBy("i", "a").agg(F.sum("v").alias("v"))
    at = lambda a, name: sums.select(F.col("i").alias("pos"), F.col("a").alias(a), F.col("v").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    single = mutants.join(at("subs", "new"), ["pos", "subs"], "left").join(at("wt", "old"), ["pos", "wt"], "left").select("mutant", (zero("new") - zero("old")).alias("d"))
    left = mutants.select("mutant", F.col("pos").alias("i"), F.col("wt").alias("wi"), F.col("subs").alias("a"))
    right = mutants.select("mutant", F.col("pos").alias("j"), F.col("wt").alias("wj"), F.col("subs").alias("b"))
    pairs = left.join(right, "mutant").where("i < j")
    for x, y, name in (("a", "b", "v1"), ("a", "wj", "v2"), ("wi", "b", "v3"), ("wi", "wj", "v4")):
        pairs = pairs.join(couplings.select("i", "j", F.col("a").alias(x), F.col("b").alias(y), F.col("v").alias(name)), ["i", "j", x, y], "left")
    double = pairs.select("mutant", (zero("v1") - zero("v2") - zero("v3") + zero("v4")).alias("d"))
    return single.unionByName(double).groupBy("mutant").agg(F.sum("d").alias("d")).join(bad, "mutant").select("mutant", F.when(F.col("bad") == 0, F.col("d")).alias("effect"))


def split_mutants(table: DataFrame, column: str = "mutant") -> DataFrame:
    """Adds ``num_mutations`` and comma-joined ``pos, wt, subs``, in order of position."""
    m = F.array_sort(mutations(F.col(column)))
    joined = lambda f: F.array_join(F.transform("_m", lambda x: x[f].cast("string")), ",")
    return table.withColumn("_m", m).withColumns({"num_mutations": F.size("_m"), "pos": joined("pos"), "wt": joined("wt"), "subs": joined("subs")}).drop("_m")
