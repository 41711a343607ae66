"""Restraints and checks for folding: secondary-structure clashes, disulfides, restraint lines, dihedral ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dihedral
from .structure import state_runs


def secondary_structure_clash(i: Column, j: Column, states: Column) -> Column:
    """Whether a pair less than 15 positions apart contradicts the states H, E, C of its chain.

    It does if all positions between the two are helix or all are strand; if
    one end only is in a state and the stretch, both ends included, holds a run
    of that state nearly as long as itself; or if it is longer than 8 and all
    but the outermost two positions on either side are strand.
    """
    low, high = F.least(i, j), F.greatest(i, j)
    d = high - low
    stretch = F.substring(states, low, d + 1)
    run = lambda c, less: F.contains(stretch, F.repeat(F.lit(c), F.greatest(d - less, F.lit(0)).cast("int")))
    all_are = lambda c, skip: F.translate(F.substring(states, low + skip, F.greatest(d + 1 - 2 * skip, F.lit(0))), c, "") == ""
    one_end = lambda c: (F.substring(states, low, F.lit(1)) == c) != (F.substring(states, high, F.lit(1)) == c)
    helix = one_end("H") & F.when(run("H", 1), d > 6).otherwise(run("H", 2) & (d > 11))
    strand = one_end("E") & (run("E", 2) | (run("E", 3) & (d > 8)))
    return (d < 15) & (all_are("H", 1) | all_are("E", 1) | (all_are("E", 2) & (d > 8)) | helix | strand)


def clashes(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """``pairs`` (``chain, i, j``) with ``ss_clash``; chains have ``chain`` and ``ss``, the states from position 1 in one string."""
    flag = secondary_structure_clash(F.col("i").cast("int"), F.col("j").cast("int"), F.col("ss"))
    return pairs.join(chains, "chain").withColumn("ss_clash", flag).drop("ss")


def distance_restraints(pairs: DataFrame, atoms: list[tuple[str, str, float, float, float]]) -> DataFrame:
    """``i, j, line`` for each pair (``i, A_i, j, A_j``) and restraint kind (two atoms, distance, lower, upper); none from CB of glycine."""
    kinds = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d"), F.lit(lo).alias("lo"), F.lit(up).alias("up")) for a, b, d, lo, up in atoms))
    rows = pairs.select("*", F.explode(kinds).alias("k"))
    no_beta = ((F.col("k.a") == "CB") & (F.col("A_i") == "G")) | ((F.col("k.b") == "CB") & (F.col("A_j") == "G"))
    line = F.format_string("assign (resid %d and name %s) (resid %d and name %s) %.1f %.1f %.1f", "i", "k.a", "j", "k.b", "k.d", "k.lo", "k.up")
    return rows.where(~no_beta).select("i", "j", line.alias("line"))


def state_restraints(residues: DataFrame, keys: list[str], separations: dict[str, list[tuple[int, float]]]) -> DataFrame:
    """``keys, i, j, state, dist`` for positions ``pos`` that lie a listed separation apart inside one run of a state."""
    order = Window.partitionBy(*keys).orderBy("pos")
    change = F.coalesce((F.col("ss") != F.lag("ss").over(order)).cast("int"), F.lit(1))
    runs = residues.select(*keys, "pos", "ss", change.alias("_c")).withColumn("_run", F.sum("_c").over(order))
    steps = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("n"), F.lit(d).alias("d")) for s, many in separations.items() for n, d in many))
    wanted = runs.select("*", F.explode(steps).alias("k")).where("ss = k.s")
    other = runs.select(*keys, "_run", F.col("pos").alias("j"))
    joined = wanted.withColumn("j", F.col("pos") + F.col("k.n")).join(other, [*keys, "_run", "j"])
    return joined.select(*keys, F.col("pos").alias("i"), "j", F.col("ss").alias("state"), F.col("k.d").alias("dist"))


def angle_restraints(residues: DataFrame, keys: list[str], angles: dict[str, tuple[float, float]]) -> DataFrame:
    """``keys, i, phi, psi`` where a position and the next share a state of ``angles``."""
    after = F.lead("ss").over(Window.partitionBy(*keys).orderBy("pos"))
    rows = residues.select(*keys, F.col("pos").alias("i"), "ss", after.alias("_next")).where("ss = _next")
    pick = lambda k: F.create_map(*(F.lit(x) for s, a in angles.items() for x in (s, a[k])))[F.col("ss")]
    return rows.select(*keys, "i", pick(0).alias("phi"), pick(1).alias("psi")).where("phi IS NOT NULL")


def docking_restraints(pairs: DataFrame, upper: float = 5.0) -> DataFrame:
    """``i, j, line`` of inter-segment pairs; a segment's first letter is its chain."""
    chain = lambda c: F.substring(F.col(c), 1, 1)
    line = F.format_string("assign (resid %d and segid %s) (resid %d and segid %s) %.1f %.1f 0.0", "pos_i", chain("segment_i"), "pos_j", chain("segment_j"), F.lit(upper), F.lit(upper))
    return pairs.where("segment_i != segment_j").select("i", "j", line.alias("line"))


def chain_dihedrals(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, dihedral`` (radians) of positions whose neighbours -1, +1 and +2 are there."""
    order = Window.partitionBy(*keys).orderBy("pos")
    at = lambda n: tuple(F.lead(c, n).over(order) if n > 0 else F.lag(c, -n).over(order) if n < 0 else F.col(c) for c in ("x", "y", "z"))
    straight = (F.lead("pos", 2).over(order) == F.col("pos") + 2) & (F.lag("pos", 1).over(order) == F.col("pos") - 1)
    return points.select(*keys, "pos", F.when(straight, dihedral([at(-1), at(0), at(1), at(2)])).alias("dihedral")).where("dihedral IS NOT NULL")


#: Lower and upper bound, in radians, and weight of a dihedral angle; helices first, then strands.
HELIX_BINS = [(0.44, 0.52, 0.2), (0.52, 0.61, 0.4), (0.61, 0.70, 0.6), (0.70, 0.78, 0.8), (0.78, 0.96, 1.0), (0.96, 1.05, 0.8), (1.05, 1.13, 0.6), (1.13, 1.22, 0.4), (1.22, 1.31, 0.2)]
STRAND_BINS = [(-0.3, -0.1, 0.2), (-0.4, -0.3, 0.4), (-0.5, -0.4, 0.6), (-0.6, -0.5, 0.8), (-0.8, -0.6, 1.0), (-0.9, -0.8, 0.8), (-1.0, -0.9, 0.6), (-1.1, -1.0, 0.4), (-1.2, -1.1, 0.2)]


def bin_weight(angle: Column, bins: list[tuple[float, float, float]], upper_closed: bool) -> Column:
    """Weight of the bin an angle falls in, 0 for none; helix bins hold their upper bound, strand bins their lower."""
    weight = F.lit(0.0)
    for low, high, w in bins:
        inside = (angle > low) & (angle <= high) if upper_closed else (angle >= low) & (angle < high)
        weight = F.when(inside, w).otherwise(weight)
    return weight


def dihedral_scores(angles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, alpha, beta``: number of angles and their summed weights as helix and as strand, whatever they are angles of."""
    alpha, beta = bin_weight(F.col("dihedral"), HELIX_BINS, True), bin_weight(F.col("dihedral"), STRAND_BINS, False)
    return angles.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(alpha).alias("alpha"), F.sum(beta).alias("beta"))


def strand_partners(strands: DataFrame, points: DataFrame, farthest: float = 7.0, most: int = 2) -> DataFrame:
    """``chain, strand_1, strand_2, dist`` of strands whose nearest points are within reach; strand by strand, in order of distance, each gets ``most`` partners.

    strands: ``chain, strand, first, stop``; points: ``chain, pos, x, y, z``.
    Order decides, so a chain's strand pairs, a few dozen, are one group.
    """
    at = strands.join(points, "chain").where("pos >= first AND pos < stop").select("chain", "strand", "x", "y", "z")
    other = at.select("chain", F.col("strand").alias("strand_2"), *(F.col(c).alias(f"{c}_2") for c in "xyz"))
    dist = F.sqrt(F.pow(F.col("x") - F.col("x_2"), 2) + F.pow(F.col("y") - F.col("y_2"), 2) + F.pow(F.col("z") - F.col("z_2"), 2))
    pairs = at.join(other, "chain").where("strand < strand_2").groupBy("chain", F.col("strand").alias("strand_1"), "strand_2").agg(F.min(dist).alias("dist")).where(F.col("dist") <= farthest)

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        keep = []
        group = group.sort_values(["strand_1", "dist", "strand_2"])
        for a, b in zip(group["strand_1"], group["strand_2"]):
            ok = used.get(a, 0) < most and used.get(b, 0) < most
            keep.append(ok)
            if ok:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        return group[keep]

    return pairs.groupBy("chain").applyInPandas(greedy, pairs.schema)


def alpha_dihedrals(points: DataFrame, residues: DataFrame) -> DataFrame:
    """``chain, pos, dihedral`` of the helix positions of ``residues`` (``chain, pos, ss``)."""
    return chain_dihedrals(points, ["chain"]).join(residues.where("ss = 'H'").select("chain", "pos"), ["chain", "pos"])


def beta_dihedrals(points: DataFrame, residues: DataFrame, farthest: float = 7.0, original: bool = True) -> DataFrame:
    """``chain, strand_1, strand_2, i, j, dihedral`` between paired strands.

    A position's partner is the nearest of the other strand, of equally near
    ones the first; positions from the first to the last with a partner within
    reach count.  They vote whether the strands are parallel.  ``original``
    votes and asks for points as the 2011 protocol does, whose choice differs
    from the points of the angle; an angle that lacks a point is left out.
    """
    runs = state_runs(residues, ["chain"]).where("ss = 'E'")
    strands = runs.select("chain", F.row_number().over(Window.partitionBy("chain").orderBy("first")).alias("strand"), "first", "stop")
    here = points.select("chain", "pos", F.struct("x", "y", "z").alias("p"))
    step = lambda n, name: here.select("chain", (F.col("pos") - n).alias("pos"), F.col("p").alias(name))
    around = here.join(step(2, "up"), ["chain", "pos"], "left").join(step(-2, "down"), ["chain", "pos"], "left")
    inside = strands.join(around, "chain").where("pos >= first AND pos < stop")
    side = lambda k, pos: inside.select("chain", F.col("strand").alias(f"strand_{k}"), F.col("pos").alias(pos), *(F.col(c).alias(f"{c}_{k}") for c in ("p", "up", "down")))
    far = lambda a, b: F.sqrt(sum(F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2)) for c in "xyz"))
    pair = ["chain", "strand_1", "strand_2"]
    both = strand_partners(strands, points, farthest).select(*pair).join(side(1, "i"), ["chain", "strand_1"]).join(side(2, "j"), ["chain", "strand_2"])
    fields = F.struct(far("p_1", "p_2").alias("dist"), "j", "p_1", "up_1", "down_1", "p_2", "up_2", "down_2")
    nearest = both.groupBy(*pair, "i").agg(F.min(fields).alias("m")).select(*pair, "i", "m.*")
    whole = Window.partitionBy(*pair)
    close = F.when(F.col("dist") <= farthest, F.col("i"))
    near = nearest.select("*", F.min(close).over(whole).alias("_low"), F.max(close).over(whole).alias("_high")).where("i BETWEEN _low AND _high")
    votes = F.col("up_1").isNotNull() & F.col("down_1").isNotNull() & F.col("up_2").isNotNull()
    crossed = far("down_1", "up_2") if original else far("up_1", "down_2")
    vote = F.when(votes, F.when(far("up_1", "up_2") <= crossed, 1).otherwise(-1)).otherwise(0)
    parallel = F.sum(vote).over(whole) > 0
    third = F.when(F.col("_parallel"), F.col("up_2")).otherwise(F.col("down_2"))
    asked = F.when(F.col("_parallel"), F.col("up_1")).otherwise(F.col("down_1")).isNotNull() & F.col("up_2").isNotNull() if original else F.lit(True)
    angles = near.select("*", parallel.alias("_parallel")).withColumn("third", third).where(asked & F.col("up_1").isNotNull() & F.col("third").isNotNull())
    at = lambda c: tuple(F.col(f"{c}.{k}") for k in "xyz")
    return angles.select(*pair, "i", "j", dihedral([at("p_1"), at("up_1"), at("third"), at("p_2")]).alias("dihedral"))


def dihedral_ranking_score(points: DataFrame, residues: DataFrame, original: bool = True) -> DataFrame:
    """``chain, n_alpha, alpha, n_beta, beta`` of each chain with points: angles in helices and between strands, and their weights.

    points: ``chain, pos, x, y, z``, those without coordinates don't count; residues: ``chain, pos, ss``.
    """
    points = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    kinds = (("alpha", alpha_dihedrals(points, residues)), ("beta", beta_dihedrals(points, residues, original=original)))
    out = points.select("chain").distinct()
    for kind, angles in kinds:
        score = dihedral_scores(angles, ["chain"]).select("chain", F.col("n").alias(f"n_{kind}"), kind)
        out = out.join(score, "chain", "left")
    return out.na.fill(0, ["n_alpha", "n_beta"]).na.fill(0.0, ["alpha", "beta"])


def disulfide_clashes(pairs: DataFrame) -> DataFrame:
    """``chain, i, j, score, cys_clash``: in order of score, a cysteine pair that shares a residue with an earlier accepted one clashes.

    Order decides, so a chain's cysteine pairs are one group; there are few of them.
    """
    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        used, flags = set(), []
        group = group.sort_values(["score", "i", "j"], ascending=[False, True, True])
        for i, j in zip(group["i"], group["j"]):
            clash = i in used or j in used
            flags.append(clash)
            if not clash:
                used |= {i, j}
        return group[["chain", "i", "j", "score"]].assign(cys_clash=flags)

    cysteines = pairs.where("A_i = 'C' AND A_j = 'C'").select("chain", "i", "j", "score")
    return cysteines.groupBy("chain").applyInPandas(greedy, "chain long, i long, j long, score double, cys_clash boolean")


def ranked_models(scores: DataFrame) -> DataFrame:
    """``model, ranking_score`` of ``model, alpha, beta``: their sum over the greatest of each."""
    top = scores.agg(F.max("alpha"), F.max("beta")).first()
    return scores.select("model", ((F.col("alpha") + F.col("beta")) / max(1.0, (top[0] or 0) + (top[1] or 0))).alias("ranking_score"))
