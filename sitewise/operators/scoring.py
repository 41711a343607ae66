"""Scoring of pairs against sites, structures and each other: published features, comparisons, contact maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import couplings as C
from . import mixture
from .running import ranked
from .stored import stored

#: Inputs of the logistic model, besides its intercept.
FEATURES = ("mad_score", "num_sites_log", "min_gap", "max_gap", "min_cons", "max_cons", "meff_over_l_norm_log", "meff_over_l2_norm_log")


def ec_table(couplings: DataFrame, pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """``i, j, fn, cn, mi_raw, mi_apc``: norm of the zero-sum couplings and mutual information, both with their correction."""
    # a row a pair of positions: small beside the model, and read four times
    cn = C.product_corrected(stored(C.frobenius_norm(C.zero_sum_gauge(couplings))), "fn", "cn")
    mi = C.product_corrected(stored(C.mutual_information(pairs, sites)), "mi_raw", "mi_apc")
    return cn.join(mi, ["i", "j"]).select("i", "j", "fn", "cn", "mi_raw", "mi_apc")


def site_features(frequencies: DataFrame, conserved: DataFrame, gap: int = 0) -> DataFrame:
    """``pos, conservation, gap``."""
    gaps = frequencies.where(F.col("sym") == gap).select("pos", F.col("frequency").alias("gap"))
    return conserved.join(gaps, "pos")


def with_features(ecs: DataFrame, sites: DataFrame, theta: float, n_eff: float, num_sites: int) -> DataFrame:
    """The eight inputs of the logistic model but ``mad_score``, from site features and the size of the alignment."""
    rows = C.add_site_features(ecs, sites).withColumnsRenamed({"min_conservation": "min_cons", "max_conservation": "max_cons"})
    scalars = {"num_sites_log": num_sites, "meff_over_l_norm_log": n_eff / num_sites / theta, "meff_over_l2_norm_log": n_eff / num_sites**2 / theta}
    return rows.withColumns({name: F.lit(math.log10(v)) for name, v in scalars.items()})


def logistic_rescored(ecs: DataFrame, sites: DataFrame, coefficients: dict[str, float], intercept: float, theta: float, n_eff: float, num_sites: int | None = None, score: str = "cn", least: float = 0.375) -> DataFrame:
    """``ecs`` with ``mad_score, probability`` and ``score``, the model's log odds; columns of these names that ``ecs`` has are replaced.

    With fewer than ``least`` effective sequences a site, over theta, the score
    stays what it was and probabilities are 0.
    """
    if num_sites is None:
        num_sites = ecs.select("i").union(ecs.select("j")).distinct().count()
    if n_eff / num_sites / theta < least:
        return ecs.withColumns({"score": F.col(score), "probability": F.lit(0.0)})  # both from the columns before
    rows = C.logistic_score(with_features(C.mad_score(ecs, score), sites, theta, n_eff, num_sites), coefficients, intercept)
    kept = [c for c in ecs.columns if c not in ("mad_score", "probability", "score")]
    return rows.select(*kept, "mad_score", "probability", F.col("score_logit").alias("score"))


def with_mixture_probability(ecs: DataFrame, model: str = "skewnormal", score: str = "cn") -> DataFrame:
    """``probability`` by the model named: ``skewnormal``, ``normal`` or ``evcomplex``."""
    if model == "skewnormal":
        return mixture.add_probability(ecs, score)
    if model == "normal":
        return mixture.add_normal_probability(ecs, score)
    if model == "evcomplex":
        return C.minimum_scaled(ecs, score)
    raise ValueError(f"no model {model!r}; there are skewnormal, normal and evcomplex")


def complex_probability(ecs: DataFrame, model: str = "skewnormal", score: str = "cn", use_all: bool = False) -> DataFrame:
    """Mixture probabilities of pairs within and between segments, each by a fit of its own unless ``use_all``."""
    if use_all:
        return with_mixture_probability(ecs, model, score)
    between = F.col("segment_i") != F.col("segment_j")
    return with_mixture_probability(ecs.where(~between), model, score).unionByName(with_mixture_probability(ecs.where(between), model, score))


def compared(ecs: DataFrame, distances: DataFrame, multimer: DataFrame | None = None, cutoff: float | None = 5.0, score: str = "cn", least: int | None = 6, ties: tuple = ("i", "j")) -> DataFrame:
    """Distances of pairs (``dist_intra``, ``dist_multimer`` and the lesser, ``dist``, if both maps are given), long-range pairs only, and the precision down to each."""
    if multimer is None:
        rows = C.with_distances(ecs, distances)
    else:
        rows = C.with_distances(C.with_distances(ecs, distances, "dist_intra"), multimer, "dist_multimer")
        rows = rows.withColumn("dist", C.nearest_distance("dist_intra", "dist_multimer"))
    if least is not None:
        rows = C.long_range(rows, least)
    return rows if cutoff is None else C.precision(rows, cutoff, score, least or 0, ties=ties)


def complex_compared(ecs: DataFrame, intra: dict[str, DataFrame | tuple[DataFrame, DataFrame]], inter: DataFrame | None = None, cutoff: float = 5.0, score: str = "cn", least: int = 6, ties: tuple = ("i", "j")) -> DataFrame:
    """Each segment's pairs against its own map and the pairs between segments against theirs: ``segmentwise_precision``, then ``precision`` over all.

    ``intra``: a map for each segment, or one within and one between the chains of a multimer.  Pairs that have no map
    stay, all of them, without a distance: those of a segment that ``intra`` doesn't name, or between segments without ``inter``.
    """
    same = F.col("segment_i") == F.col("segment_j")
    part = lambda rows, maps, least: compared(rows, *maps, cutoff=cutoff, score=score, least=least, ties=ties).withColumnRenamed("precision", "segmentwise_precision")
    mapped = same & F.col("segment_i").isin(list(intra))
    unknown = ecs.where(same & ~mapped if inter is not None else ~mapped)
    rows = unknown.withColumns({"dist": F.lit(None).cast("double"), "segmentwise_precision": F.lit(None).cast("double")})
    if inter is not None:
        rows = rows.unionByName(part(ecs.where(~same), (inter,), None))
    for name, maps in intra.items():
        maps = maps if isinstance(maps, tuple) else (maps,)
        rows = rows.unionByName(part(ecs.where(same & (F.col("segment_i") == name)), maps, least), allowMissingColumns=True)
    return C.precision(rows, cutoff, score, 0, ties=ties)


def contact_map_rows(ecs: DataFrame, probabilities: list[float], counts: list[int], score: str = "score", probability: str = "probability", ties: tuple = ("i", "j")) -> DataFrame:
    """The pairs of each contact map of a sweep: ``kind`` (probability or count) and ``cutoff`` with each pair that passes it."""
    rows = ranked(ecs, score, list(ties), "_rank")
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(float(c)).alias("cutoff"))
    passed = [F.when(F.col(probability) >= c, entry("probability", c)) for c in probabilities] + [F.when(F.col("_rank") <= c, entry("count", c)) for c in counts]
    return rows.withColumn("_in", F.explode(F.array_compact(F.array(*passed)))).select("_in.*", *ecs.columns)


def axis_boundaries(ecs: DataFrame, distances: DataFrame | None, how: str | tuple = "union", symmetric: bool = True) -> dict[str, tuple]:
    """First and last position of either axis of a contact map, by pairs (``ecs``), known distances (``structure``), their ``union`` or ``intersection``, or as given."""
    if not isinstance(how, str):
        low, high = how
        return {"i": (low, high), "j": (low, high)}

    def ends(rows: DataFrame) -> dict[str, tuple]:
        r = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "ij" for f in (F.min, F.max))).first()
        if symmetric:
            values = [v for v in r if v is not None]
            both = (min(values, default=None), max(values, default=None))
            return {"i": both, "j": both}
        return {c: (r[f"min_{c}"], r[f"max_{c}"]) for c in "ij"}

    a = ends(ecs)
    if how == "ecs" or distances is None:
        return a
    b = ends(distances)
    if how == "structure":
        return b
    low, high = {"union": (min, max), "intersection": (max, min)}[how]
    pick = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    return {c: (pick(low, a[c][0], b[c][0]), pick(high, a[c][1], b[c][1])) for c in "ij"}


def cumulative(rows: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """Empirical distribution of a value: ``below``, how many rows come before each; an empty table is an error."""
    if rows.isEmpty():
        raise ValueError("no values to show the distribution of")
    return ranked(rows, value, ties, "below", descending=False).withColumn("below", F.col("below") - 1)


def job_summary(ecs: DataFrame, keys: list[str], order: list, significant: Column, hit: Column, at: int) -> DataFrame:
    """Per job: pairs, significant ones, and the precision at rank ``at``."""
    by_rank = Window.partitionBy(*keys).orderBy(*order)
    upto = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    rows = ecs.withColumns({"_rank": F.row_number().over(by_rank), "_precision": F.try_divide(F.sum(hit.cast("long")).over(upto), F.count("dist").over(upto)), "_significant": significant})
    return rows.groupBy(*keys).agg(F.count("*").alias("num_pairs"), F.sum(F.col("_significant").cast("long")).alias("num_significant"), F.max(F.when(F.col("_rank") == at, F.col("_precision"))).alias("precision"))


def complex_summary(ecs: DataFrame, keys: list[str], order: Column, significant: Column, hit: Column, at: int) -> DataFrame:
    """Per job: pairs, significant ones between segments, rank of the first pair between segments, and precision of those within, at rank ``at``."""
    by_rank = Window.partitionBy(*keys).orderBy(order, "i", "j")
    between = F.col("segment_i") != F.col("segment_j")
    within = Window.partitionBy(*keys, between.cast("int")).orderBy(order, "i", "j")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = ecs.withColumns({"_rank": F.row_number().over(by_rank), "_own": F.row_number().over(within), "_precision": F.try_divide(F.sum(hit.cast("long")).over(upto), F.count("dist").over(upto)), "_between": between, "_significant": significant})
    return rows.groupBy(*keys).agg(
        F.count("*").alias("num_pairs"),
        F.sum((F.col("_between") & F.col("_significant")).cast("long")).alias("num_significant_inter"),
        F.min(F.when(F.col("_between"), F.col("_rank"))).alias("first_inter_rank"),
        F.max(F.when(~F.col("_between") & (F.col("_own") == at), F.col("_precision"))).alias("precision_intra"),
        F.max(F.when(F.col("_between") & (F.col("_own") == at), F.col("_precision"))).alias("precision_inter"),
    )
