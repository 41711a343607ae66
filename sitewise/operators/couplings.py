"""Scores of position pairs ("evolutionary couplings"): tables with ``i, j`` and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import percentile, ranked, running_totals


def mutual_information(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """``i, j, mi_raw`` (natural logarithm) of pair and site frequencies."""
    at = lambda i, a, f: sites.select(F.col("pos").alias(i), F.col("sym").alias(a), F.col("frequency").alias(f))
    both = pairs.join(at("i", "a", "fa"), ["i", "a"]).join(at("j", "b", "fb"), ["j", "b"])
    term = F.when(F.col("frequency") > 0, F.col("frequency") * F.log(F.col("frequency") / (F.col("fa") * F.col("fb"))))
    return both.groupBy("i", "j").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("mi_raw"))


def product_corrected(scores: DataFrame, score: str, name: str) -> DataFrame:
    """Average product correction: each score less the product of its positions' mean scores over the grand mean.

    Means are computed within the plan; ``scores`` is read for each of them, so store it if it is dear.
    """
    both = scores.select("i", score).union(scores.select("j", score)).toDF("pos", "s")
    means = both.groupBy("pos").agg(F.avg("s").alias("mean"))
    grand = both.agg(F.coalesce(F.nullif(F.avg("s"), F.lit(0.0)), F.lit(1.0))).scalar()
    mean = lambda p, m: means.select(F.col("pos").alias(p), F.col("mean").alias(m))
    return scores.join(mean("i", "_mi"), "i").join(mean("j", "_mj"), "j").withColumn(name, F.col(score) - F.col("_mi") * F.col("_mj") / grand).drop("_mi", "_mj")


def zero_sum_gauge(couplings: DataFrame) -> DataFrame:
    """Couplings ``i, j, a, b, v`` less row and column means, plus the pair's mean."""
    over = lambda *c: F.avg("v").over(Window.partitionBy("i", "j", *c))
    return couplings.withColumn("v", F.col("v") - over("a") - over("b") + over())


def frobenius_norm(couplings: DataFrame) -> DataFrame:
    return couplings.groupBy("i", "j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("fn"))


def long_range(ecs: DataFrame, least: int = 6) -> DataFrame:
    return ecs.where(F.abs(F.col("i") - F.col("j")) >= least)


def top(ecs: DataFrame, n: int, score: str = "score") -> DataFrame:
    return ecs.orderBy(F.desc(score), "i", "j").limit(n)


def number_of_pairs(ecs: DataFrame, num_pairs: float | int) -> int:
    """A fraction of the number of sites, rounded up, or the number itself."""
    if isinstance(num_pairs, int):
        return num_pairs
    sites = ecs.select("i").union(ecs.select("j")).distinct().count()
    return -int(-num_pairs * sites // 1)


def enrichment(ecs: DataFrame, num_pairs: float | int = 1.0, score: str = "score", least: int = 6, ties: tuple = ("i", "j")) -> DataFrame:
    """``i, enrichment``: each site's summed score among the top long-range pairs, over their mean score."""
    n = number_of_pairs(ecs, num_pairs)
    rows = long_range(ecs, least).select(*dict.fromkeys(["i", "j", score, *ties]))
    best = ranked(rows, score, list(ties), "_rank").where(F.col("_rank") <= n).select("i", "j", score)
    mean = best.agg(F.avg(score)).first()[0]
    flat = best.select("i", score).union(best.select("j", score)).toDF("i", "s")
    return flat.groupBy("i").agg((F.sum("s") / F.lit(mean)).alias("enrichment"))


def mad_score(ecs: DataFrame, score: str = "score", name: str = "mad_score") -> DataFrame:
    """Distance from the median in units of 1.4826 median absolute deviations."""
    middle = percentile(ecs, score)
    spread = percentile(ecs.select(F.abs(F.col(score) - F.lit(middle)).alias("d")), "d")
    return ecs.withColumn(name, (F.col(score) - F.lit(middle)) / (1.4826 * F.lit(spread)))


def precision(ecs: DataFrame, cutoff: float = 5.0, score: str = "score", least: int = 6, dist: str = "dist", ties: tuple = ("i", "j")) -> DataFrame:
    """Share of pairs within ``cutoff`` among those of known distance, down to each row in order of score; null before the first."""
    rows = long_range(ecs, least)
    out = running_totals(rows, score, list(ties), {"_hits": (F.col(dist) <= cutoff).cast("long"), "_known": F.col(dist).isNotNull().cast("long")})
    return out.withColumn("precision", F.try_divide("_hits", "_known")).drop("_hits", "_known")


def with_distances(ecs: DataFrame, distances: DataFrame, name: str = "dist") -> DataFrame:
    """Distance of each pair, null where unknown."""
    return ecs.join(distances.select("i", "j", F.col("dist").alias(name)), ["i", "j"], "left")


def nearest_distance(*columns: str) -> Column:
    """Least of several distances, unknown ones left out."""
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def expected_true(ecs: DataFrame, n_sites: int, score: str = "score", probability: str = "probability", least: int = 6, ties: tuple = ("i", "j")) -> DataFrame:
    """``n_rows, expected`` of the rows down to the ``n_sites``-th long-range pair; short-range rows in between count too."""
    far = (F.abs(F.col("i") - F.col("j")) >= least).cast("long")
    upto = running_totals(ecs, score, list(ties), {"_far": far}).where(F.col("_far") <= n_sites)
    return upto.agg(F.count("*").alias("n_rows"), F.sum(probability).alias("expected"))


def minimum_scaled(ecs: DataFrame, score: str = "score", name: str = "probability") -> DataFrame:
    """Score over the absolute value of the least score."""
    least = ecs.agg(F.min(score)).first()[0]
    return ecs.withColumn(name, F.col(score) / F.abs(F.lit(least)))


def add_site_features(ecs: DataFrame, sites: DataFrame) -> DataFrame:
    """Joins ``pos, conservation, gap`` to both positions: least and greatest of each.

    Every position must be in ``sites``: a pair with one that isn't is an error when it is read.
    """
    at = lambda p: sites.select(F.col("pos").alias(p), F.struct("conservation", "gap").alias(f"_at_{p}"))
    joined = ecs.join(at("i"), "i", "left").join(at("j"), "j", "left")
    missing = F.raise_error(F.concat(F.lit("no features of a site of pair "), F.col("i"), F.lit(", "), F.col("j")))
    known = F.col("_at_i").isNotNull() & F.col("_at_j").isNotNull()
    ends = {f"{n}_{c}": F.when(known, f(f"_at_i.{c}", f"_at_j.{c}")).otherwise(missing.cast("double")) for n, f in (("min", F.least), ("max", F.greatest)) for c in ("conservation", "gap")}
    return joined.withColumns(ends).drop("_at_i", "_at_j")


def logistic_score(ecs: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """``score_logit`` and ``probability`` of a linear model over named columns."""
    z = F.lit(intercept)
    for name, weight in coefficients.items():
        z = z + weight * F.col(name)
    return ecs.withColumn("score_logit", z).withColumn("probability", 1 / (1 + F.exp(-F.col("score_logit"))))


def rank_bands(ecs: DataFrame, shares: list[float], score: str, ties: list[str]) -> DataFrame:
    """``band``: number, from 1, of the first share of all rows that holds the row's rank; one more than all shares for the rest."""
    n = ecs.count()
    rows = ranked(ecs, score, ties, "_rank")
    band = F.lit(len(shares) + 1)
    for k, share in reversed(list(enumerate(shares, 1))):
        band = F.when(F.col("_rank") <= int(share * n), k).otherwise(band)
    return rows.withColumn("band", band).drop("_rank")


def segment_map(ecs: DataFrame, segments: list[dict]) -> DataFrame:
    """``segment_i, pos_i, segment_j, pos_j`` of model indices: segments are laid end to end, ``{'segment', 'start', 'end'}`` each."""
    def place(c: str) -> tuple[Column, Column]:
        name, pos, base = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
        for s in segments:
            size = s["end"] - s["start"] + 1
            inside = (F.col(c) > base) & (F.col(c) <= base + size)
            name, pos = F.when(inside, s["segment"]).otherwise(name), F.when(inside, F.col(c) - base + s["start"] - 1).otherwise(pos)
            base += size
        return name, pos

    (si, pi), (sj, pj) = place("i"), place("j")
    return ecs.withColumns({"segment_i": si, "pos_i": pi, "segment_j": sj, "pos_j": pj})


def inter_segment(ecs: DataFrame) -> DataFrame:
    return ecs.where(F.col("segment_i") != F.col("segment_j"))
