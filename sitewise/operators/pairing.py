"""Pairing of genes and sequences across two families, and resolution of overlapping hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import gene_distance
from .overlaps import overlap_hits  # noqa: F401


def possible_partners(genes1: DataFrame, genes2: DataFrame) -> DataFrame:
    """``id_1, id_2, distance`` of genes on the same genome (``genome_id, id, gene_start, gene_end``; rows with nulls go)."""
    side = lambda g, k: g.select("genome_id", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "gene_start", "gene_end"))).dropna().distinct()
    both = side(genes1, 1).join(side(genes2, 2), "genome_id")
    return both.select("genome_id", "id_1", "id_2", gene_distance(*map(F.col, ("gene_start_1", "gene_end_1", "gene_start_2", "gene_end_2"))).alias("distance"))


def _nearest(pairs: DataFrame, by: str, other: str) -> DataFrame:
    best = pairs.groupBy(by).agg(F.min(F.struct("distance", other)).alias("m"))
    return best.select(by, F.col(f"m.{other}").alias(other), F.col("m.distance").alias("distance"))


def reciprocal_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs each of which is the other's nearest; ties go to the smaller id."""
    return _nearest(pairs, "id_1", "id_2").join(_nearest(pairs, "id_2", "id_1"), ["id_1", "id_2", "distance"])


def genome_distance_pairs(genes1: DataFrame, genes2: DataFrame, threshold: int | None = None) -> DataFrame:
    """Reciprocal nearest genes, nearer than ``threshold`` if it is given and not 0."""
    pairs = reciprocal_pairs(possible_partners(genes1, genes2))
    return pairs.where(F.col("distance") < threshold) if threshold else pairs


def without_clan_overlaps(hits: DataFrame) -> DataFrame:
    """Drops hits that overlap a better one of the same query and clan; on equal scores the smaller ``idx`` is better; a null clan is kept."""
    better = hits.select("query", "clan", *(F.col(c).alias(f"{c}_2") for c in ("idx", "start", "stop", "score")))
    worse = (F.col("score_2") > F.col("score")) | ((F.col("score_2") == F.col("score")) & (F.col("idx_2") < F.col("idx")))
    overlap = (F.col("start") < F.col("stop_2")) & (F.col("start_2") < F.col("stop"))
    keys = ["query", "clan", "idx", "start", "stop", "score"]
    losers = hits.join(better, ["query", "clan"]).where(worse & overlap).select(*keys).distinct()
    return hits.join(losers, keys, "left_anti")


def best_hit_by_species(identities: DataFrame) -> DataFrame:
    """The row of highest ``identity`` of each ``species`` (null ones go); ties go to the larger ``id``, as a whole row."""
    rows = identities.where(F.col("species").isNotNull())
    best = rows.groupBy("species").agg(F.max(F.struct("identity", "id")).alias("m"))
    return best.select("species", "m.id", "m.identity")


def paralogs(identities: DataFrame, target_id: str, threshold: float) -> DataFrame:
    """Hits of the target's species (any species of an id that contains ``target_id``) below the identity threshold."""
    species = identities.where(F.col("id").cast("string").contains(target_id)).select("species").distinct()
    return identities.where(F.col("identity") < threshold).join(species, "species", "left_semi")


def best_reciprocal(best: DataFrame, pair_identities: DataFrame, allowed_error: float = 0.02) -> DataFrame:
    """Best hits whose identity to every paralog (``id, paralog, identity``) is below their own to the query plus the error; without paralogs all stay."""
    bad = best.alias("b").join(pair_identities.alias("p"), F.col("b.id") == F.col("p.id")).where(F.col("p.identity") >= F.col("b.identity") + allowed_error).select(F.col("b.id").alias("id")).distinct()
    return best.join(bad, "id", "left_anti")


def concatenated(pairs: DataFrame, sequences1: DataFrame, sequences2: DataFrame) -> DataFrame:
    """``id_1, id_2, seq``: paired sequences end to end (``id, seq``)."""
    a = sequences1.select(F.col("id").alias("id_1"), F.col("seq").alias("_1"))
    b = sequences2.select(F.col("id").alias("id_2"), F.col("seq").alias("_2"))
    return pairs.join(a, "id_1").join(b, "id_2").select("id_1", "id_2", F.concat("_1", "_2").alias("seq"))


def describe_concatenation(table1: DataFrame, table2: DataFrame) -> DataFrame:
    """Sequences, distinct species, species in common, and median sequences per species of two annotated tables (``id, species``)."""
    def one(t: DataFrame, k: int) -> DataFrame:
        per = t.groupBy("species").agg(F.count("*").alias("n"))
        return per.agg(F.sum("n").alias(f"num_seqs_{k}"), F.count("species").alias(f"num_nonred_species_{k}"), F.percentile(F.when(F.col("species").isNotNull(), F.col("n")), F.lit(0.5)).alias(f"median_num_per_species_{k}"))

    a, b = one(table1, 1).first(), one(table2, 2).first()
    overlap = table1.select("species").where("species IS NOT NULL").distinct().join(table2.select("species").distinct(), "species").agg(F.count("*").alias("num_species_overlap"))
    scalars = {**a.asDict(), **b.asDict()}
    return overlap.select(*(F.lit(v).alias(k) for k, v in scalars.items()), "num_species_overlap")


def unique_cds(rows: DataFrame) -> DataFrame:
    """Coding sequences of an accession (``ac, genome, cds``) that lie on exactly one genome."""
    return rows.groupBy("ac", "cds").agg(F.count("*").alias("n"), F.min("genome").alias("genome")).where("n = 1").drop("n")


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
