"""Lookups of structures, chains, indices, families and annotations: filters and equi-joins with their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = ("resseq_start", "resseq_end", "coord_start", "coord_end", "uniprot_start", "uniprot_end")


def _named(segments: DataFrame, uniprot: str):
    found = F.col("uniprot_ac") == uniprot
    return found | (F.col("uniprot_id") == uniprot) if "uniprot_id" in segments.columns else found


def by_pdb_id(segments: DataFrame, pdb_id: str, chain: str | None = None, uniprot: str | None = None) -> DataFrame:
    """Structure segments of an entry, maybe of one chain and sequence; an error if several sequences are left."""
    rows = segments.where(F.col("pdb_id") == pdb_id.lower())
    if chain is not None:
        rows = rows.where(F.col("pdb_chain") == chain)
    if uniprot is not None:
        rows = rows.where(_named(segments, uniprot))
    several = [r.uniprot_ac for r in rows.select("uniprot_ac").distinct().limit(5).collect()]
    if len(several) > 1:
        raise ValueError(f"the chains hold several sequences, name one of {', '.join(sorted(several))}")
    return rows


def by_uniprot_id(segments: DataFrame, uniprot: str, reduce_chains: bool = False) -> DataFrame:
    """Structure segments of a sequence by accession or name; ``reduce_chains``: of the first chain of each entry."""
    rows = segments.where(_named(segments, uniprot))
    if not reduce_chains:
        return rows
    first = rows.groupBy("pdb_id").agg(F.min("pdb_chain").alias("pdb_chain"))
    return rows.join(first, ["pdb_id", "pdb_chain"], "left_semi")


def chain_mappings(segments: DataFrame) -> DataFrame:
    """``pdb_id, pdb_chain, ranges``: each chain's ranges in the structure and on the sequence, in order; a row is a chain's few segments."""
    ranges = F.sort_array(F.collect_list(F.struct("uniprot_start", *(c for c in RANGE if c in segments.columns and c != "uniprot_start"))))
    return segments.groupBy("pdb_id", "pdb_chain").agg(ranges.alias("ranges"))


def chosen_structures(hits: DataFrame, pdb_ids: list[str] | None = None, most_hits: int | None = None, most_structures: int | None = None, order: tuple = ("pdb_id", "pdb_chain")) -> DataFrame:
    """Hits of listed entries, the first ``most_hits`` in order, and of those the first ``most_structures`` entries."""
    if pdb_ids is not None:
        hits = hits.where(F.col("pdb_id").isin([p.lower() for p in pdb_ids]))
    if most_hits is not None:
        hits = hits.orderBy(*order).limit(most_hits)
    if most_structures is not None:
        rank = F.min(F.struct(*(F.col(c) for c in order))).alias("_first")
        first = hits.groupBy("pdb_id").agg(rank).orderBy("_first").limit(most_structures)
        hits = hits.join(first.select("pdb_id"), "pdb_id", "left_semi")
    return hits


def with_atoms(residues: DataFrame, atoms: DataFrame, names: list[str] | str = "CA", name: str = "atom_name") -> tuple[DataFrame, DataFrame]:
    """Atoms of those names, and the residues that have one (keys ``chain, residue``)."""
    kept = atoms.where(F.col(name).isin([names] if isinstance(names, (str, int)) else list(names)))
    return residues.join(kept, ["chain", "residue"], "left_semi"), kept


def at_positions(residues: DataFrame, atoms: DataFrame, positions: list) -> tuple[DataFrame, DataFrame]:
    """Residues of those ids, and their atoms."""
    kept = residues.where(F.col("residue").isin(list(positions)))
    return kept, atoms.join(kept, ["chain", "residue"], "left_semi")


def atom_rows(atoms: DataFrame) -> DataFrame:
    """``chain, residue, first, last``: the atoms of each residue by ``atom_idx``."""
    return atoms.groupBy("chain", "residue").agg(F.min("atom_idx").alias("first"), F.max("atom_idx").alias("last"))


def with_letters(residues: DataFrame, letters: DataFrame) -> DataFrame:
    """Residues (``residue``) under the letters of a table ``pos, letter``; others go."""
    return residues.drop("letter").join(letters.select(F.col("pos").alias("residue"), "letter"), "residue")


def transposed(distances: DataFrame) -> DataFrame:
    return distances.select(*(F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in distances.columns))


def remapped_chains(atoms: DataFrame, mapping: DataFrame, letters: DataFrame | None = None, names: tuple = ("N", "CA", "C", "O")) -> DataFrame:
    """Atoms of the backbone under sequence numbers (``pdb_id, chain, source, target``), maybe with the sequence's letters."""
    kept = atoms.where(F.col("atom_name").isin(list(names)))
    rows = kept.join(mapping.select("pdb_id", "chain", F.col("source").alias("residue"), "target"), ["pdb_id", "chain", "residue"]).drop("residue").withColumnRenamed("target", "residue")
    return with_letters(rows, letters) if letters is not None else rows


def remapped_complexes(atoms: DataFrame, first: DataFrame, second: DataFrame, letters: tuple = (None, None), names: tuple = ("N", "CA", "C", "O"), chains: tuple = ("A", "B")) -> DataFrame:
    """A complex for each chain of one side with each of the other in the same entry: ``pdb_id, chain_1, chain_2`` name it.

    Its atoms are under sequence numbers, ``side`` 1 and 2, in chains renamed to ``chains``.  A chain's atoms stand
    in every complex that it is part of; write with ``partitionBy("pdb_id", "chain_1", "chain_2")`` for a folder each.
    """
    hits = [m.select("pdb_id", F.col("chain").alias(f"chain_{k}")).distinct() for k, m in enumerate((first, second), 1)]
    pairs = hits[0].join(hits[1], "pdb_id")
    sides = [
        remapped_chains(atoms, m, s, names).withColumnRenamed("chain", f"chain_{k}").join(pairs, ["pdb_id", f"chain_{k}"]).withColumns({"side": F.lit(k), "chain": F.lit(name)})
        for k, (m, s, name) in enumerate(zip((first, second), letters, chains), 1)
    ]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def segment_index(spark: SparkSession, segments: list[dict]) -> DataFrame:
    """``model, segment, pos``: segments laid end to end, ``{'segment', 'start', 'end'}`` each, or with a list of ``positions``."""
    rows, model = [], 0
    for s in segments:
        for pos in s.get("positions") or range(s["start"], s["end"] + 1):
            model += 1
            rows.append((model, s["segment"], pos))
    return spark.createDataFrame(rows, "model long, segment string, pos long")


def to_model(targets: DataFrame, index: DataFrame) -> DataFrame:
    """Model indices of ``segment, pos``; those outside the segments have none."""
    return targets.join(index, ["segment", "pos"], "left")


def patched(table: DataFrame, index: DataFrame, columns: tuple = ("i", "j")) -> DataFrame:
    """A table of model indices under target numbers, ``segment_i`` and the like beside them; an error if one is missing."""
    out = table
    for c in columns:
        at = index.select(F.col("model").alias(c), F.col("segment").alias(f"segment_{c}"), F.col("pos").alias(f"_{c}"))
        if not table.join(at, c, "left_anti").isEmpty():
            raise ValueError(f"the segments don't cover all of column {c}")
        out = out.join(F.broadcast(at), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out


def inter_segment_model(fields: DataFrame, couplings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of 0, and couplings between segments only."""
    return fields.withColumn("v", F.lit(0.0)), couplings.where(F.col("segment_i") != F.col("segment_j"))


def independent_model(sites: DataFrame) -> DataFrame:
    """Fields ``i, a, v`` of a model without couplings: logarithms of regularised frequencies."""
    return sites.select(F.col("pos").alias("i"), F.col("sym").alias("a"), F.log("frequency").alias("v"))


def family_hits(hits: DataFrame, clans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Domain hits with their clan and family size, null where unknown, and sequences per position, ``num_seqs / target_len``."""
    rows = hits.join(clans, "family", "left").join(sizes.withColumnRenamed("n", "num_seqs"), "family", "left")
    return rows.withColumn("num_seqs_over_len", F.col("num_seqs") / F.col("target_len"))


def alignment_index(rows: DataFrame, target: list[int], gap: int = 0) -> DataFrame:
    """``other, target_i, other_i``: running positions of the target (its symbols) and of each other sequence at columns where both have a symbol."""
    upto = lambda array, k: F.size(F.filter(F.slice(array, F.lit(1), k + 1), lambda s: s != gap))
    numbers, n = [], 0
    for s in target:
        n += s != gap
        numbers.append(n if s != gap else None)
    mine = F.array(*(F.lit(v).cast("int") for v in numbers))
    both = F.zip_with(mine, F.transform("residues", lambda s, k: F.when(s != gap, upto("residues", k))), lambda a, b: F.struct(a.alias("target_i"), b.alias("other_i")))
    return rows.select(F.col("seq_idx").alias("other"), F.inline(both)).where("target_i IS NOT NULL AND other_i IS NOT NULL")


def species_annotation(table: DataFrame, columns: tuple = ("OS", "Tax")) -> DataFrame:
    """``id, name, species``: the first of the columns that has the most values; an error if none has any."""
    counts = table.agg(*(F.count(c).alias(c) for c in columns)).first()
    best = max(columns, key=lambda c: counts[c])  # the first of equals
    if not counts[best]:
        raise ValueError(f"none of {', '.join(columns)} has a value")
    return table.select("id", "name", F.col(best).alias("species"))


def paired_by_species(best1: DataFrame, best2: DataFrame) -> DataFrame:
    """Best hits of both sides of each species they share."""
    side = lambda t, k: t.select("species", F.col("id").alias(f"id_{k}"), F.col("identity").alias(f"identity_{k}"))
    return side(best1, 1).join(side(best2, 2), "species")


def complex_segments(first: list[dict], second: list[dict]) -> list[dict]:
    """Both sides' segments under names A_1, A_2 and B_1, B_2 and so on."""
    return [{**s, "segment": f"{side}_{k}"} for side, segments in (("A", first), ("B", second)) for k, s in enumerate(segments, 1)]


def with_full_header(annotation: DataFrame, headers: DataFrame) -> DataFrame:
    """Annotation rows by ``id`` under each full header they belong to."""
    return annotation.join(headers.select("id", "header"), "id")


def merged_clusterings(clusterings: dict[str, DataFrame]) -> DataFrame:
    """Clusters of models (``filename, cluster``) by several measures side by side, null where a measure lacks a model."""
    out = None
    for name, table in clusterings.items():
        one = table.select("filename", F.col("cluster").alias(f"cluster_{name}"))
        out = one if out is None else out.join(one, "filename", "full")
    return out
