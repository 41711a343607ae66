"""Text formats written by Spark: each row becomes one or more lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wrap


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """Records of ``header, seq``, wrapped."""
    write_lines(sequences, F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("seq"), width)), path)


def write_aln(sequences: DataFrame, path: str) -> None:
    """One sequence a line."""
    write_lines(sequences, F.col("seq"), path)


def write_a3m(sequences: DataFrame, path: str, insert_gap: str = ".") -> None:
    write_lines(sequences, F.concat(F.lit(">"), "header", F.lit("\n"), F.translate("seq", insert_gap, "")), path)


def write_alignment(sequences: DataFrame, path: str, fmt: str = "fasta") -> None:
    {"fasta": write_fasta, "aln": write_aln, "a3m": write_a3m}[fmt](sequences, path)


def write_ecs(ecs: DataFrame, path: str, scores: list[str]) -> None:
    """Space-separated pairs, scores to six decimals."""
    line = F.concat_ws(" ", "i", "A_i", "j", "A_j", *(F.format_string("%.6f", s) for s in scores))
    write_lines(ecs, line, path)


def pdb_line() -> Column:
    """Fixed-width ``ATOM`` line of ``atom_id, atom_name, residue_name, chain, residue (int), x, y, z, occupancy, b_factor, element``; numbers too wide raise."""
    wide = (F.col("atom_id") > 99999) | (F.col("residue") > 9999)
    name = F.when(F.length("atom_name") < 4, F.rpad(F.concat(F.lit(" "), "atom_name"), 4, " ")).otherwise(F.col("atom_name"))
    line = F.format_string("ATOM  %5d %4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "atom_id", name, "residue_name", "chain", "residue", "x", "y", "z", "occupancy", "b_factor", "element")
    return F.when(wide, F.raise_error(F.lit("number too wide for the format")).cast("string")).otherwise(line)


def write_pdb(atoms: DataFrame, path: str) -> None:
    write_lines(atoms.orderBy("atom_id"), pdb_line(), path)


def three_letter_lines(sequence: Column, names: dict[str, str], per_line: int = 16) -> Column:
    """A one-letter sequence as lines of three-letter residues; an unknown letter raises."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    words = F.transform(F.split(sequence, ""), lambda c: F.coalesce(table[c], F.raise_error(F.concat(F.lit("unknown residue: "), c)).cast("string")))
    starts = F.sequence(F.lit(1), F.size(words), F.lit(per_line))
    return F.array_join(F.transform(starts, lambda s: F.array_join(F.slice(words, s, F.lit(per_line)), " ")), "\n")


def pair_script(pairs: DataFrame, path: str, prefix: str = "ec", cutoff: float = 5.0) -> None:
    """Drawing commands of pairs (``i, j, score, dist``): width by share of the greatest score, colour by distance."""
    top = pairs.agg(F.max("score")).first()[0] or 1.0
    colour = F.when(F.col("dist").isNull(), "grey").when(F.col("dist") <= cutoff, "green").otherwise("red")
    name = F.concat(F.lit(prefix), "i", F.lit("_"), "j")
    width = F.format_string("%.4f", F.greatest(F.lit(0.0), F.col("score") * 0.5 / top))
    lines = F.array(
        F.concat(F.lit("dist "), name, F.lit(", resid "), "i", F.lit(" and name CA, resid "), "j", F.lit(" and name CA")),
        F.concat(F.lit("color "), colour, F.lit(", "), name),
        F.concat(F.lit("set dash_radius, "), width, F.lit(", "), name),
    )
    write_lines(pairs, F.array_join(lines, "\n"), path)


def site_script(sites: DataFrame, path: str) -> None:
    """Colour commands of positions (``pos, colour``)."""
    write_lines(sites.where("colour IS NOT NULL"), F.concat(F.lit("color "), "colour", F.lit(", resi "), "pos"), path)


def couplings_json(pairs: DataFrame, n: int) -> DataFrame:
    """One JSON document of the top pairs (``i, j, score``) for a viewer."""
    best = pairs.orderBy(F.desc("score"), "i", "j").limit(n)
    rows = F.sort_array(F.collect_list(F.struct(F.col("score"), "i", "j")), asc=False)
    return best.agg(F.to_json(F.struct(F.lit(n).alias("n"), rows.alias("couplings"))).alias("json"))
