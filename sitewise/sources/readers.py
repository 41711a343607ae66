"""Text formats as typed DataFrames.

Files of many small records are read by record separator, so a large FASTA file
is split between tasks; formats whose lines depend on earlier ones are read one
file a row and taken apart with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_match, header_parts
from ..operators.running import ranked
from .stockholm import read_stockholm, read_stockholm_annotation  # noqa: F401

#: Column names of the two hit tables, in order of the files.
TBL = "target_name target_accession query_name query_accession full_evalue full_score full_bias domain_evalue domain_score domain_bias exp reg clu ov env dom rep inc description"
DOMTBL = "target_name target_accession target_len query_name query_accession query_len evalue score bias domain_no num_domains domain_c_evalue domain_i_evalue domain_score domain_bias hmm_from hmm_to ali_from ali_to env_from env_to acc description"
_LONG = set("target_len query_len domain_no num_domains hmm_from hmm_to ali_from ali_to env_from env_to reg clu ov env dom rep inc".split())
_TEXT = set("target_name target_accession query_name query_accession description".split())
EC_SCHEMA = "i long, A_i string, j long, A_j string, fn double, cn double"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, seq`` of FASTA or A2M records; lines that begin with ``;`` are comments. Records are split at ``\\n>``."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "(?m)^;.*$", "").alias("v"))
    records = records.select("file", F.regexp_replace("v", r"^\s*>", "").alias("v")).where(F.trim("v") != "")
    header = F.trim(F.substring_index("v", "\n", 1))
    body = F.when(F.instr("v", "\n") > 0, F.substring("v", F.instr("v", "\n") + 1, F.length("v"))).otherwise("")
    return records.select("file", header.alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``seq_idx``, the row's number in order of a column of unique values."""
    return ranked(df, order, [], "seq_idx", descending=False)


def a3m_to_a2m(sequences: DataFrame, first: str, inserts: str = "first") -> DataFrame:
    """Sequences in which lower-case inserts are expanded to the columns of the first record.

    ``first``: insert columns that the first record has become columns of all
    (``.`` where a sequence has none); ``delete``: all inserts go.
    """
    upper = F.array_join(F.filter(F.split("seq", ""), lambda c: (c == F.upper(c))), "")
    if inserts == "delete":
        return sequences.withColumn("seq", upper)
    if inserts != "first":
        raise ValueError("inserts must be first or delete")
    kept, at = [], 0
    for c in first:
        if c == c.upper():
            at += 1
            kept.append(F.substring(upper, at, 1))
        else:
            kept.append(F.lit("."))
    same = F.col("seq") == first
    return sequences.withColumn("seq", F.when(same, F.col("seq")).otherwise(F.concat(*kept)))


def detect_format(spark: SparkSession, path: str) -> str | None:
    """``fasta``, ``a3m`` (by suffix), ``stockholm`` or None, from the first line with text."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        return None
    if first[0].value.startswith("# STOCKHOLM"):
        return "stockholm"
    if first[0].value.startswith(">"):
        return "a3m" if path.endswith(".a3m") else "fasta"
    return None


def read_alignment(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``seq_id, seq``; of rows of one id the last stays."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "stockholm":
        return read_stockholm(spark, path).select("seq_id", "seq")
    if fmt not in ("fasta", "a3m"):
        raise ValueError(f"unknown alignment format: {fmt}")
    rows = read_fasta(spark, path).select(F.split("header", r"\s+")[0].alias("seq_id"), "seq")
    if fmt == "a3m":
        rows = a3m_to_a2m(rows, rows.first().seq)
    # records are numbered as they are read, before any shuffle
    return rows.withColumn("_n", F.monotonically_increasing_id()).groupBy("seq_id").agg(F.max_by("seq", "_n").alias("seq"))


def with_ranges(sequences: DataFrame) -> DataFrame:
    """``name, first, last`` of ids like ``name/1-20``."""
    name, first, last = header_parts(F.col("seq_id"))
    return sequences.withColumns({"name": name, "first": first, "last": last})


def read_hits(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A whitespace table with ``#`` comments whose last column may hold spaces (``TBL`` or ``DOMTBL``)."""
    names = columns.split()
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+", len(names))
    kind = lambda c: "string" if c in _TEXT else "long" if c in _LONG else "double"
    return lines.select(*(F.get(parts, F.lit(k)).cast(kind(c)).alias(c) for k, c in enumerate(names)))


def read_ecs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EC_SCHEMA).csv(path, sep=" ")


def read_structure_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of structures on sequences; rows whose two spans differ in length go."""
    schema = "pdb_id string, pdb_chain string, uniprot_ac string, resseq_start long, resseq_end long, coord_start string, coord_end string, uniprot_start long, uniprot_end long"
    return spark.read.schema(schema).csv(path, comment="#", header=True).where("resseq_end - resseq_start = uniprot_end - uniprot_start")


def read_cds_table(spark: SparkSession, path: str) -> DataFrame:
    """``ac, genome, cds`` of lines ``accession genome:cds,genome:cds``."""
    rows = spark.read.schema("ac string, ena string").csv(path, sep=" ")
    pair = F.split("p", ":")
    return rows.select("ac", F.explode(F.split("ena", ",")).alias("p")).where(F.size(pair) == 2).select("ac", pair[0].alias("genome"), pair[1].alias("cds"))


def read_gene_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cds string, genome_id string, uniprot_ac string, gene_start long, gene_end long").csv(path, sep="\t")


def family_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``family, n`` of a flat file of alignments: ``#=GF AC`` and ``#=GF SQ`` of each record, records ended by ``//``."""
    records = spark.read.option("lineSep", "//\n").text(path)
    of = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^#=GF {key}\s+([^\s.;]+)", 1), F.lit(""))
    return records.select(of("AC").alias("family"), of("SQ").cast("long").alias("n")).where("family IS NOT NULL AND n IS NOT NULL")


def pdb_columns(lines: DataFrame, *first: Column) -> DataFrame:
    """Columns ``first`` and the fixed columns of those of the lines ``value`` that are atoms."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n: F.nullif(cut(a, n), F.lit("")).cast("double")
    return lines.where(F.col("value").rlike("^(ATOM  |HETATM)")).select(
        *first, cut(7, 5).cast("long").alias("atom_id"), cut(13, 4).alias("atom_name"), cut(17, 1).alias("alt_loc"), cut(18, 3).alias("residue_name"), cut(22, 1).alias("chain"), cut(23, 5).alias("residue"),
        number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(55, 6).alias("occupancy"), number(61, 6).alias("b_factor"), cut(77, 2).alias("element"), F.col("value").startswith("HETATM").alias("hetatm"),
    )


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Fixed columns of ``ATOM`` and ``HETATM`` lines of all models; a residue id is a string and may end in an insertion code."""
    return pdb_columns(spark.read.text(path), F.input_file_name().alias("file"))


def read_secondary_structure(spark: SparkSession, path: str, first_index: int = 1) -> DataFrame:
    """``i, A_i, ss, confidence`` of a vertical prediction: lines of number, residue, state and numbers."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+[A-Z]\s+[HEC]\b"))
    p = F.split(F.trim("value"), r"\s+")
    best = F.array_max(F.transform(F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))), lambda c: c.cast("double")))
    return lines.select((p[0].cast("int") + first_index - 1).alias("i"), p[1].alias("A_i"), p[2].alias("ss"), best.alias("confidence"))


def read_inference_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per log: valid and all sequences, sites, effective sequences, and region start, where given."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    of = lambda pattern, k, kind: F.nullif(F.regexp_extract("value", pattern, k), F.lit("")).cast(kind)
    return files.select(
        "file", of(r"(\d+) valid sequences out of (\d+)", 1, "long").alias("num_valid_seqs"), of(r"(\d+) valid sequences out of (\d+)", 2, "long").alias("num_total_seqs"), of(r"(\d+) sites", 1, "long").alias("num_valid_sites"),
        of(r"Effective number of samples: ([\d.]+)", 1, "double").alias("effective_samples"), of(r"Region starts at (\d+)", 1, "long").alias("region_start"),
    )


def read_inference_iterations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numeric rows of a log's iteration table, by line number of the file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    rows = files.where(F.col("text").rlike(rf"^\s*[-+\d.eE]+(\s+[-+\d.eE]+){{{len(columns) - 1}}}\s*$")).withColumn("p", F.split(F.trim("text"), r"\s+"))
    return rows.select("file", "line", *(F.col("p")[k].cast("double").alias(c) for k, c in enumerate(columns)))


def read_model_comparison(spark: SparkSession, path: str) -> DataFrame:
    """``filename, pairs, rmsd, maxsub, tm, msi`` of a scorer's output lines."""
    pattern = r"Pairs=\s*(\d+),\s*RMSD=\s*([\d.]+),\s*MaxSub=\s*([\d.]+),\s*TM=\s*([\d.]+),\s*MSI=\s*([\d.]+)"
    of = lambda k, kind: F.regexp_extract("value", pattern, k).cast(kind)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    name = F.regexp_extract("value", r"(\S+\.pdb)", 1)
    return rows.select(name.alias("filename"), of(1, "long").alias("pairs"), of(2, "double").alias("rmsd"), of(3, "double").alias("maxsub"), of(4, "double").alias("tm"), of(5, "double").alias("msi"))


def retrieve_ids(headers: DataFrame, patterns: list[str]) -> DataFrame:
    """``header, id``: first group of the first pattern that matches; headers without one go."""
    return headers.select("header", first_match(F.col("header"), patterns).alias("id")).where("id IS NOT NULL")


def checked_lengths(sequences: DataFrame) -> DataFrame:
    """Raises if sequences differ in length."""
    low, high = sequences.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if low != high:
        raise ValueError(f"sequences have between {low} and {high} positions")
    return sequences

