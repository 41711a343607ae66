"""Stockholm files read by record, and a query laid over the match columns of a search result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST = "# STOCKHOLM"
MATCH = "x"
GAP = "-"


def _raised(message: str, *of: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), *of)).cast("string")


def stockholm_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, aln, block``: the lines of each alignment before its ``//``, numbered from 0 in a file.

    Records are split at their first lines, so a file of many alignments is
    read by as many tasks as it has splits, and a record without its ``//`` is
    seen as such.  A record's number is its number within its split, plus the
    records of the file's splits before it, a table of one row a split.
    A missing first line or ``//`` raises; a file of blank lines has no records.
    """
    lines = spark.read.option("lineSep", "\n" + FIRST).text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at")]
    read = lines.select(*at, F.monotonically_increasing_id().alias("_n"), "value").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    splits = read.groupBy("file", "_at").agg(F.min("_n").alias("_least"), F.count("*").alias("_of"))
    before = F.coalesce(F.sum("_of").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = read.join(splits.select("file", "_at", (before - F.col("_least")).alias("_shift")), ["file", "_at"]).withColumn("aln", (F.col("_n") + F.col("_shift")).cast("int"))
    # all records but a file's first lost the words at which they were split
    text = F.when(F.col("aln") == 0, F.regexp_replace("value", rf"^{FIRST}", "")).otherwise(F.col("value"))
    headed = text.startswith(" 1.0") & ((F.col("aln") > 0) | F.col("value").startswith(FIRST))
    ended = F.col("value").rlike(r"(?m)^//") & F.trim(F.regexp_replace("value", r"(?s)^.*?(?:^|\n)//[^\n]*", "")).rlike(r"^\s*$")
    whole = F.when(~headed, _raised("not a Stockholm file: ", "file")).when(~ended, _raised("a Stockholm record without its end, or text after it: ", "file"))
    return numbered.select("file", "aln", whole.otherwise(F.regexp_replace(text, r"(?s)(?:^|\n)//.*$", "")).alias("block"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, aln, line, text`` of all lines after the first."""
    rows = stockholm_records(spark, path).select("file", "aln", F.posexplode(F.split("block", "\r?\n")).alias("line", "text"))
    return rows.where((F.col("line") > 0) & (F.trim("text") != ""))


def read_stockholm(spark: SparkSession, path: str, raise_prefixed: bool = True) -> DataFrame:
    """``file, aln, seq_id, line, seq`` of Stockholm alignments: blocks of an id are joined in order of lines; ``line`` is the first.

    A missing first line, a missing ``//`` and ids like ``1|name`` raise.
    """
    p = F.split(F.trim("text"), r"\s+")
    rows = _lines(spark, path).where(~F.col("text").startswith("#") & (F.size(p) == 2)).select("file", "aln", "line", p[0].alias("seq_id"), p[1].alias("chunk"))
    if raise_prefixed:
        rows = rows.withColumn("seq_id", F.when(F.col("seq_id").rlike(r"^\d+\|"), _raised("prefixed id: ", "seq_id")).otherwise(F.col("seq_id")))
    parts = F.sort_array(F.collect_list(F.struct("line", "chunk")))
    return rows.groupBy("file", "aln", "seq_id").agg(F.min("line").alias("line"), F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("seq"))


def read_stockholm_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``file, aln, line, kind, name, feature, value`` of GF, GC, GS and GR lines."""
    of = lambda pattern, k: F.nullif(F.regexp_extract("text", pattern, k), F.lit(""))
    whole, named = r"^#=(G[FC])\s+(\S+)\s+(.*?)\s*$", r"^#=(G[SR])\s+(\S+)\s+(\S+)\s+(.*?)\s*$"
    rows = _lines(spark, path).where(F.col("text").startswith("#="))
    rows = rows.select("file", "aln", "line", F.coalesce(of(whole, 1), of(named, 1)).alias("kind"), of(named, 2).alias("name"), F.coalesce(of(whole, 2), of(named, 3)).alias("feature"), F.coalesce(of(whole, 3), of(named, 4)).alias("value"))
    return rows.where("kind IS NOT NULL")


def column_annotation(annotation: DataFrame, feature: str) -> DataFrame:
    """``file, aln, value``: a column annotation (GC) whose blocks are joined in order of lines."""
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))
    rows = annotation.where((F.col("kind") == "GC") & (F.col("feature") == feature))
    return rows.groupBy("file", "aln").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))


def lifted(reference: Column, query: Column) -> Column:
    """``query`` over the columns of a reference line: its letters in turn at match columns, gaps elsewhere.

    The reference line is cut into runs and each run takes its part of the
    query, so the work follows the number of runs.  A query with more or fewer
    letters than match columns raises; so does a null reference.
    """
    runs = F.regexp_extract_all(reference, F.lit(f"({MATCH}+|[^{MATCH}]+)"), F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(done: Column, run: Column) -> Column:
        n, match = F.length(run), run.startswith(MATCH)
        part = F.when(match, F.substring(query, done["at"], n)).otherwise(F.repeat(F.lit(GAP), n))
        return F.struct(F.concat(done["out"], part).alias("out"), (done["at"] + F.when(match, n).otherwise(0)).alias("at"))

    n_match = F.length(F.regexp_replace(reference, f"[^{MATCH}]", ""))
    return (
        F.when(reference.isNull(), _raised("no annotation of match states"))
        .when(n_match != F.length(query), _raised("match columns and letters of the query differ in number"))
        .otherwise(F.aggregate(runs, start, step, lambda done: done["out"]))
    )


def match_positions(references: DataFrame, *keys: str, reference: str = "value") -> DataFrame:
    """``keys, column, pos`` (both from 1) of match columns: which position of the query each is."""
    marked = F.transform(F.split(reference, ""), lambda c, k: F.struct(c.alias("c"), (k + 1).alias("column")))
    rows = references.select(*keys, F.posexplode(F.filter(marked, lambda m: m["c"] == MATCH)).alias("pos", "m"))
    return rows.select(*keys, F.col("m.column").alias("column"), (F.col("pos") + 1).alias("pos"))


def under_query(sequences: DataFrame, annotation: DataFrame, query_id: str, query: str) -> DataFrame:
    """``file, aln, n, seq_id, seq``: each alignment of a search result under its query, which is row -1.

    An alignment without a reference line (RF) raises.  Without any alignment
    the query alone is the result, its ``file`` and ``aln`` null.
    """
    alignments = sequences.select("file", "aln").distinct()
    gapped = alignments.join(column_annotation(annotation, "RF"), ["file", "aln"], "left").select("file", "aln", F.lit(-1).alias("n"), F.lit(query_id).alias("seq_id"), lifted(F.col("value"), F.lit(query)).alias("seq"))
    found = gapped.unionByName(sequences.select("file", "aln", F.col("line").alias("n"), "seq_id", "seq"))
    alone = sequences.sparkSession.range(1).select(F.lit(-1).alias("n"), F.lit(query_id).alias("seq_id"), F.lit(query).alias("seq"))
    missing = alone.join(sequences.select(F.lit(1).alias("some")).limit(1), F.lit(True), "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)
