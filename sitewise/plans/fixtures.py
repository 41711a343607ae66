"""Views of the driver's tables that stand in for alignments, pairs, genes, hits and atoms, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msa_rows(spark, sf_dir) -> DataFrame:
    """One aligned sequence per vector: ``seq_idx``, ``residues`` (symbols 0 to 4, 0 the gap), ``label``."""
    quantised = F.transform("embedding", lambda v: F.least(F.lit(4), F.greatest(F.lit(0), F.floor(v.cast("double") * 8) + 2)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_idx"), quantised.alias("residues"), "label")


MSA = """msa AS (
  SELECT vec_id AS seq_idx, CAST(p AS INT) AS pos, label,
    CAST(least(4, greatest(0, floor(CAST(embedding[p] AS DOUBLE) * 8) + 2)) AS INT) AS sym
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"""


def ecs(spark, sf_dir) -> DataFrame:
    """Scored pairs ``i, j, score, dist``, some distances unknown."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("dist"), "l_suppkey", "l_discount"
    )


ECS = """ecs AS (
  SELECT l_orderkey AS i, l_partkey AS j, l_linenumber AS line, l_extendedprice AS score,
    CASE WHEN l_tax > 0.01 THEN l_quantity END AS dist, l_suppkey, l_discount FROM lineitem)"""


def genes(spark, sf_dir, side: int) -> DataFrame:
    """Genes ``genome_id, id, gene_start, gene_end`` of one of two families."""
    items = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == side))
    return items.select(F.col("l_suppkey").alias("genome_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 100).alias("gene_start"), (F.col("l_partkey") * 100 + F.col("l_quantity") * 30).cast("long").alias("gene_end"))


GENES = """genes AS (
  SELECT l_linenumber AS side, l_suppkey AS genome_id, l_orderkey * 10 + l_linenumber AS id, l_partkey * 100 AS gene_start,
    CAST(l_partkey * 100 + l_quantity * 30 AS BIGINT) AS gene_end
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2))"""


def hits(spark, sf_dir) -> DataFrame:
    """Domain hits ``query, clan, idx, start, stop, score``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_linestatus").alias("clan"), F.col("l_linenumber").alias("idx"), (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_quantity")).cast("long").alias("stop"), F.col("l_extendedprice").alias("score")
    )


HITS = """hits AS (
  SELECT l_orderkey AS query, l_linestatus AS clan, l_linenumber AS idx, l_partkey % 200 AS start,
    CAST(l_partkey % 200 + l_quantity AS BIGINT) AS stop, l_extendedprice AS score FROM lineitem)"""


def atoms(spark, sf_dir) -> DataFrame:
    """Two atoms per residue: ``chain, residue, atom, x, y, z``."""
    vectors = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    atom = lambda n, k: F.struct(F.lit(n).alias("atom"), at(k).alias("x"), at(k + 1).alias("y"), at(k + 2).alias("z"))
    return vectors.select(F.col("label").alias("chain"), F.col("vec_id").alias("residue"), F.explode(F.array(atom(0, 0), atom(1, 3))).alias("a")).select("chain", "residue", "a.*")


ATOMS = """atoms AS (
  SELECT label AS chain, vec_id AS residue, a AS atom, CAST(embedding[3 * a + 1] AS DOUBLE) AS x,
    CAST(embedding[3 * a + 2] AS DOUBLE) AS y, CAST(embedding[3 * a + 3] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest([0, 1]) AS a))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views)
