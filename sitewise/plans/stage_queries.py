"""Queries of whole stages and lookups, with their SQL."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import lookup as K
from ..operators import mutation as U
from ..operators import pairing as P
from ..operators import scoring as S
from ..operators import stages as T
from ..operators import structure as R
from ..operators.stored import removed, shared_dir, stored
from ..sources import maps as M
from ..sources import stockholm as Q
from .fixtures import ATOMS, ECS, HITS, MSA, SYMBOLS, atoms, ecs, genes, hits, msa_rows, table, with_views
from .msa_queries import ALPHABET, LENGTH, THETA, WEIGHTS, _counted, _model, _model_sql, r6
from .pair_oracles import _genes

TIES = ("i", "j", "line")
#: Fixed weights of the fixture's logistic model.
COEFFICIENTS = {"mad_score": 0.9, "num_sites_log": -0.4, "min_gap": -1.5, "max_gap": -0.5, "min_cons": 0.7, "max_cons": -0.3, "meff_over_l_norm_log": 0.6, "meff_over_l2_norm_log": 0.2}
INTERCEPT = -2.0
SEGMENTS = [{"segment": "A_1", "start": 11, "end": 40}, {"segment": "B_1", "start": 1, "end": 34}]


def _ec_table(spark, d):
    rows, sites, pairs = _counted(spark, d)
    return rows, sites, S.ec_table(U.log_odds_model(pairs, sites)[1], pairs, sites)


def ec_table(spark, d):
    return _ec_table(spark, d)[2].select("i", "j", r6("fn"), r6("cn"), r6("mi_raw"), r6("mi_apc"))


def logistic_published(spark, d):
    rows, sites, table_ = _ec_table(spark, d)
    table_ = stored(table_)
    features = S.site_features(sites, A.conservation(sites, SYMBOLS))
    n_eff = A.sequence_weights(rows, THETA).agg(F.sum("weight")).first()[0]
    scored = S.logistic_rescored(table_.select("i", "j", "mi_apc"), features, COEFFICIENTS, INTERCEPT, THETA, n_eff, score="mi_apc")
    return scored.select("i", "j", r6("mad_score"), r6("probability"), r6("score"))


def meanfield_table(spark, d):
    return T.meanfield_ecs(A.sequence_weights(msa_rows(spark, d), THETA), LENGTH, SYMBOLS).select("i", "j", r6("mi_raw"), r6("mi_apc"), r6("di"), r6("cn"))


def _maps(spark, d):
    rows = ecs(spark, d)
    intra = rows.groupBy("i", "j").agg(F.min("dist").alias("dist"))
    multimer = rows.groupBy("i", "j").agg(F.min(F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 200)).alias("dist"))
    return rows.drop("dist"), intra, multimer


def compared(spark, d):
    rows, intra, multimer = _maps(spark, d)
    found = S.compared(rows, intra, multimer, 10.0, "score", ties=TIES)
    return found.select("i", "j", "line", r6("dist_intra"), r6("dist_multimer"), r6("dist"), r6("precision"))


def complex_compared(spark, d):
    rows, intra, multimer = _maps(spark, d)
    side = lambda c: F.when(F.col(c) % 2 == 0, "A").otherwise("B")
    rows = rows.withColumns({"segment_i": side("i"), "segment_j": side("j")})
    found = S.complex_compared(rows, {"A": intra, "B": multimer}, intra, 10.0, "score", ties=TIES)
    return found.select("i", "j", "line", "segment_i", "segment_j", r6("dist"), r6("segmentwise_precision"), r6("precision"))


def contact_maps(spark, d):
    rows = ecs(spark, d).withColumn("probability", F.col("score") / 100000)
    found = S.contact_map_rows(rows, [0.5, 0.9], [10, 100], ties=TIES)
    return found.groupBy("kind", "cutoff").agg(F.count("*").alias("n_pairs"), F.sum((F.col("dist") <= 10).cast("long")).alias("n_contacts"), F.min("score").alias("least"))


def _structures(spark, d):
    items = table(spark, d, "lineitem")
    start = (F.col("l_partkey") % 300).cast("long")
    end = (start + F.col("l_quantity")).cast("long")
    return items.select(
        F.concat(F.lit("p"), F.col("l_suppkey")).alias("pdb_id"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("pdb_chain"), F.concat(F.lit("u"), F.col("l_partkey") % 20).alias("uniprot_ac"),
        F.col("l_orderkey").alias("resseq_start"), (F.col("l_orderkey") + end - start).alias("resseq_end"), start.alias("uniprot_start"), end.alias("uniprot_end"),
    )


def by_uniprot(spark, d):
    hits_ = K.chosen_structures(K.by_uniprot_id(_structures(spark, d), "u7", reduce_chains=True), most_structures=25)
    return K.chain_mappings(hits_).select("pdb_id", "pdb_chain", F.size("ranges").cast("long").alias("n"), F.col("ranges")[0]["uniprot_start"].alias("first"), F.array_max(F.transform("ranges", lambda r: r["uniprot_end"])).alias("last"))


def alignment_stage(spark, d):
    stage = T.focused(msa_rows(spark, d), 0, ALPHABET, SYMBOLS, 0.85, 0.95, None)
    return stage["sequences"].join(stage["identities"], "seq_idx").select("seq_idx", "seq", r6("identity"))


def target_columns(spark, d):
    letters = A.read_out(msa_rows(spark, d), ALPHABET).select(F.concat(F.lit("seq"), F.col("seq_idx"), F.lit("/1-64")).alias("id"), "seq")
    return T.under_target(letters, "seq0/")


def alignment_index(spark, d):
    rows = msa_rows(spark, d)
    return K.alignment_index(rows, rows.where("seq_idx = 0").first().residues)


def species_pairs(spark, d):
    one = lambda name, key, nation, value: P.best_hit_by_species(table(spark, d, name).select(F.col(key).alias("id"), F.col(nation).alias("species"), F.col(value).alias("identity")))
    return K.paired_by_species(one("customer", "c_custkey", "c_nationkey", "c_acctbal"), one("supplier", "s_suppkey", "s_nationkey", "s_acctbal"))


def family_hits(spark, d):
    found = hits(spark, d).select("query", "idx", (F.col("start") % 60).alias("family"), (F.col("stop") - F.col("start")).alias("target_len"))
    parts = table(spark, d, "part")
    clans = parts.select((F.col("p_partkey") + 20).alias("family"), F.col("p_size").alias("clan"))
    sizes = parts.select((F.col("p_partkey") + 10).alias("family"), (F.col("p_size") * 7).cast("long").alias("n"))
    return K.family_hits(found, clans, sizes).select("query", "idx", "family", "clan", "num_seqs", r6("num_seqs_over_len"))


def inter_segment(spark, d):
    _, fields, couplings = _model(spark, d)
    model = K.patched(couplings, K.segment_index(spark, SEGMENTS))
    return K.inter_segment_model(fields, model)[1].select("segment_i", "i", "segment_j", "j", "a", "b", r6("v"))


def mutation_matrix(spark, d):
    rows, fields, couplings = _model(spark, d)
    target = A.cells(rows.where("seq_idx = 0")).select("pos", "sym")
    return T.mutation_matrix(target, fields, couplings, A.site_frequencies(rows, SYMBOLS), SYMBOLS).select("i", "wt", "subs", r6("frequency"), r6("column_conservation"), r6("prediction_epistatic"))


def double_mutants(spark, d):
    rows, fields, couplings = _model(spark, d)
    target = A.cells(rows.where("seq_idx = 0")).select("pos", "sym")
    return U.double_mutants(U.single_mutants(target, fields, couplings, SYMBOLS), couplings).select("i", "j", "subs_i", "subs_j", r6("effect"))


def complex_summary(spark, d):
    side = lambda c: F.when(F.col(c) % 2 == 0, "A").otherwise("B")
    rows = ecs(spark, d).withColumns({"segment_i": side("i"), "segment_j": side("j"), "job": F.col("l_suppkey")})
    found = S.complex_summary(rows, ["job"], F.desc("score"), F.col("score") >= 60000, F.col("dist") <= 10, 5)
    return found.select("job", "num_pairs", "num_significant_inter", F.col("first_inter_rank").cast("long"), r6("precision_intra"), r6("precision_inter"))


def distance_distribution(spark, d):
    pairs = P.reciprocal_pairs(P.possible_partners(genes(spark, d, 1), genes(spark, d, 2)))
    return S.cumulative(pairs, "distance", ["id_1", "id_2"]).select("id_1", "id_2", "distance", F.col("below").cast("long"))


def query_lifted(spark, d):
    """Per label an alignment whose match columns have few gaps, and its first sequence's letters there as the query."""
    rows = msa_rows(spark, d)
    gaps = A.cells(rows).groupBy("label", "pos").agg(F.avg((F.col("sym") == 0).cast("int")).alias("g"))
    reference = gaps.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("g") <= 0.15, "x").otherwise(".").alias("c")))), lambda p: p["c"]), "").alias("value"))
    letters = rows.groupBy("label").agg(F.min_by("residues", "seq_idx").alias("first")).join(reference, "label")
    match = F.filter("first", lambda s, k: F.substring("value", k + 1, F.lit(1)) == "x")
    query = F.array_join(F.transform(match, lambda s: F.substring(F.lit("BACGT"), s + 1, F.lit(1))), "")
    return letters.select("label", Q.lifted(F.col("value"), query).alias("seq"), F.size(match).cast("long").alias("n_match"))


def stored_maps(spark, d):
    """Distances of all chains, written by tiles and read again: what each tile of each chain holds.

    Stores of up to ``M.PAIRS`` pairs follow one another, and each goes once it has been read. Few pairs are put in order first, for fewer files.
    """
    rows = atoms(spark, d)
    residues = rows.select("chain", F.col("residue").alias("idx")).distinct()
    n = F.count("*").cast("double")
    pairs = residues.groupBy("chain").agg((n * (n - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
    shares = max(1, math.ceil(pairs / M.PAIRS))
    tiles = []
    for k in range(shares):
        path = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
        M.write_distance_map(residues, R.distance_map(rows, (k, shares)), path, keys=("chain",), once=pairs > M.ROWS)
        found = M.read_distances(spark, path).withColumns({"ti": F.floor(F.col("i") / M.TILE), "tj": F.floor(F.col("j") / M.TILE)})
        tiles.append(stored(found.groupBy("chain", "ti", "tj").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))))
        removed(spark, path)
    every = reduce(DataFrame.unionAll, tiles).groupBy("chain", "ti", "tj")
    return every.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).select("chain", "ti", "tj", "n", r6("least"), r6("most"))


def chain_atoms(spark, d):
    rows = atoms(spark, d)
    residues, kept = K.with_atoms(rows.select("chain", "residue").distinct(), rows, [1], "atom")
    residues, kept = K.at_positions(residues, kept, list(range(0, 500, 7)))
    return kept.join(residues, ["chain", "residue"], "left_semi").select("chain", "residue", "atom", r6("x"))


def species_columns(spark, d):
    orders = table(spark, d, "orders")
    annotated = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("OS"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("Tax"))
    return K.species_annotation(annotated)


QUERIES = {
    "ec_table": ec_table,
    "ec_logistic_published": logistic_published,
    "meanfield_ec_table": meanfield_table,
    "ec_compared": compared,
    "ec_complex_compared": complex_compared,
    "ec_contact_maps": contact_maps,
    "structures_by_uniprot": by_uniprot,
    "alignment_stage": alignment_stage,
    "alignment_target_columns": target_columns,
    "alignment_index": alignment_index,
    "species_pairs": species_pairs,
    "family_hits": family_hits,
    "model_inter_segment": inter_segment,
    "mutation_matrix": mutation_matrix,
    "mutants_double": double_mutants,
    "complex_summary": complex_summary,
    "genome_distance_distribution": distance_distribution,
    "alignment_query_lifted": query_lifted,
    "struct_stored_maps": stored_maps,
    "struct_chain_atoms": chain_atoms,
    "species_annotation": species_columns,
}

EC_TABLE = """z AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i, j, a) - avg(v) OVER (PARTITION BY i, j, b) + avg(v) OVER (PARTITION BY i, j) AS v FROM couplings),
fns AS (SELECT i, j, sqrt(sum(v * v)) AS fn FROM z GROUP BY i, j),
mis AS (
  SELECT i, j, sum(p.frequency * ln(p.frequency / (x.frequency * y.frequency))) AS mi
  FROM pairs p JOIN sites x ON x.pos = i AND x.sym = p.a JOIN sites y ON y.pos = j AND y.sym = p.b GROUP BY i, j),
joined AS (SELECT * FROM fns JOIN mis USING (i, j)),
flat AS (SELECT i AS p, fn, mi FROM joined UNION ALL SELECT j, fn, mi FROM joined),
mean AS (SELECT p, avg(fn) AS f, avg(mi) AS m FROM flat GROUP BY p), grand AS (SELECT avg(fn) AS f, avg(mi) AS m FROM flat),
ectable AS (
  SELECT i, j, fn, fn - x.f * y.f / g.f AS cn, mi AS mi_raw, mi - x.m * y.m / g.m AS mi_apc
  FROM joined JOIN mean x ON x.p = i JOIN mean y ON y.p = j CROSS JOIN grand g)"""
MAPS = """intra AS (SELECT i, j, min(dist) AS dist FROM ecs GROUP BY i, j),
multi AS (SELECT i, j, min(CASE WHEN l_discount > 0.05 THEN l_discount * 200 END) AS dist FROM ecs GROUP BY i, j)"""
SINGLES = """t AS (SELECT pos, sym FROM msa WHERE seq_idx = 0),
flip AS (SELECT * FROM couplings UNION ALL SELECT j, i, b, a, v FROM couplings),
s AS (SELECT i, a, sum(v) AS v FROM (SELECT i, a, v FROM fields UNION ALL SELECT i, a, v FROM flip JOIN t ON t.pos = j AND t.sym = b) GROUP BY i, a),
singles AS (
  SELECT g.pos AS i, t.sym AS wt, g.sym AS subs, coalesce(m.v, 0) - coalesce(o.v, 0) AS effect
  FROM grid g JOIN t ON t.pos = g.pos LEFT JOIN s m ON m.i = g.pos AND m.a = g.sym LEFT JOIN s o ON o.i = g.pos AND o.a = t.sym WHERE g.sym <> 0 AND g.sym <> t.sym)"""
CONSERVED = "cons AS (SELECT pos, 1 + sum(CASE WHEN frequency > 0 THEN frequency * log2(frequency) ELSE 0 END) / log2(5) AS c, max(frequency) FILTER (sym = 0) AS g FROM sites GROUP BY pos)"
_z = " + ".join(f"({w}) * {n}" for n, w in COEFFICIENTS.items())
_precision = "CAST(sum((dist <= 10)::INT) OVER ({0}) AS DOUBLE) / count(dist) OVER ({0})"
_upto = "ORDER BY score DESC, i, j, line ROWS UNBOUNDED PRECEDING"

ORACLE_SQL = {
    "ec_table": _model_sql + ", " + EC_TABLE + " SELECT i, j, round(fn, 6) AS fn, round(cn, 6) AS cn, round(mi_raw, 6) AS mi_raw, round(mi_apc, 6) AS mi_apc FROM ectable",
    "ec_logistic_published": _model_sql
    + f""", {EC_TABLE}, {CONSERVED}, {WEIGHTS},
neff AS (SELECT sum(weight) AS n FROM weights),
med AS (SELECT quantile_cont(mi_apc, 0.5) AS m FROM ectable), mad AS (SELECT quantile_cont(abs(mi_apc - m), 0.5) AS d FROM ectable, med),
feat AS (
  SELECT i, j, (mi_apc - m) / (1.4826 * d) AS mad_score, log10(64) AS num_sites_log, least(x.g, y.g) AS min_gap, greatest(x.g, y.g) AS max_gap, least(x.c, y.c) AS min_cons, greatest(x.c, y.c) AS max_cons,
    log10(n / 64 / {THETA}) AS meff_over_l_norm_log, log10(n / 4096 / {THETA}) AS meff_over_l2_norm_log
  FROM ectable JOIN cons x ON x.pos = i JOIN cons y ON y.pos = j, med, mad, neff),
sc AS (SELECT i, j, mad_score, {INTERCEPT} + {_z} AS z FROM feat)
SELECT i, j, round(mad_score, 6) AS mad_score, round(1 / (1 + exp(-z)), 6) AS probability, round(z, 6) AS score FROM sc""",
    "ec_compared": with_views(ECS, MAPS)
    + f""", x AS (
  SELECT e.i, e.j, e.line, e.score, a.dist AS dist_intra, m.dist AS dist_multimer, CASE WHEN a.dist IS NULL THEN m.dist WHEN m.dist IS NULL THEN a.dist ELSE least(a.dist, m.dist) END AS dist
  FROM ecs e LEFT JOIN intra a ON a.i = e.i AND a.j = e.j LEFT JOIN multi m ON m.i = e.i AND m.j = e.j WHERE abs(e.i - e.j) >= 6)
SELECT i, j, line, round(dist_intra, 6) AS dist_intra, round(dist_multimer, 6) AS dist_multimer, round(dist, 6) AS dist, CASE WHEN count(dist) OVER ({_upto}) > 0 THEN round({_precision.format(_upto)}, 6) END AS precision FROM x""",
    "ec_complex_compared": with_views(ECS, MAPS)
    + f""", named AS (SELECT i, j, line, score, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS segment_i, CASE WHEN j % 2 = 0 THEN 'A' ELSE 'B' END AS segment_j FROM ecs),
x AS (
  SELECT n.*, CASE WHEN segment_i = 'B' AND segment_j = 'B' THEN m.dist ELSE a.dist END AS dist, CASE WHEN segment_i = segment_j THEN segment_i ELSE 'AB' END AS part
  FROM named n LEFT JOIN intra a ON a.i = n.i AND a.j = n.j LEFT JOIN multi m ON m.i = n.i AND m.j = n.j WHERE segment_i <> segment_j OR abs(n.i - n.j) >= 6)
SELECT i, j, line, segment_i, segment_j, round(dist, 6) AS dist,
  CASE WHEN count(dist) OVER (PARTITION BY part {_upto}) > 0 THEN round({_precision.format("PARTITION BY part " + _upto)}, 6) END AS segmentwise_precision,
  CASE WHEN count(dist) OVER ({_upto}) > 0 THEN round({_precision.format(_upto)}, 6) END AS precision FROM x""",
    "ec_contact_maps": with_views(ECS)
    + """, r AS (SELECT *, score / 100000 AS p, row_number() OVER (ORDER BY score DESC, i, j, line) AS n FROM ecs),
m AS (
  SELECT 'probability' AS kind, c AS cutoff, score, dist FROM r, (SELECT unnest([0.5, 0.9])::DOUBLE AS c) WHERE p >= c
  UNION ALL SELECT 'count', c, score, dist FROM r, (SELECT unnest([10, 100])::DOUBLE AS c) WHERE n <= c)
SELECT kind, cutoff, count(*) AS n_pairs, CAST(sum((dist <= 10)::INT) AS BIGINT) AS n_contacts, min(score) AS least FROM m GROUP BY kind, cutoff""",
    "structures_by_uniprot": """WITH s AS (
  SELECT 'p' || l_suppkey AS pdb_id, 'c' || l_linenumber AS pdb_chain, l_partkey % 300 AS a, CAST(l_partkey % 300 + l_quantity AS BIGINT) AS b FROM lineitem WHERE l_partkey % 20 = 7),
f AS (SELECT pdb_id, min(pdb_chain) AS pdb_chain FROM s GROUP BY pdb_id ORDER BY pdb_id LIMIT 25)
SELECT pdb_id, pdb_chain, count(*) AS n, min(a) AS first, max(b) AS last FROM s JOIN f USING (pdb_id, pdb_chain) GROUP BY pdb_id, pdb_chain""",
    "alignment_stage": with_views(MSA)
    + """, kept AS (SELECT m.* FROM msa m JOIN (SELECT seq_idx FROM msa GROUP BY seq_idx HAVING 1 - avg((sym = 0)::INT) >= 0.85) USING (seq_idx)),
low AS (SELECT pos FROM kept GROUP BY pos HAVING 1 - avg((sym <> 0)::INT) > 1 - 0.95)
SELECT k.seq_idx, string_agg(CASE WHEN low.pos IS NULL THEN substr('-ACGT', k.sym + 1, 1) ELSE substr('.acgt', k.sym + 1, 1) END, '' ORDER BY k.pos) AS seq, round(avg((k.sym = t.sym)::INT), 6) AS identity
FROM kept k LEFT JOIN low ON low.pos = k.pos JOIN msa t ON t.seq_idx = 0 AND t.pos = k.pos GROUP BY k.seq_idx""",
    "alignment_target_columns": with_views(MSA)
    + """SELECT 'seq' || m.seq_idx || '/1-64' AS id, string_agg(substr('-ACGT', m.sym + 1, 1), '' ORDER BY m.pos) AS seq, m.seq_idx = 0 AS is_target
FROM msa m JOIN msa t ON t.seq_idx = 0 AND t.pos = m.pos AND t.sym <> 0 GROUP BY m.seq_idx""",
    "alignment_index": with_views(MSA)
    + """, n AS (SELECT seq_idx, pos, row_number() OVER (PARTITION BY seq_idx ORDER BY pos) AS k FROM msa WHERE sym <> 0)
SELECT o.seq_idx AS other, CAST(t.k AS INT) AS target_i, CAST(o.k AS INT) AS other_i FROM n o JOIN n t ON t.seq_idx = 0 AND t.pos = o.pos""",
    "species_pairs": """WITH a AS (SELECT c_nationkey AS species, max((c_acctbal, c_custkey)) AS m FROM customer GROUP BY c_nationkey),
b AS (SELECT s_nationkey AS species, max((s_acctbal, s_suppkey)) AS m FROM supplier GROUP BY s_nationkey)
SELECT species, a.m[2] AS id_1, a.m[1] AS identity_1, b.m[2] AS id_2, b.m[1] AS identity_2 FROM a JOIN b USING (species) WHERE species IS NOT NULL""",
    "family_hits": with_views(HITS)
    + """SELECT query, idx, start % 60 AS family, c.p_size AS clan, CAST(s.p_size * 7 AS BIGINT) AS num_seqs, round(s.p_size * 7 / (stop - start), 6) AS num_seqs_over_len
FROM hits LEFT JOIN part c ON c.p_partkey + 20 = start % 60 LEFT JOIN part s ON s.p_partkey + 10 = start % 60""",
    "model_inter_segment": _model_sql + " SELECT 'A_1' AS segment_i, CAST(i + 10 AS BIGINT) AS i, 'B_1' AS segment_j, CAST(j - 30 AS BIGINT) AS j, a, b, round(v, 6) AS v FROM couplings WHERE i <= 30 AND j > 30",
    "mutation_matrix": _model_sql
    + f""", {SINGLES}, {CONSERVED}
SELECT m.i, wt, subs, round(f.frequency, 6) AS frequency, round(c, 6) AS column_conservation, round(effect, 6) AS prediction_epistatic
FROM singles m JOIN sites f ON f.pos = m.i AND f.sym = m.subs JOIN cons ON cons.pos = m.i""",
    "mutants_double": _model_sql
    + f""", {SINGLES}, ij AS (SELECT DISTINCT i, j FROM couplings)
SELECT ij.i, ij.j, x.subs AS subs_i, y.subs AS subs_j, round(x.effect + y.effect + coalesce(p.v, 0) - coalesce(q.v, 0) - coalesce(r.v, 0) + coalesce(w.v, 0), 6) AS effect
FROM ij JOIN singles x ON x.i = ij.i JOIN singles y ON y.i = ij.j
  LEFT JOIN couplings p ON p.i = ij.i AND p.j = ij.j AND p.a = x.subs AND p.b = y.subs LEFT JOIN couplings q ON q.i = ij.i AND q.j = ij.j AND q.a = x.subs AND q.b = y.wt
  LEFT JOIN couplings r ON r.i = ij.i AND r.j = ij.j AND r.a = x.wt AND r.b = y.subs LEFT JOIN couplings w ON w.i = ij.i AND w.j = ij.j AND w.a = x.wt AND w.b = y.wt""",
    "complex_summary": with_views(ECS)
    + """, x AS (
  SELECT l_suppkey AS job, score, dist, i % 2 <> j % 2 AS inter, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, i, j) AS n,
    row_number() OVER (PARTITION BY l_suppkey, i % 2 <> j % 2 ORDER BY score DESC, i, j) AS own,
    CAST(sum((dist <= 10)::INT) OVER (PARTITION BY l_suppkey, i % 2 <> j % 2 ORDER BY score DESC, i, j ROWS UNBOUNDED PRECEDING) AS DOUBLE)
      / nullif(count(dist) OVER (PARTITION BY l_suppkey, i % 2 <> j % 2 ORDER BY score DESC, i, j ROWS UNBOUNDED PRECEDING), 0) AS p
  FROM ecs)
SELECT job, count(*) AS num_pairs, CAST(sum((inter AND score >= 60000)::INT) AS BIGINT) AS num_significant_inter, min(n) FILTER (inter) AS first_inter_rank,
  round(max(p) FILTER (NOT inter AND own = 5), 6) AS precision_intra, round(max(p) FILTER (inter AND own = 5), 6) AS precision_inter FROM x GROUP BY job""",
    "genome_distance_distribution": _genes + "SELECT id_1, id_2, distance, row_number() OVER (ORDER BY distance, id_1, id_2) - 1 AS below FROM recip",
    "alignment_query_lifted": with_views(MSA)
    + """, g AS (SELECT label, pos, avg((sym = 0)::INT) <= 0.15 AS m, arg_min(sym, seq_idx) AS sym FROM msa GROUP BY label, pos)
SELECT label, string_agg(CASE WHEN m THEN substr('BACGT', sym + 1, 1) ELSE '-' END, '' ORDER BY pos) AS seq, CAST(sum(m::INT) AS BIGINT) AS n_match FROM g GROUP BY label""",
    "struct_stored_maps": with_views(ATOMS)
    + """, p AS (
  SELECT a.chain, a.residue AS i, b.residue AS j, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dist
  FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.residue < b.residue GROUP BY ALL),
b AS (SELECT * FROM p UNION ALL SELECT chain, j, i, dist FROM p)
SELECT chain, i // 64 AS ti, j // 64 AS tj, count(*) AS n, round(min(dist), 6) AS least, round(max(dist), 6) AS most FROM b GROUP BY ALL""",
    "struct_chain_atoms": with_views(ATOMS) + "SELECT chain, residue, atom, round(x, 6) AS x FROM atoms WHERE atom = 1 AND residue % 7 = 0 AND residue < 500",
    "species_annotation": "SELECT o_orderkey AS id, o_custkey AS name, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) >= (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END ELSE CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END END AS species FROM orders",
}
ORACLE_SQL = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLE_SQL.items()}
