"""Queries over the alignment fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import couplings as C
from ..operators import meanfield as M
from ..operators import mutation as U
from ..operators.stored import stored
from .fixtures import MSA, SYMBOLS, msa_rows, with_views

THETA = 0.5
LENGTH = 64
ALPHABET = "-ACGT"


def r6(c):
    return F.round(c, 6).alias(c)


def site_frequencies(spark, d):
    return A.site_frequencies(msa_rows(spark, d), SYMBOLS).select("pos", "sym", r6("frequency"))


def sequence_weights(spark, d):
    return A.sequence_weights(msa_rows(spark, d), THETA).select("seq_idx", "n_similar", r6("weight"))


def _weighted(spark, d):
    return A.site_frequencies(A.sequence_weights(msa_rows(spark, d), THETA), SYMBOLS)


def weighted_frequencies(spark, d):
    return _weighted(spark, d).select("pos", "sym", r6("frequency"))


def conservation(spark, d):
    return A.conservation(_weighted(spark, d), SYMBOLS).select("pos", r6("conservation"))


def identity_to_query(spark, d):
    rows = msa_rows(spark, d)
    reference = rows.where("seq_idx = 0").first().residues
    return A.identities_to(rows, reference).select("seq_idx", r6("identity"))


def column_coverage(spark, d):
    return A.column_coverage(msa_rows(spark, d)).select("pos", r6("coverage"))


def coverage_stats(spark, d):
    stats = A.describe_coverage(msa_rows(spark, d), [0.5, 0.85, 0.9, 0.95], first_index=10)
    return stats.select("threshold", F.col("num_seqs").cast("long"), "seqlen", "num_cov", "num_lc", r6("perc_cov"), F.col("first_uc").cast("long"), F.col("last_uc").cast("long"), F.col("len_cov").cast("long"), F.col("num_lc_cov").cast("long"))


def frequency_table(spark, d):
    rows = msa_rows(spark, d)
    sites = A.site_frequencies(rows, SYMBOLS)
    target = A.cells(rows.where("seq_idx = 0")).select("pos", F.substring(F.lit(ALPHABET), F.col("sym") + 1, F.lit(1)).alias("letter"))
    wide = A.frequency_table(sites, A.conservation(sites, SYMBOLS), ALPHABET, target)
    return wide.select("i", "A_i", r6("conservation"), *(F.round(F.col(f"`{c}`"), 6).alias("gap" if c == "-" else c) for c in ALPHABET))


def valid_rows(spark, d):
    return A.covered_rows(A.valid_rows(msa_rows(spark, d), 4), 70).select("seq_idx")


def symbol_counts(spark, d):
    return A.count_symbol(msa_rows(spark, d), 2, by="seq_idx").select("seq_idx", r6("frequency"))


def pair_frequencies(spark, d):
    return A.pair_frequencies(msa_rows(spark, d)).select("i", "j", "a", "b", r6("frequency"))


def mutual_information_apc(spark, d):
    _, sites, pairs = _counted(spark, d)
    return C.product_corrected(stored(C.mutual_information(pairs, sites)), "mi_raw", "mi_apc").select("i", "j", r6("mi_raw"), r6("mi_apc"))


def _counted(spark, d):
    """Rows, and site and pair frequencies, counted once."""
    rows = msa_rows(spark, d)
    return rows, stored(A.site_frequencies(rows, SYMBOLS)), stored(A.pair_frequencies(rows))


def _model(spark, d):
    rows, sites, pairs = _counted(spark, d)
    fields, couplings = U.log_odds_model(pairs, sites)
    return rows, fields, stored(couplings)


def sequence_energy(spark, d):
    rows, fields, couplings = _model(spark, d)
    return U.sequence_energies(A.cells(rows).select("seq_idx", "pos", "sym"), fields, couplings).select("seq_idx", r6("fields"), r6("couplings"), r6("energy"))


def single_matrix(spark, d):
    rows, fields, couplings = _model(spark, d)
    target = A.cells(rows.where("seq_idx = 0")).select("pos", "sym")
    return U.single_mutants(target, fields, couplings, SYMBOLS).select("i", "wt", "subs", r6("effect"))


def zero_sum_norm(spark, d):
    _, _, couplings = _model(spark, d)
    return C.frobenius_norm(C.zero_sum_gauge(couplings)).select("i", "j", r6("fn"))


def logo_bits(spark, d):
    return A.logo(A.site_frequencies(msa_rows(spark, d), SYMBOLS), SYMBOLS).select("pos", "sym", r6("bits"))


def _regular(spark, d):
    rows = msa_rows(spark, d)
    sites = M.regularized_sites(A.site_frequencies(rows, SYMBOLS), SYMBOLS)
    return sites, M.regularized_pairs(A.pair_frequencies(rows), LENGTH, SYMBOLS)


def regularized_pairs(spark, d):
    return _regular(spark, d)[1].select("i", "j", "a", "b", r6("frequency"))


def meanfield_couplings(spark, d):
    sites, pairs = _regular(spark, d)
    model = M.couplings(pairs, sites, LENGTH, SYMBOLS)
    cn = C.product_corrected(stored(C.frobenius_norm(C.zero_sum_gauge(model))), "fn", "cn")
    return cn.select("i", "j", r6("fn"), r6("cn"))


def meanfield_fields(spark, d):
    sites, pairs = _regular(spark, d)
    return M.fields(M.couplings(pairs, sites, LENGTH, SYMBOLS), sites, SYMBOLS).select("i", "a", r6("v"))


def direct_information(spark, d):
    sites, pairs = _regular(spark, d)
    return M.direct_information(M.couplings(pairs, sites, LENGTH, SYMBOLS), sites, SYMBOLS).select("i", "j", r6("di"))


def independent_fields(spark, d):
    rows = msa_rows(spark, d)
    return M.independent_fields(A.site_frequencies(rows, SYMBOLS), rows.count()).select("i", "a", r6("v"))


QUERIES = {
    "msa_site_frequencies": site_frequencies,
    "msa_sequence_weights": sequence_weights,
    "msa_weighted_frequencies": weighted_frequencies,
    "msa_conservation": conservation,
    "msa_identity_to_query": identity_to_query,
    "msa_column_coverage": column_coverage,
    "msa_coverage_stats": coverage_stats,
    "msa_frequency_table": frequency_table,
    "msa_invalid_row_filter": valid_rows,
    "msa_symbol_counts": symbol_counts,
    "pair_frequencies": pair_frequencies,
    "ec_mutual_information_apc": mutual_information_apc,
    "sequence_energy": sequence_energy,
    "mutant_single_matrix": single_matrix,
    "zero_sum_gauge_fn": zero_sum_norm,
    "logo_bits": logo_bits,
    "meanfield_regularized_pairs": regularized_pairs,
    "meanfield_couplings": meanfield_couplings,
    "meanfield_fields": meanfield_fields,
    "direct_information": direct_information,
    "independent_fields": independent_fields,
}

TOTAL = "total AS (SELECT count(DISTINCT seq_idx) AS n FROM msa)"
GRID = "grid AS (SELECT CAST(p AS INT) AS pos, CAST(s AS INT) AS sym FROM (SELECT unnest(range(1, 65)) AS p), (SELECT unnest(range(0, 5)) AS s))"
SITES = """sites AS (
  SELECT g.pos, g.sym, count(m.seq_idx) / max(n)::DOUBLE AS frequency
  FROM grid g CROSS JOIN total LEFT JOIN msa m ON m.pos = g.pos AND m.sym = g.sym GROUP BY g.pos, g.sym)"""
WEIGHTS = """same AS (
  SELECT a.seq_idx AS x, b.seq_idx AS y FROM msa a JOIN msa b ON a.pos = b.pos AND a.sym = b.sym GROUP BY ALL HAVING count(*) >= 32),
weights AS (SELECT x AS seq_idx, count(*) AS n_similar, 1.0::DOUBLE / count(*) AS weight FROM same GROUP BY x)"""
WSITES = """wtotal AS (SELECT sum(weight) AS n FROM weights),
wsites AS (
  SELECT g.pos, g.sym, coalesce(sum(weight), 0) / max(n) AS frequency
  FROM grid g CROSS JOIN wtotal LEFT JOIN msa m ON m.pos = g.pos AND m.sym = g.sym LEFT JOIN weights w ON w.seq_idx = m.seq_idx GROUP BY g.pos, g.sym)"""
PAIRS = """pairs AS (
  SELECT a.pos AS i, b.pos AS j, a.sym AS a, b.sym AS b, count(*) / max(n)::DOUBLE AS frequency
  FROM msa a JOIN msa b ON a.seq_idx = b.seq_idx AND a.pos < b.pos CROSS JOIN total GROUP BY ALL)"""
MODEL = """fields AS (SELECT pos AS i, sym AS a, ln(frequency) AS v FROM sites WHERE frequency > 0),
couplings AS (
  SELECT i, j, p.a, p.b, ln(p.frequency / (x.frequency * y.frequency)) AS v
  FROM pairs p JOIN sites x ON x.pos = i AND x.sym = p.a JOIN sites y ON y.pos = j AND y.sym = p.b)"""
_base_sql = with_views(MSA, TOTAL, GRID, SITES)
_pairs_sql = with_views(MSA, TOTAL, GRID, SITES, PAIRS)
_model_sql = with_views(MSA, TOTAL, GRID, SITES, PAIRS, MODEL)
_plogp = "CASE WHEN frequency > 0 THEN frequency * log2(frequency) ELSE 0 END"

ORACLE_SQL = {
    "msa_site_frequencies": _base_sql + "SELECT pos, sym, round(frequency, 6) AS frequency FROM sites",
    "msa_sequence_weights": with_views(MSA, WEIGHTS) + "SELECT seq_idx, n_similar, round(weight, 6) AS weight FROM weights",
    "msa_weighted_frequencies": with_views(MSA, GRID, WEIGHTS, WSITES) + "SELECT pos, sym, round(frequency, 6) AS frequency FROM wsites",
    "msa_conservation": with_views(MSA, GRID, WEIGHTS, WSITES) + f"SELECT pos, round(1 + sum({_plogp}) / log2(5), 6) AS conservation FROM wsites GROUP BY pos",
    "msa_identity_to_query": with_views(MSA) + "SELECT m.seq_idx, round(avg((m.sym = q.sym)::INT), 6) AS identity FROM msa m JOIN msa q ON q.seq_idx = 0 AND q.pos = m.pos GROUP BY m.seq_idx",
    "msa_column_coverage": with_views(MSA) + "SELECT pos, round(avg((sym <> 0)::INT), 6) AS coverage FROM msa GROUP BY pos",
    "msa_coverage_stats": with_views(MSA)
    + """, cov AS (SELECT pos, avg((sym <> 0)::INT) AS c, count(*) AS n FROM msa GROUP BY pos),
t AS (SELECT unnest([0.5, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
s AS (
  SELECT threshold, max(n) AS num_seqs, count(*) AS seqlen, count(*) FILTER (NOT 1 - c > 1 - threshold) AS num_cov, count(*) FILTER (1 - c > 1 - threshold) AS num_lc,
    min(pos + 9) FILTER (NOT 1 - c > 1 - threshold) AS first_uc, max(pos + 9) FILTER (NOT 1 - c > 1 - threshold) AS last_uc
  FROM cov, t GROUP BY threshold)
SELECT threshold, num_seqs, seqlen, num_cov, num_lc, round(num_cov / seqlen, 6) AS perc_cov, CAST(first_uc AS BIGINT) AS first_uc, CAST(last_uc AS BIGINT) AS last_uc,
  CAST(last_uc - first_uc + 1 AS BIGINT) AS len_cov, CAST(last_uc - first_uc + 1 - num_cov AS BIGINT) AS num_lc_cov FROM s""",
    "msa_frequency_table": _base_sql
    + f""", cons AS (SELECT pos, 1 + sum({_plogp}) / log2(5) AS conservation FROM sites GROUP BY pos),
w AS (SELECT pos, max(frequency) FILTER (sym = 0) AS gap, max(frequency) FILTER (sym = 1) AS A, max(frequency) FILTER (sym = 2) AS C, max(frequency) FILTER (sym = 3) AS G, max(frequency) FILTER (sym = 4) AS T FROM sites GROUP BY pos),
t AS (SELECT pos, substr('-ACGT', sym + 1, 1) AS A_i FROM msa WHERE seq_idx = 0)
SELECT pos AS i, A_i, CASE WHEN A_i <> '-' THEN round(conservation, 6) END AS conservation, CASE WHEN A_i <> '-' THEN round(gap, 6) END AS gap, CASE WHEN A_i <> '-' THEN round(A, 6) END AS A,
  CASE WHEN A_i <> '-' THEN round(C, 6) END AS C, CASE WHEN A_i <> '-' THEN round(G, 6) END AS G, CASE WHEN A_i <> '-' THEN round(T, 6) END AS T
FROM w JOIN cons USING (pos) JOIN t USING (pos)""",
    "msa_invalid_row_filter": with_views(MSA) + "SELECT seq_idx FROM msa GROUP BY seq_idx HAVING max(sym) < 4 AND 1 - avg((sym = 0)::INT) >= 0.7",
    "msa_symbol_counts": with_views(MSA) + "SELECT seq_idx, round(avg((sym = 2)::INT), 6) AS frequency FROM msa GROUP BY seq_idx",
    "pair_frequencies": with_views(MSA, TOTAL, PAIRS) + "SELECT i, j, a, b, round(frequency, 6) AS frequency FROM pairs",
    "ec_mutual_information_apc": _pairs_sql
    + """, mi AS (
  SELECT i, j, sum(p.frequency * ln(p.frequency / (x.frequency * y.frequency))) AS m
  FROM pairs p JOIN sites x ON x.pos = i AND x.sym = p.a JOIN sites y ON y.pos = j AND y.sym = p.b GROUP BY i, j),
flat AS (SELECT i AS p, m FROM mi UNION ALL SELECT j, m FROM mi), mean AS (SELECT p, avg(m) AS u FROM flat GROUP BY p), grand AS (SELECT avg(m) AS g FROM flat)
SELECT i, j, round(m, 6) AS mi_raw, round(m - x.u * y.u / g, 6) AS mi_apc FROM mi JOIN mean x ON x.p = i JOIN mean y ON y.p = j CROSS JOIN grand""",
    "sequence_energy": _model_sql
    + """, f AS (SELECT seq_idx, sum(v) AS v FROM msa JOIN fields ON i = pos AND a = sym GROUP BY seq_idx),
c AS (SELECT x.seq_idx, sum(v) AS v FROM msa x JOIN msa y ON x.seq_idx = y.seq_idx AND x.pos < y.pos JOIN couplings k ON k.i = x.pos AND k.a = x.sym AND k.j = y.pos AND k.b = y.sym GROUP BY x.seq_idx)
SELECT f.seq_idx, round(f.v, 6) AS fields, round(c.v, 6) AS couplings, round(f.v + c.v, 6) AS energy FROM f JOIN c USING (seq_idx)""",
    "mutant_single_matrix": _model_sql
    + """, t AS (SELECT pos, sym FROM msa WHERE seq_idx = 0),
flip AS (SELECT * FROM couplings UNION ALL SELECT j, i, b, a, v FROM couplings),
s AS (SELECT i, a, sum(v) AS v FROM (SELECT i, a, v FROM fields UNION ALL SELECT i, a, v FROM flip JOIN t ON t.pos = j AND t.sym = b) GROUP BY i, a)
SELECT g.pos AS i, t.sym AS wt, g.sym AS subs, round(coalesce(m.v, 0) - coalesce(o.v, 0), 6) AS effect
FROM grid g JOIN t ON t.pos = g.pos LEFT JOIN s m ON m.i = g.pos AND m.a = g.sym LEFT JOIN s o ON o.i = g.pos AND o.a = t.sym WHERE g.sym <> 0 AND g.sym <> t.sym""",
    "zero_sum_gauge_fn": _model_sql
    + """, z AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i, j, a) - avg(v) OVER (PARTITION BY i, j, b) + avg(v) OVER (PARTITION BY i, j) AS v FROM couplings)
SELECT i, j, round(sqrt(sum(v * v)), 6) AS fn FROM z GROUP BY i, j""",
    "logo_bits": _base_sql
    + f""", h AS (SELECT pos, -sum({_plogp}) AS h FROM sites GROUP BY pos)
SELECT pos, sym, round(frequency * (log2(5) - h), 6) AS bits FROM sites JOIN h USING (pos) WHERE frequency >= 0.01""",
    "meanfield_regularized_pairs": _pairs_sql
    + """SELECT x.pos AS i, y.pos AS j, x.sym AS a, y.sym AS b, round(0.5 * coalesce(frequency, 0) + 0.5 / 25, 6) AS frequency
FROM grid x JOIN grid y ON x.pos < y.pos LEFT JOIN pairs p ON p.i = x.pos AND p.j = y.pos AND p.a = x.sym AND p.b = y.sym""",
}
ORACLE_SQL = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLE_SQL.items()}
