"""SQL that the queries of ``pair_queries`` are checked against."""

from __future__ import annotations

from .fixtures import ATOMS, ECS, GENES, HITS, MSA, with_views
from .msa_queries import GRID, MODEL, PAIRS, SITES, TOTAL

_ecs = with_views(ECS)
_genes = with_views(GENES) + """,
partners AS (
  SELECT DISTINCT a.genome_id, a.id AS id_1, b.id AS id_2,
    greatest(0, least(b.gene_start, b.gene_end) - greatest(a.gene_start, a.gene_end), least(a.gene_start, a.gene_end) - greatest(b.gene_start, b.gene_end)) AS distance
  FROM genes a JOIN genes b ON a.genome_id = b.genome_id AND a.side = 1 AND b.side = 2),
n1 AS (SELECT id_1, min((distance, id_2)) AS m FROM partners GROUP BY id_1),
n2 AS (SELECT id_2, min((distance, id_1)) AS m FROM partners GROUP BY id_2),
recip AS (SELECT n1.id_1, n2.id_2, n1.m[1] AS distance FROM n1 JOIN n2 ON n1.m[2] = n2.id_2 AND n2.m[2] = n1.id_1)
"""
_ident = with_views(MSA) + """,
ident AS (SELECT m.seq_idx AS id, any_value(m.label) AS species, avg((m.sym = q.sym)::INT) AS identity FROM msa m JOIN msa q ON q.seq_idx = 0 AND q.pos = m.pos GROUP BY m.seq_idx),
best AS (SELECT species, max((identity, id)) AS m FROM ident WHERE species IS NOT NULL GROUP BY species)
"""
_dist = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
_models = with_views(ATOMS) + ", m AS (SELECT residue % 5 AS model, chain, residue // 50 AS residue, x, y, z FROM atoms)\n"
_states = with_views(MSA) + ", st AS (SELECT seq_idx, pos, CASE WHEN sym >= 3 THEN 'H' WHEN sym = 2 THEN 'E' ELSE 'C' END AS ss FROM msa),\nrun AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_idx, ss ORDER BY pos) AS r FROM st)\n"
_helix = " ".join(f"WHEN d > {a} AND d <= {b} THEN {w}" for a, b, w in [(0.44, 0.52, 0.2), (0.52, 0.61, 0.4), (0.61, 0.70, 0.6), (0.70, 0.78, 0.8), (0.78, 0.96, 1.0), (0.96, 1.05, 0.8), (1.05, 1.13, 0.6), (1.13, 1.22, 0.4), (1.22, 1.31, 0.2)])
_strand = " ".join(f"WHEN d >= {a} AND d < {b} THEN {w}" for a, b, w in [(-0.3, -0.1, 0.2), (-0.4, -0.3, 0.4), (-0.5, -0.4, 0.6), (-0.6, -0.5, 0.8), (-0.8, -0.6, 1.0), (-0.9, -0.8, 0.8), (-1.0, -0.9, 0.6), (-1.1, -1.0, 0.4), (-1.2, -1.1, 0.2)])

ORACLE_SQL = {
    "ec_enrichment": _ecs
    + """, n AS (SELECT CAST(ceil(0.5 * count(*)) AS BIGINT) AS n FROM (SELECT i FROM ecs UNION SELECT j FROM ecs)),
best AS (SELECT i, j, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, i, j, line) AS rn FROM ecs WHERE abs(i - j) >= 6) WHERE rn <= (SELECT n FROM n)),
flat AS (SELECT i, score FROM best UNION ALL SELECT j, score FROM best)
SELECT i, round(sum(score) / (SELECT avg(score) FROM best), 6) AS enrichment FROM flat GROUP BY i""",
    "ec_top_longrange": _ecs + "SELECT i, j, line, score FROM ecs WHERE abs(i - j) >= 6 ORDER BY score DESC, i, j, line LIMIT 100",
    "ec_mad_score": _ecs
    + """, m AS (SELECT median(score) AS m FROM ecs), s AS (SELECT median(abs(score - m)) AS s FROM ecs, m)
SELECT i, j, line, round((score - m) / (1.4826 * s), 6) AS mad_score FROM ecs, m, s""",
    "ec_precision": _ecs
    + """SELECT i, j, line, round(sum((dist <= 10)::INT) OVER w / count(dist) OVER w, 6) AS precision FROM ecs WHERE abs(i - j) >= 6
WINDOW w AS (ORDER BY score DESC, i, j, line ROWS UNBOUNDED PRECEDING)""",
    "ec_expected_true": _ecs
    + """, r AS (SELECT l_discount, sum((abs(i - j) >= 6)::INT) OVER (ORDER BY score DESC, i, j, line ROWS UNBOUNDED PRECEDING) AS f FROM ecs)
SELECT count(*) AS n_rows, round(sum(l_discount), 6) AS expected FROM r WHERE f <= 500""",
    "ec_evcomplex_score": _ecs + "SELECT i, j, line, round((score - 40000) / abs((SELECT min(score - 40000) FROM ecs)), 6) AS probability FROM ecs",
    "ec_segment_map": _ecs
    + """SELECT i, j, line, CASE WHEN i BETWEEN 1 AND 500 THEN 'A_1' WHEN i BETWEEN 501 AND 1200 THEN 'B_1' END AS segment_i, CASE WHEN i BETWEEN 1 AND 500 THEN i + 9 WHEN i BETWEEN 501 AND 1200 THEN i - 500 END AS pos_i,
  CASE WHEN j BETWEEN 1 AND 500 THEN 'A_1' WHEN j BETWEEN 501 AND 1200 THEN 'B_1' END AS segment_j, CASE WHEN j BETWEEN 1 AND 500 THEN j + 9 WHEN j BETWEEN 501 AND 1200 THEN j - 500 END AS pos_j FROM ecs""",
    "ec_rank_bands": _ecs
    + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, i, j, line) AS rn, count(*) OVER () AS n FROM ecs)
SELECT i, j, line, CAST(CASE WHEN rn <= floor(0.05 * n) THEN 1 WHEN rn <= floor(0.15 * n) THEN 2 ELSE 3 END AS INT) AS band FROM r""",
    "ec_logistic_score": _ecs
    + """, s AS (SELECT p_partkey AS pos, p_size / 50 AS c, p_retailprice % 1 AS g FROM part),
f AS (SELECT e.l_suppkey AS i, j, line, score, least(x.c, y.c) AS c0, greatest(x.c, y.c) AS c1, least(x.g, y.g) AS g0, greatest(x.g, y.g) AS g1 FROM ecs e JOIN s x ON x.pos = e.l_suppkey JOIN s y ON y.pos = e.j),
z AS (SELECT *, -4.0 + 0.0001 * score + 1.5 * c0 + 0.5 * c1 - 2.0 * g0 - 1.0 * g1 AS z FROM f)
SELECT i, j, line, score, round(z, 6) AS score_logit, round(1 / (1 + exp(-z)), 6) AS probability FROM z""",
    "ec_distance_join": _ecs
    + """, e AS (SELECT i % 50 + 1 AS i, j, min(dist) AS other FROM ecs GROUP BY ALL),
k AS (SELECT CAST(p_size AS BIGINT) AS i, p_partkey AS j, p_retailprice AS dist FROM part)
SELECT e.i, e.j, least(dist, other) AS dist FROM e LEFT JOIN k ON k.i = e.i AND k.j = e.j""",
    "genome_partners": _genes + "SELECT genome_id, id_1, id_2, distance FROM partners",
    "genome_reciprocal_pairs": _genes + "SELECT id_1, id_2, distance FROM recip",
    "genome_distance_filter": _genes + "SELECT id_1, id_2, distance FROM recip WHERE distance < 3000",
    "clan_overlap_filter": with_views(HITS)
    + """SELECT query, clan, idx, start, stop, score FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM hits b WHERE b.query = h.query AND b.clan = h.clan AND h.start < b.stop AND b.start < h.stop AND (b.score > h.score OR (b.score = h.score AND b.idx < h.idx)))""",
    "species_best_hit": _ident + "SELECT species, m[2] AS id, round(m[1], 6) AS identity FROM best",
    "species_paralogs": _ident + "SELECT id, species, round(identity, 6) AS identity FROM ident WHERE identity < 0.3 AND species IN (SELECT species FROM ident WHERE contains(CAST(id AS VARCHAR), '7'))",
    "species_best_reciprocal": _ident
    + """, para AS (SELECT id FROM ident WHERE identity < 0.25 AND species IN (SELECT species FROM ident WHERE contains(CAST(id AS VARCHAR), '0'))),
pair AS (SELECT x.seq_idx AS id, y.seq_idx AS p, count(*) / 64 AS identity FROM msa x JOIN msa y ON x.pos = y.pos AND x.sym = y.sym WHERE x.seq_idx IN (SELECT m[2] FROM best) AND y.seq_idx IN (SELECT id FROM para) GROUP BY ALL)
SELECT m[2] AS id, species, round(m[1], 6) AS identity FROM best WHERE NOT EXISTS (SELECT 1 FROM pair WHERE pair.id = m[2] AND pair.identity >= m[1] + 0.02)""",
    "concatenate_pairs": with_views(MSA)
    + """, s AS (SELECT seq_idx AS id, string_agg(substr('-ACGT', sym + 1, 1), '' ORDER BY pos) AS seq FROM msa GROUP BY seq_idx),
p AS (SELECT min(seq_idx) AS id_1, max(seq_idx) AS id_2 FROM msa GROUP BY label)
SELECT id_1, id_2, a.seq || b.seq AS seq FROM p JOIN s a ON a.id = id_1 JOIN s b ON b.id = id_2""",
    "concatenation_stats": """WITH a AS (SELECT label AS s, count(*) AS n FROM embeddings GROUP BY label), b AS (SELECT s_nationkey AS s, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM a) AS num_seqs_1, (SELECT count(s) FROM a) AS num_nonred_species_1, (SELECT median(n) FROM a WHERE s IS NOT NULL) AS median_num_per_species_1,
  (SELECT CAST(sum(n) AS BIGINT) FROM b) AS num_seqs_2, (SELECT count(s) FROM b) AS num_nonred_species_2, (SELECT median(n) FROM b WHERE s IS NOT NULL) AS median_num_per_species_2,
  (SELECT count(*) FROM a JOIN b USING (s)) AS num_species_overlap""",
    "sifts_overlap_hits": with_views(HITS)
    + """, g AS (SELECT p_size AS ac, p_brand AS structure, p_type AS chain, p_partkey % 150 AS s0, p_partkey % 150 + 30 AS s1 FROM part)
SELECT query AS alignment_id, structure, chain, CAST(sum(least(stop, s1) - greatest(start, s0)) AS BIGINT) AS overlap, min(s0) AS "first", max(s1) AS "last", max(score) AS score
FROM hits JOIN g ON g.ac = hits.idx WHERE least(stop, s1) > greatest(start, s0) GROUP BY ALL HAVING sum(least(stop, s1) - greatest(start, s0)) >= 20""",
    "struct_distance_map": with_views(ATOMS) + f"SELECT a.chain, a.residue AS i, b.residue AS j, round(min({_dist}), 6) AS dist FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.residue < b.residue GROUP BY ALL",
    "struct_contacts": with_views(ATOMS) + f"SELECT a.chain, a.residue AS i, b.residue AS j, round(min({_dist}), 6) AS dist FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.residue < b.residue GROUP BY ALL HAVING min({_dist}) <= 0.12 AND min({_dist}) > 0",
    "struct_inter_min": _models + f"SELECT a.residue AS i, b.residue AS j, round(min({_dist}), 6) AS dist FROM m a JOIN m b ON a.model = b.model AND a.chain % 2 = 0 AND b.chain % 2 = 1 GROUP BY ALL",
    "struct_multimer_min": _models
    + f""", p AS (SELECT a.residue AS i, b.residue AS j, min({_dist}) AS dist FROM m a JOIN m b ON a.model = b.model AND a.chain < b.chain GROUP BY ALL)
SELECT i, j, round(min(dist), 6) AS dist FROM (SELECT * FROM p UNION ALL SELECT j, i, dist FROM p) GROUP BY i, j""",
    "struct_combined_maps": with_views(ATOMS)
    + f""", m AS (SELECT residue % 3 AS chain, residue // 3 AS residue, x, y, z FROM atoms),
p AS (SELECT a.chain, a.residue AS i, b.residue AS j, min({_dist}) AS dist FROM m a JOIN m b ON a.chain = b.chain AND a.residue < b.residue GROUP BY ALL)
SELECT i, j, round(min(dist), 6) AS dist FROM p GROUP BY i, j HAVING count(DISTINCT chain) = 3""",
    "struct_coverage_islands": """WITH r AS (SELECT DISTINCT l_suppkey AS structure, l_partkey AS pos FROM lineitem), g AS (SELECT *, pos - row_number() OVER (PARTITION BY structure ORDER BY pos) AS k FROM r)
SELECT structure, min(pos) AS "first", max(pos) AS "last" FROM g GROUP BY structure, k""",
    "index_mapping": with_views(MSA)
    + """, p AS (SELECT a.seq_idx AS pair, a.sym AS x, b.sym AS y, sum((a.sym <> 0)::INT) OVER w AS cx, sum((b.sym <> 0)::INT) OVER w AS cy
  FROM msa a JOIN msa b ON b.seq_idx = a.seq_idx + 1 AND a.pos = b.pos WINDOW w AS (PARTITION BY a.seq_idx ORDER BY a.pos ROWS UNBOUNDED PRECEDING))
SELECT pair, CAST(CASE WHEN x <> 0 THEN cx END AS BIGINT) AS i, CAST(CASE WHEN y <> 0 THEN 100 + cy END AS BIGINT) AS j FROM p WHERE x <> 0 OR y <> 0""",
    "mutants_split": """WITH m AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS pos, substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_suppkey % 20 + 1 AS INT), 1) AS wt, substr('ACDEFGHIKLMNPQRSTVWY', CAST(CAST(l_quantity AS BIGINT) % 20 + 1 AS INT), 1) AS subs FROM lineitem)
SELECT l_orderkey, string_agg(wt || pos || subs, ',' ORDER BY l_linenumber, wt || pos || subs) AS mutant, CAST(count(*) AS INT) AS num_mutations, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos, wt, subs) AS pos,
  string_agg(wt, ',' ORDER BY pos, wt, subs) AS wt, string_agg(subs, ',' ORDER BY pos, wt, subs) AS subs FROM m GROUP BY l_orderkey""",
    "mutant_delta_energy": with_views(MSA, TOTAL, GRID, SITES, PAIRS, MODEL)
    + """, t AS (SELECT pos, sym FROM msa WHERE seq_idx = 0),
flip AS (SELECT * FROM couplings UNION ALL SELECT j, i, b, a, v FROM couplings),
s AS (SELECT i, a, sum(v) AS v FROM (SELECT i, a, v FROM fields UNION ALL SELECT i, a, v FROM flip JOIN t ON t.pos = j AND t.sym = b) GROUP BY i, a),
mu AS (SELECT l_orderkey AS mutant, CAST(l_partkey % 9 + 9 * (l_linenumber - 1) + 1 AS INT) AS p, CAST(l_suppkey % 4 + 1 AS INT) AS subs FROM lineitem),
mt AS (SELECT mutant, p, sym AS wt, subs FROM mu JOIN t ON t.pos = p),
one AS (SELECT mutant, coalesce(n.v, 0) - coalesce(o.v, 0) AS d FROM mt LEFT JOIN s n ON n.i = p AND n.a = subs LEFT JOIN s o ON o.i = p AND o.a = wt),
two AS (
  SELECT x.mutant, coalesce(c1.v, 0) - coalesce(c2.v, 0) - coalesce(c3.v, 0) + coalesce(c4.v, 0) AS d FROM mt x JOIN mt y ON x.mutant = y.mutant AND x.p < y.p
  LEFT JOIN couplings c1 ON c1.i = x.p AND c1.j = y.p AND c1.a = x.subs AND c1.b = y.subs LEFT JOIN couplings c2 ON c2.i = x.p AND c2.j = y.p AND c2.a = x.subs AND c2.b = y.wt
  LEFT JOIN couplings c3 ON c3.i = x.p AND c3.j = y.p AND c3.a = x.wt AND c3.b = y.subs LEFT JOIN couplings c4 ON c4.i = x.p AND c4.j = y.p AND c4.a = x.wt AND c4.b = y.wt)
SELECT mutant, round(sum(d), 6) AS effect FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY mutant""",
    "header_parse": "SELECT c_custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS \"first\", c_custkey AS \"last\" FROM customer",
    "id_extract": "SELECT c_custkey, c_name AS id FROM customer",
    "annotation_parse": "SELECT s_suppkey, s_name AS \"OS\", CASE WHEN s_nationkey > 10 THEN 'G' || s_nationkey END AS \"GN\", '1' AS \"PE\", CAST(s_suppkey AS VARCHAR) AS \"SV\", CAST(NULL AS VARCHAR) AS \"Tax\" FROM supplier",
    "cds_unique": "SELECT l_suppkey AS ac, l_partkey AS cds, min(l_orderkey) AS genome FROM lineitem GROUP BY ALL HAVING count(*) = 1",
    "ss_segments": _states + "SELECT seq_idx, ss, min(pos) AS \"first\", max(pos) + 1 AS stop FROM run GROUP BY seq_idx, ss, r",
    "ss_clashes": with_views(MSA)
    + """, c AS (SELECT seq_idx AS chain, string_agg(CASE WHEN sym >= 2 THEN 'H' WHEN sym = 1 THEN 'E' ELSE 'C' END, '' ORDER BY pos) AS ss FROM msa GROUP BY seq_idx),
p AS (SELECT l_orderkey % 500 AS chain, l_linenumber, l_orderkey, l_partkey % 40 + 1 AS i, l_partkey % 40 + 2 + l_suppkey % 20 AS j FROM lineitem),
q AS (SELECT *, j - i AS d, substr(ss, i, j - i + 1) AS z, substr(ss, i + 1, j - i - 1) AS inner1, substr(ss, i + 2, greatest(j - i - 3, 0)) AS inner2, substr(ss, i, 1) AS a, substr(ss, j, 1) AS b FROM p JOIN c USING (chain))
SELECT l_orderkey, l_linenumber, i, j, d < 15 AND (replace(inner1, 'H', '') = '' OR replace(inner1, 'E', '') = '' OR (replace(inner2, 'E', '') = '' AND d > 8)
  OR ((a = 'H') <> (b = 'H') AND CASE WHEN contains(z, repeat('H', CAST(greatest(d - 1, 0) AS INT))) THEN d > 6 ELSE contains(z, repeat('H', CAST(greatest(d - 2, 0) AS INT))) AND d > 11 END)
  OR ((a = 'E') <> (b = 'E') AND (contains(z, repeat('E', CAST(greatest(d - 1, 0) AS INT))) OR contains(z, repeat('E', CAST(greatest(d - 2, 0) AS INT))) OR (contains(z, repeat('E', CAST(greatest(d - 3, 0) AS INT))) AND d > 8)))) AS ss_clash FROM q""",
    "restraint_rows": _states
    + """, k AS (SELECT unnest([{'s': 'H', 'n': 1, 'd': 3.8::DOUBLE}, {'s': 'H', 'n': 2, 'd': 5.5::DOUBLE}, {'s': 'H', 'n': 3, 'd': 5.0::DOUBLE}, {'s': 'E', 'n': 1, 'd': 3.8::DOUBLE}, {'s': 'E', 'n': 2, 'd': 6.4::DOUBLE}], recursive := true))
SELECT a.seq_idx, a.pos AS i, b.pos AS j, a.ss AS state, k.d AS dist FROM run a JOIN k ON k.s = a.ss JOIN run b ON b.seq_idx = a.seq_idx AND b.ss = a.ss AND b.r = a.r AND b.pos = a.pos + k.n""",
    "restraint_lines": _ecs
    + """, p AS (SELECT i, j, i % 7 = 0 OR j % 7 = 0 AS g FROM ecs)
SELECT i, j, format('assign (resid {} and name CA) (resid {} and name CA) 7.0 3.0 1.0', i, j) AS line FROM p
UNION ALL SELECT i, j, format('assign (resid {} and name CB) (resid {} and name CB) 5.0 2.0 2.0', i, j) FROM p WHERE NOT g""",
    "dihedral_scores": f"""WITH p AS (SELECT vec_id % 20 AS model, vec_id // 20 AS pos, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
b AS (
  SELECT q.model, q.x - o.x AS ax, q.y - o.y AS ay, q.z - o.z AS az, r.x - q.x AS bx, r.y - q.y AS by_, r.z - q.z AS bz, s.x - r.x AS cx, s.y - r.y AS cy, s.z - r.z AS cz
  FROM p q JOIN p o ON o.model = q.model AND o.pos = q.pos - 1 JOIN p r ON r.model = q.model AND r.pos = q.pos + 1 JOIN p s ON s.model = q.model AND s.pos = q.pos + 2),
n AS (SELECT *, ay * bz - az * by_ AS mx, az * bx - ax * bz AS my, ax * by_ - ay * bx AS mz, by_ * cz - bz * cy AS nx, bz * cx - bx * cz AS ny, bx * cy - by_ * cx AS nz FROM b),
d AS (SELECT model, atan2(sqrt(bx * bx + by_ * by_ + bz * bz) * (ax * nx + ay * ny + az * nz), mx * nx + my * ny + mz * nz) AS d FROM n)
SELECT model, count(*) AS n, round(sum(CAST(CASE {_helix} ELSE 0 END AS DOUBLE)), 6) AS alpha, round(sum(CAST(CASE {_strand} ELSE 0 END AS DOUBLE)), 6) AS beta FROM d GROUP BY model""",
    "job_latest_state": "SELECT user_id, m.event_id, m.event_type, m.value FROM (SELECT user_id, max({'ts': ts, 'event_id': event_id, 'event_type': event_type, 'value': value}) AS m FROM events GROUP BY user_id)",
    "job_summary": _ecs
    + """, k AS (SELECT l_suppkey AS job, score, row_number() OVER w AS rn, sum((dist <= 10)::INT) OVER w / count(dist) OVER w AS p FROM ecs WHERE abs(i - j) >= 6
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC, i, j, line ROWS UNBOUNDED PRECEDING))
SELECT job, count(*) AS num_pairs, count(*) FILTER (score >= 90000) AS num_significant, round(max(p) FILTER (rn = 10), 6) AS precision FROM k GROUP BY job""",
}
ORACLE_SQL = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLE_SQL.items()}
