"""Queries over scored pairs, genes, hits, species, structures and tables of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import alignment as A
from ..operators import couplings as C
from ..operators import folding as O
from ..operators import mixture as X
from ..operators import mutation as U
from ..operators import pairing as P
from ..operators import scoring as G
from ..operators import structure as S
from ..streaming.jobs import latest_states
from .fixtures import atoms, ecs, genes, hits, msa_rows, table
from .msa_queries import _model, r6
from .pair_oracles import ORACLE_SQL  # noqa: F401

TIES = ("i", "j", "line")
CUTOFF = 0.12


def enrichment(spark, d):
    return C.enrichment(ecs(spark, d), 0.5, ties=TIES).select("i", r6("enrichment"))


def top_longrange(spark, d):
    return C.long_range(ecs(spark, d)).orderBy(F.desc("score"), *TIES).limit(100).select("i", "j", "line", "score")


def mad(spark, d):
    return C.mad_score(ecs(spark, d)).select("i", "j", "line", r6("mad_score"))


def precision(spark, d):
    return C.precision(ecs(spark, d), 10.0, ties=TIES).select("i", "j", "line", r6("precision"))


def expected_true(spark, d):
    rows = ecs(spark, d).withColumn("probability", F.col("l_discount"))
    return C.expected_true(rows, 500, ties=TIES).select("n_rows", r6("expected"))


def evcomplex(spark, d):
    rows = ecs(spark, d).withColumn("score", F.col("score") - 40000)
    return C.minimum_scaled(rows).select("i", "j", "line", r6("probability"))


SEGMENTS = [{"segment": "A_1", "start": 10, "end": 509}, {"segment": "B_1", "start": 1, "end": 700}]


def segment_map(spark, d):
    return C.segment_map(ecs(spark, d), SEGMENTS).select("i", "j", "line", "segment_i", "pos_i", "segment_j", "pos_j")


def rank_bands(spark, d):
    return C.rank_bands(ecs(spark, d), [0.05, 0.15], "score", list(TIES)).select("i", "j", "line", "band")


def _sites(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") / 50).alias("conservation"), (F.col("p_retailprice") % 1).alias("gap"))


COEFFICIENTS = {"score": 0.0001, "min_conservation": 1.5, "max_conservation": 0.5, "min_gap": -2.0, "max_gap": -1.0}


def logistic(spark, d):
    rows = C.add_site_features(ecs(spark, d).withColumn("i", F.col("l_suppkey")), _sites(spark, d))
    return C.logistic_score(rows, COEFFICIENTS, -4.0).select("i", "j", "line", "score", r6("score_logit"), r6("probability"))


def distance_join(spark, d):
    known = table(spark, d, "part").select(F.col("p_size").cast("long").alias("i"), F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("dist"))
    rows = ecs(spark, d).select((F.col("i") % 50 + 1).alias("i"), "j", "line", F.col("dist").alias("other"))
    found = C.with_distances(rows.groupBy("i", "j").agg(F.min("other").alias("other")), known)
    return found.select("i", "j", C.nearest_distance("dist", "other").alias("dist"))


def mixture(spark, d):
    return X.add_probability(ecs(spark, d).select("i", "j", "line", ((F.col("score") - 38000) / 20000).alias("score"))).select("i", "j", "line", r6("probability"))


def partners(spark, d):
    return P.possible_partners(genes(spark, d, 1), genes(spark, d, 2))


def reciprocal(spark, d):
    return P.reciprocal_pairs(partners(spark, d)).select("id_1", "id_2", "distance")


def near_genes(spark, d):
    return P.genome_distance_pairs(genes(spark, d, 1), genes(spark, d, 2), 3000).select("id_1", "id_2", "distance")


def clan_filter(spark, d):
    return P.without_clan_overlaps(hits(spark, d)).select("query", "clan", "idx", "start", "stop", "score")


def _identities(spark, d):
    rows = msa_rows(spark, d)
    reference = rows.where("seq_idx = 0").first().residues
    return A.identities_to(rows, reference).join(rows.select("seq_idx", "label"), "seq_idx").select(F.col("seq_idx").alias("id"), F.col("label").alias("species"), "identity")


def species_best(spark, d):
    return P.best_hit_by_species(_identities(spark, d)).select("species", "id", r6("identity"))


def species_paralogs(spark, d):
    return P.paralogs(_identities(spark, d), "7", 0.3).select("id", "species", r6("identity"))


def species_reciprocal(spark, d):
    """Best hits against the paralogs of the query's species, by identity of whole rows."""
    found = _identities(spark, d)
    best = P.best_hit_by_species(found)
    others = P.paralogs(found, "0", 0.25).select(F.col("id").alias("paralog"))
    rows = msa_rows(spark, d)
    mine = rows.join(best.select("id"), rows.seq_idx == F.col("id")).select("id", F.col("residues").alias("a"))
    theirs = rows.join(others, rows.seq_idx == F.col("paralog")).select("paralog", F.col("residues").alias("b"))
    # best hits, one a species, are asked against all paralogs position by position
    x, y = (f.select(k, F.posexplode(c).alias("p", "s")) for f, k, c in ((mine, "id", "a"), (theirs, "paralog", "b")))
    pairs = x.join(y, ["p", "s"]).groupBy("id", "paralog").agg((F.count("*") / 64).alias("identity"))
    return P.best_reciprocal(best, pairs).select("id", "species", r6("identity"))


def concatenate(spark, d):
    rows = A.read_out(msa_rows(spark, d), "-ACGT").withColumnRenamed("seq_idx", "id")
    pairs = msa_rows(spark, d).groupBy("label").agg(F.min("seq_idx").alias("id_1"), F.max("seq_idx").alias("id_2")).select("id_1", "id_2")
    return P.concatenated(pairs, rows, rows)


def concatenation_stats(spark, d):
    one = msa_rows(spark, d).select(F.col("seq_idx").alias("id"), F.col("label").alias("species"))
    two = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("species"))
    out = P.describe_concatenation(one, two)
    return out.select(*(F.col(c).cast("double" if "median" in c else "long").alias(c) for c in out.columns))


def sifts_hits(spark, d):
    found = hits(spark, d).select(F.col("query").alias("alignment_id"), F.col("idx").alias("ac"), "start", "stop", "score")
    parts = table(spark, d, "part").select(F.col("p_size").alias("ac"), F.col("p_brand").alias("structure"), F.col("p_type").alias("chain"), (F.col("p_partkey") % 150).alias("seg_start"), (F.col("p_partkey") % 150 + 30).alias("seg_stop"))
    return P.overlap_hits(found, parts)


def distance_map(spark, d):
    return S.distance_map(atoms(spark, d)).select("chain", "i", "j", r6("dist"))


def contacts(spark, d):
    return S.contacts(atoms(spark, d), CUTOFF).select("chain", "i", "j", r6("dist"))


def _models(spark, d):
    at = atoms(spark, d)
    return at.select((F.col("residue") % 5).alias("model"), "chain", F.floor(F.col("residue") / 50).cast("long").alias("residue"), "atom", "x", "y", "z")


def inter_min(spark, d):
    rows = _models(spark, d)
    return S.inter_chain(rows.where("chain % 2 = 0").drop("chain"), rows.where("chain % 2 = 1").drop("chain"), ["model"]).select("i", "j", r6("dist"))


def multimer_min(spark, d):
    return S.multimer_min(_models(spark, d), ["model"]).select("i", "j", r6("dist"))


def combined_maps(spark, d):
    at = atoms(spark, d).select((F.col("residue") % 3).alias("chain"), F.floor(F.col("residue") / 3).cast("long").alias("residue"), "atom", "x", "y", "z")
    return S.combined_map(at, 3).select("i", "j", r6("dist"))


def coverage_islands(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_partkey").alias("pos"))
    return S.segments(rows, ["structure"])


def index_mapping(spark, d):
    rows = msa_rows(spark, d)
    pairs = rows.alias("a").join(rows.alias("b"), F.col("b.seq_idx") == F.col("a.seq_idx") + 1).select(F.col("a.seq_idx").alias("pair"), F.col("a.residues").alias("residues_1"), F.col("b.residues").alias("residues_2"), F.lit(1).alias("start_1"), F.lit(101).alias("start_2"))
    return S.index_mapping(pairs).select("pair", F.col("i").cast("long"), F.col("j").cast("long"))


def _mutants(spark, d):
    letter = lambda c: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (c % 20 + 1).cast("int"), F.lit(1))
    one = F.concat(letter(F.col("l_suppkey")), F.col("l_partkey").cast("string"), letter(F.col("l_quantity").cast("long")))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", one.alias("m")).alias("m"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["m"]), ",").alias("mutant"))


def mutants_split(spark, d):
    return U.split_mutants(_mutants(spark, d))


def mutant_delta(spark, d):
    """A substitution of the first sequence for each line of an order, each in a stretch of its own, under the log-odds model."""
    rows, fields, couplings = _model(spark, d)
    target = A.cells(rows.where("seq_idx = 0")).select("pos", "sym")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mutant"), (F.col("l_partkey") % 9 + 9 * (F.col("l_linenumber") - 1) + 1).cast("int").alias("pos"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("subs"))
    wild = target.select("pos", F.col("sym").alias("wt"))
    return U.mutant_effects(items.join(wild, "pos").select("mutant", "pos", "wt", "subs"), target, fields, couplings).select("mutant", r6("effect"))


def _headers(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("/"), "c_nationkey", F.lit("-"), "c_custkey").alias("header"))


def header_parse(spark, d):
    name, first, last = K.header_parts(F.col("header"))
    return _headers(spark, d).select("c_custkey", name.alias("name"), first.alias("first"), last.alias("last"))


def id_extract(spark, d):
    headers = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "sp|").otherwise("UniRef100_"), "c_name", F.lit("|x y")).alias("header"))
    return headers.select("c_custkey", K.first_match(F.col("header"), [r"^sp\|([^|]+)", r"^UniRef\d+_([^|]+)"]).alias("id"))


KEYS = ["GN", "OS", "PE", "SV", "n", "Tax", "RepID"]


def annotation_parse(spark, d):
    text = F.concat(F.lit("protein "), "s_name", F.lit(" OS="), "s_name", F.when(F.col("s_nationkey") > 10, F.concat(F.lit(" GN=G"), "s_nationkey")).otherwise(""), F.lit(" PE=1 SV="), "s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", text.alias("t"))
    return rows.select("s_suppkey", *(K.annotation(F.col("t"), k, KEYS).alias(k) for k in ("OS", "GN", "PE", "SV", "Tax")))


def cds_unique(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ac"), F.col("l_orderkey").alias("genome"), F.col("l_partkey").alias("cds"))
    return P.unique_cds(rows)


def _states(spark, d):
    return A.cells(msa_rows(spark, d)).select("seq_idx", "pos", F.when(F.col("sym") >= 3, "H").when(F.col("sym") == 2, "E").otherwise("C").alias("ss"))


def ss_segments(spark, d):
    return S.state_runs(_states(spark, d), ["seq_idx"])


def ss_clashes(spark, d):
    chains = msa_rows(spark, d).select(F.col("seq_idx").alias("chain"), F.array_join(F.transform("residues", lambda s: F.when(s >= 2, "H").when(s == 1, "E").otherwise("C")), "").alias("ss"))
    pairs = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("chain"), "l_linenumber", F.col("l_orderkey"), (F.col("l_partkey") % 40 + 1).alias("i"), (F.col("l_partkey") % 40 + 2 + F.col("l_suppkey") % 20).alias("j"))
    return O.clashes(pairs, chains).select("l_orderkey", "l_linenumber", "i", "j", "ss_clash")


def restraint_rows(spark, d):
    return O.state_restraints(_states(spark, d), ["seq_idx"], {"H": [(1, 3.8), (2, 5.5), (3, 5.0)], "E": [(1, 3.8), (2, 6.4)]}).select("seq_idx", "i", "j", "state", "dist")


def restraint_lines(spark, d):
    letter = lambda c: F.when(c % 7 == 0, "G").otherwise("A")
    pairs = ecs(spark, d).select("i", letter(F.col("i")).alias("A_i"), "j", letter(F.col("j")).alias("A_j"))
    return O.distance_restraints(pairs, [("CA", "CA", 7.0, 3.0, 1.0), ("CB", "CB", 5.0, 2.0, 2.0)])


def dihedrals(spark, d):
    points = table(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("model"), F.floor(F.col("vec_id") / 20).cast("long").alias("pos"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return O.dihedral_scores(O.chain_dihedrals(points, ["model"]), ["model"]).select("model", "n", r6("alpha"), r6("beta"))


def disulfides(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("chain"), (F.col("l_partkey") % 40).alias("i"), (F.col("l_orderkey") % 40 + 40).alias("j"), F.col("l_extendedprice").alias("score"), F.lit("C").alias("A_i"), F.lit("C").alias("A_j"))
    return O.disulfide_clashes(pairs)


def job_latest(spark, d):
    return latest_states(table(spark, d, "events")).select("user_id", "event_id", "event_type", "value")


def job_summary(spark, d):
    """Per job (supplier): significant long-range pairs and the precision at the tenth row."""
    rows = C.long_range(ecs(spark, d)).withColumn("job", F.col("l_suppkey"))
    found = G.job_summary(rows, ["job"], [F.desc("score"), *TIES], F.col("score") >= 90000, F.col("dist") <= 10, 10)
    return found.select("job", "num_pairs", "num_significant", r6("precision"))


QUERIES = {
    "ec_enrichment": enrichment,
    "ec_top_longrange": top_longrange,
    "ec_mad_score": mad,
    "ec_precision": precision,
    "ec_expected_true": expected_true,
    "ec_evcomplex_score": evcomplex,
    "ec_segment_map": segment_map,
    "ec_rank_bands": rank_bands,
    "ec_logistic_score": logistic,
    "ec_distance_join": distance_join,
    "mixture_probability": mixture,
    "genome_partners": partners,
    "genome_reciprocal_pairs": reciprocal,
    "genome_distance_filter": near_genes,
    "clan_overlap_filter": clan_filter,
    "species_best_hit": species_best,
    "species_paralogs": species_paralogs,
    "species_best_reciprocal": species_reciprocal,
    "concatenate_pairs": concatenate,
    "concatenation_stats": concatenation_stats,
    "sifts_overlap_hits": sifts_hits,
    "struct_distance_map": distance_map,
    "struct_contacts": contacts,
    "struct_inter_min": inter_min,
    "struct_multimer_min": multimer_min,
    "struct_combined_maps": combined_maps,
    "struct_coverage_islands": coverage_islands,
    "index_mapping": index_mapping,
    "mutants_split": mutants_split,
    "mutant_delta_energy": mutant_delta,
    "header_parse": header_parse,
    "id_extract": id_extract,
    "annotation_parse": annotation_parse,
    "cds_unique": cds_unique,
    "ss_segments": ss_segments,
    "ss_clashes": ss_clashes,
    "restraint_rows": restraint_rows,
    "restraint_lines": restraint_lines,
    "dihedral_scores": dihedrals,
    "disulfide_clashes": disulfides,
    "job_latest_state": job_latest,
    "job_summary": job_summary,
}
