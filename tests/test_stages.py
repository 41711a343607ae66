"""Fixed cases of parameter files, stages, lookups and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import couplings as C
from sitewise.operators import lookup as K
from sitewise.operators import mixture as X
from sitewise.operators import pairing as P
from sitewise.operators import scoring as S
from sitewise.operators import stages as T
from sitewise.sources import models


@pytest.mark.parametrize("precision", ["float32", "float64"])
def test_model_file_round_trip(spark, tmp_path, precision):
    rng = np.random.default_rng(0)
    sites = [(i, a, *map(float, rng.random(2).astype(np.float32))) for i in range(1, 5) for a in range(3)]
    pairs = [(i, j, a, b, *map(float, rng.random(2).astype(np.float32))) for i in range(1, 5) for j in range(i + 1, 5) for a in range(3) for b in range(3)]
    frames = spark.createDataFrame(sites, "i int, a int, frequency double, v double"), spark.createDataFrame(pairs, "i int, j int, a int, b int, frequency double, v double")
    path = str(tmp_path / "m.model")
    models.write_model(path, *frames, alphabet="-AC", target="ACCA", positions=[5, 6, 8, 9], n_valid=7, n_eff=3.5, precision=precision)
    head = models.read_model_header(spark, path, precision).first()
    assert (head.num_sites, head.num_symbols, head.num_valid_seqs, head.n_eff, head.alphabet, head.target, list(head.positions), head.mean_field) == (4, 3, 7, 3.5, "-AC", "ACCA", [5, 6, 8, 9], False)
    assert sorted(tuple(r)[1:] for r in models.read_model_sites(spark, path, precision).collect()) == sorted(sites)
    assert sorted(tuple(r)[1:] for r in models.read_model_pairs(spark, path, precision).collect()) == sorted(pairs)
    models.write_mean_field_model(path, *frames, pseudo=0.5, alphabet="-AC", target="ACCA", positions=[1, 2, 3, 4], n_valid=1, n_eff=1.0, precision=precision)
    head = models.read_model_header(spark, path, precision).first()
    assert head.mean_field and head.lambda_h == -0.5


def test_short_model_file(spark, tmp_path):
    (tmp_path / "m.model").write_bytes(np.array([4, 3, 7, 0, 0], "<i4").tobytes())
    with pytest.raises(Exception, match="ends early"):
        models.read_model_header(spark, str(tmp_path / "m.model")).collect()


def test_normal_mixture(spark):
    rng = np.random.default_rng(1)
    noise, signal = rng.normal(0, 0.1, 4000), rng.lognormal(0.3, 0.25, 300)
    ecs = spark.createDataFrame([(float(x), k) for k, part in enumerate((noise, signal)) for x in part], "cn double, k int")
    got = S.with_mixture_probability(ecs, "normal").collect()
    assert np.mean([(r.probability > 0.5) == bool(r.k) for r in got]) > 0.99
    mean, deviation, q, mu, sigma = X.fit_normal(X.score_bins(ecs, "cn"))
    assert abs(q - 40 / 43) < 0.02 and abs(deviation - 0.1) < 0.01 and abs(mu - 0.3) < 0.06 and abs(sigma - 0.25) < 0.05
    with pytest.raises(ValueError, match="no model"):
        S.with_mixture_probability(ecs, "other")
    parts = ecs.select("cn", F.lit("A").alias("segment_i"), F.when(F.rand(3) < 0.5, "A").otherwise("B").alias("segment_j"))
    assert S.complex_probability(parts, "evcomplex").count() == 4300


def test_gate_of_logistic_score(spark):
    ecs = spark.createDataFrame([(1, 9, 2.0), (2, 8, 1.0)], "i int, j int, cn double")
    got = S.logistic_rescored(ecs, spark.createDataFrame([], "pos int, conservation double, gap double"), {}, 0.0, 0.8, 1.0)
    assert [(r.score, r.probability) for r in got.orderBy("i").collect()] == [(2.0, 0.0), (1.0, 0.0)]


def test_sites_without_features(spark):
    """A pair is not lost with its site; it is an error."""
    ecs = spark.createDataFrame([(1, 9, 2.0, 7.0), (2, 8, 1.0, 6.0)], "i int, j int, cn double, score double")
    sites = spark.createDataFrame([(k, k / 10, None if k == 2 else 0.5) for k in (1, 2, 8, 9)], "pos int, conservation double, gap double")
    got = {r.i: r for r in C.add_site_features(ecs, sites).collect()}
    assert (got[1].min_conservation, got[1].max_conservation, got[1].min_gap) == (0.1, 0.9, 0.5) and got[2].max_gap == 0.5
    with pytest.raises(Exception, match="no features of a site of pair 2, 8"):
        C.add_site_features(ecs, sites.where("pos != 8")).collect()
    rescored = S.logistic_rescored(ecs, sites, {"max_cons": 1.0}, 0.5, 0.8, 1000.0)
    assert rescored.columns.count("score") == 1 and {r.i: round(r.score, 6) for r in rescored.collect()} == {1: 1.4, 2: 1.3}


def test_complex_pairs_without_map(spark):
    """Pairs of a segment, or between segments, without a map stay without a distance."""
    rows = [(1, 9, 9.0, "A", "A"), (1, 3, 8.0, "A", "A"), (2, 3, 7.0, "B", "B"), (1, 2, 6.0, "A", "B")]
    ecs = spark.createDataFrame(rows, "i int, j int, cn double, segment_i string, segment_j string")
    a = spark.createDataFrame([(1, 9, 8.0)], "i int, j int, dist double")
    other = spark.createDataFrame([(1, 9, 3.0)], "i int, j int, dist double")
    got = {(r.segment_i, r.segment_j, r.i, r.j): (r.dist, r.segmentwise_precision, r.precision) for r in S.complex_compared(ecs, {"A": (a, other)}).collect()}
    assert got == {("A", "A", 1, 9): (3.0, 1.0, 1.0), ("B", "B", 2, 3): (None, None, 1.0), ("A", "B", 1, 2): (None, None, 1.0)}
    inter = spark.createDataFrame([(1, 2, 9.0)], "i int, j int, dist double")
    got = {(r.segment_i, r.segment_j, r.i, r.j): (r.dist, r.segmentwise_precision, r.precision) for r in S.complex_compared(ecs, {"A": a}, inter).collect()}
    assert got == {("A", "A", 1, 9): (8.0, 0.0, 0.0), ("B", "B", 2, 3): (None, None, 0.0), ("A", "B", 1, 2): (9.0, 0.0, 0.0)}


def test_cut_and_target(spark):
    assert T.cut_sequence("ABCDEF", (12, 14), 11) == (12, "BCD") and T.cut_sequence("AB", None, 3) == (3, "AB")
    with pytest.raises(ValueError, match="not inside"):
        T.cut_sequence("ABC", (1, 4))
    rows = spark.createDataFrame([("t/1-3", "A-C.D"), ("u", "AB.-E"), ("v/2", "QQQQQ")], "id string, seq string")
    assert {(r.id, r.seq, r.is_target) for r in T.under_target(rows, "t/").collect()} == {("t/1-3", "ACD", True), ("u", "A.E", False), ("v/2", "QQQ", False)}
    with pytest.raises(ValueError, match="no sequences"):
        T.under_target(rows, "w")


def test_focused_alignment(spark):
    rows = spark.createDataFrame([(0, [1, 2, 0, 1]), (1, [1, 2, 0, 0]), (2, [0, 0, 0, 1]), (3, [1, 1, 0, 1])], "seq_idx long, residues array<int>")
    stage = T.focused(rows, 0, "-AB", 3, 0.5, 0.7, 0.6, first_index=10)
    assert stage["low"] == [3, 4] and stage["positions"] == [10, 11]
    assert {r.seq_idx for r in stage["rows"].collect()} == {0, 1, 3}
    assert {(r.seq_idx, r.seq) for r in stage["sequences"].collect()} == {(0, "AB.a"), (1, "AB.."), (3, "AA.a")}
    assert {(r.seq_idx, r.n_similar) for r in stage["weights"].collect()} == {(0, 2), (1, 2), (3, 1)}
    with pytest.raises(ValueError, match="target"):
        T.focused(rows, 9, "-AB", 3, None, None, None)


def test_structure_lookup(spark):
    rows = spark.createDataFrame([("1abc", "B", "P1", "X_HUMAN", 1, 9), ("1abc", "A", "P1", "X_HUMAN", 3, 9), ("1abc", "A", "P1", "X_HUMAN", 20, 30), ("2xyz", "A", "P2", "Y_HUMAN", 1, 5), ("2xyz", "B", "P1", "X_HUMAN", 1, 5)], "pdb_id string, pdb_chain string, uniprot_ac string, uniprot_id string, uniprot_start long, uniprot_end long")
    assert K.by_pdb_id(rows, "1ABC").count() == 3 and K.by_pdb_id(rows, "1abc", "B").count() == 1
    with pytest.raises(ValueError, match="P1, P2"):
        K.by_pdb_id(rows, "2xyz")
    assert K.by_pdb_id(rows, "2xyz", uniprot="Y_HUMAN").count() == 1
    found = K.by_uniprot_id(rows, "X_HUMAN", True)
    assert {(r.pdb_id, r.pdb_chain, len(r.ranges)) for r in K.chain_mappings(found).collect()} == {("1abc", "A", 2), ("2xyz", "B", 1)}
    assert {r.pdb_id for r in K.chosen_structures(rows, ["1ABC"]).collect()} == {"1abc"}
    assert K.chosen_structures(rows, most_structures=1).count() == 3 and K.chosen_structures(rows, most_hits=2).count() == 2


def test_indices_and_models(spark):
    index = K.segment_index(spark, [{"segment": "A", "start": 5, "end": 6}, {"segment": "B", "positions": [3, 9]}])
    model = spark.createDataFrame([(1, 2, 0.5), (2, 4, 0.25)], "i long, j long, v double")
    assert {(r.segment_i, r.i, r.segment_j, r.j) for r in K.patched(model, index).collect()} == {("A", 5, "A", 6), ("A", 6, "B", 9)}
    with pytest.raises(ValueError, match="cover"):
        K.patched(model.withColumn("j", F.lit(7).cast("long")), index)
    asked = spark.createDataFrame([("B", 9), ("B", 4)], "segment string, pos long")
    assert {(r.pos, r.model) for r in K.to_model(asked, index).collect()} == {(9, 4), (4, None)}
    assert [s["segment"] for s in K.complex_segments([{"segment": "x"}, {"segment": "y"}], [{"segment": "x"}])] == ["A_1", "A_2", "B_1"]


def test_tables_of_names(spark):
    table = spark.createDataFrame([("1", "a", None, "t"), ("2", "b", "o", None)], "id string, name string, OS string, Tax string")
    assert {(r.id, r.species) for r in K.species_annotation(table).collect()} == {("1", None), ("2", "o")}
    with pytest.raises(ValueError, match="none of"):
        K.species_annotation(table.withColumns({"OS": F.lit(None).cast("string"), "Tax": F.lit(None).cast("string")}))
    one = spark.createDataFrame([("m1", 1), ("m2", 2)], "filename string, cluster int")
    merged = K.merged_clusterings({"rmsd": one, "tm": one.where("cluster = 2")})
    assert {tuple(r) for r in merged.collect()} == {("m1", 1, None), ("m2", 2, 2)}
    headers = spark.createDataFrame([("1", "1/2-9 text")], "id string, header string")
    assert [(r.name, r.header) for r in K.with_full_header(table, headers).collect()] == [("a", "1/2-9 text")]


def test_axis_and_distribution(spark):
    ecs = spark.createDataFrame([(3, 20), (5, 9)], "i long, j long")
    dist = spark.createDataFrame([(4, 30)], "i long, j long")
    assert S.axis_boundaries(ecs, dist, "union") == {"i": (3, 30), "j": (3, 30)}
    assert S.axis_boundaries(ecs, dist, "intersection", symmetric=False) == {"i": (4, 4), "j": (30, 20)}
    assert S.axis_boundaries(ecs, dist, (1, 2))["j"] == (1, 2) and S.axis_boundaries(ecs, None, "structure")["i"] == (3, 20)
    with pytest.raises(ValueError, match="no values"):
        S.cumulative(ecs.limit(0), "i", ["j"])


def test_chains(spark):
    atoms = spark.createDataFrame([("1abc", "A", 5, "CA", 0), ("1abc", "A", 5, "CB", 1), ("1abc", "A", 6, "N", 2), ("2xyz", "B", 5, "CA", 3)], "pdb_id string, chain string, residue long, atom_name string, atom_idx int")
    mapping = spark.createDataFrame([("1abc", "A", 5, 50), ("2xyz", "B", 5, 51)], "pdb_id string, chain string, source long, target long")
    letters = spark.createDataFrame([(50, "Q")], "pos long, letter string")
    assert [(r.residue, r.letter, r.atom_name) for r in K.remapped_chains(atoms, mapping, letters).collect()] == [(50, "Q", "CA")]
    assert K.remapped_complexes(atoms, mapping.where("chain = 'A'"), mapping.where("chain = 'B'")).count() == 0
    assert K.remapped_complexes(atoms, mapping, mapping).count() == 4
    four = spark.createDataFrame([("1abc", c, 5, "CA", k) for k, c in enumerate("WXYZ")], "pdb_id string, chain string, residue long, atom_name string, atom_idx int")
    sides = [spark.createDataFrame([("1abc", c, 5, n) for c in cs], "pdb_id string, chain string, source long, target long") for cs, n in (("WX", 50), ("YZ", 60))]
    got = K.remapped_complexes(four, *sides, letters=(letters, None))
    want = {(i, j, side, "AB"[side - 1], (50, 60)[side - 1]) for i in "WX" for j in "YZ" for side in (1, 2)}
    assert {(r.chain_1, r.chain_2, r.side, r.chain, r.residue) for r in got.collect()} == want and got.count() == 8
    assert {r.letter for r in got.collect()} == {"Q", None}
    assert {(r.residue, r.first, r.last) for r in K.atom_rows(atoms.where("chain = 'A'")).collect()} == {(5, 0, 1), (6, 2, 2)}
    assert K.transposed(spark.createDataFrame([(1, 2, 3.0)], "i long, j long, dist double")).first()[:2] == (2, 1)


def test_mutation_predictions(spark):
    target = spark.createDataFrame([(1, 0), (2, 1)], "pos int, sym int")
    fields = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 1, 0.5)], "i int, a int, v double")
    couplings = spark.createDataFrame([(1, 2, 1, 1, 0.25)], "i int, j int, a int, b int, v double")
    mutants = spark.createDataFrame([("x", 1, 0, 1), ("bad", 2, 0, 1)], "mutant string, pos int, wt int, subs int")
    got = {r.mutant: (r.prediction_epistatic, r.prediction_independent) for r in T.mutation_predictions(mutants, target, fields, couplings, fields).collect()}
    assert got == {"x": (2.25, 2.0), "bad": (None, None)}


def test_coding_sequences_of_concatenation(spark):
    table = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", None)], "id string, species string")
    row = P.describe_concatenation(table, table).first()
    assert (row.num_seqs_1, row.num_species_overlap) == (3, 1)
