"""Small fixed cases of operators and readers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions import columns as K
from sitewise.operators import alignment as A
from sitewise.operators import couplings as C
from sitewise.operators import folding as O
from sitewise.operators import mutation as U
from sitewise.operators import overlaps as V
from sitewise.operators import pairing as P
from sitewise.operators import running as R
from sitewise.operators import structure as S
from sitewise.sources import readers, writers
from sitewise.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("second,want", [((1400, 1700), 0), ((1800, 1700), 200), ((1700, 1800), 200)])
def test_gene_distance(spark, second, want):
    assert one(spark, K.gene_distance(*map(F.lit, (1000, 1500, *second))))[0] == want


def test_entropy(spark):
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate((0.5, 0.2, 0.1, 0.1, 0.1))], "pos int, sym int, frequency double")
    assert math.isclose(A.conservation(rows, 5).first().conservation, 0.15545875354128547)
    assert math.isclose(rows.agg(F.sum(K.entropy_term(F.col("frequency")))).first()[0], 1.9609640474436811)


@pytest.mark.parametrize("text,want", [("A143K,M100K", [(143, "A", "K"), (100, "M", "K")]), ("", []), ("wt", []), ("Wild", [])])
def test_mutations(spark, text, want):
    assert [tuple(m) for m in one(spark, K.mutations(F.lit(text)))[0]] == want


def test_split_mutants(spark):
    got = U.split_mutants(spark.createDataFrame([("A143K,M100K",)], "mutant string")).first()
    assert (got.num_mutations, got.pos, got.wt, got.subs) == (2, "100,143", "M,A", "K,K")


def test_dihedral_of_a_right_angle(spark):
    points = [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1)]
    angle = one(spark, F.degrees(K.dihedral([tuple(F.lit(float(c)) for c in p) for p in points])))[0]
    assert math.isclose(abs(angle), 90)


def test_overlap_and_wrap(spark):
    assert one(spark, K.range_overlap(*map(F.lit, (1, 5, 3, 9))))[0] == 2
    assert one(spark, K.wrap(F.lit("abcde"), 2))[0] == "ab\ncd\ne"
    with pytest.raises(Exception, match="ends before"):
        one(spark, K.range_overlap(*map(F.lit, (5, 5, 3, 9))))


def test_running_totals_and_percentile(spark):
    rows = spark.createDataFrame([(i % 37, i, 1) for i in range(500)] + [(None, 999, 1)], "score int, k int, v int")
    got = {(r.score, r.k): r.total for r in R.running_totals(rows, "score", ["k"], {"total": F.col("v")}).collect()}
    order = sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[r] for r in order] == list(range(1, 502))
    values = spark.range(30001).select((F.col("id") * 7919 % 30001).alias("v"))
    assert R.percentile(values, "v") == 15000.0 and R.percentile(values, "v", 0.25) == 7500.0
    assert R.percentile(spark.createDataFrame([(1.0,), (4.0,)], "v double"), "v", 0.5) == 2.5
    assert R.percentile(values.where("v < 0"), "v") is None
    assert R.percentile(spark.range(30000).select(F.lit(3.0).alias("v")), "v") == 3.0


def test_weights_in_blocks(spark):
    rows = spark.createDataFrame([(i, [i % 3, i % 2, 0, 0]) for i in range(30)], "seq_idx long, residues array<int>")
    want = {r.seq_idx: r.n_similar for r in A.sequence_weights(rows, 0.75).collect()}
    for block in (4, 7, 64):
        assert {r.seq_idx: r.n_similar for r in A.sequence_weights(rows, 0.75, block).collect()} == want
    assert want[0] == sum((i % 3 == 0) + (i % 2 == 0) + 2 >= 3 for i in range(30))


def test_reciprocal_and_clans(spark):
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 3), (2, 11, 1), (2, 10, 9)], "id_1 long, id_2 long, distance long")
    assert [tuple(r) for r in P.reciprocal_pairs(pairs).collect()] == [(2, 11, 1)]
    hits = spark.createDataFrame([(1, "c", 1, 0, 10, 5.0), (1, "c", 2, 5, 15, 5.0), (1, None, 3, 0, 10, 1.0), (1, "c", 4, 10, 12, 1.0)], "query long, clan string, idx long, start long, stop long, score double")
    assert {r.idx for r in P.without_clan_overlaps(hits).collect()} == {1, 3}  # 4 overlaps 2, which is better, though 2 goes too


def test_contacts_equal_the_full_map(spark):
    import random

    rng = random.Random(0)
    atoms = spark.createDataFrame([(c, r, a, *(rng.uniform(-1, 1) for _ in range(3))) for c in range(2) for r in range(40) for a in range(2)], "chain long, residue long, atom int, x double, y double, z double")
    near = {(r.chain, r.i, r.j): round(r.dist, 9) for r in S.contacts(atoms, 0.4).collect()}
    assert near == {(r.chain, r.i, r.j): round(r.dist, 9) for r in S.distance_map(atoms).collect() if 0 < r.dist <= 0.4}


def test_secondary_structure(spark):
    chains = spark.createDataFrame([(1, "CHHHHHHHHC"), (2, "CEEEC")], "chain long, ss string")
    pairs = spark.createDataFrame([(1, 1, 10), (1, 2, 4), (2, 1, 5), (2, 1, 2)], "chain long, i long, j long")
    assert {(r.chain, r.i, r.j): r.ss_clash for r in O.clashes(pairs, chains).collect()} == {(1, 1, 10): True, (1, 2, 4): True, (2, 1, 5): True, (2, 1, 2): True}
    angles = spark.createDataFrame([(1, 0.8), (1, -0.7), (1, 0.52)], "model long, dihedral double")
    got = O.dihedral_scores(angles, ["model"]).first()
    assert (got.n, round(got.alpha, 6), round(got.beta, 6)) == (3, 1.2, 1.0)


def _angle(a, b, c, d):
    b0, b1, b2 = (np.subtract(q, p) for p, q in ((a, b), (b, c), (c, d)))
    n1, n2 = np.cross(b0, b1), np.cross(b1, b2)
    return math.atan2(np.linalg.norm(b1) * (b0 @ n2), n1 @ n2)


@pytest.mark.parametrize("parallel", [True, False])
def test_dihedral_ranking_score(spark, parallel):
    ss = "CC" + "H" * 6 + "CCCC" + "E" * 7 + "CCCC" + "E" * 7 + "CCC"
    at = {p: (100.0 + 2.3 * math.cos(1.745 * p), 2.3 * math.sin(1.745 * p), 1.5 * p) for p in range(1, 12)}  # a helix that coil continues
    for k in range(-2, 9):
        at[13 + k] = (3.3 * k, 0.0, 0.3 * k)
        at[24 + (k if parallel else 6 - k)] = (3.3 * k, 4.8, -0.3 * k)
    points = spark.createDataFrame([(1, p, *map(float, c)) for p, c in at.items()] + [(2, 5, 0.0, 0.0, 0.0)], "chain long, pos long, x double, y double, z double")
    residues = spark.createDataFrame([(c, p, s) for c in (1, 2) for p, s in enumerate(ss, 1)], "chain long, pos long, ss string")
    helix = {(r.chain, r.pos): r.dihedral for r in O.alpha_dihedrals(points, residues).collect()}
    assert helix.keys() == {(1, p) for p in range(3, 9)}
    assert all(math.isclose(v, _angle(*(at[p + k] for k in (-1, 0, 1, 2))), abs_tol=1e-9) for (_, p), v in helix.items())
    found = {r.i: (r.j, r.dihedral) for r in O.beta_dihedrals(points, residues).collect()}
    assert found.keys() == set(range(13, 20))
    for i, (j, angle) in found.items():
        assert j == (i + 11 if parallel else 43 - i)
        assert math.isclose(angle, _angle(at[i], at[i + 2], at[j + 2 if parallel else j - 2], at[j]), abs_tol=1e-9)
    weight = lambda v, bins: sum(w for low, high, w in bins if low < v < high)
    rows = {r.chain: r for r in O.dihedral_ranking_score(points, residues).collect()}
    assert (rows[1].n_alpha, rows[1].n_beta) == (6, 7) and rows[2][1:] == (0, 0.0, 0, 0.0)
    assert math.isclose(rows[1].alpha, sum(weight(v, O.HELIX_BINS) for v in helix.values()), abs_tol=1e-9)
    assert math.isclose(rows[1].beta, sum(weight(v, O.STRAND_BINS) for _, v in found.values()), abs_tol=1e-9)


def test_strands_take_partners_in_turn(spark):
    """Strand 1 fills its two places first, though strands 3 and 4 lie closer to each other."""
    where = {1: (0.0, 0.0), 2: (5.0, 0.0), 3: (0.0, 6.0), 4: (1.0, 6.5)}
    strands = spark.createDataFrame([(1, s, s, s + 1) for s in where], "chain long, strand int, first long, stop long")
    points = spark.createDataFrame([(1, s, x, y, 0.0) for s, (x, y) in where.items()], "chain long, pos long, x double, y double, z double")
    got = {(r.strand_1, r.strand_2) for r in O.strand_partners(strands, points, 7.0, 1).collect()}
    assert got == {(1, 2), (3, 4)}
    where[2] = (-30.0, 0.0)
    points = spark.createDataFrame([(1, s, x, y, 0.0) for s, (x, y) in where.items()], "chain long, pos long, x double, y double, z double")
    assert {(r.strand_1, r.strand_2) for r in O.strand_partners(strands, points, 7.0, 1).collect()} == {(1, 3)}


def test_alignment_files(spark, tmp_path):
    fasta = tmp_path / "a.fa"
    fasta.write_text(";comment\n>s1/1-4 x\nAC\nG-\n>s2/5-8\nACGT\n>s3\n")
    got = {r.header: r.seq for r in readers.read_fasta(spark, str(fasta)).collect()}
    assert got == {"s1/1-4 x": "ACG-", "s2/5-8": "ACGT", "s3": ""}
    assert readers.detect_format(spark, str(fasta)) is None
    sto = tmp_path / "a.sto"
    sto.write_text("# STOCKHOLM 1.0\n#=GF ID fam\n#=GS s1 DE text here\ns1 AC\ns2 GG\n\ns1 GT\ns2 --\n//\n")
    assert readers.detect_format(spark, str(sto)) == "stockholm"
    assert {r.seq_id: r.seq for r in readers.read_stockholm(spark, str(sto)).collect()} == {"s1": "ACGT", "s2": "GG--"}
    assert {(r.kind, r.name, r.feature, r.value) for r in readers.read_stockholm_annotation(spark, str(sto)).collect()} == {("GF", None, "ID", "fam"), ("GS", "s1", "DE", "text here")}
    out = str(tmp_path / "out")
    writers.write_fasta(spark.createDataFrame([("h", "ABCDE")], "header string, seq string"), out, 2)
    assert [r.value for r in spark.read.text(out).collect()] == [">h", "AB", "CD", "E"]
    rows = spark.createDataFrame([("q", "ACgT"), ("r", "A-T"), ("t", "ACxyT")], "seq_id string, seq string")
    assert [r.seq for r in readers.a3m_to_a2m(rows, "ACgT").orderBy("seq_id").collect()] == ["ACgT", "A-.T", "AC.T"]
    assert [r.seq for r in readers.a3m_to_a2m(rows, "ACgT", "delete").orderBy("seq_id").collect()] == ["ACT", "A-T", "ACT"]


def test_tables(spark, tmp_path):
    tbl = tmp_path / "hits.domtbl"
    tbl.write_text("# comment\n" + " ".join(["t", "-", "10", "q", "-", "20", "1e-5", "33.3", "0.1", "1", "2", "1e-6", "1e-7", "30.1", "0.2", "1", "9", "2", "8", "1", "9", "0.9", "some long description"]) + "\n")
    row = readers.read_hits(spark, str(tbl), readers.DOMTBL).first()
    assert (row.target_len, row.evalue, row.description) == (10, 1e-5, "some long description")
    pdb = tmp_path / "a.pdb"
    pdb.write_text("HEADER\nATOM      1  CA AALA A  52A     11.104   6.134  -6.504  1.00 10.50           C\n")
    atom = readers.read_pdb_atoms(spark, str(pdb)).first()
    assert (atom.atom_name, atom.alt_loc, atom.residue, atom.x, atom.chain) == ("CA", "A", "52A", 11.104, "A")
    flat = tmp_path / "fam.txt"
    flat.write_text("#=GF AC PF1.3\n#=GF SQ 12\nx\n//\n#=GF AC PF2.1\n#=GF SQ 7\n//\n")
    assert {tuple(r) for r in readers.family_sizes(spark, str(flat)).collect()} == {("PF1", 12), ("PF2", 7)}


def test_stream_of_jobs(spark, tmp_path):
    import datetime as dt

    rows = [(k, dt.datetime(2024, 1, 1, k), k % 2, "run", 1.0, None) for k in range(6)]
    events = spark.createDataFrame(rows, jobs.SCHEMA)
    events.write.parquet(str(tmp_path / "events"))
    query = jobs.latest_states_stream(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.user_id, r.event_id) for r in spark.table("latest").collect()} == {(0, 4), (1, 5)}
    assert {(r.user_id, r.event_id) for r in jobs.latest_states(events).collect()} == {(0, 4), (1, 5)}


def test_segments_and_pairs(spark):
    ecs = spark.createDataFrame([(1, 9, 3.0), (2, 12, 2.0), (1, 3, 9.0)], "i long, j long, score double")
    mapped = C.segment_map(ecs, [{"segment": "A", "start": 5, "end": 8}, {"segment": "B", "start": 1, "end": 10}])
    assert [(r.segment_i, r.pos_i, r.segment_j, r.pos_j) for r in mapped.orderBy("i", "j").collect()] == [("A", 5, "A", 7), ("A", 5, "B", 5), ("A", 6, "B", 8)]
    assert [r.score for r in C.top(C.long_range(ecs), 1).collect()] == [3.0]


def test_enrichment_of_many_pairs_has_no_single_task(spark, monkeypatch):
    from sitewise.operators import running

    monkeypatch.setattr(running, "ROWS", 50)
    rows = [(k % 37, k % 41 + 50, k, float(k * 7919 % 101)) for k in range(400)]
    pairs = spark.createDataFrame(rows, "i long, j long, line long, score double")
    out = C.enrichment(pairs, 150, ties=("i", "j", "line"))
    assert "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()
    best = sorted(rows, key=lambda r: (-r[3], *r[:3]))[:150]
    want = {}
    for i, j, _, s in best:
        want[i], want[j] = want.get(i, 0) + s, want.get(j, 0) + s
    mean = sum(r[3] for r in best) / 150
    assert {r.i: round(r.enrichment, 9) for r in out.collect()} == {k: round(v / mean, 9) for k, v in want.items()}


def test_segments_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 5)
    monkeypatch.setattr(S, "TASK_ROWS", 7)
    rows = [(k, p) for k, ps in (("a", [*range(-3, 18), 18, 19, 21, 24, 25, 40]), ("b", [4, 4, 5, 9, 10, 11, 30]), (None, [1, 2, 7]), ("c", [None, 3, None])) for p in ps]
    got = sorted(map(tuple, S.segments(spark.createDataFrame(rows, "k string, pos long"), ["k"]).collect()), key=str)
    want = [("a", -3, 19), ("a", 21, 21), ("a", 24, 25), ("a", 40, 40), ("b", 4, 5), ("b", 9, 11), ("b", 30, 30), (None, 1, 2), (None, 7, 7), ("c", 3, 3), ("c", None, None)]
    assert got == sorted(want, key=str)


def test_energies_of_small_and_large_models_are_equal(spark, monkeypatch):
    from sitewise.operators import mutation as U

    cells = spark.createDataFrame([(s, p, (s * p) % 3) for s in range(9) for p in range(1, 7) if (s + p) % 5], "seq_idx long, pos int, sym int")
    fields = spark.createDataFrame([(p, a, p + 0.1 * a) for p in range(1, 7) for a in range(3)], "i int, a int, v double")
    couplings = spark.createDataFrame([(i, j, a, b, i * 0.3 - j * 0.7 + a - b) for i in range(1, 7) for j in range(i + 1, 7) for a in range(3) for b in range(2)], "i int, j int, a int, b int, v double")
    small = U.sequence_energies(cells, fields, couplings)
    assert "Join" in small._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(U, "MODEL_ROWS", 0)
    rounded = lambda df: {r.seq_idx: tuple(round(v, 9) for v in (r.fields, r.couplings, r.energy)) for r in df.collect()}
    assert rounded(small) == rounded(U.sequence_energies(cells, fields, couplings)) and len(rounded(small)) == 9


def test_overlap_hits_of_equal_intervals_and_segments(spark):
    hits = spark.createDataFrame([(k % 3, 1, 10 * (k % 2), 10 * (k % 2) + 30, float(k)) for k in range(8)], "alignment_id long, ac long, start long, stop long, score double")
    segments = spark.createDataFrame([(1, s, "c", 5, 25) for s in ("p", "p", None)] + [(1, "p", "c", 20, 60), (2, "p", "c", 0, 90)], "ac long, structure string, chain string, seg_start long, seg_stop long")
    out = P.overlap_hits(hits, segments)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    want = {}
    for h in hits.collect():
        for s in segments.collect():
            n = min(h.stop, s.seg_stop) - max(h.start, s.seg_start)
            if h.ac == s.ac and n > 0:
                want.setdefault((h.alignment_id, s.structure, s.chain), []).append((n, s.seg_start, s.seg_stop, h.score))
    sums = {k: (sum(r[0] for r in v), min(r[1] for r in v), max(r[2] for r in v), max(r[3] for r in v)) for k, v in want.items()}
    assert {tuple(r[:3]): tuple(r[3:]) for r in out.collect()} == {k: v for k, v in sums.items() if v[0] >= 20}


def test_pair_frequencies_by_products(spark):
    """Rows of different lengths, symbols that are missing or of any number, weights of nothing; a task sends on pairs of cells, not of sequences."""
    rows = spark.createDataFrame([(0, [1, 2, None], 1.0), (1, [1, 2, -3], 0.5), (2, [7, 2], 0.0), (3, [5], 2.0), (4, [], 1.0)], "seq_idx long, residues array<int>, weight double")
    got = {(r.i, r.j, r.a, r.b): r.frequency for r in A.pair_frequencies(rows).collect()}
    want = {(1, 2, 1, 2): 1.5, (1, 3, 1, None): 1.0, (2, 3, 2, None): 1.0, (1, 3, 1, -3): 0.5, (2, 3, 2, -3): 0.5, (1, 2, 7, 2): 0.0}
    assert got == {k: w / 4.5 for k, w in want.items()}
    assert "Generate" not in A.pair_frequencies(rows)._jdf.queryExecution().toString()


def test_sequence_weights_by_slabs(spark, monkeypatch):
    monkeypatch.setattr(A, "SLAB", 2)
    rng = random.Random(1)
    seqs = [[rng.choice([0, 1, 9, -2]) for _ in range(8)] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "seq_idx long, residues array<int>")
    near = lambda a, b: sum(x == y for x, y in zip(a, b)) >= 4
    for block in (7, 64):
        got = {r.seq_idx: r.n_similar for r in A.sequence_weights(rows, 0.5, block).collect()}
        assert got == {i: sum(near(a, b) for b in seqs) for i, a in enumerate(seqs)}


@pytest.mark.parametrize("hits_a_block,segments_a_block,cells", [(500_000, 500_000, 1 << 21), (7, 5, 40)])
def test_overlap_hits_by_blocks(spark, monkeypatch, hits_a_block, segments_a_block, cells):
    """No row of a hit and a segment is made by a join; ends that are null bound nothing, as in SQL."""
    for name, value in (("HITS", hits_a_block), ("SEGMENTS", segments_a_block), ("CELLS", cells)):
        monkeypatch.setattr(V, name, value)
    rng = random.Random(8)
    end = lambda low, high: None if rng.random() < 0.05 else rng.randrange(low, high)
    hits = [(rng.choice([None, *range(9)]), rng.choice([None, "P1", "P2", "P3", "Q"]), end(0, 60), end(30, 100), rng.choice([None, float("nan"), rng.random()])) for _ in range(60)]
    segments = [(rng.choice([None, "P1", "P2", "P3", "R"]), rng.choice([None, "1abc", "2abc"]), rng.choice("AB"), end(0, 60), end(30, 100)) for _ in range(50)]
    out = P.overlap_hits(spark.createDataFrame(hits, "alignment_id int, ac string, start long, stop int, score double"), spark.createDataFrame(segments, "ac string, structure string, chain string, seg_start int, seg_stop long"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "seg_start" not in plan.split("Join Inner")[0].split("MapInArrow")[1]
    want = {}
    for alignment, ac, start, stop, score in hits:
        for other, structure, chain, s0, s1 in segments:
            lows, highs = [v for v in (start, s0) if v is not None], [v for v in (stop, s1) if v is not None]
            if ac is not None and ac == other and lows and highs and min(highs) > max(lows):
                want.setdefault((alignment, structure, chain), []).append((min(highs) - max(lows), s0, s1, score))
    least = lambda f, v: f((x for x in v if x is not None), default=None)
    most = lambda v: math.nan if any(x != x for x in v if x is not None) else least(max, v)
    sums = {k: (sum(r[0] for r in v), least(min, [r[1] for r in v]), least(max, [r[2] for r in v]), most([r[3] for r in v])) for k, v in want.items()}
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str((*k, *v)) for k, v in sums.items() if v[0] >= 20)
    assert out.schema["first"].dataType.simpleString() == "int" and out.schema["alignment_id"].dataType.simpleString() == "int"
