"""Stockholm files by record, lifted queries, stored distance maps, and running totals over many ranges."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import running, tiles
from sitewise.plans import stage_queries
from sitewise.sources import maps as M
from sitewise.sources import readers
from sitewise.sources import stockholm as Q


def _record(k, width=60, blocks=3):
    rng = random.Random(k)
    seqs = {f"s{k}_{n}": "".join(rng.choice("ACDEFG-.") for _ in range(width * blocks)) for n in range(4)}
    rf = "".join(rng.choice("xxx.") for _ in range(width * blocks))
    lines = ["# STOCKHOLM 1.0", f"#=GF ID fam{k}", f"#=GS s{k}_0 DE some text // here", ""]
    for b in range(blocks):
        part = slice(b * width, (b + 1) * width)
        lines += [f"{name}   {seq[part]}" for name, seq in seqs.items()] + [f"#=GR s{k}_0 PP {'9' * width}", f"#=GC RF   {rf[part]}", ""]
    return "\n".join([*lines, "//"]), seqs, rf


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_records_of_a_split_file(spark, tmp_path, small_splits, newline):
    records = [_record(k) for k in range(150)]
    path = tmp_path / "family.sto"
    path.write_bytes((newline.join(text for text, _, _ in records) + newline).encode())
    blocks = Q.stockholm_records(spark, str(path))
    assert len(spark.read.option("lineSep", "\n" + Q.FIRST).text(str(path)).select(F.spark_partition_id().alias("p")).distinct().collect()) > 3
    assert sorted(r.aln for r in blocks.select("aln").collect()) == list(range(150))
    got = {(r.aln, r.seq_id): r.seq for r in readers.read_stockholm(spark, str(path)).collect()}
    assert got == {(k, name): seq for k, (_, seqs, _) in enumerate(records) for name, seq in seqs.items()}
    notes = readers.read_stockholm_annotation(spark, str(path))
    assert {r.aln: r.value for r in Q.column_annotation(notes, "RF").collect()} == {k: rf for k, (_, _, rf) in enumerate(records)}
    assert {r.aln: r.value for r in notes.where("feature = 'ID'").collect()} == {k: f"fam{k}" for k in range(150)}
    assert {r.value for r in notes.where("feature = 'DE'").collect()} == {"some text // here"}
    assert {r.value for r in notes.where("feature = 'PP'").collect()} == {"9" * 60}


GOOD = "# STOCKHOLM 1.0\ns1 AC\n//\n"


@pytest.mark.parametrize("text", ["s1 AC\n//\n", "# STOCKHOLM 1.0\ns1 AC\n", GOOD + "# STOCKHOLM 1.0\ns1 AC\n", GOOD + "s2 AC\n//\n", "# STOCKHOLM 2.0\ns1 AC\n//\n", GOOD + "# STOCKHOLM 2.0\ns1 AC\n//\n", "# STOCKHOLM 1.0\n1|s1 AC\n//\n"])
def test_bad_records_raise(spark, tmp_path, text):
    path = tmp_path / "bad.sto"
    path.write_text(text)
    with pytest.raises(Exception):
        readers.read_stockholm(spark, str(path)).collect()


def test_good_and_blank_files(spark, tmp_path):
    for name, text, n in (("good.sto", GOOD.rstrip(), 1), ("two.sto", GOOD + "\n\n" + GOOD + "\n", 2), ("blank.sto", "\n\n", 0), ("empty.sto", "# STOCKHOLM 1.0\n//\n", 0)):
        (tmp_path / name).write_text(text)
        assert readers.read_stockholm(spark, str(tmp_path / name)).count() == n, name
    assert readers.read_stockholm(spark, str(tmp_path / "*.sto")).groupBy("file").count().count() == 2
    (tmp_path / "prefixed.sto").write_text("# STOCKHOLM 1.0\n1|s1 AC\n//\n")
    assert readers.read_stockholm(spark, str(tmp_path / "prefixed.sto"), raise_prefixed=False).first().seq_id == "1|s1"


def _lifted(rf, query):
    letters = iter(query)
    return "".join(next(letters) if c == "x" else "-" for c in rf)


def test_query_over_match_columns(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("x..x~") for _ in range(rng.choice([1, 7, 300])))) for k in range(40)] + [(40, ""), (41, "..."), (42, "xxx")]
    rows = [(k, rf, "".join(rng.choice("ACDE") for _ in range(rf.count("x")))) for k, rf in rows]
    df = spark.createDataFrame(rows, "k int, rf string, query string")
    assert {r.k: r.s for r in df.select("k", Q.lifted(F.col("rf"), F.col("query")).alias("s")).collect()} == {k: _lifted(rf, q) for k, rf, q in rows}
    places = {(r.k, r.column): r.pos for r in Q.match_positions(df, "k", reference="rf").collect()}
    assert places == {(k, c + 1): rf[: c + 1].count("x") for k, rf, _ in rows for c in range(len(rf)) if rf[c] == "x"}
    for rf, query in (("xx.", "A"), ("x", "AC"), (None, "A")):
        with pytest.raises(Exception):
            spark.createDataFrame([(rf, query)], "rf string, query string").select(Q.lifted(F.col("rf"), F.col("query"))).collect()


def test_search_result_under_its_query(spark, tmp_path):
    text, seqs, rf = _record(3)
    path, empty, bare = tmp_path / "hits.sto", tmp_path / "empty.sto", tmp_path / "bare.sto"
    path.write_text(text + "\n")
    empty.write_text("")
    bare.write_text(GOOD)
    query = "".join(random.Random(1).choice("KLMN") for _ in range(rf.count("x")))
    under = lambda p, q: Q.under_query(readers.read_stockholm(spark, str(p)), readers.read_stockholm_annotation(spark, str(p)), "me/1-9", q).orderBy("n").collect()
    got = under(path, query)
    assert [(r.seq_id, r.seq) for r in got] == [("me/1-9", _lifted(rf, query)), *seqs.items()]
    assert [(r.seq_id, r.seq, r.aln) for r in under(empty, "KLM")] == [("me/1-9", "KLM", None)]
    with pytest.raises(Exception):
        under(bare, "KL")


def _map(n, step=1):
    rng = random.Random(n)
    return [(k, i, j, rng.random()) for k in ("a", "b") for i in range(0, n, step) for j in range(i + 1, n, step)]


def test_symmetric_store(spark, tmp_path):
    pairs, path = _map(200, 5), str(tmp_path / "store")
    distances = spark.createDataFrame(pairs + [(k, j, i, d + 1) for k, i, j, d in pairs] + [("a", 0, 1000, None), ("a", 3, 3, 0.0)], "pdb string, i long, j long, dist double")
    residues = spark.createDataFrame([(k, i, f"{i}A") for k in "ab" for i in range(0, 200, 5)], "pdb string, idx long, id string")
    M.write_distance_map(residues, distances, path, keys=("pdb",))
    want = {(k, i, j): d for k, i, j, d in pairs} | {(k, j, i): d for k, i, j, d in pairs} | {("a", 0, 1000): None, ("a", 1000, 0): None, ("a", 3, 3): 0.0}
    rows = M.read_distances(spark, path).collect()
    assert len(rows) == len(want) and {(r.pdb, r.i, r.j): r.dist for r in rows} == want
    assert M.is_symmetric(spark, path) and sorted(M.read_residues(spark, path).collect()) == sorted(residues.collect())
    for i, j in (((10, 63), None), (None, (64, 127)), ((60, 70), (100, 130)), ((150, 199), (0, 20)), ((10, 40), (20, 60))):
        found = M.read_distances(spark, path, i, j)
        inside = {k: d for k, d in want.items() if (not i or i[0] <= k[1] <= i[1]) and (not j or j[0] <= k[2] <= j[1])}
        rows = found.collect()
        assert len(rows) == len(inside) and {(r.pdb, r.i, r.j): r.dist for r in rows} == inside
    M.write_distance_map(residues, distances.limit(0), path, keys=("pdb",))
    assert M.read_residues(spark, path).count() == 80


def test_ranges_prune_tiles(spark, tmp_path):
    path = str(tmp_path / "store")
    distances = spark.createDataFrame(_map(400, 10), "pdb string, i long, j long, dist double")
    M.write_distance_map(distances.select("pdb", F.col("i").alias("idx")).distinct(), distances, path, keys=("pdb",))
    found = M.read_distances(spark, path, (0, 63), (320, 383))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(ti") == 2 and "ti#" in plan and "tj#" in plan
    files = {r.f for r in found.select(F.regexp_extract(F.input_file_name(), "(ti=.*)/", 1).alias("f")).collect()}
    assert files == {"ti=0/tj=5"}


def test_asymmetric_store_and_text(spark, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "text")
    distances = spark.createDataFrame([(0, 1, 2.5), (1, 0, 3.5), (70, 0, None)], "i long, j long, dist double")
    residues = spark.createDataFrame([(0, "i"), (1, "i"), (70, "i"), (0, "j"), (1, "j")], "idx long, axis string")
    M.write_distance_map(residues, distances, path)
    assert not M.is_symmetric(spark, path)
    assert sorted(map(tuple, M.read_distances(spark, path).collect())) == [(0, 1, 2.5), (1, 0, 3.5), (70, 0, None)]
    assert [tuple(r) for r in M.read_distances(spark, path, i=(1, 69)).collect()] == [(1, 0, 3.5)]
    M.export_distance_map(spark, path, out)
    again = spark.read.schema("i long, j long, dist double").csv(f"{out}/distances", header=True)
    assert sorted(map(tuple, again.collect())) == [(0, 1, 2.5), (1, 0, 3.5), (70, 0, None)]
    assert spark.read.csv(f"{out}/residues", header=True).columns == ["idx", "axis"]


def test_matrix_files(spark, tmp_path):
    matrix = np.random.default_rng(1).random((130, 70)).astype("float32")
    matrix[3, 4] = np.nan
    np.save(tmp_path / "m.npy", matrix)
    (tmp_path / "m.csv").write_text(",id,axis\n" + "".join(f"{k + 7},r{k},i\n" for k in range(130)) + "".join(f"{k},c{k},j\n" for k in range(70)))
    got = {(r.i, r.j): r.dist for r in M.read_matrix_files(spark, str(tmp_path / "*.npy")).collect()}
    assert len(got) == matrix.size and got[3, 4] is None
    assert all(got[i, j] == float(matrix[i, j]) for i in range(130) for j in range(70) if (i, j) != (3, 4))
    sites = {(r.axis, r.idx): r.id for r in M.read_residue_files(spark, str(tmp_path / "m.csv")).collect()}
    assert sites == {("i", k): f"r{k}" for k in range(130)} | {("j", k): f"c{k}" for k in range(70)}


def test_running_totals_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS", 50)
    rng = random.Random(2)
    data = [(k, rng.choice([None, 1.0, 1.0, 1.0, rng.random() * 9]), rng.choice([None, 1, 2, 5])) for k in range(1000)]
    rows = spark.createDataFrame(data, "k int, score double, v int")
    for descending in (True, False):
        out = running.running_totals(rows, "score", ["k"], {"total": F.col("v"), "n": F.lit(1)}, descending)
        sign = -1 if descending else 1
        total, want = 0, {}
        for n, (k, s, v) in enumerate(sorted(data, key=lambda r: (r[1] is None, (r[1] or 0) * sign, r[0])), 1):
            total += v or 0
            want[k] = (total, n)
        assert {r.k: (r.total, r.n) for r in out.collect()} == want
        assert out.columns == ["k", "score", "v", "total", "n"]
    sizes = running.stored(rows.repartitionByRange(20, F.col("score").asc_nulls_last(), "k").withColumn("p", F.spark_partition_id())).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 200  # 600 rows share one score
    assert running.running_totals(rows.limit(0), "score", ["k"], {"n": F.lit(1)}).count() == 0


def test_long_maps_make_few_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    pairs = [("a", 97 * k, 97 * m, float(k + m)) for k in range(100) for m in range(k + 1, 100)]
    distances = spark.createDataFrame([*pairs, ("a", 97, 0, 0.5), ("a", 0, 97, None)], "pdb string, i long, j long, dist double")
    residues = spark.createDataFrame([("a", 97 * k) for k in range(100)], "pdb string, idx long")
    M.write_distance_map(residues, distances, path, keys=("pdb",))
    assert len(list((tmp_path / "store" / "distances").glob("t*/t*"))) <= M.AXIS * (M.AXIS + 1) // 2
    want = {(i, j): d for _, i, j, d in pairs} | {(0, 97): 0.5}
    want |= {(j, i): d for (i, j), d in want.items()}
    assert {(r.i, r.j): r.dist for r in M.read_distances(spark, path).collect()} == want
    found = {(r.i, r.j): r.dist for r in M.read_distances(spark, path, (300, 2000), (5000, 9000)).collect()}
    assert found == {k: d for k, d in want.items() if 300 <= k[0] <= 2000 and 5000 <= k[1] <= 9000}
    assert M.read_distances(spark, path).columns == ["pdb", "i", "j", "dist"]


def test_maps_stored_in_shares(spark, monkeypatch, tmp_path):
    """Pairs are written where they are made, in stores of bounded size that go once they are read."""
    made, write = [], M.write_distance_map

    def seen(residues, distances, path, **kw):
        write(residues, distances, path, **kw)
        plan = distances._jdf.queryExecution().executedPlan().toString()
        made.append((path, spark.read.parquet(f"{path}/distances").count(), plan.split("MapInArrow")[0].count("Exchange")))

    monkeypatch.setattr(M, "write_distance_map", seen)
    monkeypatch.setattr(M, "PAIRS", 4000)
    monkeypatch.setattr(M, "ROWS", 1000)
    monkeypatch.setattr(tiles, "LEAST", 16)
    monkeypatch.setattr(tiles, "RUN", 8)
    rng = np.random.default_rng(4)
    vectors = [(k, [float(v) for v in rng.normal(size=6)], k % 3) for k in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.chain, r.ti, r.tj): (r.n, r.least, r.most) for r in stage_queries.stored_maps(spark, str(tmp_path)).collect()}
    want = {}
    at = {k: np.array(v, "float32").astype(float).reshape(2, 3) for k, v, _ in vectors}
    for i, _, chain in vectors:
        for j in range(chain, 400, 3):
            if i != j:
                want.setdefault((chain, i // 64, j // 64), []).append(min(np.sqrt(((a - b) ** 2).sum()) for a in at[i] for b in at[j]))
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(got[k][1] - min(v)) < 1e-6 and abs(got[k][2] - max(v)) < 1e-6 for k, v in want.items())
    assert len(made) == 7 and sum(n for _, n, _ in made) == sum(len(v) for v in want.values()) // 2 and max(n for _, n, _ in made) < 8000
    assert not any(os.path.exists(path.removeprefix("file:")) for path, _, _ in made) and not any(e for _, _, e in made)
