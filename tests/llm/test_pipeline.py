import random

from pyspark.sql import functions as F

import corpus_pipeline
from sitewise.llm import language_id
from test_line_dedup import brute as brute_lines
from test_packing import check as check_pieces
from test_simhash_dedup import brute_components, brute_fingerprint
from test_suffix_dedup import brute as brute_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"en": "the cat sat upon that mat with this hat and then".split(), "de": "der hund läuft über die straße nach hause und".split()}

    def line(lang, n=12):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", str(rng.randrange(60))]) for _ in range(n))

    passage = {lang: line(lang, 40) for lang in words}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        lines = [line(lang) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            lines.append(line(lang, 3) + " " + passage[lang] + " " + line(lang, 25))
        rows.append((i, "\n".join(lines), lang, "s", 1))
    rows += [(60 + i, rows[i][1], rows[i][2], "t", 1) for i in range(8)]
    rows += [(70 + i, rows[20 + i][1] + f" tail{i}", None, "t", 1) for i in range(5)]
    return rows + [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "12 34 !", "en", "s", 7), (93, "the cat\nthe cat", None, "s", 1)]


def text_rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "suffix_dedup", "best_fit_packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, tables[-1], "")
        tables.append(spark.createDataFrame(made.collect(), made.schema))
    assert all(t.columns == COLUMNS for t in tables[:-1])
    told = {r._row.doc_id for r in language_id.identify(docs).collect() if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE}
    assert text_rows(tables[1]) == sorted((i, t) for i, t, *_ in corpus() if i in told)
    assert not told & {90, 91, 92} and 93 in told
    before = text_rows(tables[1])
    assert text_rows(tables[2]) == sorted((k, v[2]) for (k, _), v in brute_lines(before).items())
    before = text_rows(tables[2])
    roots = brute_components([brute_fingerprint(t) for _, t in before])
    firsts = {r: before[[i for i, x in enumerate(roots) if x == r][0]] for r in roots}
    assert text_rows(tables[3]) == sorted(firsts.values())
    before = text_rows(tables[3])
    assert text_rows(tables[4]) == sorted((k, v[3].decode("utf-8", "ignore")) for (k, _), v in brute_bytes(before, 100).items())
    assert all(r.n_chars == len(r.text) for r in tables[4].collect())
    check_pieces(tables[5].collect(), text_rows(tables[4]))


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_repeated_ids_nulls_and_other_columns(spark):
    """Null and repeated ids, and columns that have an operator's own names."""
    rng = random.Random(1)
    english = lambda n: " ".join(rng.choice("the cat sat upon that mat with this hat and then".split()) + rng.choice(["", str(rng.randrange(90))]) for _ in range(n))
    rows = [(i, english(30), "en", i) for i in range(20)]
    rows += [rows[3], (4, english(30), "en", 99), (None, english(30), "en", 5), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, line long").withColumns({c: F.col("line") for c in ("at", "fp", "token", "kept", "score", "start")})
    tables = [frame]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, tables[-1], "")
        tables.append(spark.createDataFrame(made.collect(), made.schema))
        if name != "best_fit_packing":
            assert tables[-1].columns == frame.columns
    assert tables[1].count() == len(rows) - 1  # the null text goes
    assert tables[3].count() == len(rows) - 2  # and one of the row that comes twice
    assert all(r.at == r.line == r.score for r in tables[4].collect())
    assert {r.doc_id for r in tables[5].collect()} == {None, *range(20)}
