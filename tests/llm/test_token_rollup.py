import os
from collections import Counter

import pytest
from tokenizers import Tokenizer

from sitewise.llm import token_rollup as m
from sitewise.llm.bpe_codec import VOCABULARY

DATA = "/root/testdata/sf0.001"
CHANGES = "sign int, source string, lang string, text string, n_tokens string"
LIBRARY = Tokenizer.from_file(VOCABULARY)


def count(version, text):
    text = text or ""
    return len(text.split(" ")) if version == "words-1" and text else 0 if version == "words-1" else len(LIBRARY.encode(text, add_special_tokens=False).ids)


def brute(rows):
    docs, tokens = Counter(), Counter()
    for sign, source, lang, text, _ in rows:
        for version in m.VERSIONS:
            docs[source, lang, version] += sign or 0
            tokens[source, lang, version] += (sign or 0) * count(version, text)
    return {(*k, docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}


def totals(rollup):
    return {tuple(r) for r in rollup.totals().collect()}


LOAD = [(1, "a", "en", "some words here", "x"), (1, "a", "en", "some words here", "x"), (1, None, None, None, None), (1, "b", "de", "", None), (1, "b", "de", "eins zwei", None), (None, "c", "de", "never", None)]
CHANGE = [(-1, "a", "en", "some words here", None), (-1, "b", "de", "eins zwei", None), (1, "b", "de", "eins zwei drei", None)]


@pytest.fixture
def rollup(spark, tmp_path):
    return m.Rollup(spark, str(tmp_path / "rollup"))


def changes(spark, rows, versions=None):
    """Counted rows with their signs, some of the columns' names being the operator's own."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, " + CHANGES)
    found = m.counted(frame, versions)
    return found.join(frame.select("doc_id", "sign"), "doc_id")


def test_batches(spark, rollup):
    assert totals(rollup) == set()
    assert rollup.commit("one", changes(spark, LOAD))
    assert totals(rollup) == brute(LOAD)
    assert rollup.commit("two", changes(spark, CHANGE))
    assert totals(rollup) == brute(LOAD + CHANGE)
    assert not rollup.commit("one", changes(spark, LOAD)) and not rollup.commit("two", changes(spark, CHANGE))
    assert rollup.commit("empty", changes(spark, []))
    again = m.Rollup(spark, rollup.root)
    assert totals(again) == brute(LOAD + CHANGE)
    assert again.commit("undo", changes(spark, [(-(r[0] or 0), *r[1:]) for r in LOAD + CHANGE]))
    assert totals(again) == set()


def test_unfinished_and_raced_attempts(spark, rollup):
    m.deltas(changes(spark, LOAD)).write.parquet(f"{rollup.root}/deltas-zz")
    assert totals(rollup) == set()
    rollup.commit("one", changes(spark, LOAD))
    rollup._append([("one", "zz")], m.LEDGER, "ledger")
    assert totals(rollup) == brute(LOAD)


def test_snapshots(spark, rollup, monkeypatch):
    rollup.fold()
    assert totals(rollup) == set()
    rollup.commit("one", changes(spark, LOAD))
    rollup.fold()
    assert totals(rollup) == brute(LOAD)
    rollup.commit("two", changes(spark, CHANGE))
    with monkeypatch.context() as c:  # a writer that dies with its tables written and not named
        c.setattr(m.Rollup, "_publish", lambda *_: None)
        rollup.fold()
    assert totals(rollup) == brute(LOAD + CHANGE)
    rollup.fold()
    at = rollup.snapshot()
    m.deltas(changes(spark, LOAD)).write.parquet(f"{rollup.root}/totals-{at}x")  # a later racer for the same number
    rollup._publish(3, at + "x")
    assert totals(rollup) == brute(LOAD + CHANGE)
    assert not rollup.commit("one", changes(spark, LOAD))
    rollup.vacuum()
    assert totals(m.Rollup(spark, rollup.root)) == brute(LOAD + CHANGE)
    rollup.commit("three", changes(spark, LOAD))
    assert totals(rollup) == brute(LOAD + CHANGE + LOAD)


def test_new_version(spark, rollup):
    rollup.commit("one", changes(spark, LOAD[:2]))
    rollup.commit("chars", changes(spark, LOAD[:2], {"chars-1": lambda texts: list(map(len, texts))}))
    assert {(r.tokenizer_version, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} >= {("chars-1", 2, 30), ("words-1", 2, 6)}


def test_long_text(spark, rollup):
    rollup.commit("one", changes(spark, [(1, "a", "en", "word " * 400_000, None)], {"words-1": m.words}))
    assert [r.n_tokens for r in rollup.totals().collect()] == [400_000]


def test_query(spark, tmp_path):
    docs = [(1, "x y", "en", "s"), (2, "x y z", "en", "s"), (3, "bad", None, "s"), (4, None, "de", None), (5, "poor text", "en", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 1), (5, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [(1, s, g, t, None) for i, t, g, s in docs if i not in (3, 5)] + [(1, "quarantine", "en", "poor text", None)]
    assert {tuple(r) for r in m.op6_token_rollup(spark, str(tmp_path)).collect()} == brute(kept)


def test_query_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert m.op6_token_rollup(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables needed")
def test_words_against_sql(spark):
    duck = pytest.importorskip("duckdb").connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.sql(m.ORACLE_SQL["token_rollup_words"]).fetchall()
    assert want and {tuple(r) for r in m.token_rollup_words(spark, DATA).collect()} == set(want)
