import random
import zlib

import numpy as np

from sitewise.llm import language_id as m

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"aa": "the cat sat upon that mat with this hat".split(), "bb": "der hund läuft über die straße nach hause".split(), "cc": "le chat été sur la île où ça".split()}


def corpus(n=240):
    rng = random.Random(0)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, None) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def reference(rows):
    """Counts by n-gram bucket and log posteriors, one document after another."""
    learned = [(t, lang) for i, t, lang, _ in rows if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({lang for _, lang in learned})
    counts = {lang: np.full(m.BUCKETS, m.SMOOTHING) for lang in langs}
    for text, lang in learned:
        for b in m.grams(text):
            counts[lang][b] += 1
    prior = np.log([sum(lang == x for _, x in learned) / len(learned) for lang in langs])
    out = []
    for _, text, _, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        b = m.grams(text)
        logits = prior + [np.log(counts[lang] / counts[lang].sum())[b].sum() * min(1, m.EVIDENCE / len(b)) for lang in langs]
        p = np.exp(logits - logits.max())
        out.append((langs[int(p.argmax())], p.max() / p.sum()))
    return out


def test_against_reference(spark):
    rows = corpus() + [(300, None, "aa", "x"), (301, "", "bb", None), (302, "123 !?", None, None), (None, "the cat", "aa", None), (5, corpus()[5][1], None, None), (304, "der " * 3000, None, None)]
    got = m.identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want: dict = {}
    for (i, text, *_), (name, score) in zip(rows, reference(rows)):
        want[i, text] = (name, score)
    assert len(got) == len(rows)
    for r in got:
        name, score = want[r._row.doc_id, r._text]
        assert r.lang_pred == name and abs(r.score - score) < 1e-4
        assert 0 <= r.score <= 1


def test_held_out_accuracy(spark):
    rows = corpus()
    got = m.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    apart = [r for r in got if zlib.crc32(str(r._row.doc_id).encode()) % 3 == 1]
    assert len(apart) > 40 and sum(r.lang_pred == r._row.lang for r in apart) / len(apart) > 0.98


def test_bounded_sample(spark):
    rows = corpus()
    model = m.learn(spark.createDataFrame(rows, SCHEMA), per_language=20)
    assert model.languages == ["aa", "bb", "cc"] and model.log_likelihood.shape == (m.BUCKETS, 3)


def test_accepted_keeps_columns(spark):
    frame = spark.createDataFrame([*corpus(60), (99, "77", "aa", "x")], SCHEMA)
    kept = m.accepted(m.identify(frame), frame.columns)
    assert kept.columns == frame.columns and kept.count() == 60


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in m.identify(frame).collect()] == [("und", 0.0)]
    assert m.identify(frame.limit(0)).count() == 0


def test_grams():
    assert len(m.grams("abcd")) == 4 + 3 + 2 and len(m.grams("")) == 0 and len(m.grams("é")) == 1
    assert (m.grams("ABC") == m.grams("abc")).all()
