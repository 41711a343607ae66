import itertools
import random
import re

import numpy as np

from sitewise.llm import quality_rules as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def test_base_counts():
    rng = random.Random(0)
    texts = ["", "\n", " a ", "é é é é", "a b c a b c\n\na b c", "x\x0by\x0cz   \xa0q", "#|<> *$% &", "l\nl\n l\nl", "a b", "a a a a", "日本 語\t語\r\n語"]
    texts += ["".join(rng.choice(["a", "b ", "é", "\n", " ", "c", "#"]) for _ in range(rng.randrange(150))) for _ in range(150)]
    for t in texts:
        assert m.base_counts(t.encode()) == brute(t), repr(t)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        chain = m.Chain(rng.normal(size=(2, len(m.FEATURES))), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(m.FEATURES)))
        emit = x @ chain.states.T

        def score(path):
            return sum(emit[t, s] for t, s in enumerate(path)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert chain.viterbi(x).astype(int).tolist() == list(best)
    assert len(chain.viterbi(np.empty((0, len(m.FEATURES))))) == 0


def test_gradient():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 5, len(m.FEATURES)))
    mask = np.arange(5) < np.array([5, 1, 3, 4])[:, None]
    y = rng.integers(0, 2, (4, 5))
    states, moves = rng.normal(size=(2, len(m.FEATURES))) / 3, rng.normal(size=(2, 2)) / 3
    _, gs, gm = m.likelihood(m.Chain(states, moves), x, mask, y)
    for target, g in ((states, gs), (moves, gm)):
        for at in np.ndindex(target.shape):
            old = target[at]
            target[at] = old + 1e-5
            up = m.likelihood(m.Chain(states, moves), x, mask, y)[0]
            target[at] = old - 1e-5
            down = m.likelihood(m.Chain(states, moves), x, mask, y)[0]
            target[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


SCHEMA = "doc_id long, text string, kept string"


def clean(rng):
    return "\n".join(" ".join(rng.choice(["river", "stone", "walks", "under", "bright", "morning", "house"]) + str(rng.randrange(20)) for _ in range(25)).capitalize() + "." for _ in range(4))


def junk(rng):
    return "\n".join(" ".join(rng.choice(["BUY", "NOW", "***", "$$$", "CLICK"]) + str(rng.randrange(30)) + "###" for _ in range(20)) for _ in range(5))


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, clean(rng) if i % 2 else junk(rng), "k") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows += [(500, None, None), (501, "", "k"), (501, " \n ", "k"), (None, clean(rng), "k"), (502, "same words here " * 60, "k")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = m.judge(frame, m.fit(frame, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r._text or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
        if r._row.doc_id is not None and r._row.doc_id < 500:
            assert r.kept == bool(r._row.doc_id % 2)
            assert len(r.boilerplate) == (0 if r.kept else 5)


def test_half_menu(spark):
    """Only the menu lines of a page are marked, though every training document is of one kind."""
    rng = random.Random(4)
    menu = lambda: "\n".join(" | ".join(rng.choice(["Home", "Shop", "Login", "Help"]) + str(rng.randrange(9)) for _ in range(9)) for _ in range(6))
    rows = [(i, clean(rng) if i % 2 else menu(), "k") for i in range(100)]
    rows += [(200, menu() + "\n" + clean(rng) + "\n" + menu(), "k"), (201, clean(rng) + "\n\n" + menu() + "\n" + clean(rng), "k")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r._row.doc_id: r for r in m.judge(frame, m.fit(frame, labels)).collect()}
    assert got[200].boilerplate == [*range(6), *range(10, 16)] and got[201].boilerplate == list(range(5, 11))
    assert 0 < got[200].content_words < got[200].n_words
    assert not got[200].kept and got[201].kept


def test_repeated_ids_train_once(spark):
    rng = random.Random(6)
    rows = [(i, clean(rng) if i % 2 else junk(rng), "k") for i in range(40)] + [(1, clean(rng), "k")] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sizes = []
    train = m.train
    try:
        m.train = lambda features, quality: sizes.append(len(features)) or train(features, quality, 2)
        m.fit(spark.createDataFrame(rows, SCHEMA), labels)
    finally:
        m.train = train
    assert sizes == [40]


def test_very_long_text(spark):
    text = "\n".join(["many words in one of the lines here."] * 50_000 + ["w" * 1_000_000])
    frame = spark.createDataFrame([(1, text, "k")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    r = m.judge(frame, m.fit(frame, labels)).first()
    assert (r.n_words, r.n_dup_lines, r.base_failed) == (400_001, 49_999, True)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "plain words " * 9 + " ".join(map(str, range(80))), None)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in m.judge(frame, m.fit(frame, labels)).collect()] == [True]
    assert m.judge(frame.limit(0), m.fit(frame, labels)).count() == 0
