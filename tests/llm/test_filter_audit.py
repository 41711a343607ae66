import random
import re
from collections import defaultdict
from itertools import permutations

from sitewise.llm import filter_audit as m

SCHEMA = "doc_id long, text string, lang string, digest string, n string"


def brute(rows, labels):
    ids = [k if k is not None else m.NO_ID for k, *_ in rows]
    least = {}
    for k, (_, t, _) in zip(ids, rows):
        least[t or ""] = min(least.get(t or "", m.NO_ID), k)
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in range(2))
    docs = defaultdict(list)
    for k, (_, t, lang) in zip(ids, rows):
        t = t or ""
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        fails = {f for f, v in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), k > least[t])) if v}
        docs[lang or ""].append((fails, k in good, k in toxic))
    out = []
    for part, mine in docs.items():
        shapley = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in mine)
                steps.append((part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in mine), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def audited(spark, rows, labels):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = m.labelled(m.facts(frame), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(map(tuple, m.audit(m.patterns(found)).collect()))


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        n = rng.choice([10, 199, 200, 201, 300])
        words = [rng.choice(["Ab", "cd", "e#", "É"] if rng.random() < 0.1 else [f"w{rng.randrange(n)}"]) for _ in range(n)]
        texts.append(" ".join(words))
    rows = [(i * 37 % 211, rng.choice(texts), rng.choice(["en", "de"])) for i in range(200)]
    labels = [(rng.randrange(220), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (2, "", None), (2, "", ""), (None, "A", "de"), (None, "A", "de"), (7, "A", "de"), (7, "A", "fr"), (7, "A", "fr"), (8, "A", "fr"), (9, "x " * 400_000, "en"), (9, "other", "en"), (10, "É" * 30 + "A", "en"), (11, "É" * 33 + "A", "en"), (None, None, None)]
    labels = [(None, 1, 1), (2, 1, 0), (2, 0, 1), (7, 1, 1), (99, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty_table(spark):
    assert audited(spark, [], []) == []


def test_one_filter_alone_and_dividends(spark):
    """Shapley values of all filters add up to what all of them remove, in each of 120 orders."""
    rows = [(i, "w " * (i % 5 * 100) + "#" * (i % 2), "en") for i in range(50)]
    got = audited(spark, rows, [])
    order = [r for r in got if r[1] == "ABCDE"]
    assert sum(r[-1] for r in order) == 120 * sum(r[4] for r in order)
