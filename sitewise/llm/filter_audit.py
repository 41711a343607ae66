"""Audit of how filters interact: what each removes in every order, from joint-failure counts.

Five filters judge a document (words are maximal runs of ``[^\\x20\\x09-\\x0D]``):
A fewer than 200 words; B fewer than half as many distinct words as words; C
over 3 % of the code points in A-Z; D one of ``#$%&*|``; E a text that a smaller
doc_id has too, table-wide, removed or not.

Method: for each part (language) and each set S of filters, N(S) is the number
of documents that fail all of S: the sum of the product of S's flags.  Counts
of the sets of any order of filters follow from those 32 numbers:

* survivors of T, by inclusion-exclusion (a Moebius inversion): the sum over
  subsets S of T of (-1)^|S| N(S); a filter removes the survivors of those
  before it less the survivors with it;
* failures of f alone: the survivors of all others less those of all;
* f's Shapley value over all orders: the game "documents removed by T" has the
  Harsanyi dividends (-1)^(|S|+1) N(S), of which f gets one |S|-th for each S
  that holds it; times 120 orders that is a sum of whole numbers.

Only E needs other documents.  Of the rows of one text, those of the least id
don't fail it, so failures of E are all rows less those firsts; both are sums
that tasks make before any shuffle, however many copies a text has.  Texts
travel as digests of 256 bits.

Defined results: a null text is empty, a null language the part ``''``; without
words A fails and B doesn't, without characters C doesn't; rows that repeat an
id and a text are all first; a null id is greater than any other; a document
is good (toxic) if any label row of its id says so, and without label rows
neither; texts of any length are judged whole; an empty table has no part, so
no row; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, documents, stash
from .windows import pieces

FILTERS = "ABCDE"
LEAST_WORDS = 200
KINDS = ("n", "good", "toxic")
#: Parts that documents without an id are dealt to.
SPREAD = 256
FACTS = "_key long, part string, digest binary, fails int"
_SPECIAL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def fails(text: bytes) -> int:
    """Bit k is set if the text fails filter k of ABCD."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | bool(_SPECIAL.search(text)) << 3


def facts(docs: DataFrame) -> DataFrame:
    """``_key, part, digest, fails`` of each row of ``doc_id, text, lang``."""

    def judge(batches):
        for batch in batches:
            for keys, parts, texts in pieces(batch):
                columns = (keys, [p.decode() for p in parts], [hashlib.sha256(t).digest() for t in texts], list(map(fails, texts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.int32()))], names=["_key", "part", "digest", "fails"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("_key"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, FACTS)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``_key, part, digest, fails, n, good, toxic``: counts of rows that agree in the first four."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_key"))
    known = known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).withColumn("salt", F.lit(0))
    salt = F.when(F.col("_key") == NO_ID, 1 + F.pmod(F.hash("digest"), F.lit(SPREAD))).otherwise(0)
    both = rows.withColumn("salt", salt).join(known, ["_key", "salt"], "left")
    sums = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in KINDS[1:])]
    return both.groupBy("_key", "salt", "digest", "part", "fails").agg(*sums).drop("salt")


def patterns(rows: DataFrame) -> DataFrame:
    """``part, fails, n, good, toxic``: documents by exactly which filters they fail, E included as the last bit; ``rows`` as of ``labelled``."""
    last = 1 << (len(FILTERS) - 1)
    sums = [F.sum(c).alias(c) for c in KINDS]
    total = rows.groupBy("part", "fails").agg(*sums)
    same_id = rows.groupBy("digest", "fails", "_key").agg(F.collect_list(F.struct("part", *KINDS)).alias("rows"))  # as many as a document has languages
    first = same_id.groupBy("digest", "fails").agg(F.min_by("rows", "_key").alias("rows")).select("fails", F.inline("rows")).groupBy("part", "fails").agg(*sums)
    repeat = F.col("fails").bitwiseOR(F.lit(last)).alias("fails")
    later = total.select("part", repeat, *KINDS).union(first.select("part", repeat, *(-F.col(c) for c in KINDS)))
    return first.select("part", "fails", *KINDS).union(later).groupBy("part", "fails").agg(*sums)


def joint_failures(found: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """A row per ``part`` with, for each of ``n, good, toxic``, the array of N(S) by the bits of S."""
    fails = lambda s: F.when(F.col("fails").bitwiseAND(F.lit(s)) == s, 1).otherwise(0)  # noqa: E731  the product of the flags of S
    return found.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(fails(s) * F.col(c)), F.lit(0)).cast("long") for s in range(1 << n_filters))).alias(c) for c in KINDS))


def _signed(joint: Column, s: int) -> Column:
    return F.element_at(joint, s + 1) * (-1) ** s.bit_count()


def survivors(joint: Column, n_filters: int) -> Column:
    """By the bits of T, how many pass all of T."""
    return F.array(*(sum((_signed(joint, s) for s in range(1, t + 1) if s & t == s), F.element_at(joint, 1)) for t in range(1 << n_filters)))


def shapley(joint: Column, n_filters: int) -> Column:
    """By filter, its removals summed over all orders."""
    orders = factorial(n_filters)
    return F.array(*(sum((-_signed(joint, s) * (orders // s.bit_count()) for s in range(1 << n_filters) if s >> f & 1), F.lit(0).cast("long")) for f in range(n_filters)))


def audit(found: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; ``found`` as of ``patterns``."""
    k, every = len(names), (1 << len(names)) - 1
    joint = joint_failures(found, k)
    parts = joint.select("part", *(survivors(F.col(c), k).alias(f"pass_{c}") for c in KINDS), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.element_at("n", F.call_function("shiftleft", F.lit(1), f) + 1)).alias("failed"), shapley(F.col("n"), k).alias("shapley"))
    steps = [("".join(order), i + 1, f := names.index(order[i]), before := sum(1 << names.index(o) for o in order[:i]), before | 1 << f) for order in permutations(names) for i in range(k)]
    orders = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("filter_order", "step", "f", "before", "after"), step))) for step in steps))
    rows = parts.withColumn("o", F.explode(orders)).select("*", "o.*")
    at = lambda c, t: F.element_at(f"pass_{c}", t + 1)
    removed = {c: at(c, F.col("before")) - at(c, F.col("after")) for c in KINDS}
    others = F.lit(every) - F.call_function("shiftleft", F.lit(1), F.col("f"))
    return rows.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed["n"].alias("removed"), (F.element_at("failed", F.col("f") + 1) - removed["n"]).alias("redundant"),
        (at("n", others) - at("n", F.lit(every))).alias("unique_fails"), removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), F.element_at("shapley", F.col("f") + 1).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = stash(labelled(facts(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")), "facts")
    return audit(patterns(rows))


QUERIES = {"op13_filter_audit": op13_filter_audit}

#: Every order is walked through, filter by filter.
ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS d FROM w GROUP BY t),
flags AS (
  SELECT doc_id, part, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > d} AS f
  FROM w JOIN firsts USING (t)),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
pat AS (
  SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flags LEFT JOIN l USING (doc_id) GROUP BY ALL),
failing AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fs, n, good, toxic FROM pat),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, i AS step, o[i] AS f FROM orders, range(1, 6) r(i)),
done AS (
  SELECT o, fs, min(i) AS at FROM orders, (SELECT DISTINCT fs FROM failing) p, range(1, 6) r(i) WHERE contains(fs, o[i]) GROUP BY o, fs),
counted AS (
  SELECT p.part, s.o, s.step, s.f,
    sum(CASE WHEN coalesce(d.at, 9) > s.step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN d.at = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN d.at < s.step AND contains(p.fs, s.f) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN p.fs = s.f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN d.at = s.step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN d.at = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM failing p CROSS JOIN steps s LEFT JOIN done d ON d.o = s.o AND d.fs = p.fs GROUP BY p.part, s.o, s.step, s.f)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
}
