"""Phrase collocation mining with vertical positional inverted lists.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
those into words ``[^\\x20\\x09]+``; all counts are by language.  A phrase of 2 to
``LONGEST`` words is a candidate if it occurs ``LEAST`` times within pieces,
overlaps included; it is scored at its weakest cut.

Method, level by level:

1. A task cuts its texts into blocks of some MB of whole pieces.  A block has a
   list of positions for each of its words; positions of a piece follow each
   other, between pieces one is left out.  The list's length is the word's
   frequency in the block; summed over blocks it is exact.
2. Frequent words and phrases get an id that is unique everywhere: the block and
   number of their first list.  A block learns the ids of its lists by a
   co-group on the block; lists that are not frequent are dropped.
3. A block's lists of phrases of k words are merge-joined with the postings of
   the adjacent word, k positions on.  An extension is kept where the k words
   from the next position on are frequent too.  What is left are the lists of
   phrases of k + 1 words, which are counted as in step 1.

Between levels a block travels as one row of packed lists.  Counts of a block's
phrases travel to buckets by a hash of the phrase, those for one bucket as one
packed value; the number of buckets follows the corpus.  Nothing is sent to all
tasks, and no phrase has more counts than there are blocks.  Ids stand for words and phrases exactly;
no hash decides.  Scores are whole numbers of up to 38 digits.

Defined results: a null text is empty, a null language is ``und``; a text
without words counts nothing; rows that come twice count twice; a text of any
length is taken whole (cut at pieces, so that blocks stay small); scores that
tie go by frequency, then by phrase; an empty table gives no row; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, lean_workers, stash
from .windows import mix, pieces

LEAST = 100
LONGEST = 5
TOP = 2000
NO_LANGUAGE = "und"
#: Text of a block.
BLOCK_BYTES = 8 << 20
#: An id has the partition, the block in it and the list in that: 20, 19 and 24 bits.
_BLOCKS, _LISTS = 19, 24
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_PIECES = bytes.maketrans(_SEPARATORS, b"\n" * len(_SEPARATORS))
WORDS = "block long, idx int, lang string, word string, n long, lengths binary, positions binary"
PHRASES = "block long, bucket int, counts binary, word_at binary, word_id binary, lengths binary, positions binary"
KNOWN = "block long, ids binary, id long, prefix long, last long, f long"
#: Word occurrences for each bucket of phrases; there are no more phrases than that.
BUCKET_WORDS = 500_000
_COUNT = np.dtype([("idx", np.int32), ("prefix", np.int64), ("last", np.int64), ("n", np.int32)])
_ID = np.dtype([("idx", np.int32), ("id", np.int64)])


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def lists(idx: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and positions of ``n`` lists, of occurrences in order of position."""
    return np.bincount(idx, minlength=n).astype(np.int32), at[np.argsort(idx, kind="stable")].astype(np.int32)


def occurrences(lengths: bytes, positions: bytes, idx: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order, and the id of the list that holds each, of the lists that have one."""
    n, at = unpacked(lengths, np.int32), unpacked(positions, np.int32)
    of = np.full(len(n), -1, np.int64)
    of[idx] = ids
    found = np.repeat(of, n)
    at, found = at[found >= 0], found[found >= 0]
    order = np.argsort(at)
    return at[order], found[order]


def adjacent(at: np.ndarray, postings: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-joins positions with those ``ahead`` of them: which have one, and where it is in ``postings``."""
    place = np.minimum(np.searchsorted(postings, at + ahead), max(0, len(postings) - 1))
    return (postings[place] == at + ahead) if len(postings) else np.zeros(len(at), bool), place


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text with pieces as lines, in parts of about ``size`` bytes that end with a piece."""
    text = text.lower().translate(_PIECES)
    start = 0
    while len(text) - start > size:
        end = text.rfind(b"\n", start, start + size)
        end = end if end > start else text.find(b"\n", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def block_table(block: int, words: list[tuple[str, bytes]], idx: list[int], sizes: list[int]) -> pa.RecordBatch:
    """A block's words with their frequencies, and one row with their lists."""
    at = np.arange(len(idx)) + np.repeat(np.arange(len(sizes)), sizes)
    lengths, positions = lists(np.array(idx, np.int64), at, len(words))
    n = len(words)
    columns = [
        pa.array([block] * (n + 1), pa.int64()),
        pa.array([*range(n), None], pa.int32()),
        pa.array([*(lang for lang, _ in words), None], pa.string()),
        pa.array([*(w for _, w in words), None], pa.binary()).cast(pa.string()),
        pa.array([*lengths.tolist(), None], pa.int64()),
        pa.array([None] * n + [packed(lengths)], pa.binary()),
        pa.array([None] * n + [packed(positions)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WORDS.split(", ")])


def word_lists(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each word of each block with its frequency there, and one with the block's lists, of ``text, lang``."""

    def run(batches):
        partition, number = TaskContext.get().partitionId(), count()

        def made():
            k = next(number)
            if partition >> (63 - _BLOCKS - _LISTS) or k >> _BLOCKS:
                raise ValueError("too many blocks for their ids")
            words = sorted((i, lang, w) for lang, v in vocabulary.items() for w, i in v.items())
            return block_table(partition << _BLOCKS | k, [(lang, w) for _, lang, w in words], idx, sizes)

        def fresh():
            new = count().__next__
            return defaultdict(lambda: defaultdict(new)), [], [], 0

        vocabulary, idx, sizes, size = fresh()
        for batch in batches:
            for texts, langs in pieces(batch):
                for text, lang in zip(texts, langs):
                    known = vocabulary[lang.decode()]
                    for part in parts(text, block_bytes):
                        for piece in part.split(b"\n"):
                            words = piece.split()
                            if words:
                                sizes.append(len(words))
                                idx.extend(map(known.__getitem__, words))
                        size += len(part)
                        if size >= block_bytes:
                            if idx:
                                yield made()
                            vocabulary, idx, sizes, size = fresh()
                            known = vocabulary[lang.decode()]
        if idx:
            yield made()

    rows = docs.select(F.coalesce("text", F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)))
    return rows.mapInArrow(run, WORDS)


def frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """``block, idx, id, f, first`` and the key of lists whose phrase occurs ``least`` times in all blocks; ``first``: one of its lists, that the id comes from."""
    own = F.shiftleft("block", _LISTS).bitwiseOR(F.col("idx").cast("long"))
    same = Window.partitionBy(*key)
    found = rows.where("idx IS NOT NULL").select("block", "idx", *key, F.sum("n").over(same).alias("f"), F.min(own).over(same).alias("id"), own.alias("own"))
    return found.where(F.col("f") >= least).select("block", "idx", *key, "f", "id", (F.col("own") == F.col("id")).alias("first"))


def columnar(rows: np.ndarray) -> bytes:
    """A structured array packed by columns."""
    return zstandard.compress(b"".join(rows[c].tobytes() for c in rows.dtype.names), 1)


def rowwise(data: bytes, kind: np.dtype) -> np.ndarray:
    data, at = zstandard.decompress(data), 0
    rows = np.empty(len(data) // kind.itemsize, kind)
    for c in kind.names:
        rows[c] = np.frombuffer(data, kind[c], len(rows), at)
        at += rows[c].nbytes
    return rows


def _table(schema: str, kinds: list[pa.DataType], columns: dict[str, list]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    size = max(map(len, columns.values()), default=0)
    return pa.table([pa.array(columns.get(c, [None] * size), kind) for c, kind in zip(names, kinds)], names=names)


def extended(k: int, last: bool, n_buckets: int):
    """Lists of phrases of ``k + 1`` words, from a block's lists of those of ``k``; their counts by bucket."""
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def run(key: tuple[pa.Scalar, ...], block: pa.Table, known: pa.Table) -> pa.Table:
        if not block.num_rows or not known.num_rows:
            return _table(PHRASES, kinds, {})
        row = {c: v[0] for c, v in block.to_pydict().items()}
        if k == 1:
            at, ids = occurrences(row["lengths"], row["positions"], known["idx"].to_numpy(), known["id"].to_numpy())
            word_at, word_id = at, ids
        else:
            named = np.concatenate([rowwise(v, _ID) for v in known["ids"].to_pylist()])
            at, ids = occurrences(row["lengths"], row["positions"], named["idx"], named["id"])
            word_at, word_id = unpacked(row["word_at"], np.int32), unpacked(row["word_id"], np.int64)
        has_word, place = adjacent(at, word_at, k)
        keep = has_word & adjacent(at, at, 1)[0]
        prefixes, code = np.unique(ids[keep], return_inverse=True)
        words, w = np.unique(word_id[place[keep]], return_inverse=True)
        at, code = at[keep], code << 32 | w
        del ids, place, has_word, keep, w  # a block has millions of positions
        pairs, idx = np.unique(code, return_inverse=True)
        n = len(pairs)
        if not n:
            return _table(PHRASES, kinds, {})
        lengths, positions = lists(idx.astype(np.int32), at, n)
        del at, code, idx
        counts = np.empty(n, _COUNT)
        counts["idx"], counts["prefix"], counts["last"], counts["n"] = np.arange(n), prefixes[pairs >> 32], words[pairs & 0xFFFFFFFF], lengths
        bucket = (mix(counts["prefix"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts["last"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        block_id = key[0].as_py()
        out = _table(PHRASES, kinds, {"block": [block_id] * len(found), "bucket": found.tolist(), "counts": [columnar(counts[i]) for i in np.split(order, start[1:])]})
        if last:
            return out
        state = {c: [packed(v)] for c, v in (("word_at", word_at), ("word_id", word_id), ("lengths", lengths), ("positions", positions))}
        return pa.concat_tables([out, _table(PHRASES, kinds, {"block": [block_id], **state})])

    return run


def summed(least: int):
    """Of a bucket's counts: the phrases that occur ``least`` times, and for each block the ids of its lists of them."""
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def run(bucket: pa.Table) -> pa.Table:
        parts = [rowwise(v, _COUNT) for v in bucket["counts"].to_pylist()]
        block = np.repeat(bucket["block"].to_numpy(), list(map(len, parts)))
        rows = np.concatenate(parts)
        own = block << _LISTS | rows["idx"]
        order = np.lexsort((own, rows["last"], rows["prefix"]))
        rows, own, block = rows[order], own[order], block[order]
        new = np.r_[True, (rows["prefix"][1:] != rows["prefix"][:-1]) | (rows["last"][1:] != rows["last"][:-1])]
        first = np.flatnonzero(new)
        f = np.add.reduceat(rows["n"].astype(np.int64), first)
        enough = f >= least
        phrases = rows[first[enough]]
        keep = enough[np.cumsum(new) - 1]
        named = np.empty(int(keep.sum()), _ID)
        named["idx"], named["id"], block = rows["idx"][keep], own[first][np.cumsum(new) - 1][keep], block[keep]
        order = np.argsort(block, kind="stable")
        blocks, start = np.unique(block[order], return_index=True)
        by_block = {"block": blocks.tolist(), "ids": [columnar(named[i]) for i in np.split(order, start[1:])] if len(blocks) else []}
        counted = {"id": own[first[enough]].tolist(), "prefix": phrases["prefix"].tolist(), "last": phrases["last"].tolist(), "f": f[enough].tolist()}
        return pa.concat_tables([_table(KNOWN, kinds, by_block), _table(KNOWN, kinds, counted)])

    return run


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` of the words and phrases that occur ``least`` times, and ``lang, n``, all word occurrences."""
    rows = stash(word_lists(docs, block_bytes), "words", "zstd")
    totals = stash(rows.where("idx IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = stash(frequent(rows, ["lang", "word"], least), "frequent-1", "zstd")
    words = stash(found.where("first").select("id", "lang", "word", "f"), "frequent-words", "zstd")
    level = words.select("id", "lang", F.array("word").alias("words"), "f")
    words = words.select(F.col("id").alias("last"), "word")
    n_buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS
    every = [level]
    state, known = rows.where("idx IS NULL").select("block", "lengths", "positions"), found.select("block", "idx", "id")
    for k in range(1, longest):
        final = k + 1 == longest
        longer = state.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(extended(k, final, n_buckets), PHRASES)
        longer = stash(longer, f"lists-{k + 1}")
        discard(rows, found)
        counts = longer.where("bucket IS NOT NULL").select("bucket", "block", "counts")
        rows, found = longer, stash(counts.groupBy("bucket").applyInArrow(summed(least), KNOWN), f"frequent-{k + 1}")
        before = level.select(F.col("id").alias("prefix"), "lang", "words")
        level = found.where("block IS NULL").select("id", "prefix", "last", "f").join(before, "prefix").join(words, "last")
        level = stash(level.select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f"), f"phrases-{k + 1}", "zstd")
        every.append(level)
        state, known = rows.where("bucket IS NULL").drop("bucket", "counts"), found.where("block IS NOT NULL").select("block", "ids")
    discard(rows, found)
    return reduce(DataFrame.union, every).select("lang", "words", "f"), totals


def scored(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates ``lang, phrase, words, a, l, r, n, score``, scored at the cut with the least score, the first of several."""
    known = counted.select("lang", F.array_join("words", " ").alias("part"), F.col("f"))
    own = counted.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))
    cut = own.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    left = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")
    cut = cut.withColumns({"left": left, "right": right}).join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(totals.select("lang", F.col("n").cast("long").alias("n")), "lang")
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "anlr"}
    score = F.expr(f"CAST((CAST(1000 AS DECIMAL(4, 0)) * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']}) AS BIGINT)")
    cut = cut.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "words", "a", "n").alias("at"))
    return cut.groupBy("lang", "phrase").agg(F.min("at").alias("at")).select("lang", "phrase", "at.words", "at.a", "at.l", "at.r", "at.n", "at.score")


def not_inside(candidates: DataFrame) -> DataFrame:
    """Candidates without a longer one that holds their words and occurs as often."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inside = candidates.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    counted, totals = phrases(documents(spark, sf_dir).select("text", "lang"))
    return ranked(not_inside(stash(scored(counted, totals), "scored")))


QUERIES = {"op12_collocations": op12_collocations}

#: All phrases of one to five words, counted.
ORACLE_SQL = {
    "op12_collocations": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT lang, m, p, f AS a, k, string_split(p, ' ') AS ws FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scores AS (
  SELECT c.lang, c.p, c.m, c.a, k, l.f AS l, r.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(ws[k + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
alone AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = b.lang AND x.m > b.m AND 100 * x.f >= 100 * b.a AND contains(' ' || x.p || ' ', ' ' || b.p || ' '))),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM alone)
SELECT lang, rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM top WHERE rank <= 2000
"""
}
