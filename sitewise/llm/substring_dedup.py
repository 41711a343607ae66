"""Substring dedup: words inside a window of words that occurs in an earlier document are removed.

Words are runs of bytes other than ASCII white space.  A word goes if a window
of ``window`` words that covers it also starts in a document of smaller id.
Windows are judged on the input.

Method: super-k-mer partitioning (see ``windows``).  A window's minimiser is
its least hashed run of ``GRAM`` words; consecutive windows that share it
travel as one packed string to the minimiser's bucket, where the windows of
strings from two or more documents are sorted and counted exactly, as bytes.
Windows of a minimiser with too many different strings travel one by one.

Defined results: null text has no words and stays null; texts of fewer words
than a window are kept whole; rows of equal id never make each other's windows
repeats, and rows that repeat id and text get the same result each; a null id
sorts last; a very long text is one chunk, held with a few numbers a word; other
columns pass through, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import documents, identity, others, with_fields
from .windows import merged, mix, repeat_spans, super_windows, variants, with_spans

WINDOW = 13
#: Words in the runs that minimisers are chosen from.
GRAM = 3
#: Windows that are sorted at once; the least of each distinct window is carried on to the next sort.
SORTED = 1 << 18
RUNS = ArrayType(StructType().add("start", "long").add("stop", "long"))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of words joined by single spaces; hashes are differences of a running polynomial."""
    global _UP, _DOWN
    raw = np.frombuffer(data, np.uint8)
    if len(raw) >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
    space = np.flatnonzero(raw == 32)
    start, stop = np.r_[0, space + 1], np.r_[space, len(raw)]
    running = np.r_[np.uint64(0), np.cumsum((raw + np.uint64(1)) * _UP[: len(raw)])]
    return mix((running[stop] - running[start]) * _DOWN[start])


def cut_words(window: int, gram: int):
    def cut(text: bytes, hot: np.ndarray | None = None, sample: bool = False):
        words = text.split()
        if len(words) < window:
            return None
        values = word_hashes(b" ".join(words))
        return variants(values, window, gram) if sample else super_windows(values, window, gram, False, hot)

    return cut


def word_strings(window: int):
    def strings(text: bytes, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        words = text.split()
        data = b" ".join(words)
        stop = np.cumsum([len(w) + 1 for w in words])
        start = np.r_[0, stop]
        return [data[a:b] for a, b in zip(start[first].tolist(), (stop[first + n + (window - 2)] - 1).tolist())]

    return strings


def judge_words(window: int):
    def count(rows: list, least_key: dict) -> list:
        """Sorts (window, id, row, start); gives the (row, start) of windows also seen under a smaller id, and notes each window's least id."""
        rows.sort()
        repeats, last = [], None
        for string, key, row, start in rows:
            if string != last:
                last, first_key = string, min(key, least_key.get(string, key))
                least_key[string] = first_key
            if key > first_key:
                repeats.append((row, start))
        return repeats

    def judge(least, key, ver, first, n, strings):
        edges = np.flatnonzero(np.r_[True, least[1:] != least[:-1], True])
        several = key[edges[:-1]] != key[edges[1:] - 1]  # rows are in order of id
        keys, starts = key.tolist(), first.tolist()
        repeats: list = []
        rows: list = []
        for lo, hi in zip(edges[:-1][several].tolist(), edges[1:][several].tolist()):
            least_key: dict = {}
            for i in range(lo, hi):
                words = strings[i].split(b" ")
                rows += [(b" ".join(words[o : o + window]), keys[i], i, starts[i] + o) for o in range(len(words) - window + 1)]
                if len(rows) >= SORTED:
                    repeats += count(rows, least_key)
                    rows = []
            if least_key or len(rows) >= SORTED // 8:
                repeats += count(rows, least_key)
                rows = []
        repeats += count(rows, {})
        if not repeats:
            return (np.empty(0, np.int64),) * 4
        row, start = np.array(repeats).T
        return merged(key[row], ver[row], start, start + 1)

    return judge


def removed_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``_key, _ver, start, stop``: word runs to remove of documents with ``identity`` columns; of one document they may still overlap."""
    unit = 6 * (window - gram + 2) / 2
    spans = repeat_spans(rows, cut_words(window, gram), word_strings(window), judge_words(window), across=True, unit_bytes=unit)
    return spans.withColumn("stop", F.col("stop") + F.lit(window - 1))


def kept_words(text: bytes, spans: list | None) -> tuple[int, list[bytes], list[tuple[int, int]]]:
    """Number of words, words left, and maximal removed runs of words."""
    words = text.split()
    runs: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(x for run in runs for x in run), len(words)]
    return len(words), [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]], [(a, b) for a, b in runs]


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the columns but the text), ``kept`` (words left, joined by a space; null for null text), ``removed`` (array of struct<start,stop> in words), ``n_words``."""
    mine = docs.select(others(docs, text_col), F.col(f"`{text_col}`").isNull().alias("_missing"), *identity(docs, id_col, text_col))
    spans = removed_spans(mine, window)
    joined = with_spans(mine, spans).select("_row", "_text", "_spans", "_missing")
    run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def strip(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            left = list(map(kept_words, texts, batch.column(2).to_pylist()))
            missing = batch.column(3).to_pylist()
            columns = [
                batch.column(0),
                pa.array([None if m else b" ".join(words) for (_, words, _), m in zip(left, missing)], pa.binary()).cast(pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in runs] for *_, runs in left], run),
                pa.array([n for n, *_ in left], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "kept", "removed", "n_words"])

    return joined.mapInArrow(strip, with_fields(joined.select("_row"), kept=StringType(), removed=RUNS, n_words=LongType()))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    kept = F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256)
    return docs.select("_row.doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

#: Windows as lists of words; each word looks back at the windows that cover it.
ORACLE_SQL = {
    "op5_substring_dedup": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE doc_id > d),
gone_list AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone_list USING (doc_id)
"""
}
