"""Suffix-array dedup: bytes inside a long string that occurred before are removed.

Bytes are those of the text in UTF-8.  A byte goes if a string of
``min_bytes`` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.  Strings are judged on the input.

Method: documents are cut into super-windows that meet in buckets by their
minimiser (see ``windows``); a bucket's candidates are joined into one text,
and threshold-bounded interval expansion on its Burrows-Wheeler transform
(see ``bwt``) gives the groups of equal ``min_bytes``-byte strings.  All of a
group but the earliest are repeats.

Defined results: null text counts as empty and stays null if nothing is
removed; texts shorter than ``min_bytes`` are kept whole; rows that repeat id
and text are one document and get the same result each; rows that repeat an id
only are told apart by text hash; a null id sorts last; of equal strings at the
same start, that is of repeated rows, none goes before another; a very long text
is one chunk, held with a few numbers a byte; other columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructType

from .bwt import repeat_groups
from .common import documents, identity, others, with_fields
from .windows import merged, repeat_spans, super_windows, variants, with_spans

MIN_BYTES = 100
#: Length of the k-grams that minimisers are chosen from.
GRAM = 32
#: Bytes of candidates whose transform is built at once; groups of one minimiser stay whole, and windows of hot ones are groups of their own.
PIECE_BYTES = 1 << 20
RUNS = ArrayType(StructType().add("start", "long").add("stop", "long"))
SEPARATOR = b"\xff"  # never in UTF-8


def cut_bytes(min_bytes: int, gram: int):
    def cut(text: bytes, hot: np.ndarray | None = None, sample: bool = False):
        if len(text) < min_bytes:
            return None
        values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        return variants(values, min_bytes, gram) if sample else super_windows(values, min_bytes, gram, True, hot)

    return cut


def byte_strings(min_bytes: int):
    def strings(text: bytes, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        return [text[a:b] for a, b in zip(first.tolist(), (first + n + (min_bytes - 1)).tolist())]

    return strings


def judge_bytes(min_bytes: int):
    def judge(least, key, ver, first, n, strings):
        spans, rest, lasts = [], [], []
        seen: dict[bytes, int] = {}
        last = None
        for i, (m, string) in enumerate(zip(least.tolist(), strings)):
            if m != last:
                seen, last = {}, m
            if seen.setdefault(string, i) == i:
                rest.append(i)
            else:
                lasts.append(i)
        if lasts:
            d = np.array(lasts)
            spans.append((key[d], ver[d], first[d], first[d] + n[d]))
        rest = np.array(rest)
        size = np.cumsum([len(strings[i]) + 1 for i in rest.tolist()])
        begin = 0
        while begin < len(rest):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PIECE_BYTES)))
            while end < len(rest) and least[rest[end]] == least[rest[end - 1]]:
                end += 1
            rows = rest[begin:end]
            begin = end
            text = np.frombuffer(SEPARATOR.join([strings[i] for i in rows.tolist()]), np.uint8)
            place, group = repeat_groups(text, min_bytes)
            length = np.array([len(strings[i]) for i in rows.tolist()])
            start = np.r_[0, np.cumsum(length + 1)[:-1]]
            whole = np.zeros(len(place), bool)  # windows inside one string
            row = np.repeat(np.arange(len(rows)), length - min_bytes + 1)
            at = np.arange(len(row)) - np.r_[0, np.cumsum(length - min_bytes + 1)[:-1]][row] + start[row]
            whole[at] = True
            keep = whole[place]
            place, group = place[keep], group[keep]
            order = np.lexsort((place, group))  # texts stand in document order: the first place is the earliest
            place, group = place[order], group[order]
            again = np.zeros(len(whole), bool)
            again[place[1:][group[1:] == group[:-1]]] = True
            hit = again[at]
            r, o = row[hit], (at - start[row])[hit]
            spans.append(merged(key[rows[r]], ver[rows[r]], first[rows[r]] + o, first[rows[r]] + o + 1))
        return tuple(np.concatenate(c) for c in zip(*spans)) if spans else (np.empty(0, np.int64),) * 4

    return judge


def removed_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """``_key, _ver, start, stop``: byte runs of documents with ``identity`` columns to remove; of one document they may still overlap."""
    unit = (min_bytes - gram + 2) / 2
    spans = repeat_spans(docs, cut_bytes(min_bytes, gram), byte_strings(min_bytes), judge_bytes(min_bytes), across=False, unit_bytes=unit)
    return spans.withColumn("stop", F.col("stop") + F.lit(min_bytes - 1))


def kept_bytes(text: bytes, spans: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    runs: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), [(a, b) for a, b in runs]


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the columns but the text), ``kept`` (the bytes left), ``removed`` (array of struct<start,stop>), ``n_bytes``, ``missing`` (text was null).

    Kept bytes can begin or end inside a character, so ``kept`` is binary;
    ``with_kept_text`` makes documents of it.
    """
    mine = docs.select(others(docs, text_col), F.col(f"`{text_col}`").isNull().alias("_missing"), *identity(docs, id_col, text_col))
    spans = removed_spans(mine, min_bytes)
    joined = with_spans(mine, spans).select("_row", "_text", "_spans", "_missing")
    run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def strip(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            left = list(map(kept_bytes, texts, batch.column(2).to_pylist()))
            columns = [
                batch.column(0),
                pa.array([kept for kept, _ in left], pa.binary()),
                pa.array([[{"start": a, "stop": b} for a, b in runs] for _, runs in left], run),
                pa.array([len(t) for t in texts], pa.int64()),
                batch.column(3),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "kept", "removed", "n_bytes", "missing"])

    return joined.mapInArrow(strip, with_fields(joined.select("_row"), kept=BinaryType(), removed=RUNS, n_bytes=LongType(), missing=BooleanType()))


def with_kept_text(deduped: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The documents' columns again, text replaced by what is left; parts of characters cut in two are dropped; null text stays null."""
    text = F.when(~F.col("missing"), _decoded("kept"))
    return deduped.select(*((text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in columns))


@F.pandas_udf(StringType())
def _decoded(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for batch in batches:
            ids, kept, removed, n_bytes = (batch.column(i) for i in range(4))
            kept, removed, n_bytes = kept.to_pylist(), removed.to_pylist(), n_bytes.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_bytes, pa.int64()),
                    pa.array([n - len(k) for n, k in zip(n_bytes, kept)], pa.int64()),
                    pa.array([len(r) for r in removed], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    docs = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("_row.doc_id", "kept", "removed", "n_bytes").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
