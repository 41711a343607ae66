"""Exact repeats of fixed-length windows, found through super-k-mer buckets.

Used by the byte and the word operator.  Both follow one plan:

1. Each window of a document has a minimiser, the least hashed k-gram in it;
   consecutive windows that share it form a super-window.  Equal windows have
   equal minimisers.
2. Minimisers travel to buckets, with their document and place but without
   text.  Those found once are done: their windows can't repeat.  What a
   chunk of documents shows to come twice needs no asking, so a minimiser
   reaches its bucket once a chunk, even if a third of all documents hold it.
3. The other super-windows are cut out of the documents.  Each travels as one
   packed string to its minimiser's bucket; of equal strings in a chunk only
   the earliest does, as windows of later copies are repeats already.
   Of a minimiser with too many different super-windows for one bucket, each
   window goes its own way instead, by a hash of the whole window: equal
   windows still meet, and others spread over all buckets.
4. A bucket finds repeats exactly (the operators differ here) and emits spans,
   which are joined to the documents by id.

What a chunk has for one bucket travels as one compressed value.  The number
of buckets follows the corpus size, so a bucket's size does not.  Which
minimisers are hot is estimated from a sample of super-windows of all
documents; the choice decides the way windows travel, not the result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that a task holds at once.
CHUNK_BYTES = 8 << 20
#: Mean size of a bucket of minimisers, in entries, and of one of strings, if all were candidates.
BUCKET_ENTRIES = 400_000
BUCKET_BYTES = 16 << 20
#: Different super-windows of one minimiser that still meet in one bucket, in bytes of text, about; windows of hotter ones part.
HOT_BYTES = 2 << 20
#: One in so many pieces of text, of so many bytes, is looked at to find the hot minimisers.
PIECES, PIECE = 64, 4 << 10
#: Of minimisers 48 bits are compared; a chance match costs an exact comparison, nothing else.
KEY_BITS = np.uint64(16)
PACKED = "bucket long, done boolean, packed binary"
ENTRIES = "least long, _key long, _ver long, first long, n long"
SPANS = "_key long, _ver long, start long, stop long"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` values, by doubling."""
    cur, span, base = values, 1, 0x9E3779B97F4A7C15
    out, have = None, 0
    while True:
        if k & span:
            if out is None:
                out, have = cur, span
            else:
                n = len(values) - (have + span) + 1
                out = out[:n] * np.uint64(base) + cur[have : have + n]
                have += span
        if span * 2 > k:
            return mix(out)
        n = len(values) - 2 * span + 1
        cur = cur[:n] * np.uint64(base) + cur[span : span + n]
        base, span = base * base & 0xFFFFFFFFFFFFFFFF, span * 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return np.minimum(h[: len(h) - width + span], h[width - span :]) if span < width else h


def super_windows(values: np.ndarray, window: int, k: int, within: bool, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Minimiser, first window, number of windows of each run of windows with one minimiser, and whether it comes twice in the run.

    Only then can the run hold a window twice; it is looked for if ``within``.
    Runs of minimisers in ``hot`` are cut into single windows, with a hash of
    the window in the minimiser's place.
    """
    w = window - k + 1
    h = gram_hashes(values, k)
    least = sliding_min(h, w)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(np.r_[first, len(least)])
    twice = np.zeros(len(first), bool)
    if within and len(least) > 1:
        zeros = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero(~sliding_min(~np.concatenate([zeros, least, zeros]), w) == h)  # grams that are the least of some window
        if ((h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= w)).any():
            size = n + w - 1
            run = np.repeat(np.arange(len(first)), size)
            gram = np.arange(len(run)) - (np.cumsum(size) - size - first)[run]
            twice = np.bincount(run[h[gram] == least[first][run]], minlength=len(first)) > 1
    key = (least[first] >> KEY_BITS).astype(np.int64)
    if hot is not None and len(hot) and (part := np.isin(key, hot)).any():
        size = np.where(part, n, 1)
        run = np.repeat(np.arange(len(first)), size)
        part = part[run]
        first = first[run] + np.arange(len(run)) - (np.cumsum(size) - size)[run]
        whole = (gram_hashes(values, window)[first] >> KEY_BITS).astype(np.int64)
        key, n, twice = np.where(part, whole, key[run]), np.where(part, 1, n[run]), np.where(part, False, twice[run])
    return key, first, n, twice


def hot_minimisers(docs: DataFrame, cut: Callable, most: float) -> np.ndarray:
    """Minimisers with more than ``most`` different super-windows, about, in order."""
    def sampled(batches):
        for batch in batches:
            for (texts,) in pieces(batch):
                found = []
                for text in texts:
                    for at in range(0, len(text), PIECE):
                        piece = text[at : at + PIECE]
                        if zlib.crc32(piece) % PIECES == 0 and (entries := cut(piece, None, True)) is not None:
                            found.append(np.array(entries))
                if found:
                    least, variant = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(variant)], names=["least", "variant"])

    variants = docs.select("_text").mapInArrow(sampled, "least long, variant long").distinct()
    hot = variants.groupBy("least").count().where(F.col("count") > most / PIECES).select("least").collect()
    return np.sort(np.array([r["least"] for r in hot], np.int64))


def variants(values: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser of each super-window, and a hash of its text."""
    least, first, n, _ = super_windows(values, window, k, False)
    whole = gram_hashes(values, window)
    return least, mix(mix(whole[first]) + whole[first + n - 1] + n.astype(np.uint64)).astype(np.int64)


def pack(columns: list[np.ndarray], text: bytes) -> bytes:
    raw = b"".join([struct.pack("<qq", len(columns[0]), len(columns)), *(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), text])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, k = struct.unpack_from("<qq", raw)
    columns = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16 + 8 * n * i).reshape(8, n).T).view(np.int64).ravel() for i in range(k)]
    return columns, raw[16 + 8 * n * k :]


def merged(key: np.ndarray, ver: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans with those that touch or overlap in one document made one."""
    if not len(key):
        return key, ver, start, stop
    order = np.lexsort((start, ver, key))
    key, ver, start, stop = key[order], ver[order], start[order], stop[order]
    doc = np.r_[0, np.cumsum((key[1:] != key[:-1]) | (ver[1:] != ver[:-1]))]
    lift = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(stop + doc * lift)
    new = np.r_[True, start[1:] + doc[1:] * lift > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1
    return key[first], ver[first], start[first], reach[last] - doc[last] * lift


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[list]]:
    """A batch's columns as Python lists, some rows at a time; strings as bytes."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of (key, version, text, ...) in order, repeated ones once, about CHUNK_BYTES of text at a time."""
    docs, size = {}, 0
    for batch in batches:
        for columns in pieces(batch):
            for key, ver, text, *rest in zip(*columns):
                docs[key, ver] = (text, *rest)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield [(*k, *docs[k]) for k in sorted(docs)]
                    docs, size = {}, 0
    if docs:
        yield [(*k, *docs[k]) for k in sorted(docs)]


def record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def packed_record(rows: list[tuple]) -> pa.RecordBatch:
    return record(rows, ["bucket", "done", "packed"], [pa.int64(), pa.bool_(), pa.binary()])


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]) if len(sorted_values) else np.zeros(1, int)
    return edges[:-1], edges[1:]


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    return [(int(bucket[order[lo]]), False, pack([c[order[lo:hi]] for c in columns], b"")) for lo, hi in zip(*(e.tolist() for e in runs_of(bucket[order])))]


def anywhere(docs: list[tuple], n_buckets: int) -> int:
    """A bucket for what a chunk has settled, which needs no meeting place: a hash of its first document, so chunks differ."""
    key, ver = (np.array([docs[0][i]], np.int64).view(np.uint64) for i in (0, 1))
    return int(mix(mix(key) + ver)[0] % np.uint64(n_buckets))


def ask(docs: list[tuple], cut: Callable, n_buckets: int, across: bool, hot: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries (minimiser, key, version, first window, number of windows, known to repeat) of one chunk, by bucket; entries settled here are done."""
    cols = []
    for i, (_, _, text) in enumerate(docs):
        if (found := cut(text, hot)) is not None:
            least, first, n, twice = found
            cols.append((least, np.full(len(least), i), first, n, twice))
    if not cols:
        return packed_record([])
    least, doc, first, n, twice = (np.concatenate(c) for c in zip(*cols))
    key, ver = (np.array([d[i] for d in docs], np.int64)[doc] for i in (0, 1))
    order = np.argsort(least, kind="stable")  # rows stay in document order
    least, key, ver, first, n, twice = (c[order] for c in (least, key, ver, first, n, twice))
    lo, hi = runs_of(least)
    known = key[lo] != key[hi - 1] if across else (hi - lo > 1) | np.logical_or.reduceat(twice, lo)
    settled = np.repeat(known, hi - lo)
    send = ~settled
    send[lo[known]] = True
    rows = by_bucket(least[send] % n_buckets, [c[send] for c in (least, key, ver, first, n, settled.astype(np.int64))])
    if settled.any():
        rows.append((anywhere(docs, n_buckets), True, pack([c[settled] for c in (least, key, ver, first, n)], b"")))
    return packed_record(rows)


def answer(table: pa.Table, across: bool) -> pa.Table:
    """Entries of one bucket whose minimiser comes twice."""
    repeated, asked = [], []
    for done, value in zip(table.column("done").to_pylist(), table.column("packed").to_pylist()):
        (repeated if done else asked).append(unpack(value)[0])
    if asked:
        least, key, ver, first, n, known = (np.concatenate(c) for c in zip(*asked))
        order = np.lexsort((key, least)) if across else np.argsort(least, kind="stable")
        least, key, ver, first, n, known = (c[order] for c in (least, key, ver, first, n, known))
        lo, hi = runs_of(least)
        again = (key[lo] != key[hi - 1] if across else hi - lo > 1) | (np.maximum.reduceat(known, lo) > 0)
        take = np.repeat(again, hi - lo) & (known == 0)
        repeated.append([c[take] for c in (least, key, ver, first, n)])
    columns = [np.concatenate(c) for c in zip(*repeated)] if repeated else [np.empty(0, np.int64)] * 5
    return pa.table(dict(zip(("least", "_key", "_ver", "first", "n"), columns)))


def send(docs: list[tuple], strings: Callable, n_buckets: int, across: bool) -> pa.RecordBatch:
    """Strings of one chunk's candidates, by bucket, and spans of those that repeat another in the chunk."""
    cols, texts, seen = [], [], {}
    drop: list[bool] = []
    for i, (key, _, text, found, *_) in enumerate(docs):
        entries = np.array([(e["least"], e["first"], e["n"]) for e in found], np.int64)
        entries = entries[np.unique(entries[:, 1], return_index=True)[1]]  # a row read twice answers twice
        cols.append((entries, np.full(len(entries), i)))
        for string in strings(text, entries[:, 1], entries[:, 2]):
            owner = seen.setdefault(string, key)
            drop.append(owner < key if across else owner is not key)
            texts.append(string)
            if not across:
                seen[string] = None
    if not texts:
        return packed_record([])
    entries, doc = (np.concatenate(c) for c in zip(*cols))
    least, first, n = entries.T
    key, ver = (np.array([d[i] for d in docs], np.int64)[doc] for i in (0, 1))
    dropped = np.array(drop)
    rows = []
    if dropped.any():
        spans = merged(key[dropped], ver[dropped], first[dropped], (first + n)[dropped])
        rows.append((anywhere(docs, n_buckets), True, pack(list(spans), b"")))
    keep = np.flatnonzero(~dropped)
    keep = keep[np.argsort(least[keep] % n_buckets, kind="stable")]
    for lo, hi in zip(*(e.tolist() for e in runs_of(least[keep] % n_buckets))):
        o = keep[lo:hi]
        parts = [texts[i] for i in o.tolist()]
        rows.append((int(least[o[0]] % n_buckets), False, pack([least[o], key[o], ver[o], first[o], n[o], np.array([len(t) for t in parts])], b"".join(parts))))
    return packed_record(rows)


def decide(table: pa.Table, judge: Callable) -> pa.Table:
    spans, cols, texts = [], [], []
    for done, value in zip(table.column("done").to_pylist(), table.column("packed").to_pylist()):
        columns, text = unpack(value)
        if done:
            spans.append(tuple(columns))
        else:
            cols.append(columns)
            texts.append(text)
    if cols:
        least, key, ver, first, n, length = (np.concatenate(c) for c in zip(*cols))
        offset = np.cumsum(length) - length
        order = np.lexsort((first, ver, key, least))
        least, key, ver, first, n, length, offset = (c[order] for c in (least, key, ver, first, n, length, offset))
        new = np.r_[True, (least[1:] != least[:-1]) | (key[1:] != key[:-1]) | (ver[1:] != ver[:-1]) | (first[1:] != first[:-1])]  # a row read twice counts once
        text = b"".join(texts)
        strings = [text[s:e] for s, e in zip(offset[new].tolist(), (offset + length)[new].tolist())]
        spans.append(judge(*(c[new] for c in (least, key, ver, first, n)), strings))
    return span_table([s for s in spans if len(s[0])])


def span_table(spans: list[tuple]) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*spans)] if spans else [np.empty(0, np.int64)] * 4
    return pa.table(dict(zip(("_key", "_ver", "start", "stop"), (pa.array(c, pa.int64()) for c in merged(*cols)))))


def repeat_spans(docs: DataFrame, cut: Callable, strings: Callable, judge: Callable, across: bool, unit_bytes: float) -> DataFrame:
    """Runs of window starts that are repeats, of documents with the columns of ``identity``: ``_key, _ver, start, stop``.

    ``cut(text, hot)``: minimiser, first window, number of windows of each
    super-window, and whether its minimiser comes twice in it; of minimisers
    in ``hot``, of each window.  ``cut(text, None, True)``: ``variants``.
    ``strings(text, first, n)``: their strings.
    ``judge(least, key, ver, first, n, strings)``: the spans of repeats in one
    bucket's rows, which are sorted by minimiser and document order.
    ``across``: only windows in documents of smaller id make repeats.
    ``unit_bytes``: text for each super-window, about.
    """
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_keys = 1 + int(total / unit_bytes / BUCKET_ENTRIES)
    n_strings = 1 + int(4 * total / BUCKET_BYTES)
    most = HOT_BYTES / (4 * unit_bytes)
    hot = hot_minimisers(docs, cut, most) if total / unit_bytes > most else None

    def asked(batches):
        for chunk in chunks(batches):
            yield ask(chunk, cut, n_keys, across, hot)

    def answered(table: pa.Table) -> pa.Table:
        return answer(table, across)

    def sent(batches):
        for chunk in chunks(batches):
            yield send(chunk, strings, n_strings, across)

    def decided(table: pa.Table) -> pa.Table:
        return decide(table, judge)

    entries = docs.select("_key", "_ver", "_text").mapInArrow(asked, PACKED).groupBy("bucket").applyInArrow(answered, ENTRIES)
    entries = entries.groupBy("_key", "_ver").agg(F.collect_list(F.struct("least", "first", "n")).alias("_entries"))
    # all columns go on, so that this exchange of the documents is the one that with_spans needs too
    rest = [c for c in docs.columns if c not in ("_key", "_ver", "_text")]
    candidates = docs.join(entries, ["_key", "_ver"]).select("_key", "_ver", "_text", "_entries", *rest)
    return candidates.mapInArrow(sent, PACKED).groupBy("bucket").applyInArrow(decided, SPANS)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document's row with ``_spans``, its list of (start, stop), or null."""
    by_doc = spans.groupBy("_key", "_ver").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    return docs.join(by_doc, ["_key", "_ver"], "left")

