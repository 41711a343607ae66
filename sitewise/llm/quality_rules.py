"""Quality rules: line labels from a linear-chain conditional random field.

Every line with a word gets a vector of surface features; Viterbi decoding of a
two-state chain marks it content or boilerplate.  A document is kept if at
least ``LEAST_SHARE`` of its words stand in content lines and the base rules
don't fail it.

The chain is trained here, by maximum conditional likelihood with the
forward-backward recursion, on whole texts of a bounded sample of labelled
documents (``SAMPLE`` of each class).  Labels are of documents, states are of
lines, and pages mix both, so

* training sequences are spliced: runs of about ``RUN`` lines of documents of
  either class follow each other in a seeded random order, and the chain sees
  what a change of state looks like;
* a line's state is latent: it starts as its document's label, and after each
  of ``ROUNDS`` fits but the last, lines are decoded anew with the label as
  noisy evidence, wrong for ``NOISE`` of the lines.

Only the sample's features come to the driver.  The weights are a few dozen
numbers.

Base rules, over words ``[^\\x20\\x09-\\x0D]+``: ``n_words``, ``word_chars``,
``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word
that equal an earlier line), ``n_repeat_words`` (words in three-word windows
that come twice or more, the first included).

Defined results: null and blank texts have no words, fail the base rules and
have share 0; without labels of both classes nothing is marked boilerplate;
labels of null and of unknown documents are left out, and documents with
contrary labels too; of rows that repeat an id training takes one; rows that
repeat an id are judged each for itself; ties in decoding go to content; texts
and lines of any length are judged whole; other columns pass through, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from .common import documents, others, with_fields

#: Bound of the training sample: documents of each class.
SAMPLE = 1500
RUN = 4
ROUNDS = 3
NOISE = 0.2
#: Lines of a training sequence.
SEQUENCE = 64
LEAST_SHARE = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
STEPS = 150
PENALTY = 1e-3
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")
FEATURES = ("bias", "few words", "long line", "word length", "long words", "symbols", "marks", "bars", "capitals", "digits", "repeated words", "same line before", "no end mark", "links")


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    characters = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = ids[:-1] * len(number) + ids[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        windows = pairs[:-1] * len(number) + ids[2:]
        _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[which] > 1)
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = int(covered.sum())
    return len(words), characters, symbols, len(lines) - len(set(lines)), repeated


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and its number of words."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        letters = max(1, sum(map(len, words)))
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        again = line in seen
        seen.add(line)
        rows.append(
            (
                1.0,
                math.exp(-n / 4),
                min(1.0, n / 100),
                min(2.0, letters / n / 10),
                float(max(map(len, words)) > 40),
                min(1.0, 4 * symbols / letters),
                min(1.0, 8 * (line.count(b"!") + line.count(b"?")) / letters),
                min(1.0, 8 * line.count(b"|") / letters),
                (len(line) - len(line.translate(None, _UPPER))) / letters,
                (len(line) - len(line.translate(None, _DIGITS))) / letters,
                1 - len(set(words)) / n,
                float(again),
                float(not words[-1].endswith(_ENDS)),
                min(1.0, (line.count(b"http") + line.count(b"www.") + line.count(b"@")) / n * 4),
            )
        )
        sizes.append(n)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class Chain:
    """Weights of states (2, features) and transitions (2, 2); state 1 is content."""

    def __init__(self, states: np.ndarray, moves: np.ndarray):
        self.states, self.moves = states, moves

    def viterbi(self, features: np.ndarray, evidence: np.ndarray | None = None) -> np.ndarray:
        """The likeliest states, with ``evidence`` added to their scores if given; ties go to content."""
        emit = features @ self.states.T
        if evidence is not None:
            emit = emit + evidence
        n = len(emit)
        if not n:
            return np.empty(0, bool)
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = emit[0].tolist()
        back = []
        for e0, e1 in emit[1:].tolist():
            from0 = 0 if a + m00 > b + m10 else 1
            from1 = 0 if a + m01 > b + m11 else 1
            back.append((from0, from1))
            a, b = (a + m00 if from0 == 0 else b + m10) + e0, (a + m01 if from1 == 0 else b + m11) + e1
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return np.array(out[::-1], bool)


def likelihood(chain: Chain, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of the states ``y`` (sequences, lines) of padded lines (sequences, lines, features), and its gradients."""
    docs, length, _ = x.shape
    emit = x @ chain.states.T
    alpha = np.zeros((docs, length, 2))
    beta = np.zeros((docs, length, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + chain.moves[0], alpha[:, t - 1, 1, None] + chain.moves[1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = emit[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(chain.moves[:, 0] + ahead[:, 0, None], chain.moves[:, 1] + ahead[:, 1, None])
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    mine = np.eye(2)[y] * mask[:, :, None]
    both = np.einsum("dts,dtr->sr", mine[:, :-1], mine[:, 1:])  # the second line's mask is enough, lines being at the front
    score = (emit * mine).sum((1, 2)).sum() + (both * chain.moves).sum()
    p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    states = np.einsum("dts,dtf->sf", mine - p, x)
    pair = alpha[:, :-1, :, None] + chain.moves + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]
    expected = (np.exp(pair) * mask[:, 1:, None, None]).sum((0, 1))
    return float((score - total.sum()) / docs), states / docs, (both - expected) / docs


def spliced(lines: list[tuple[np.ndarray, np.ndarray]], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive lines of documents (features, states), in random order, as padded sequences: features, mask, states."""
    rng = np.random.default_rng(seed)
    runs = []
    for f, y in lines:
        at = 0
        while at < len(f):
            n = int(rng.integers(1, 2 * RUN))
            runs.append((f[at : at + n], y[at : at + n]))
            at += n
    order = rng.permutation(len(runs))
    f, y = (np.concatenate([runs[k][part] for k in order]) for part in (0, 1))
    rows = -(-len(f) // SEQUENCE)
    pad = rows * SEQUENCE - len(f)
    mask = np.arange(rows * SEQUENCE) < len(f)
    return np.pad(f, ((0, pad), (0, 0))).reshape(rows, SEQUENCE, -1), mask.reshape(rows, -1), np.pad(y, (0, pad)).reshape(rows, -1)


def maximised(x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int) -> Chain:
    """Gradient ascent with adaptive steps (Adam)."""
    weights = np.zeros(2 * x.shape[2] + 4)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    chain = lambda: Chain(weights[:-4].reshape(2, -1), weights[-4:].reshape(2, 2))
    for step in range(1, steps + 1):
        _, states, moves = likelihood(chain(), x, mask, y)
        g = np.r_[states.ravel(), moves.ravel()] - PENALTY * weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights = weights + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return chain()


def train(documents_features: list[np.ndarray], quality: list[int], steps: int = STEPS, rounds: int = ROUNDS) -> Chain:
    kept = [(f, q) for f, q in zip(documents_features, quality) if len(f)]
    if len({q for _, q in kept}) < 2:
        return Chain(np.zeros((2, len(FEATURES))), np.zeros((2, 2)))
    states = [np.full(len(f), q) for f, q in kept]
    evidence = np.log([[1 - NOISE, NOISE], [NOISE, 1 - NOISE]])
    for left in range(rounds - 1, -1, -1):
        chain = maximised(*spliced([(f, y) for (f, _), y in zip(kept, states)]), steps)
        if left:
            states = [chain.viterbi(f, evidence[q]).astype(int) for f, q in kept]
    return chain


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain of a sample, by hash of the id, of documents whose label (columns ``doc_id``, ``quality`` 0 or 1) is clear."""
    clear = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    sizes = {r.q: r["count"] for r in clear.groupBy("q").count().collect()}
    # about ``sample`` ids of either class, so the join can broadcast them whatever the tables' size
    share = F.when(F.col("q") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    chosen = clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "q")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text")).where("_text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "q").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("doc_id", "_text", "q")

    def run(batches):
        for batch in batches:
            for key, text, q in zip(*(c.to_pylist() for c in batch.columns)):
                f, _ = line_features(text.encode())
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([q], pa.int32()), pa.array([f.ravel().tolist()], pa.list_(pa.float64()))], names=["doc_id", "q", "f"])

    rows = texts.mapInArrow(run, "doc_id long, q int, f array<double>").toPandas().sort_values("doc_id")
    return train([np.array(f, float).reshape(-1, len(FEATURES)) for f in rows["f"]], rows["q"].tolist())


def judge(docs: DataFrame, chain: Chain, text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """``_row`` (the columns but the text), the text, the base counts, ``content_words``, ``boilerplate`` (numbers, from 0, of lines so marked), ``base_failed``, ``kept``."""
    frame = docs.select(others(docs, text_col), F.col(f"`{text_col}`").alias("_text"))

    def one(text: bytes) -> tuple:
        counts = base_counts(text)
        f, sizes = line_features(text)
        content = chain.viterbi(f)
        numbers = [i for i, line in enumerate(text.split(b"\n")) if line.strip()]
        words = int(sizes[content].sum())
        failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
        return (*counts, words, [n for n, c in zip(numbers, content.tolist()) if not c], failed, not failed and words >= least_share * counts[0])

    def run(batches):
        kinds = (*(pa.int64(),) * 6, pa.list_(pa.int64()), pa.bool_(), pa.bool_())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "boilerplate", "base_failed", "kept")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["_row", "_text", *names])

    counts = {c: LongType() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")}
    return frame.mapInArrow(run, with_fields(frame, **counts, boilerplate=ArrayType(LongType()), base_failed=BooleanType(), kept=BooleanType()))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, chain).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
