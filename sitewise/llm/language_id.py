"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are all runs of one to three code points of the lower-cased text,
hashed to ``BUCKETS``.  Learning takes labelled documents (a bounded sample of
``PER_LANGUAGE`` for each language, chosen by a hash of the id): their n-grams
are counted in the tasks and summed by language and bucket.  The matrix of
smoothed log probabilities has one row a bucket and one column a language
(``LANGUAGES`` at most), so its size doesn't depend on the corpus; it is
broadcast.  Documents are scored in numpy: the sparse product of a batch's
n-grams with the matrix is a gather of matrix rows and a sum for each document.

Neighbouring n-grams overlap, so a text counts as ``EVIDENCE`` n-grams at most;
the score is the posterior probability of the predicted language then.

Defined results: ``und`` with score 0 for null text, for text without a letter
and if nothing could be learned; ties go to the language that sorts first;
labels of null are not learned from, nor are documents of null id, which count
as not held out; repeated rows are learned and predicted each for itself;
of a very long text all n-grams count, with a few numbers a character held;
other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import documents, others, with_fields

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Bound of the sample learned from: labelled documents of each language, about.
PER_LANGUAGE = 10_000
LANGUAGES = 512
EVIDENCE = 100
SMOOTHING = 0.1
UNKNOWN = "und"
#: Less sure predictions are rejected by ``accepted``.
LEAST_SCORE = 0.5
_LETTER = regex.compile(r"\p{L}")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    found, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * _BASE + points[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def held_out(id_col: str) -> Column:
    """True for the third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class Model:
    """Languages in order, and the matrix of log probabilities (bucket, language) with the log priors."""

    def __init__(self, languages: list[str], log_likelihood: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_likelihood, self.log_prior = languages, log_likelihood, log_prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            bucket = grams(text)
            total = sum(self.log_likelihood[bucket[at : at + 65536]].sum(axis=0, dtype=np.float64) for at in range(0, len(bucket), 65536))
            logits = self.log_prior + total * min(1.0, EVIDENCE / len(bucket))
            best = int(logits.argmax())
            names[i], scores[i] = self.languages[best], float(1 / np.exp(logits - logits[best]).sum())
        return names, scores


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of rows with id, text and language; null ones are left out."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).dropna()
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([], np.empty((BUCKETS, 0)), np.empty(0))
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))))
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, total in counts.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(bucket), pa.array(total[bucket])], names=["lang", "bucket", "n"])

    summed = sampled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[summed["bucket"].to_numpy(int), np.searchsorted(languages, summed["lang"].to_numpy(str))] = summed["n"].to_numpy()
    counts += SMOOTHING
    prior = np.array([sizes[lang] for lang in languages], float)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``_row`` (the columns but the text), the text, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(others(docs, text_col), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_row", "_text", "lang_pred", "score"])

    return frame.mapInArrow(run, with_fields(frame, lang_pred=StringType(), score=DoubleType()))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the documents that aren't held out, and predicts all."""
    known = docs.where(F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    return predict(docs, learn(known, id_col, text_col, lang_col, per_language), text_col)


def accepted(identified: DataFrame, columns: list[str], text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language was told, with their own columns."""
    sure = identified.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return sure.select(*((F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in columns))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return docs.select("_row.*", "lang_pred", "score").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
