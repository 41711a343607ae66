"""Media columns: interleaved sequences of text and media references.

``interleave`` parses HTML into one ordered array of structs, each a text or a
reference to a medium: its source, the SHA-256 digest that names its payload
(null if the source has none), and its figure's caption.
``store`` writes payloads as 8-bit grey images (binary PGM, ``WIDTH`` samples a
row), padded with bytes 0 to a positive multiple of the width, in the shared
folder.  ``resolve`` reads the stored bytes back, computes features, and joins
them to the references by digest; a reference keeps its position and caption,
and one without a stored payload stays, with nulls.

Payloads don't travel: a task writes what it has read, equal payloads of one
task once.  Features of the copies of a digest are reduced to one row before
the join, which moves digests and features only.  References to a digest that
has over one in ``HOT`` of them (fewer than ``HOT`` digests) are dealt out in
``SALTS`` parts, and its one row of features goes to each.

Defined results: null text is an empty payload; equal texts have equal values;
rows that repeat an id or a text are each a document; null or malformed HTML
gives what can be parsed, null an empty array; a caption goes to all media of
its figure, before or after it, and takes the place of an ``alt`` text; long
texts are stored whole; an empty table gives an empty table; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import documents, others, stash, with_fields
from .windows import pieces

WIDTH = 64
HOT = 1024
SALTS = 64
SEGMENT = StructType().add("position", "integer").add("kind", "string").add("text", "string").add("digest", "string").add("source", "string").add("caption", "string")
#: Elements whose text isn't content, and those that end a run of text.
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "figure", "figcaption", "blockquote", "pre", "hr", "body", "title"}
MEDIA = {"img", "audio", "video", "source", "embed"}


class Sequence(HTMLParser):
    """Texts and media references in order; a figure's caption goes to the references inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[tuple[list[dict], list[str]]] = []
        self.in_caption = False

    def add(self, kind: str, text: str | None = None, digest: str | None = None, source: str | None = None, caption: str | None = None) -> dict:
        self.segments.append({"position": len(self.segments), "kind": kind, "text": text, "digest": digest, "source": source, "caption": caption})
        return self.segments[-1]

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add("text", text)

    def end_figure(self) -> None:
        media, words = self.figures.pop()
        caption = " ".join("".join(words).split())
        if media and words:
            for medium in media:
                medium["caption"] = caption
        elif caption:  # of no medium: content like any other
            self.add("text", caption)
        self.in_caption = False

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS or tag in MEDIA:
            self.flush()
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self.in_caption = True
        elif tag in MEDIA:
            attrs = dict(attrs)
            source = attrs.get("src")
            digest = (source or "").rpartition("sha256:")[2].lower()
            known = len(digest) == 64 and not set(digest) - set("0123456789abcdef")
            if source:
                medium = self.add("media", digest=digest if known else None, source=source, caption=attrs.get("alt"))
                if self.figures:
                    self.figures[-1][0].append(medium)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.in_caption = False
        elif tag == "figure" and self.figures:
            self.flush()
            self.end_figure()
        if tag in BREAKS:
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.figures[-1][1] if self.in_caption and self.figures else self.run).append(data)

    def close(self):
        super().close()
        self.flush()
        while self.figures:
            self.end_figure()


def segments(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.segments


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``_row`` (the columns but the HTML) and ``sequence``, an array of segments."""
    frame = pages.select(others(pages, html_col), F.col(f"`{html_col}`").alias("_html"))

    def run(batches):
        segment = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("source", pa.string()), ("caption", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(segments, part.column(1).to_pylist())), pa.list_(segment))], names=["_row", "sequence"])

    return frame.mapInArrow(run, with_fields(frame.select("_row"), sequence=ArrayType(SEGMENT)))


def to_pgm(data: bytes, width: int = WIDTH) -> bytes:
    rows = max(1, -(-len(data) // width))
    return b"P5\n%d %d\n255\n" % (width, rows) + data.ljust(rows * width, b"\0")


def from_pgm(stored: bytes) -> np.ndarray:
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not an image as stored here")
    return np.frombuffer(samples, np.uint8).reshape(rows, width)


def image_features(image: np.ndarray) -> str:
    """Height, sum of samples, and a 64-bit average hash: which of 64 equal stretches lie above the mean. Integers only, so equal everywhere."""
    flat = image.ravel()
    total = int(flat.sum(dtype=np.int64))
    stretch = flat.reshape(64, -1).sum(axis=1, dtype=np.int64)
    above = stretch * 64 > total
    return f"h{image.shape[0]}-s{total}-a{int(np.packbits(above).tobytes().hex(), 16):016x}"


def store(payloads: DataFrame, name: str = "media") -> DataFrame:
    """Writes ``digest, n_bytes, media`` of texts (column ``payload``) to the shared folder; equal ones of a task once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for (texts,) in pieces(batch):
                rows = []
                for text in texts:
                    digest = hashlib.sha256(text)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        rows.append((digest.hexdigest(), len(text), to_pgm(text)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["digest", "n_bytes", "media"])

    return stash(payloads.select(F.coalesce("payload", F.lit(""))).mapInArrow(run, "digest string, n_bytes long, media binary"), name, "zstd")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes."""

    def run(batches):
        for batch in batches:
            for digests, sizes, media in pieces(batch, 64):
                rows = []
                for digest, n, data in zip(digests, sizes, media):
                    image = from_pgm(data)
                    payload = image.tobytes()
                    rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), image_features(image)))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                columns[0] = columns[0].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FEATURES.split(", ")])

    found = stored.mapInArrow(run, FEATURES)
    return found.groupBy("digest").agg(*(F.first(c).alias(c) for c in found.columns[1:]))


def hot_digests(media: DataFrame) -> list[str]:
    """Digests that have over one in ``HOT`` of all references."""
    counts = media.where("digest IS NOT NULL").groupBy("digest").count()
    total = media.count()
    return [r.digest for r in counts.where(F.col("count") > max(SALTS, total / HOT)).collect()]  # fewer than HOT rows


def resolve(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """One row per media reference: ``_row``, ``position``, ``caption``, ``digest`` and the stored medium's features, null if there is none."""
    media = sequences.select("_row", F.explode(F.filter("sequence", lambda s: s["kind"] == "media")).alias("m"))
    media = stash(media.select("_row", "m.position", "m.caption", "m.digest"), "references")
    hot = F.col("digest").isin(hot_digests(media))
    salted = media.withColumn("_salt", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = known.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, ["digest", "_salt"], "left").drop("_salt")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page: a heading, and a figure that refers to its payload by digest, with its size as caption."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    raw = F.encode("payload", "UTF-8")
    page = F.concat(F.lit("<article><h1>document</h1><figure><img src='sha256:"), F.sha2(raw, 256), F.lit("'><figcaption>"), F.octet_length("payload").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    sequences = interleave(docs.select("doc_id", page.alias("html")))
    found = resolve(sequences, features(store(docs.select("payload"))))
    aligned = F.col("caption") == F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes"))
    n_bytes = F.when(aligned, F.col("n_bytes")).otherwise(F.raise_error(F.lit("caption and payload don't belong together")).cast("long"))
    return found.select("_row.doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE_SQL: dict[str, str] = {}
