"""Media columns: interleaved document sequences.

``parse_page`` turns HTML into an ordered array of structs: text runs and media references with position, reference,
digest and caption. ``store_media`` keeps payloads losslessly as 8-bit grey images (binary PGM, 192 samples a row),
keyed by the digest of the stored form; ``interleave`` resolves references by joining on the digest, so equal payloads
are described once and positions and captions stay with their references.

Null pages give an empty sequence. Null payloads count as empty, which is one row of blanks. Broken HTML is parsed as
far as it makes sense; a reference without a stored payload keeps a null payload. Repeated rows stay repeated. Very long texts
are stored whole. Only ``doc_id`` and the text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, stored

ROW = 192
SCHEME = "media:"
ITEM = "array<struct<position int, kind string, text string, ref string, digest string, caption string>>"
_VOID_MEDIA = {"img": "image", "source": "media", "video": "video", "audio": "audio"}
_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "tr", "td", "nav",
           "header", "footer", "ul", "ol", "table", "blockquote", "pre"}


class _Sequence(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.hidden = [], [], 0
        self.figure, self.caption = None, None         # first item of the open figure; pieces of its caption

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        if tag == "figcaption" and self.figure is not None:
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        ref = attrs.get("src") or attrs.get("data-src")
        if tag in _VOID_MEDIA and ref:
            self.flush()
            digest = ref.removeprefix(SCHEME) if ref.startswith(SCHEME) else attrs.get("data-digest")
            self.items.append({"kind": _VOID_MEDIA[tag], "text": None, "ref": ref, "digest": digest,
                               "caption": attrs.get("alt") or attrs.get("title")})

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure:]:
                if item["kind"] != "text" and text:
                    item["caption"] = text
            self.caption = None
        if tag == "figure":
            self.figure = self.caption = None

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    """Ordered text runs and media references of one page."""
    parser = _Sequence()
    try:
        parser.feed(page or "")
        parser.close()
    except AssertionError:            # a declaration the parser gives up on; what came before it stays
        pass
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """``key, items``: the interleaved sequence of every page."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), *[(n, pa.string()) for n in
                                                  ("kind", "text", "ref", "digest", "caption")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, column, 8 << 20):
            found = [parse_page(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.list_(item))], names=[key, "items"])

    return pages.select(key, column).mapInArrow(run, f"`{key}` {kind}, items {ITEM}")


def padded(raw: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of a row."""
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def to_image(payload: bytes) -> bytes:
    """A binary grey map whose samples are the payload."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_image(media: bytes) -> bytes:
    """The samples of ``to_image``."""
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit grey map")
    return samples


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Write every text as media and read it back: ``doc_id, n_bytes, digest, media``. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text, 8 << 20):
            raws = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(text).to_pylist()]
            media = [to_image(padded(raw)) for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()),
                 pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "digest", "media"])

    return stored(docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, digest string, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Features of the stored bytes, one row per digest."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "media", 8 << 20):
            rows = []
            for digest, stored_bytes in zip(b.column("digest").to_pylist(), b.column("media").to_pylist()):
                payload = from_image(stored_bytes)
                grey = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = grey / len(payload)
                mean = float(share @ np.arange(256))
                spread = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
                bits = share[share > 0]
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                             len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(),
                             f"{ROW}x{len(payload) // ROW} mean={mean:.4f} sd={spread:.4f} "
                             f"entropy={float(-(bits * np.log2(bits)).sum()):.4f}"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    schema = ", ".join(f"{n} {'long' if n in ('payload_bytes', 'tail_crc32', 'media_bytes') else 'string'}"
                       for n in names)
    found = media.select("digest", "media").mapInArrow(run, schema)
    rest = F.struct(*[F.col(n) for n in names[1:]])
    return found.groupBy("digest").agg(F.first(rest).alias("r")).select("digest", "r.*")


def interleave(pages: DataFrame, described: DataFrame, key: str, column: str = "html") -> DataFrame:
    """One row per sequence item, in ``position`` order within ``key``, with what its digest resolves to."""
    items = sequences(pages, key, column).select(key, F.explode("items").alias("i")).select(key, "i.*")
    return items.join(described, "digest", "left")


def media_page(digest: Column, caption: Column) -> Column:
    """HTML of a figure whose payload is in the store."""
    return F.concat(F.lit(f'<p>Document as media</p><figure><img src="{SCHEME}'), digest,
                    F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))


def escape(text: str) -> str:
    return html.escape(text)


def media_report(docs: DataFrame) -> DataFrame:
    """Every whole text stored as media, read back and resolved through its page's sequence."""
    kept = store_media(docs)
    described = stored(describe(kept), "media-described")
    pages = kept.select("doc_id", media_page(F.col("digest"), F.col("n_bytes").cast("string")).alias("html"))
    items = interleave(pages, described, "doc_id").filter("kind = 'image'")
    return items.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256",
                        "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
