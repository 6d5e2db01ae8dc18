"""Media columns: interleaved document sequences of text and media references.

``sequences`` parses HTML into ordered structs (position, kind, text, digest,
caption): text runs and the media elements between them, each with its caption
(``figcaption``, else ``alt``).  A media element names its payload by digest
(``src="sha256:..."``).  ``resolve`` joins references to stored payloads by digest;
a reference whose payload is missing keeps its row, position and caption with null
media columns, so nothing shifts.  Payloads are stored losslessly as 8-bit RGB
rasters (binary PPM, eight pixels wide: 192 bytes are one 8 x 8 tile).

The join moves digests and per-payload features, never payload bytes: features are
computed where a payload is read.  A payload that many documents share is stored once
for every batch that met it and reduced by digest before the join.  References are a
table, so the join's sides are plain exchanges and adaptive execution splits a digest
that is very common.

Null or empty text: one all-padding tile.  Null or empty HTML: no elements.  Very long
texts: one payload, a batch of its own.  Empty table: no rows.  Repeated rows and ties:
equal values, a row each.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage

TILE, WIDTH = 192, 8
ELEMENT = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
STORE = "digest string, n_bytes long, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SILENT, _BLOCK = {"script", "style", "title"}, {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "article", "section", "figure", "ul", "ol", "table"}
_MEDIA = {"img", "video", "audio", "source"}
_TITLE = re.compile(r"<title\b[^>]*>", re.IGNORECASE)


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.text: list[str] = []
        self.silent: str | None = None  # the open element whose text is none of the page's
        self.in_caption = False
        self.figure: int | None = None  # index of the first media element of an open figure
        self.open_figure = False
        self.caption: list[str] = []
        self.endless = -1  # length of the text in which a comment had no end

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self._add("text", text, None, None)

    def _add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> None:
        self.elements.append({"position": len(self.elements), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent = tag if tag in _SILENT else None  # a title ends at the next element at the latest
        if tag in _MEDIA:
            a = dict(attrs)
            self.flush()
            if self.open_figure and self.figure is None:
                self.figure = len(self.elements)
            self._add(tag, None, (a.get("src") or "").removeprefix("sha256:") or None, a.get("alt"))
        elif tag == "figcaption":
            self.flush()
            self.in_caption = True
        elif tag in _BLOCK:
            self.text.append(" ")
            if tag == "figure":
                self.close_figure()
                self.flush()
                self.open_figure = True

    def close_figure(self) -> None:
        """The caption goes to the figure's first media element; without one it is text."""
        caption = " ".join("".join(self.caption).split())
        self.caption.clear()
        if caption and self.figure is not None:
            self.elements[self.figure]["caption"] = caption
        elif caption:
            self.flush()
            self._add("text", caption, None, None)
        self.open_figure, self.in_caption, self.figure = False, False, None

    def parse_html_declaration(self, i: int) -> int:
        """A comment that finds no end is looked for once: none after it finds one either."""
        comment = self.rawdata.startswith("<!--", i)
        if comment and self.endless == len(self.rawdata):
            return -1
        end = super().parse_html_declaration(i)
        if comment and end < 0:
            self.endless = len(self.rawdata)
        return end

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments up to the next ">", as browsers read them."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_endtag(self, tag: str) -> None:
        if tag == self.silent:
            self.silent = None
        elif tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.close_figure()
        elif tag in _BLOCK:
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.caption if self.in_caption else self.text).append(data)


def _closed(source: str) -> str:
    """What follows the last ">" with each "<" spelled out: no tag can end there, and one
    look at each would read to the end."""
    at = source.rfind(">") + 1
    return source[:at] + source[at:].replace("<", "&lt;")


def parse(source: str | None) -> list[dict]:
    """Ordered elements of one HTML text.  Broken mark-up never fails: end tags may be
    missing, marked sections are comments, what looks like no tag is text, also a tag or
    comment that never ends; time is in proportion to the length.  Text inside
    script, style and title is none of the page's; a title that never closes is no title."""
    source, parser = source or "", _Parser()
    if len(_TITLE.findall(source)) > source.lower().count("</title"):
        source = _TITLE.sub(" ", source)
    parser.feed(_closed(source))
    parser.close()
    parser.close_figure()
    parser.flush()
    return parser.elements


def sequences(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, elements): every page's interleaved sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(x) for x in batch.column(1).to_pylist()], kind)], names=[key, "elements"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"`{key}` {kind}, elements {ELEMENT}")


def raster(payload: bytes) -> bytes:
    """The payload as a binary PPM, losslessly; its length must be a positive multiple of 192."""
    return b"P6 %d %d 255\n" % (WIDTH, len(payload) // (3 * WIDTH)) + payload


def unraster(media: bytes) -> bytes:
    head, _, payload = media.partition(b"\n")
    magic, w, h, top = head.split(b" ")
    if (magic, top) != (b"P6", b"255") or len(payload) != 3 * int(w) * int(h):
        raise ValueError("not a raster written by this module")
    return payload


def describe(payload: bytes) -> str:
    """Height, mean colour and a 64-bit average hash of the 8 x 8 mean luminance grid."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    luma = pixels.sum(axis=2, dtype=np.int64)
    tiles = luma.reshape(-1, WIDTH, WIDTH).sum(axis=0)
    bits = np.packbits((tiles * 64 > tiles.sum()).ravel()).tobytes().hex()
    mean = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (len(payload) // 3)
    return f"{len(payload) // (3 * WIDTH)}:{'-'.join(map(str, mean.tolist()))}:{bits}"


def _padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(TILE, -(-len(data) // TILE) * TILE), b" ")


def store_texts(docs: DataFrame) -> DataFrame:
    """Media table of all texts of ``docs``: written to the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {}
            for text in batch.column(0).to_pylist():
                n, payload = _padded(text)
                made.setdefault(hashlib.sha256(b"%d " % n + payload).hexdigest(), (n, payload))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([n for n, _ in made.values()], pa.int64()), pa.array([raster(p) for _, p in made.values()], pa.binary())], names=["digest", "n_bytes", "media"])

    return storage.stage(docs.select("text").mapInArrow(run, STORE), "media")[0]


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a page per document that refers to its text's payload by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for text in batch.column(1).to_pylist():
                n, payload = _padded(text)
                digest = hashlib.sha256(b"%d " % n + payload).hexdigest()
                pages.append(f'<figure><img src="sha256:{digest}" alt="{n} bytes"><figcaption>{html_lib.escape(f"raster of {n} bytes")}</figcaption></figure>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, html string")


def payload_features(store: DataFrame) -> DataFrame:
    """One row per digest with features of the stored bytes as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, media in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = unraster(media)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    found = store.mapInArrow(run, FEATURES)
    names = [c for c in found.columns if c != "digest"]
    # Copies of one digest agree in every column.
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in names))


def resolve(sequenced: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """Every element of every sequence with the media columns of its digest (or nulls)."""
    flat = sequenced.select(key, F.explode("elements").alias("e")).select(key, "e.*")
    return flat.join(media, "digest", "left")


def page_media(pages: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(page_id, position, kind, text, digest, caption, and the media columns where
    ``media`` is given): every element of every page in its place."""
    found = sequences(storage.bounded(pages).select("page_id", "html"))
    if media is not None:
        return resolve(found, "page_id", media)
    return found.select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")


def document_media(docs: DataFrame) -> DataFrame:
    """Every text of ``docs`` stored as media, referred to, resolved and described."""
    features, _ = storage.stage(payload_features(store_texts(docs)), "media-features")
    placed, _ = storage.stage(sequences(references(docs), "doc_id"), "media-sequences")
    placed = resolve(placed, "doc_id", features)
    columns: list[Column | str] = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"]
    return placed.where(F.col("kind") == "img").select(*columns)
