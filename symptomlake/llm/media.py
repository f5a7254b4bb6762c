"""Interleaved document sequences: ordered text and media references parsed from HTML, payloads joined by digest.

``sequences`` parses pages into one array of items per page. An item has a position (0, 1, ... in document order over
text and media alike), a kind (``text`` or ``media``), its text, and for media the reference, the digest named in it
and the caption (``figcaption`` of the same figure, else ``alt``, else ``title``). ``references`` gives one row per
media item, ``resolve`` joins a payload table by digest and leaves position and caption as they are, so text and media
stay aligned; a reference without a payload keeps its row with null payload columns.

The payload table stores bytes losslessly as the 8-bit grey samples of a PNG picture, 64 samples a row, padded with
zero bytes to whole rows (one row at least); a text chunk keeps the unpadded length. Equal payloads are stored once.

Nulls and edges: a null page has no items and a null text is empty; broken markup loses no text: an open caption ends with its figure, with the next block that is none of those a caption
holds, or with the page; a caption outside a figure, or of one without media, is text, and what an unclosed ``noscript`` or ``template``
hides is text again at the end of the page; the length
of a text is not limited; equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .order import stored

ITEM = "struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>"
WIDTH = 64
DIGEST = "sha256:"
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead "
                   "title tr ul".split())
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
#: Blocks that a caption may hold.
INSIDE = frozenset("br p div ul ol li dl dt dd blockquote pre".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))


# -- parsing ----------------------------------------------------------------

class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.veiled: list[str] = []  # what an element that hides its text has held so far
        self.figures: list[list[dict]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def end_caption(self) -> None:
        """The open caption belongs to its figure."""
        if self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            if said:
                self.figures[-1].append({"caption": said})

    def end_figure(self) -> None:
        """The first caption is that of the figure's media; what captions nothing is text."""
        self.end_caption()
        found = self.figures.pop()
        media, said = [x for x in found if "kind" in x], [x["caption"] for x in found if "kind" not in x]
        for item in media:
            item["caption"] = said[0] if said else item["caption"]
        self.items += [{"kind": "text", "text": x} for x in said[1 if media else 0:]]

    def finish(self) -> None:
        """The end of the page closes whatever is open."""
        self.end_caption()
        while self.figures:
            self.end_figure()
        if self.hidden:
            self.text += self.veiled
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            named = a.get("data-digest") or (src[len(DIGEST):] if src.startswith(DIGEST) else None)
            item = {"kind": "media", "src": src, "digest": named, "caption": a.get("alt") or a.get("title")}
            self.items.append(item)
            if self.figures:
                self.figures[-1].append(item)
        elif tag in BLOCKS:
            if tag not in INSIDE:
                self.end_caption()
            self.flush()
            if tag == "figure":
                self.figures.append([])
            elif tag == "figcaption":
                self.end_caption()
                self.caption = [] if self.figures else None

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            if not self.hidden:
                self.veiled.clear()
        elif tag in BLOCKS:
            if tag == "figcaption":
                self.end_caption()
            elif tag == "figure" and self.figures:
                self.end_figure()
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            if not self.cdata_elem:  # scripts and styles are no text
                self.veiled.append(data)
        elif self.caption is not None:
            self.caption.append(data)
        else:
            self.text.append(data)


def parse_page(page: str | None) -> list[dict]:
    """The items of one page, in document order, with their positions."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.finish()
    return [{"position": k, "kind": None, "text": None, "src": None, "digest": None, "caption": None} | item
            for k, item in enumerate(reader.items)]


def page_of(text: str, digest: str) -> str:
    """A page with one paragraph for each line of a text, and its payload as a captioned figure below."""
    lines = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n"))
    return (f'<article>{lines}<figure><img src="{DIGEST}{digest}">'
            f"<figcaption>payload {digest[:12]}</figcaption></figure></article>")


_ITEM_TYPE = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()),
                        ("digest", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key`` and ``items``, the ordered sequence of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in arrays.runs(batch, page):
                items = [parse_page(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(_ITEM_TYPE))], [key, "items"])
    return pages.select(key, page).mapInArrow(run, f"{key} {kind}, items array<{ITEM}>")


def references(seqs: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each media item, with the number of items of its sequence."""
    at = seqs.select(key, F.size("items").alias("n_items"),
                     F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return at.select(key, "n_items", "item.position", "item.src", "item.digest", "item.caption")


def resolve(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """References with the columns of the payload of the same digest.

    Both sides are plain shuffles on the digest, so adaptive execution splits
    a digest that most references name.
    """
    return refs.join(payloads, "digest", "left")


# -- payloads ---------------------------------------------------------------

def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_png(raw: bytes) -> bytes:
    """The bytes as an 8-bit grey picture."""
    grid = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(grid), WIDTH + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = grid
    return (b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(grid), 8, 0, 0, 0, 0))
            + _chunk(b"tEXt", b"Length\x00%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3))
            + _chunk(b"IEND", b""))


def from_png(png: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of a stored picture; every chunk's checksum is verified."""
    at, packed, length, height = 8, [], None, 0
    while at < len(png):
        size, = struct.unpack_from(">I", png, at)
        name, body = png[at + 4:at + 8], png[at + 8:at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(name + body):
            raise ValueError(f"checksum of {name!r}")
        if name == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif name == b"tEXt":
            length = int(body.split(b"\x00")[1])
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter other than none")
    return lines[:, 1:].tobytes(), length


def payload_table(docs: DataFrame) -> DataFrame:
    """``digest`` and ``media`` (the stored picture) of each different text, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                raw, seen = data.tobytes(), {}
                for k in range(part.num_rows):
                    png = to_png(raw[at[k]:at[k + 1]])
                    seen[hashlib.sha256(png).hexdigest()] = png
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()),
                                                  pa.array(list(seen.values()), pa.binary())], ["digest", "media"])
    return docs.select("text").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def text_pages(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``html``: each document as a page that names its payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in arrays.runs(batch):
                pages = [page_of(x or "", hashlib.sha256(to_png((x or "").encode())).hexdigest())
                         for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string())], ["doc_id", "html"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, html string")


FEATURES = ("digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
            "media_bytes long, media_sha256 string, samples string")


def features(payloads: DataFrame) -> DataFrame:
    """Each stored picture, read back: sizes, checksums and a line about its samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, png in zip(batch.column(0), batch.column(1)):
                png = png.as_py()
                samples, length = from_png(png)
                grey = np.frombuffer(samples, np.uint8)
                rows.append((digest.as_py(), length, len(samples), hashlib.sha256(samples).hexdigest(),
                             zlib.crc32(samples[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(),
                             f"{WIDTH}x{len(samples) // WIDTH} sum={int(grey.sum(dtype=np.int64))} "
                             f"max={int(grey.max())} tones={int(np.count_nonzero(np.bincount(grey)))}"))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [x.split()[0] for x in FEATURES.split(", ")])
    return payloads.select("digest", "media").mapInArrow(run, FEATURES)


def document_media(docs: DataFrame) -> DataFrame:
    """Every text as a stored payload, found again through its page's sequence; one row per document."""
    known = stored(features(payload_table(docs)), "media-features")
    refs = references(sequences(text_pages(docs), "doc_id"), "doc_id")
    return resolve(refs, known).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(" ", "samples", F.concat(F.lit("at="), "position", F.lit("/"), "n_items"), "caption").alias("feature"),
        "position", "caption")
