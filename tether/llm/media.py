"""Interleaved document sequences: ordered text and media references from HTML, payloads resolved by digest.

A media store holds lossless 8-bit RGB images (PNG) by the digest of their samples. HTML is parsed into items in
reading order; an image takes its figure's caption. Items stay rows with their position, so a page of any length and a
payload that many pages use need no group in one task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.llm.kernels import texts_of
from tether.runtime.scratch import Scratch

WIDTH = 64
#: Bytes of a row of samples; payloads are filled up with spaces to a positive multiple.
ROW = 3 * WIDTH
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // ROW))
    return data + b" " * (rows * ROW - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """An RGB image, 64 samples wide, of a payload whose size is a positive multiple of 192."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; ValueError for other or damaged bytes."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("another kind of image")
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean of each channel, and a 64-bit average hash over 8 x 8 cells."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    h = len(x)
    cells = x.reshape(h, 8, 24).sum(axis=2, dtype=np.int64)
    start = np.arange(8) * h // 8
    n = np.maximum(np.diff(np.append(start, h)), 1)
    cells = np.add.reduceat(cells, start, axis=0) / n[:, None]
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    mean = x.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (h * WIDTH)
    return f"{WIDTH}x{h} rgb={mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f} ahash={bits}"


class _Reader(HTMLParser):
    """Items (kind, text, ref, caption) in reading order; text of scripts and styles is left out."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure figcaption footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    MEDIA = frozenset(("img", "video", "audio", "source", "embed"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.skip = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption" and self.figures:
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.items.append(["media", None, a["src"], a.get("alt") or None])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figures[-1] :] if self.figures else []:
                if item[0] == "media" and text:
                    item[3] = text
        elif tag == "figure" and self.figures:
            self.flush()
            self.figures.pop()
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        (self.words if self.caption is None else self.caption).append(data)


def read_html(html: str | None) -> list[list]:
    """Items of a page; broken markup is read as far as it goes, null and empty pages have none."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption:  # a caption that never ends is text
        reader.words += reader.caption
    reader.flush()
    return reader.items


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``<key>, position, kind, text, ref, caption`` of each item of ``pages(<key>, html, ...)``, positions from 0."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, html in enumerate(batch.column(1)):
                for n, item in enumerate(read_html(html.as_py())):
                    keys.append(k)
                    rows.append((n, *item))
            cols = [list(c) for c in zip(*rows)] or [[]] * 5
            types = [pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], [key, "position", "kind", "text", "ref", "caption"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").mapInArrow(run, f"`{key}` {kind}, position int, kind string, text string, ref string, caption string")


def store(payloads: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, n_bytes, digest, media`` of ``payloads(<key>, text, ...)``: the padded text as an image.

    Null text is empty. Within a batch the media is given once for each digest and is null in the rows after it.
    """

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            n, digests, media, seen = [], [], [], set()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                payload = pad(data[a:b].tobytes())
                d = hashlib.sha256(payload).hexdigest()
                n.append(b - a)
                digests.append(d)
                media.append(None if d in seen else encode_png(payload))
                seen.add(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], [key, "n_bytes", "digest", "media"])

    kind = dict(payloads.dtypes)[key]
    return payloads.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, digest string, media binary")


def describe(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row a digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = m.as_py()
                p = decode_png(m)
                rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            cols = [list(c) for c in zip(*rows)] or [[]] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = media.where("media is not null").select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def interleave(pages: DataFrame, described: DataFrame, key: str = "page_id", scheme: str = "sha256:") -> DataFrame:
    """The items of ``sequences`` with what ``described`` knows of the payloads that their refs name.

    References are ``sha256:<digest>``; others and unknown digests stay, with nulls. Every item keeps its position.
    """
    items = sequences(pages, key)
    digest = F.when(F.col("ref").startswith(scheme), F.substring("ref", len(scheme) + 1, 64))
    return items.withColumn("digest", digest).join(described, "digest", "left")


def documents_as_pages(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pages(<key>, n_bytes, html), media(digest, media)) in which each document is a figure with its payload."""
    kept = scratch.save(store(docs, key), "store")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    html = F.concat(F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="sha256:'), F.col("digest"), F.lit('" alt="payload"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return kept.select(key, "n_bytes", html.alias("html")), kept.select("digest", "media")
