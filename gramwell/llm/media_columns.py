"""Media columns: interleaved document sequences whose media are resolved by digest.

HTML is parsed into an ordered array of text and media-reference structs; a reference carries the
digest of its payload and its caption. Payloads are stored losslessly as grey-scale PNG pictures of
8-bit samples, 64 to a row, under the SHA-256 of their unpadded bytes, and are read back from that
store. A join on the digest resolves the references; positions and captions stay with them.

The join moves digests and features, never payloads. Features are written, one row a digest, before they
are joined, so that both sides are dealt out for the join alone and Spark can split the references to a
digest that many documents share.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramwell.llm.store import written
from gramwell.llm.textbytes import column, sliced

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PARTS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption")]]))
ARROW_PARTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
SCHEME = "sha256:"


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW if data else ROW)


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey-scale picture with one payload byte a sample."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a picture made by to_png; raises ValueError on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, height = 8, b"", 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean, entropy (bits) and share of zeros of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = float(counts @ np.arange(256)) / len(payload)
    return f"h={len(payload) // ROW};mean={mean:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};zero={counts[0] / len(payload):.4f}"


class _Sequence(HTMLParser):
    """Ordered parts of a page: runs of text, and pictures with the caption of their figure or their alt.

    A caption outside a figure, or of one without media, is text. A figure that isn't closed ends with the
    page or with the next one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skip, self.figure, self.caption, self.captioned = 0, None, None, None

    def end_figure(self):
        """A figure's caption goes to all media in it, before and after; without media it is text."""
        if self.caption is not None:
            self.handle_endtag("figcaption")
        self.flush()
        if self.figure is not None and self.captioned is not None:
            media = [part for part in self.parts[self.figure :] if part["kind"] == "media"]
            for part in media:
                part["caption"] = self.captioned
            if not media:
                self.text = [self.captioned]
                self.flush()
        self.figure = self.captioned = None

    def flush(self):
        if text := " ".join("".join(self.text).split()):
            self.parts.append({"position": 0, "kind": "text", "text": text, "digest": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in ("script", "style", "template"):
            self.skip += 1
        elif tag in ("img", "source", "video", "audio") and (src := at.get("src")):
            self.flush()
            digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            self.parts.append({"position": 0, "kind": "media", "text": None, "digest": digest, "caption": at.get("alt")})
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "td", "article"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure is not None:
                self.captioned = caption
            elif caption:
                self.text = [caption]
                self.flush()
        elif tag == "figure":
            self.end_figure()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "td", "article"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parts_of(html: str) -> list[dict]:
    p = _Sequence()
    p.feed(html)
    p.close()
    p.end_figure()
    return [part | {"position": k} for k, part in enumerate(p.parts)]


def interleave(pages: DataFrame, html_column: str = "html", out: str = "parts", slice_bytes: int = 4 << 20) -> DataFrame:
    """pages with `out`: the ordered text and media structs of each page.

    A null or empty page has no parts; repeated pages get the same ones. A media source that isn't a
    digest is given the digest of its address.
    """
    if out in pages.columns:
        raise ValueError(f"the pages have a column {out}")
    schema = T.StructType([*pages.schema.fields, T.StructField(out, PARTS)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, html_column, slice_bytes):
                parts = pa.array([parts_of(x) for x in column(b, html_column).to_pylist()], ARROW_PARTS)
                yield pa.RecordBatch.from_arrays([*b.columns, parts], [*b.schema.names, out])

    return pages.mapInArrow(parse, schema)


def store_payloads(docs: DataFrame, text_column: str = "text", slice_bytes: int = 4 << 20, remembered: int = 200_000) -> DataFrame:
    """The written store: digest, n_bytes, media. A digest may stand in it more than once, from several tasks.

    Null texts count as empty. Within a task the last `remembered` digests are not stored again.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for whole in batches:
            for b in sliced(whole, "_text", slice_bytes):
                rows = []
                for text in column(b, "_text").cast(pa.binary()).to_pylist():
                    if (key := hashlib.sha256(text).digest()) not in seen:
                        seen[key] = None
                        rows.append((key.hex(), len(text), to_png(padded(text))))
                        if len(seen) > remembered:
                            seen.pop(next(iter(seen)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["digest", "n_bytes", "media"])

    return written(docs.select(F.col(text_column).alias("_text")).mapInArrow(store, "digest string, n_bytes long, media binary"), "media")


def read_features(store: DataFrame) -> DataFrame:
    """Features of every stored payload as it is read back; one row a digest."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, "media", 4 << 20)):
            rows = []
            for digest, n, media in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("digest", "n_bytes", "media")), strict=True):
                payload = from_png(media)
                if hashlib.sha256(payload[:n]).hexdigest() != digest:
                    raise ValueError(f"the store's {digest} reads back otherwise")
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))
    rows = store.mapInArrow(read, schema)
    return written(rows.groupBy("digest").agg(*[F.min(n).alias(n) for n in names[1:]]), "features")


def resolve(sequences: DataFrame, features: DataFrame, keep: tuple[str, ...], parts_column: str = "parts") -> DataFrame:
    """One row per media reference: columns `keep`, position, caption, and the features of its digest (null if not stored)."""
    refs = sequences.select(*[F.col(f"`{k}`") for k in keep], F.explode(F.filter(parts_column, lambda x: x["kind"] == "media")).alias("_ref"))
    refs = refs.select(*[F.col(f"`{k}`") for k in keep], F.col("_ref.position").alias("position"), F.col("_ref.caption").alias("caption"), F.col("_ref.digest").alias("digest"))
    return refs.join(features, "digest", "left")


def document_pages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A page for each document that refers to the document's text as a stored payload."""
    digest = F.sha2(F.coalesce(F.col(text_column), F.lit("")).cast("binary"), 256)
    html = F.concat(F.lit("<article><figure><img src='" + SCHEME), digest, F.lit("'><figcaption>document text</figcaption></figure></article>"))
    return docs.select(F.col(id_column), html.alias("html"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    features = read_features(store_payloads(docs))
    found = resolve(interleave(document_pages(docs)), features, ("doc_id",))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
