"""Secret scans: keyword prefilter, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over a text; a kind's pattern
is then matched only at its keyword's place. Long hexadecimal strings have no keyword; runs of their
bytes are found with array operations over a whole batch, and only texts that hold one are searched.
Tokens that carry a checksum (six base-62 digits of the CRC-32 of the thirty characters before) count
only if it is right; a JSON web token counts only if its header decodes.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramwell.llm.textbytes import column, flat, sliced

#: Base kinds first, then the method's own; spans with one start are listed in this order.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked", "jwt", "pem")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[opsur]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keyword (lower case): kind.
KEYWORDS = dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign") | {"akia": "access", "eyj": "jwt", "-----begin ": "pem"} | dict.fromkeys(("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "npm_"), "checked")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def lowered(text: str) -> str:
    """A-Z lower-cased, all other code points and so all places as they were."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def checksum_holds(body: str, digits: str) -> bool:
    n, want = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        want = DIGITS[d] + want
    return want == digits


def header_decodes(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def match_at(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """End of the kind's match at this place and whether it counts; None without a match."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= LEAST_ASSIGN) if (m := ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= LEAST_ACCESS) if (m := ACCESS.match(text, at)) else None
    if kind == "checked":
        return (m.end(), checksum_holds(m[1], m[2])) if (m := CHECKED.match(text, at)) else None
    if kind == "jwt":
        return (m.end(), header_decodes(m[1])) if (m := JWT.match(text, at)) else None
    return (m.end(), True) if (m := PEM.match(text, at)) else None


def find_secrets(text: str, has_hex: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS; code points, end exclusive.

    Of each kind the leftmost matches that don't overlap, less those that fail its test.
    """
    found, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in automaton().iter(lowered(text)))
    for at, kind in hits:
        if at < free[kind]:
            continue
        if m := match_at(kind, text, at):
            free[kind] = m[0]
            if m[1]:
                found.append((at, KINDS.index(kind), m[0]))
        elif kind == "jwt" and (run := JWT_RUN.match(text, at)):
            free[kind] = run.end()  # what follows the run fails its other keywords alike, so each run is read once
    if has_hex:
        found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[48:58] = _HEX_BYTE[97:103] = True


def with_hex(texts: pa.Array) -> np.ndarray:
    """Which texts hold LEAST_HEX hexadecimal bytes in a row."""
    data, offs = flat(texts)
    other = np.concatenate([[-1], np.flatnonzero(~_HEX_BYTE[data]), [len(data)]])
    out = np.zeros(len(texts), bool)
    for k in np.flatnonzero(np.diff(other) > LEAST_HEX):
        first, last = np.searchsorted(offs, [other[k] + 1, other[k + 1] - 1], side="right") - 1
        for d in range(first, min(last, len(texts) - 1) + 1):
            out[d] |= min(other[k + 1], offs[d + 1]) - max(other[k] + 1, offs[d]) >= LEAST_HEX
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at, n = [], 0, 0
    while n < len(spans):
        kind, start, end = spans[n]
        while n + 1 < len(spans) and spans[n + 1][1] < end:
            n += 1
            end = max(end, spans[n][2])
        out += [text[at:start], f"[{kind}]"]
        at, n = end, n + 1
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = (), redact: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """Columns `keep` of docs and `spans` (kind, start, end), one row per row of docs, in no set order.

    redact: also `redacted`, the text with its secrets replaced (null stays null). A null text counts
    as empty and has no span. Columns that are not kept don't reach Python; kept ones named spans (or
    redacted) give way to the results.
    """
    fields = [f for f in docs.schema.fields if f.name in keep and f.name != "spans" and not (redact and f.name == "redacted")]
    extra = [T.StructField("redacted", T.StringType())] if redact else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "_text", slice_bytes):
                raw = b.column(b.schema.get_field_index("_text"))
                hexed = with_hex(column(b, "_text"))
                texts = raw.to_pylist()
                spans = [find_secrets(t or "", h) for t, h in zip(texts, hexed, strict=True)]
                cols = [b.column(b.schema.get_field_index(f.name)) for f in fields]
                cols.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], ARROW_SPANS))
                if redact:
                    cols.append(pa.array([redacted(t, x) if x else t for t, x in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields] + ["spans"] + ["redacted"] * redact)

    schema = T.StructType([*fields, T.StructField("spans", SPANS), *extra])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_column).alias("_text")).mapInArrow(scan, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=("doc_id",))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
