"""Toxicity by compression distance: two zstandard dictionaries and calibrated window thresholds.

A window is one word (at most 48 bytes, A-Z lower-cased), framed by word marks. One dictionary is
trained on the windows of ordinary texts, the other on those of toxic texts, weighted by how much
likelier their starts are there: most windows of a toxic text are as ordinary as any. A window is
compressed with each, and where the toxic dictionary saves at least a threshold more bytes, it counts
as toxic. The threshold and a logistic curve over a text's toxic windows (how many, and how dense) are
calibrated on labelled texts that no dictionary was trained on.

A few bytes are too short to compress, so each byte is written as a two-byte code word and each window
ends in a trailer that both dictionaries hold: a shared stem of four letters then outweighs the cost of
a match, and lengths differ by what the dictionaries know instead of by block headers.

Labels are learnt from a bounded sample (`max_docs` documents of each class and `max_bytes` of text, by
the hash of their ids), and each dictionary from DRAWS windows, drawn before they are framed. Scoring
covers every word of every text.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramwell.llm.textbytes import column, sliced
from gramwell.llm.workers import lean

PIECE = re.compile(rb"[0-9a-z\x80-\xff]{1,48}")
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT_BYTES, SEED = 100_000, 8_192, 64, 7
#: Bounds of what labels are learnt from: documents of each class, bytes of their texts, windows that a dictionary is trained on.
MAX_DOCS, MAX_BYTES, DRAWS = 3_000, 48 << 20, 300_000
#: Lengths of the starts of windows whose rates in both classes are compared, in bytes; toxic texts that a start needs, and how many times likelier it must be there.
STARTS, LEAST_TEXTS, LEAST_RATIO, LEAST_STRENGTH = (4, 10), 3, 8, 0.02
#: Window thresholds tried, and the score from which a text counts as toxic.
THRESHOLDS, CUT = tuple(range(2, 13)), 0.7
REMEMBERED = 400_000

_codes = random.Random(SEED)
CODE = [_codes.randbytes(2) for _ in range(256)]
TRAILER = _codes.randbytes(24)
_SPACE = CODE[32]


def pieces(text: bytes) -> list[bytes]:
    return PIECE.findall(text.lower())


def framed(piece: bytes) -> bytes:
    return _SPACE + b"".join([CODE[b] for b in piece]) + _SPACE + TRAILER


def compressor(dictionary: bytes):
    import zstandard as z

    held = z.ZstdCompressionDict(dictionary)
    p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=6, strategy=z.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14, search_log=5)
    held.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=held, compression_params=p)


def trained(weights: Counter, size: int, rnd: random.Random) -> bytes:
    """A dictionary over windows, drawn in proportion to their weights, DRAWS in all at most."""
    import zstandard as z

    total = sum(weights.values())
    share = min(1.0, DRAWS / max(1, total))
    drawn: list[bytes] = []
    for w, k in sorted(weights.items()):
        drawn += [w] * int(k * share + rnd.random())
    rnd.shuffle(drawn)
    lines = [b"".join(map(framed, drawn[i : i + 8])) for i in range(0, len(drawn), 8)]
    try:
        return z.train_dictionary(size, lines, k=SEGMENT_BYTES, d=8).as_bytes()
    except z.ZstdError:  # too few samples for the trainer: the windows themselves are the dictionary
        return TRAILER + b"".join(framed(w) for w, _ in weights.most_common(size // 40)) + TRAILER


def starts(own: set[bytes]) -> set[bytes]:
    return {w[:n] for w in own for n in range(STARTS[0], min(len(w), STARTS[1]) + 1)}


def toxic_weights(train: list[tuple[bytes, int]], seen: Counter) -> Counter:
    """Weights of the windows of toxic texts, by their strongest start: how many toxic texts have it, times the log of how much likelier it is there.

    Rates are smoothed, so that a window of a few ordinary texts, as of a wrong label, still counts.
    Starts of fewer than LEAST_TEXTS toxic texts, or not LEAST_RATIO times likelier, have no strength,
    and windows of less than LEAST_STRENGTH of the strongest are left out.
    """
    toxic: Counter = Counter()
    for text, y in train:
        if y:
            toxic.update(starts(set(pieces(text))))
    toxic = Counter({w: k for w, k in toxic.items() if k >= LEAST_TEXTS})
    ordinary: Counter = Counter()
    for text, y in train:
        if not y:
            ordinary.update(starts(set(pieces(text))) & toxic.keys())
    n = sum(y for _, y in train)
    ratio = {x: ((k + 0.5) / (n + 1)) / ((ordinary[x] + 0.5) / (len(train) - n + 1)) for x, k in toxic.items()}
    strength = {x: toxic[x] * math.log(r) for x, r in ratio.items() if r >= LEAST_RATIO}
    least = LEAST_STRENGTH * max(strength.values(), default=0.0)
    best = {w: max((strength.get(x, 0.0) for x in starts({w})), default=0.0) for w in seen}
    return Counter({w: k * best[w] for w, k in seen.items() if best[w] > 0 and best[w] >= least})


@dataclass
class Model:
    """Two dictionaries, the window threshold and the logistic curve. Bounded: about 110 KB."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    curve: tuple[float, float, float]
    known: bool = True

    def difference(self):
        """A function of a piece: bytes that the toxic dictionary saves more than the ordinary one."""
        a, b = compressor(self.ordinary), compressor(self.toxic)
        return lambda piece: len(a.compress(x := framed(piece))) - len(b.compress(x))

    def score(self, toxic: int, total: int) -> float:
        x = features(np.array([toxic]), np.array([total]))[0] @ np.array(self.curve)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def features(toxic: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(toxic)), np.log1p(toxic), np.log1p(100 * toxic / (total + 20))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Coefficients, kept from falling in the two features, and the mean log loss."""
    w = np.zeros(x.shape[1])
    use = np.ones(x.shape[1], bool)
    for _ in range(2):
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w[use], -30, 30)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + ridge * np.eye(use.sum())
            step = np.linalg.solve(h, x[:, use].T @ (y - p) - ridge * w[use])
            w[use] += step
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            break
        use[1:] &= w[1:] >= 0
    w[1:] = np.maximum(w[1:], 0)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, label) rows; of every three rows, two train the dictionaries and one calibrates.

    Without rows of both classes every text scores 0.
    """
    train = [r for k, r in enumerate(rows) if k % 3]
    held = [r for k, r in enumerate(rows) if k % 3 == 0] if len(rows) >= 60 else rows
    train = train if len(rows) >= 60 else rows
    if len({y for _, y in train}) < 2 or len({y for _, y in held}) < 2:
        return Model(b"", b"", 0, (0.0, 0.0, 0.0), False)
    rnd = random.Random(SEED)
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for text, y in train:
        seen[y].update(set(pieces(text)))
    ordinary = seen[0]
    likely = toxic_weights(train, seen[1])
    bad = trained(likely, TOXIC_BYTES, rnd)
    good = trained(ordinary, ORDINARY_BYTES, rnd)
    for _ in range(2):  # ordinary windows that look toxic count more in the ordinary dictionary, unless they are likelier in toxic texts
        d = Model(good, bad, 0, (0, 0, 0)).difference()
        alarms = [w for w in ordinary if w not in likely and d(w) >= 2]
        if not alarms:
            break
        for w in alarms:
            ordinary[w] = max(200, ordinary[w] * 4)
        good = trained(ordinary, ORDINARY_BYTES, rnd)
    d, cache = Model(good, bad, 0, (0, 0, 0)).difference(), {}
    table = np.zeros((len(held), len(THRESHOLDS)))
    total = np.zeros(len(held))
    for k, (text, _) in enumerate(held):
        own = pieces(text)
        for w in own:
            if w not in cache:
                cache[w] = d(w)
        values = np.array([cache[w] for w in own] or [-99])
        total[k] = len(own)
        table[k] = [(values >= t).sum() for t in THRESHOLDS]
    y = np.array([v for _, v in held], float)
    fits = [(logistic(features(table[:, k], total), y), t) for k, t in enumerate(THRESHOLDS)]
    (curve, _), threshold = min(fits, key=lambda f: f[0][1])
    return Model(good, bad, threshold, tuple(float(c) for c in curve))


def learn(docs: DataFrame, labels: DataFrame, usable=None, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model of the labelled docs among those with `usable` (a Column over the id), `max_docs` of each class at most.

    Ids are chosen in the labels by their hash, and of their texts those that fit into `max_bytes` in that
    order; what reaches the driver is bounded by both. 2 * max_docs ids are broadcast. Null ids, labels
    and texts are left out; of repeated labels of an id the largest holds.
    """
    ids = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if usable is not None:
        ids = ids.where(usable(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y"))
    order = F.xxhash64("_id")
    chosen = ids.where("_y = 0").orderBy(order, "_id").limit(max_docs).unionByName(ids.where("_y = 1").orderBy(order, "_id").limit(max_docs))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where("_text is not null")
    known = texts.join(F.broadcast(chosen), "_id")
    # several texts of one id count once, by the least of their hashes
    sizes = known.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.octet_length("_text").alias("n"))).alias("t"), F.first("_y").alias("_y")).select("_id", "t.h", "t.n", "_y", order.alias("o")).collect()
    taken, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["o"], str(r["_id"]))):
        if held + r["n"] <= max_bytes:
            held += r["n"]
            taken.append((r["_id"], r["h"], r["_y"]))
    kind = docs.schema[id_column].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(taken, f"_id {kind}, _h bigint, _y int")
    rows = texts.join(F.broadcast(wanted), "_id").where(F.xxhash64("_text") == F.col("_h")).select("_id", "_text", "_y").dropDuplicates(["_id"])
    got = [(str(r["_id"]), r["_text"].encode(), r["_y"]) for r in rows.toLocalIterator()]
    got.sort()
    random.Random(SEED).shuffle(got)
    return fit([(text, y) for _, text, y in got])


class _Judged(dict):
    """Piece: whether it is a toxic window; forgets everything when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.difference, self.threshold = model.difference(), model.threshold

    def __missing__(self, piece: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = self.difference(piece) >= self.threshold
        return out


_judged: dict[int, _Judged] = {}


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), text_column: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """Columns `keep` of docs, n_windows, n_toxic and score (0 to 1), one row per row of docs.

    Null texts count as empty; texts without a window get the curve's value at none. Kept columns named
    n_windows, n_toxic or score give way to the results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep and f.name not in ("n_windows", "n_toxic", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        key = hash((m.ordinary, m.toxic, m.threshold))
        if m.known and key not in _judged:
            _judged.clear()
            _judged[key] = _Judged(m)
        judge = _judged[key].__getitem__ if m.known else None
        for whole in batches:
            for b in sliced(whole, "_text", slice_bytes):
                n, bad, score = [], [], []
                for text in column(b, "_text").cast(pa.binary()).to_pylist():
                    own = pieces(text)
                    n.append(len(own))
                    bad.append(sum(map(judge, own)) if judge else 0)
                    score.append(m.score(bad[-1], n[-1]) if judge else 0.0)
                cols = [b.column(b.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(score, pa.float64())], [*[f.name for f in fields], "n_windows", "n_toxic", "score"])

    schema = T.StructType([*fields, T.StructField("n_windows", T.LongType()), T.StructField("n_toxic", T.LongType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_column).alias("_text")).mapInArrow(lean(score), schema)


def fold(doc_id):
    """crc32 of the id as text, modulo 3; a null id has that of an empty text, 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(docs, labels, lambda i: fold(i) != 1)
    out = score_texts(docs, model, keep=("doc_id",))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_windows", "n_toxic")
