"""Benchmark decontamination: Wu-Manber search for all windows of all benchmark items at once.

Texts are sequences of words, and a window is `window` consecutive words of an item (an item of fewer
words is one window). For the windows of one length m a shift table, indexed by the hash of a block of
two words, tells how far a search that sees this block at the end of its m words may move on. Where
the shift is 0, the same hash names the bucket of windows that end in such a block, and each of those
is compared word by word, then byte by byte. All segments of a batch of documents move on in step, so
that the loop is over moves, not over words.

Benchmark words and windows are broadcast: `max_window_words` bounds them, and a larger benchmark is
searched in parts, one pass over the documents each. A pass is written and its broadcast let go before
the next one, so that one part is held at a time; the results of the passes are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramwell.llm.store import forget, written
from gramwell.llm.textbytes import LOWER, WORD, column, flat, sliced, word_prints, words

WINDOW, BLOCK, SEGMENT, TABLE_BITS = 8, 2, 128, 18

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def block_hash(ids: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """Table index of the b words from each place."""
    h = ids[at].astype(np.uint64)
    if b == 2:
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + 1].astype(np.uint64)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Group:
    """The distinct windows of one length, ordered by the hash of their last block."""

    m: int
    b: int
    shift: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    items: list[list[int]]
    text: list[bytes]


@dataclass
class Patterns:
    """Everything that a search needs of a benchmark: word fingerprints (ids from 1) and a Group a length."""

    prints: np.ndarray
    groups: list[Group] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    seed: int = 0

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW, least_words: int = 1) -> Patterns:
        """items: (name, text); those of fewer than least_words words have no window.

        Fingerprints are seeded anew until all different words have different ones, so that an id is a
        word. A document's word with the same fingerprint may be another one; bytes are compared there.
        """
        data, offs = flat(pa.array([t for _, t in items], pa.string()))
        starts, ends, firsts = words(data, offs, WORD)
        low = LOWER[data].tobytes()
        distinct, seed = len({low[s:e] for s, e in zip(starts, ends, strict=True)}), 0
        while len(known := np.unique(prints := word_prints(data, starts, ends, seed))) < distinct:
            seed += 1
        ids = np.searchsorted(known, prints) + 1
        found: dict[int, dict[tuple, tuple[bytes, list[int]]]] = {}
        for k in range(len(items)):
            a, z = firsts[k], firsts[k + 1]
            m = min(window, int(z - a))
            for p in range(a, z - m + 1) if m >= max(1, least_words) else ():
                own = found.setdefault(m, {}).setdefault(tuple(ids[p : p + m].tolist()), (b" ".join(low[s:e] for s, e in zip(starts[p : p + m], ends[p : p + m], strict=True)), []))[1]
                if not own or own[-1] != k:
                    own.append(k)
        out = cls(known, [], [n for n, _ in items], seed)
        for m, table in sorted(found.items()):
            b = min(BLOCK, m)
            rows = np.array(list(table), np.int64).reshape(-1, m)
            shift = np.full(1 << TABLE_BITS, m - b + 1, np.int8)
            for j in range(m - b + 1):
                np.minimum.at(shift, block_hash(rows.T.reshape(-1), j * len(rows) + np.arange(len(rows)), 1) if b == 1 else _pair_hash(rows[:, j], rows[:, j + 1]), m - b - j)
            last = block_hash(rows[:, m - 1], np.arange(len(rows)), 1) if b == 1 else _pair_hash(rows[:, m - 2], rows[:, m - 1])
            order = np.argsort(last, kind="stable")
            values = list(table.values())
            first = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1))
            out.groups.append(Group(m, b, shift, rows[order], first, [values[i][1] for i in order], [values[i][0] for i in order]))
        return out

    def ids(self, prints: np.ndarray) -> np.ndarray:
        """Word ids; 0 for words that no item has."""
        if not len(self.prints) or not len(prints):
            return np.zeros(len(prints), np.int64)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[at] == prints, at + 1, 0)


def _pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = np.stack([x, y], 1).reshape(-1)
    return block_hash(both, np.arange(0, len(both), 2), 2)


def search(group: Group, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence, never across documents; word ids are compared."""
    counts = np.maximum(np.diff(firsts) - group.m + 1, 0)
    pieces = -(-counts // SEGMENT)
    doc = np.repeat(np.arange(len(counts)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = firsts[doc] + k * SEGMENT
    end = np.minimum(at + SEGMENT, firsts[doc] + counts[doc])
    places, windows = [], []
    while len(at):
        h = block_hash(ids, at + group.m - group.b, group.b)
        move = group.shift[h].astype(np.int64)
        if (zero := np.flatnonzero(move == 0)).size:
            lo, n = group.first[h[zero]], group.first[h[zero] + 1] - group.first[h[zero]]
            place = np.repeat(at[zero], n)
            which = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            for j in range(group.m):
                same = ids[place + j] == group.rows[which, j]
                place, which = place[same], which[same]
            places.append(place)
            windows.append(which)
        at = at + np.maximum(move, 1)
        going = at < end
        at, end = at[going], end[going]
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(windows)) if places else (none, none)


def matches(patterns: Patterns, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[list[int]], np.ndarray]:
    """Of each text: its number of words, which of its words are hit, and the items found; first words."""
    data, offs = flat(texts)
    starts, ends, firsts = words(data, offs, WORD)
    ids = patterns.ids(word_prints(data, starts, ends, patterns.seed))
    cover = np.zeros(len(ids) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(texts))]
    low = None
    for g in patterns.groups:
        place, which = search(g, ids, firsts)
        if not len(place):
            continue
        low = LOWER[data].tobytes() if low is None else low
        owner = np.searchsorted(firsts, place, side="right") - 1
        good = np.zeros(len(place), bool)
        for k, (p, w) in enumerate(zip(place.tolist(), which.tolist(), strict=True)):
            # direct comparison of the words' bytes
            if b" ".join(low[s:e] for s, e in zip(starts[p : p + g.m], ends[p : p + g.m], strict=True)) == g.text[w]:
                good[k] = True
                items[owner[k]].update(g.items[w])
        np.add.at(cover, place[good], 1)
        np.add.at(cover, place[good] + g.m, -1)
    return np.diff(firsts), np.cumsum(cover[:-1]) > 0, items, firsts


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", keep: tuple[str, ...] = (), max_window_words: int = 4_000_000, slice_bytes: int = 4 << 20, least_words: int = 1) -> DataFrame:
    """Columns `keep` of docs, n_words, hit_spans (runs of hit words, from 0, end exclusive) and items (names, sorted).

    items: item_column (any type, named by its string) and text. Null texts have no words; items
    without words, or with fewer than least_words, have no window; items of one name count once. One row
    per row of docs. Kept columns named n_words, hit_spans or items give way to the results.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_column).cast("string").alias("n"), F.coalesce(F.col("text"), F.lit("")).alias("t")).where("n is not null")
    size = rows.agg(F.sum(F.length("t")).alias("s")).first()["s"] or 0
    parts = max(1, -(-int(size) // (2 * max_window_words)))
    out = None
    fields = [f for f in docs.schema.fields if f.name in keep and f.name not in ("n_words", "hit_spans", "items")]
    key = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_column).alias("_text"))
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(Patterns.of([(r["n"], r["t"]) for r in own.collect()], window, least_words))
        found = _pass(key, fields, held, slice_bytes, parts > 1)
        if parts == 1:
            return found
        found = written(found, "found")
        held.destroy()
        if out is not None:
            before, found = (out, found), written(_merged(out, found, fields), "merged")
            forget(*before)
        out = found
    return out.drop("_key")


def _pass(docs: DataFrame, fields: list, held, slice_bytes: int, keyed: bool) -> DataFrame:
    names = [f.name for f in fields]
    if keyed:
        docs = docs.withColumn("_key", F.xxhash64(F.col("_text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        for whole in batches:
            for b in sliced(whole, "_text", slice_bytes):
                n, hit, found, firsts = matches(patterns, column(b, "_text"))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for s, e in edges.reshape(-1, 2).tolist():
                    while s < e:
                        d = int(np.searchsorted(firsts, s, side="right")) - 1
                        stop = min(e, int(firsts[d + 1]))
                        spans[d].append({"start": s - int(firsts[d]), "end": stop - int(firsts[d])})
                        s = stop
                cols = [b.column(b.schema.get_field_index(x)) for x in names]
                cols += [b.column(b.schema.get_field_index("_key"))] if keyed else []
                cols += [pa.array(n, pa.int64()), pa.array(spans, ARROW_SPANS), pa.array([sorted({patterns.names[i] for i in x}) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*names, *["_key"] * keyed, "n_words", "hit_spans", "items"])

    schema = T.StructType([*fields, *[T.StructField("_key", T.LongType())] * keyed, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(scan, schema)


def _merged(x: DataFrame, y: DataFrame, fields: list) -> DataFrame:
    """Both passes' findings for each row: rows with equal kept columns and text have equal findings."""
    by = [*[f.name for f in fields], "_key"]
    both = x.withColumn("_side", F.lit(0)).unionByName(y.withColumn("_side", F.lit(1))).groupBy(*[F.col(f"`{c}`") for c in by])
    one = both.agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("hit_spans"))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum(1 - F.col("_side")).alias("_n"))
    return one.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n").withColumn("hit_spans", union_spans("hit_spans"))


def union_spans(spans: str):
    """Overlapping or touching spans as one, by start."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, add)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id",))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))
