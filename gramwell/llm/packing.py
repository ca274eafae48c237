"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Texts are tokenised once; a text of more than `capacity` ids is cut into pieces of `capacity`, of which
the first may be shorter. How many pieces have each length is all that the plan needs, so it is made on
at most `capacity` counts at the driver, whatever the number of documents:
1. exact complements: for each length, longest first, a gap is looked up among the available single
   lengths, sums of two and sums of three, and combinations that fill it exactly are consumed, as often
   as their counts allow;
2. best fit for what is left: longest first, into the smallest gap that takes it.
A plan entry gives a run of sequences one slot: (length, first rank, count, first sequence, offset). A
piece finds its slot by its length and its rank among the pieces of its length. Ranks come from counts
by task and length, summed over tasks; ids never move between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramwell.llm.store import written
from gramwell.llm.textbytes import column, sliced
from gramwell.llm.tokens import default_vocabulary, encoder

CAPACITY, END_ID = 1024, 2


def fill(counts: np.ndarray, gap: int, most: int, parts: int) -> tuple[int, ...] | None:
    """Up to three available lengths of at most `most` that sum to the gap exactly, longest first; None if none do."""
    free = counts[: most + 1]
    if gap <= most and free[gap] > 0 and parts >= 1:
        return (gap,)
    have = np.flatnonzero(free > 0)
    if parts >= 2:
        a = have[(have < gap) & (have * 2 >= gap)]
        b = gap - a
        ok = (b <= most) & (free[np.minimum(b, most)] > 0) & ((a != b) | (free[a] > 1))
        if ok.any():
            k = np.flatnonzero(ok)[-1]
            return int(a[k]), int(b[k])
    if parts >= 3:
        for a in have[(have < gap) & (have * 3 >= gap)][::-1].tolist():
            free[a] -= 1
            pair = fill(counts, gap - a, min(a, most), 2) if counts[: gap - a + 1].any() else None
            free[a] += 1
            if pair and len(pair) == 2:
                return (a, *pair)
    return None


def exact(counts: np.ndarray, capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Consumes combinations that fill a sequence exactly, as often as counts allow: (lengths, how many)."""
    made = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            rest = () if length == capacity else fill(counts, capacity - length, length, parts)
            counts[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            n = min(int(counts[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                counts[x] -= n
            made.append((lengths, n))
    return made


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, into the smallest gap that takes it; sequences of one content are handled together."""
    gaps: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, gap = int(counts[length]), length
        while n:
            while gap < capacity and not gaps[gap]:
                gap += 1
            lengths, k = gaps[gap].pop() if gaps[gap] else ((), n)
            free = gap if lengths else capacity
            # one sequence takes pieces until none fits: its gap stays the smallest
            each = min(free // length, n)
            used = min(k, n // each)
            gaps[free - each * length].append((lengths + (length,) * each, used))
            if k > used and lengths:
                gaps[gap].append((lengths, k - used))
            n -= used * each
    return [x for g in gaps for x in g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) that place every piece once.

    Combinations of up to four, three and two pieces are tried, and best fit alone: on few pieces, exact
    triples can use up the short pieces that later gaps need. The plan with the fewest sequences holds,
    of equal ones that with the most exact combinations.
    """
    tried = []
    for parts in (3, 2, 1, 0):
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"a piece of {length} ids")
            counts[length] += n
        made = exact(counts, capacity, parts) if parts else []
        tried.append(made + best_fit(counts, capacity))
    used = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    first = 0
    for lengths, n in min(tried, key=lambda x: sum(n for _, n in x)):
        at = 0
        for x in lengths:
            slots.append((x, int(used[x]), n, first, at))
            used[x] += n
            at += x
        first += n
    return slots


def tokenized(docs: DataFrame, id_column: str, text_column: str, vocabulary: str, capacity: int, end_id: int, slice_bytes: int = 4 << 20) -> DataFrame:
    """The written pieces: id, piece, start, length, ids (packed little-endian 32-bit), task, rank (of the task's pieces of this length)."""
    kind = docs.schema[id_column].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(vocabulary), int(end_id).to_bytes(2, "little")
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for b in sliced(whole, "_text", slice_bytes):
                row, piece, start, length, ids, rank = [], [], [], [], [], []
                for r, text in enumerate(column(b, "_text").to_pylist()):
                    packed = (np.frombuffer(e.encode(text) + end, "<u2").astype("<u4")).tobytes()
                    n = len(packed) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (s, z) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(z - s)
                        ids.append(packed[4 * s : 4 * z])
                        rank.append(int(seen[z - s]))
                        seen[z - s] += 1
                own = b.column(b.schema.get_field_index("_id")).take(pa.array(row, pa.int64()))
                cols = [own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "piece", "start", "length", "ids", "task", "rank"])

    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return written(texts.mapInArrow(cut, f"_id {kind.simpleString()}, piece int, start long, length long, ids binary, task int, rank long"), "pieces")


class Packed:
    """The packed pieces of a table: `pieces` with their ids, and where each goes."""

    def __init__(self, pieces: DataFrame, offsets: DataFrame, slots: list[tuple[int, int, int, int, int]]):
        self.pieces, self.offsets, self.slots = pieces, offsets, slots

    def rows(self, ids: Column | None = None) -> DataFrame:
        """One row per piece: _id, piece, start, length, ids, sequence_id, offset.

        ids: what to return of the column ids (packed little-endian 32-bit), the ids themselves if not
        given. Only this moves in the join on (length, task) that ranks the pieces.
        """
        kept = self.pieces.select("_id", "piece", "start", "length", "task", "rank", (F.col("ids") if ids is None else ids).alias("ids"))
        # the offsets grow with the number of tasks: never broadcast
        both = kept.hint("merge").join(self.offsets, ["length", "task"]).select("_id", "piece", "start", "length", "ids", (F.col("rank") + F.col("before")).alias("rank"))
        # a few thousand slots at most, of 5 numbers each
        held = both.sparkSession.sparkContext.broadcast([np.array(x, np.int64) for x in zip(*self.slots, strict=True)])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            length, first, _, sequence, offset = held.value
            key = length << 40 | first
            for b in batches:
                own, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
                at = np.searchsorted(key, own << 40 | rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*b.schema.names[:5], "sequence_id", "offset"])

        types = dict(both.dtypes)
        return both.mapInArrow(find, f"_id {types['_id']}, piece int, start long, length long, ids {types['ids']}, sequence_id long, offset long") if self.slots else both.select("_id", "piece", "start", "length", "ids", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> Packed:
    """Packs the texts of docs into sequences of at most `capacity` ids.

    Every row of docs gives at least one piece; a null or empty text is the end id alone. Repeated and
    null ids keep their pieces. The pieces of a sequence lie side by side from 0. An empty table packs
    into no sequence.
    """
    pieces = tokenized(docs, id_column, text_column, vocabulary or default_vocabulary(), capacity, end_id)
    by_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    return Packed(pieces, by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), sorted(plan(histogram, capacity)))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.rows(F.crc32("ids")).select(F.col("_id").alias("doc_id"), "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset")
