"""Exact removal of repeated byte strings by a logarithmic family of sorted anchor fingerprints.

Every `span` bytes hold a shortest-fingerprint anchor: the leftmost least fingerprint among their
substrings of `gram` bytes. Equal strings have their anchor at the same offset, so only suffixes that
start at anchors are indexed (about 2 in span - gram + 2). An entry is an anchor's fingerprint, the
fingerprint of its context (the union of the strings that it anchors), and its place.

A batch of documents gives one sorted array of entries in each block of fingerprints. In a block, the
arrays form a logarithmic family: a new one is merge-scanned with the last level while that is of
similar size, geometrically. A scan finds entries of one fingerprint and context; the later ones
repeat and leave the index. When all batches are in, anchors of several contexts remain undecided:
their strings agree in part. The contexts of such anchors meet in their blocks as bytes: a suffix array of
them, sorted by `span` bytes, shows the strings that repeat. Where an anchor has very many contexts its
strings are dealt to other blocks one by one and go through a family by two 64-bit fingerprints.

Entries of the family are ordered by fingerprint, not by byte, since only equal prefixes need to be
neighbours; whole contexts are equal when two 64-bit fingerprints with different bases are. A block holds
a hash range of fingerprints; all entries of a batch are sent, repeats inside it included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.llm.store import partitions_for, small_batches, written
from gramwell.llm.textbytes import BASE_A, BASE_B, BYTE_CODE, between, column, flat, mix, powers, prefix, sliced

SPAN, GRAM = 100, 24
POS_BITS = 22
#: Bytes of texts that make one batch; below 2 ** POS_BITS unless one text is longer.
BATCH_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20

ENTRY = np.dtype([("a", "u8"), ("b", "u8"), ("id", "i8"), ("text", "i8"), ("lo", "i4"), ("n", "i4")])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[p : p + width] for each p where that fits."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    size = -(-len(keys) // width) * width
    full = np.full(size, np.iinfo(keys.dtype).max, keys.dtype)
    full[: len(keys)] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: fingerprint, context's fingerprint, first string, how many, text."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    codes = BYTE_CODE[data]
    one, two = prefix(codes, BASE_A), prefix(codes, BASE_B)
    at = np.arange(len(data) - gram + 1)
    # unmixed: only their order matters, and anchors alone are mixed below
    prints = (one[gram:] - one[:-gram]) * powers(BASE_A, len(one))[1][: len(at)]
    # leftmost of the least by the upper bits; a text longer than 2 ** bits takes more bits
    bits = max(POS_BITS, int(len(data)).bit_length())
    keys = (prints >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    least = sliding_least(keys, span - gram + 1)
    place = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    # strings that start here and end inside the text
    valid = np.zeros(len(place), bool)
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if e - s >= span:
            valid[s : e - span + 1] = True
    start = np.flatnonzero(valid)
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = place[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)])
    first = start[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(start)]]))
    anchor = anchor[new]
    context = between(two, first, first + count - 1 + span, BASE_B)
    shape = ((anchor - first) << 32 | count).astype(np.uint64)
    context = mix(context ^ mix(shape + np.uint64(1)))
    return mix(prints[anchor]), context, first, count, np.searchsorted(offs, first, side="right") - 1


def anchors_at(sums: np.ndarray, first: np.ndarray, span: int, gram: int) -> np.ndarray:
    """A key that the strings of one anchor share: the upper bits of the least fingerprint, by which it was chosen."""
    if not len(first):
        return np.zeros(0, np.uint64)
    at = first[:, None] + np.arange(span - gram + 1)
    return mix((((sums[at + gram] - sums[at]) * powers(BASE_A, len(sums))[1][at]) >> np.uint64(POS_BITS)).min(axis=1))


def in_order(e: np.ndarray) -> np.ndarray:
    """Sorted by all of a, b, place; the rest of the order is only needed where fingerprints are equal."""
    order = np.argsort(e["a"], kind="stable")
    a = e["a"][order]
    same = np.zeros(len(e) + 1, bool)
    same[1:-1] = a[1:] == a[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    own = e[order[tied]]
    order[tied] = order[tied][np.lexsort((own["lo"], own["text"], own["id"], own["b"], own["a"]))]
    return e[order]


def merge_scan(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays as one, with the first entry of each (a, b); and the other entries, which repeat it."""
    e = in_order(np.concatenate([x, y]))
    # rows that are given twice are one
    twice = np.zeros(len(e), bool)
    twice[1:] = (e["a"][1:] == e["a"][:-1]) & (e["b"][1:] == e["b"][:-1]) & (e["lo"][1:] == e["lo"][:-1]) & (e["id"][1:] == e["id"][:-1]) & (e["text"][1:] == e["text"][:-1])
    e = e[~twice]
    later = np.zeros(len(e), bool)
    later[1:] = (e["a"][1:] == e["a"][:-1]) & (e["b"][1:] == e["b"][:-1])
    return e[~later], e[later]


class Family:
    """Levels of sorted entries, each more than twice as large as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def insert(self, batch: np.ndarray) -> np.ndarray:
        """Takes a batch; returns the entries found to repeat earlier ones."""
        now, repeats = merge_scan(batch[:0], batch)
        found = [repeats]
        while self.levels and len(self.levels[-1]) <= 2 * len(now):
            now, repeats = merge_scan(self.levels.pop(), now)
            found.append(repeats)
        self.levels.append(now)
        return np.concatenate(found)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Merges all levels: the index, and the repeats found on the way."""
        now, found = np.zeros(0, ENTRY), [np.zeros(0, ENTRY)]
        while self.levels:
            now, repeats = merge_scan(self.levels.pop(), now)
            found.append(repeats)
        self.levels = [now]
        return now, np.concatenate(found)


def blobs_of(e: np.ndarray, blocks: int) -> pa.RecordBatch:
    """The entries by block, compressed by column in the order of their places."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    block = (mix(e["a"] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    e, block = e[order], block[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(e)]]) if len(e) else [0]
    rows = [(int(block[s]), z.compress(b"".join(np.ascontiguousarray(e[s:t][name]).tobytes() for name in ENTRY.names))) for s, t in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "entries"])


def entries_of(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.zeros(len(raw) // ENTRY.itemsize, ENTRY), 0
    for name in ENTRY.names:
        size = len(out) * ENTRY[name].itemsize
        out[name] = np.frombuffer(raw[at : at + size], ENTRY[name])
        at += size
    return out


def _rows(e: np.ndarray, state: int | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[x])) for x in ("id", "text", "lo", "n")] + [pa.array(np.broadcast_to(np.int32(state), len(e)))], ["id", "text", "lo", "n", "state"])


#: What is known of a run of strings (the first's place, how many): they repeat earlier ones; or their
#: anchor has several contexts; or so many that its strings are dealt out one by one.
REPEATS, OPEN, MANY = 0, 1, 2
RUNS = "id long, text long, lo int, n int, state int"
BATCH_ENTRIES, MANY_CONTEXTS = 100_000, 20_000


class _Block:
    """One block's family, fed with blobs; small ones are joined to batches."""

    def __init__(self):
        self.family, self.waiting, self.size = Family(), [], 0

    def add(self, e: np.ndarray, most: int = BATCH_ENTRIES) -> Iterator[pa.RecordBatch]:
        self.waiting.append(e)
        self.size += len(e)
        if self.size >= most and self.waiting:
            found = self.family.insert(np.concatenate(self.waiting))
            self.waiting, self.size = [], 0
            if len(found):
                yield _rows(found, REPEATS)

    def settled(self) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        out = list(self.add(np.zeros(0, ENTRY), 0))
        now, repeats = self.family.settle()
        return now, [*out, _rows(repeats, REPEATS)]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows (block, ...) in runs of one block."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[0])


def index_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that repeat earlier contexts, and those whose anchor has several."""
    for _, rows in by_block(batches):
        block = _Block()
        for _, blob in rows:
            yield from block.add(entries_of(blob))
        now, out = block.settled()
        yield from out
        if len(now):
            first = np.flatnonzero(np.concatenate([[True], now["a"][1:] != now["a"][:-1]]))
            size = np.repeat(np.diff(np.concatenate([first, [len(now)]])), np.diff(np.concatenate([first, [len(now)]])))
            keep = size > 1
            if keep.any():
                yield _rows(now[keep], np.where(size[keep] > MANY_CONTEXTS, MANY, OPEN))


CONTEXT = np.dtype([("a", "u8"), ("id", "i8"), ("text", "i8"), ("lo", "i4"), ("n", "i4")])


def context_blobs(e: np.ndarray, contexts: list[bytes], blocks: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, OPEN, blob) of runs with their contexts."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    block = (mix(e["a"] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    e, block = e[order], block[order]
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(e)] if len(e) else [0]
    for s, t in zip(cuts, cuts[1:], strict=False):
        yield int(block[s]), OPEN, z.compress((t - s).to_bytes(8, "little") + e[s:t].tobytes() + b"".join(contexts[k] for k in order[s:t]))


def compared(e: np.ndarray, contexts: list[bytes], span: int) -> Iterator[pa.RecordBatch]:
    """The strings of runs, all with the anchors of one block, that repeat earlier ones.

    Anchors are taken in groups, so that a few hundred thousand strings are held at once; equal strings
    have equal anchors, so none is missed.
    """
    order = np.argsort(e["a"], kind="stable")
    total = np.cumsum(e["n"][order])
    edges = np.flatnonzero(np.concatenate([[True], e["a"][order][1:] != e["a"][order][:-1], [True]]))
    at = 0
    while at < len(order):
        limit = np.searchsorted(total, (total[at - 1] if at else 0) + 250_000)
        end = int(edges[min(np.searchsorted(edges, max(limit, at + 1)), len(edges) - 1)])
        own = order[at:end]
        at = end
        own = own[np.lexsort((e["lo"][own], e["text"][own], e["id"][own]))]
        twice = np.zeros(len(own), bool)
        twice[1:] = (e["lo"][own[1:]] == e["lo"][own[:-1]]) & (e["id"][own[1:]] == e["id"][own[:-1]]) & (e["text"][own[1:]] == e["text"][own[:-1]])
        own = own[~twice]
        n = e["n"][own].astype(np.int64)
        raw = np.frombuffer(b"".join(contexts[k] for k in own), np.uint8)
        begin = np.cumsum(n + span - 1) - (n + span - 1)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(begin, n) + inside
        # a suffix array of the contexts, each suffix by its first `span` bytes; stable, so that equal ones stay in the order of their places
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, span)[start]).view(f"S{span}").reshape(-1)
        place = np.argsort(suffix, kind="stable")
        later = np.zeros(len(place), bool)
        later[place[1:]] = suffix[place[1:]] == suffix[place[:-1]]
        # runs of repeats within a run
        new = later & (np.concatenate([[True], ~later[:-1]]) | (inside == 0))
        if later.any():
            group = np.cumsum(new)[later]
            head = np.flatnonzero(new)
            run = np.repeat(np.arange(len(own)), n)[head]
            out = np.zeros(len(head), ENTRY)
            out["id"], out["text"], out["lo"] = e["id"][own][run], e["text"][own][run], e["lo"][own][run] + inside[head]
            out["n"] = np.bincount(group - 1, minlength=len(head))
            yield _rows(out, REPEATS)


def compare_strings(span: int):
    """For blobs of contexts (OPEN) and of single strings (MANY): the strings that repeat earlier ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for _, rows in by_block(batches):
            block, parts, contexts = _Block(), [], []
            for _, state, blob in rows:
                if state == MANY:
                    yield from block.add(entries_of(blob))
                    continue
                raw = z.decompress(blob)
                n = int.from_bytes(raw[:8], "little")
                e = np.frombuffer(raw, CONTEXT, n, 8)
                at = 8 + n * CONTEXT.itemsize
                for size in (e["n"] + span - 1).tolist():
                    contexts.append(raw[at : at + size])
                    at += size
                parts.append(e)
            if parts:
                yield from compared(np.concatenate(parts), contexts, span)
            yield from block.settled()[1]

    return compare


def dealt(blobs: DataFrame, blocks: int, task, *columns: str) -> DataFrame:
    return blobs.repartitionById(blocks, "block").sortWithinPartitions("block").select("block", *columns).mapInArrow(task, RUNS)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_bytes, removed (array of start, end in bytes, maximal runs) and kept (binary), one row per row of docs.

    A byte goes if a string of `span` bytes over it also starts earlier: in a row of a smaller id, or
    earlier in its own text. Judged on the input; matches never cross texts. Ids must be integers; null
    ids come last. Rows that share an id are ordered by the hash of their texts, and equal rows count as
    one. Null and empty texts lose nothing.
    """
    small_batches(docs.sparkSession)
    top = 2**63 - 1
    base = docs.select(F.col(id_column).alias("_own"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("_text"))
    base = base.withColumn("_id", F.coalesce(F.col("_own").cast("long"), F.lit(top))).withColumn("_hash", F.xxhash64("_text"))
    blocks = partitions_for(docs, BLOCK_BYTES)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts, held = [], 0
            for b in sliced(whole, "_text", BATCH_BYTES):
                data, offs = flat(column(b, "_text"))
                a, c, first, count, text = anchors(data, offs, span, gram)
                e = np.zeros(len(a), ENTRY)
                e["a"], e["b"], e["lo"], e["n"] = a, c, first - offs[text], count
                e["id"] = b.column(b.schema.get_field_index("_id")).to_numpy()[text]
                e["text"] = b.column(b.schema.get_field_index("_hash")).to_numpy()[text]
                parts.append(e)
                held += len(e)
                if held > 250_000:
                    yield blobs_of(np.concatenate(parts), blocks)
                    parts, held = [], 0
            if held:
                yield blobs_of(np.concatenate(parts), blocks)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [z.compress(t) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in ("_own", "_id", "_hash")] + [pa.array(texts, pa.binary())], ["_own", "_id", "_hash", "_z"])

    runs = written(dealt(base.select("_id", "_hash", "_text").mapInArrow(entries, "block int, entries binary"), blocks, index_contexts, "entries"), "runs")
    small = base.mapInArrow(squeeze, f"_own {docs.schema[id_column].dataType.simpleString()}, _id long, _hash long, _z binary")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()

        def out(parts: list, contexts: list[bytes], single: list) -> pa.RecordBatch:
            rows = list(context_blobs(np.concatenate(parts), contexts, blocks)) if parts else []
            if single:
                b = blobs_of(np.concatenate(single), blocks)
                rows += [(k, MANY, x) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["block", "state", "entries"])

        for b in batches:
            parts, contexts, single, held = [], [], [], 0
            for own, text, blob, runs in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("_id", "_hash", "_z", "runs")), strict=True):
                raw = z.decompress(blob)
                sums = prefix(BYTE_CODE[np.frombuffer(raw, np.uint8)], BASE_A)
                lo, n, state = (np.array([r[x] for r in runs], np.int64) for x in ("lo", "n", "state"))
                few = np.flatnonzero(state == OPEN)
                e = np.zeros(len(few), CONTEXT)
                e["id"], e["text"], e["lo"], e["n"] = own, text, lo[few], n[few]
                # an anchor is the leftmost least fingerprint of the run's first string
                e["a"] = anchors_at(sums, lo[few], span, gram)
                contexts += [raw[s : s + k + span - 1] for s, k in zip(lo[few].tolist(), n[few].tolist(), strict=True)]
                parts.append(e)
                held += int(n[few].sum())
                if (many := np.flatnonzero(state == MANY)).size:
                    lo, n = lo[many], n[many]
                    start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    e = np.zeros(len(start), ENTRY)
                    e["a"] = between(sums, start, start + span, BASE_A)
                    e["b"] = between(prefix(BYTE_CODE[np.frombuffer(raw, np.uint8)], BASE_B), start, start + span, BASE_B)
                    e["id"], e["text"], e["lo"], e["n"] = own, text, start, 1
                    single.append(e)
                    held += 4 * len(e)
                if held > 1_000_000:
                    yield out(parts, contexts, single)
                    parts, contexts, single, held = [], [], [], 0
            if held:
                yield out(parts, contexts, single)

    same = (F.col("_id") == F.col("id")) & (F.col("_hash") == F.col("text"))
    undecided = runs.where(F.col("state") != REPEATS).groupBy("id", "text").agg(F.collect_list(F.struct("lo", "n", "state")).alias("runs"))
    fine = small.join(undecided, same).select("_id", "_hash", "_z", "runs").mapInArrow(strings, "block int, state int, entries binary")
    more = written(dealt(fine, blocks, compare_strings(span), "state", "entries"), "more")
    gone = runs.where(F.col("state") == REPEATS).unionByName(more).groupBy("id", "text").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    both = small.join(gone, same, "left").select("_own", "_z", "lo", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, removed, kept, rows, held = [], [], [], [], 0
            names = [*b.schema.names]

            def out(b=b) -> pa.RecordBatch:
                own = b.column(b.schema.get_field_index("_own")).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary())], [id_column, "n_bytes", "removed", "kept"])

            for k, (blob, lo, n) in enumerate(zip(*(b.column(names.index(x)).to_pylist() for x in ("_z", "lo", "n")), strict=True)):
                text = z.decompress(blob)
                cover = np.zeros(len(text) + 1, np.int64)
                if lo:
                    start = np.array(lo, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + np.array(n, np.int64) - 1 + span, -1)
                    hit = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
                    removed.append([{"start": s, "end": e} for s, e in edges.tolist()])
                    kept.append(np.frombuffer(text, np.uint8)[~hit].tobytes())
                else:
                    removed.append([])
                    kept.append(text)
                sizes.append(len(text))
                rows.append(k)
                held += len(text)
                if held > 8 << 20:
                    yield out()
                    sizes, removed, kept, rows, held = [], [], [], [], 0
            if rows:
                yield out()

    kind = docs.schema[id_column].dataType.simpleString()
    return both.mapInArrow(cut, f"{id_column} {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
