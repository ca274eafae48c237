"""Arrow string columns as flat byte arrays, and vectorised word and window fingerprints over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the two polynomial fingerprints, and the seed of the byte table.
BASE_A, BASE_B, SEED = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 20240229

_rng = np.random.default_rng(SEED)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z as a-z, every other byte as itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of digits, letters and everything beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes that are not white space.
BLACK = np.ones(256, dtype=bool)
BLACK[[32, *range(9, 14)]] = False


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.fill_null("") if got.null_count else got


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and the n + 1 offsets (from 0) between them."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def sliced(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most `most` bytes, or one longer row."""
    _, offs = flat(column(batch, name))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i up to n."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        got = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return got


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    """Running sums of codes[i] * base**i, with a leading 0."""
    up, _ = powers(base, len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit fingerprint over all bits; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Fingerprints of [start, end) whatever their place."""
    _, down = powers(base, len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in `inside`, never across texts, and each text's first run (n + 1 numbers)."""
    is_word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[offs] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = is_word
    now = np.zeros(len(data) + 1, bool)
    now[:-1] = is_word
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, offs)


_LANE_MASKS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word, with A-Z as a-z.

    A word is cut into lanes of eight bytes; each lane is mixed with its number before the lanes are
    added, so that no algebraic relation between bytes or lanes carries over to the sums.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=low[: len(data)])
    eight = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place
    size = ends - starts
    salt = np.uint64(pow(BASE_A, 2 * seed + 1, 2**64))
    out = mix((eight[starts] & _LANE_MASKS[np.minimum(size, 8)]) ^ salt)
    longer = np.flatnonzero(size > 8)
    if len(longer):
        lanes = (size[longer] - 1) // 8  # besides the first
        first = np.cumsum(lanes) - lanes
        number = np.arange(int(lanes.sum())) - np.repeat(first, lanes) + 1
        at = np.repeat(starts[longer], lanes) + 8 * number
        left = np.minimum(np.repeat(ends[longer], lanes) - at, 8)
        key = mix(number.astype(np.uint64) * np.uint64(BASE_B) + salt)
        out[longer] += np.add.reduceat(mix(mix(eight[at] & _LANE_MASKS[left]) ^ key), first)
    return mix(out ^ (size.astype(np.uint64) * np.uint64(BASE_B)))
