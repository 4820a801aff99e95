"""Vectorised text kernels shared by the corpus operators.

Everything here works on a *block*: the UTF-8 bytes of many documents laid end to end in one
uint8 array plus the offsets that separate them, which is exactly how an Arrow string column is
stored. No function loops over documents, words or bytes in Python.

Hashes are multilinear over 64-bit words (arithmetic modulo 2**64) with a final mix. Constants are
drawn once from a fixed seed so that every executor and every retry computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LANES = _rng.integers(1, 2**63, (4, 64), dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(2**58, 2**60)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 2**64)

#: Bytes of text that one vectorised step handles; positions in a block need 24 bits.
BLOCK_BYTES = 256 << 10
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of them."""
    have = _pow_cache.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _pow_cache[name] = np.multiply.accumulate(steps)
    return _pow_cache["up"], _pow_cache["down"]


def release(most: int = 4 << 20) -> None:
    """Forget the powers if a very long text made them many."""
    if len(_pow_cache.get("up", ())) > most:
        _pow_cache.clear()


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def separator_table(text: str) -> np.ndarray:
    """Boolean table over byte values: True for the ASCII characters of `text`."""
    table = np.zeros(256, bool)
    table[np.frombuffer(text.encode("ascii"), np.uint8)] = True
    return table


#: ASCII white space as the word contracts state it.
SPACES = separator_table(" \t\n\x0b\x0c\r")


def lowered(buf: np.ndarray) -> np.ndarray:
    """A copy with ASCII A-Z in lower case."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def word_spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of each row."""
    n = len(buf)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~sep[buf]
    inside[n] = False
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = inside[:n] & first[:n]
    begin[1:] |= inside[1:n] & ~inside[: n - 1]
    after = inside[:n] & (first[1:] | ~inside[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * base**i, one longer than values."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], whatever the place; lengths are mixed in."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LANES[3, 63])


def rolling_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """span_hash of every k consecutive values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _powers(len(sums))
    out = sums[k:] - sums[:n]
    out *= down[:n]
    out += np.uint64(k * int(_LANES[3, 63]) % 2**64)
    return mix(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE[buf]), starts, ends)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def gram_hash(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every k consecutive words (k up to 64); lanes are independent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _LANES[lane, 0]
    for j in range(1, k):
        out += words[j : j + n] * _LANES[lane, j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span, out = 1, x
    while span < w:
        step = min(span, w - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def rows_of(counts_offsets: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of n items, from the item offsets of the rows."""
    return np.repeat(np.arange(len(counts_offsets) - 1), np.diff(counts_offsets))[:n]


class Winnowed:
    """Winnowed anchors of a block and the run of windows that each anchor stands for.

    units: one 64-bit value per unit (word or byte), row offsets in units. A window is `span`
    consecutive units of one row. Among its grams of k units the one with the least hash, the
    rightmost of equals, is its anchor; so equal windows have equal anchors at equal places, and the
    windows that share an anchor are consecutive and form a run.

    anchor: unit index of each anchor; first, last: its first and last window; row: its row;
    gram: the anchor's hash.
    """

    def __init__(self, units: np.ndarray, offs: np.ndarray, k: int, span: int, grams: np.ndarray) -> None:
        n = len(units) - span + 1
        if n <= 0:
            self.anchor = self.first = self.last = self.row = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        m = len(units) - k + 1
        if len(units) >= 1 << 24:
            least = _argmin_wide(grams[:m], span - k + 1)
        else:
            packed = grams[:m] & ~_POS_MASK
            packed |= np.arange(int(_POS_MASK), int(_POS_MASK) - m, -1, dtype=np.uint64)
            least = sliding_min(packed, span - k + 1)
            least &= _POS_MASK
            least = int(_POS_MASK) - least.view(np.int64)
        valid = np.zeros(n + 1, bool)
        begins, stops = offs[:-1], np.maximum(offs[1:] - span + 1, offs[:-1])
        edge = np.zeros(len(units) + 2, np.int32)
        np.add.at(edge, begins, 1)
        np.add.at(edge, stops, -1)
        valid[:n] = np.cumsum(edge)[:n] > 0
        fresh = valid[:n].copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~valid[: n - 1]
        self.first = np.flatnonzero(fresh)
        # A run ends where the next one begins or where valid windows end.
        stop = valid[:n] & (~valid[1:] | np.append(least[1:] != least[:-1], True))
        self.last = np.flatnonzero(stop)
        self.anchor = least[self.first]
        self.gram = grams[self.anchor]
        self.row = np.searchsorted(offs, self.first, "right") - 1


def _argmin_wide(grams: np.ndarray, w: int) -> np.ndarray:
    """Rightmost argmin of every w consecutive values, for rows too long for packed positions."""
    val = grams & ~_POS_MASK
    idx = np.arange(len(val))
    span = 1
    while span < w:
        step = min(span, w - span)
        right = val[step:] <= val[:-step]
        val, idx = np.where(right, val[step:], val[:-step]), np.where(right, idx[step:], idx[:-step])
        span += step
    return idx


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Boolean mask of n units that some range [start, stop) covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:n]) > 0
