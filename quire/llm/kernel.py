"""Vectorised token kernel over Arrow string buffers.

Whole batches are tokenised and hashed with numpy on the raw UTF-8 bytes, with no Python object per
word.  Two token classes exist: ``WORDS`` (runs of ASCII letters, digits and non-ASCII characters, case
folded for ASCII and Latin-1 letters, byte length unchanged) and ``FIELDS`` (exact runs of bytes other
than ASCII white space).  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORDS, FIELDS = "words", "fields"
_MMAP_THRESHOLD = -3


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own ways
        return None


def _own_pages() -> None:
    """Arrays of a megabyte and more get pages of their own, which go back to the system when they are freed."""
    if hasattr(libc := _libc(), "mallopt"):
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)


def tidy() -> None:
    """Gives freed memory back: a worker idles on after its task, beside those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := _libc(), "malloc_trim"):
        libc.malloc_trim(0)


_own_pages()


def tidied(run):
    """run (batches to batches), with the memory given back at its end."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_solid = np.ones(256, bool)
_solid[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_ODD = 0xD6E8FEB86659FD93
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied element by element (the array given is overwritten)."""
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.__dict__.get("have")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        inverse = pow(_ODD, -1, 1 << 64)
        up, down = (np.full(size, b, np.uint64) for b in (_ODD, inverse))
        up[0] = down[0] = 1
        _powers.have = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


@dataclass
class Tokens:
    """Tokens of documents ``lo..hi`` of a batch; starts and ends are byte places in ``data``."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # first token of each document, and the end
    bytes_at: np.ndarray  # first byte of each document, and the end

    @property
    def docs(self) -> np.ndarray:
        """The document (0-based in this chunk) of each token."""
        return np.repeat(np.arange(self.hi - self.lo, dtype=np.int32), np.diff(self.offsets))

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 32-bit offsets and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def chunks(texts: pa.Array, size: int = CHUNK):
    """Ranges of whole documents of about ``size`` bytes; a longer document is a range of its own."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, lo + 60_000, len(texts))
        yield lo, hi
        lo = hi


def tokenize(texts: pa.Array, lo: int, hi: int, kind: str = WORDS) -> Tokens:
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    base, end = int(at[lo]), int(at[hi])
    n = end - base
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = np.frombuffer(texts.buffers()[2], np.uint8, n, base)
    if kind == WORDS:
        data = _FOLD[data]
        lead = np.flatnonzero(data[:n] == 0xC3) + 1
        low = data[lead]
        data[lead[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)]] += 0x20
    inside = (_alnum if kind == WORDS else _solid)[data[:n]]
    at = (at[lo : hi + 1] - base).astype(np.int64)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = inside[edge]
    edge = at[1:][at[1:] > 0] - 1
    closes[edge] = inside[edge]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", data.data, strides=(1,))
    hashes = (eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _C3
    mix(hashes)
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        hashes[more] = mix((hashes[more] * _C3) ^ (eight[starts[more] + done] & _MASK[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    return Tokens(lo, hi, data[:n], starts, ends, hashes, np.searchsorted(starts, at), at)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens (document edges are the caller's to mask)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    m = len(hashes) - n + 1
    return mix((total[n:] - total[:m]) * down[:m] + np.uint64(n))


def whole(tokens: Tokens, n: int) -> np.ndarray:
    """Which runs of n tokens lie in one document."""
    m = max(len(tokens.hashes) - n + 1, 0)
    docs = tokens.docs
    return docs[:m] == docs[n - 1 : n - 1 + m] if m else np.zeros(0, bool)


def anchors(tokens: Tokens, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: for every run of k+w-1 tokens, the least of its w runs of k tokens.

    Returns (place, key, first, last): each chosen place, its hash, and the first and last long run
    that chose it.  Equal long runs choose the same relative place, so none is missed.
    """
    size, none = k + w - 1, np.zeros(0, np.int64)
    fits = whole(tokens, size)
    if not fits.any():
        return none, np.zeros(0, np.uint64), none, none
    keys = ngrams(tokens.hashes, k)
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    least = ((keys >> bits) << bits) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: -(w - span)], least[w - span :])
    runs = np.flatnonzero(fits)
    chosen = (least[runs] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1])])
    place = chosen[new]
    return place, keys[place], runs[new], runs[np.r_[new[1:] - 1, len(runs) - 1]]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the given byte ranges (sorted, apart)."""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order; ranges that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
