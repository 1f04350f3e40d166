"""Vectorised rolling hashes over Arrow text columns.

Texts are handled as their UTF-8 bytes. A polynomial prefix hash modulo 2**64
gives the hash of any byte span from two prefix values; words and word windows
are hashed the same way one level up. For every odd base there are known
different texts of 1,024 and more letters with one such hash, so
``span_hashes`` and ``run_hashes`` take a digest of the content for long spans
and the polynomial for short ones only. All functions work on one Arrow array at
a time and cut it into slices of bounded size, so memory does not grow with
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
_SLICE = 1 << 21
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS
_MASK64 = (1 << 64) - 1

# Odd multipliers and a seed of the byte table: fixed, so that hashes are the
# same on every executor and in every run.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASE = 0xC2B2AE3D27D4EB4F
_rng = np.random.Generator(np.random.PCG64(20231017))
_BYTE_TABLES = tuple(_rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in _BASES)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & _MASK64, _U)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = {}


def _pow_tables(base: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Powers of ``base`` and of its inverse within a block, and the block steps."""
    if base not in _POW:
        inv = pow(base, -1, 1 << 64)
        _POW[base] = (_powers(base, _BLOCK), _powers(inv, _BLOCK),
                      pow(base, _BLOCK, 1 << 64), pow(inv, _BLOCK, 1 << 64))
    return _POW[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer: spreads the weak low bits of a polynomial hash."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """H with H[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    out = np.empty(len(values) + 1, _U)
    out[0] = 0
    pw, _, step, _ = _pow_tables(base)
    carry, scale = 0, 1
    for a in range(0, len(values), _BLOCK):
        v = values[a:a + _BLOCK]
        h = np.cumsum(v * pw[:len(v)], dtype=_U)
        if a:
            h = h * _U(scale) + _U(carry)
        out[a + 1:a + 1 + len(v)] = h
        carry, scale = int(h[-1]), scale * step & _MASK64
    return out


def span(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Position-free hashes of spans [start, end) from prefix values ``h``."""
    _, ipw, _, istep = _pow_tables(base)
    high = _powers(istep, (len(h) >> _BLOCK_BITS) + 1)
    shift = ipw[start & (_BLOCK - 1)] * high[start >> _BLOCK_BITS]
    return (h[end] - h[start]) * shift


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix(_BYTE_TABLES[which][data], _BASES[which])


def byte_span(h: np.ndarray, start, end, which: int = 0) -> np.ndarray:
    """Mixed span hash that also depends on the span's length."""
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    return mix(span(h, start, end, _BASES[which]) + (end - start).astype(_U) * _U(0x632BE59BD9B4E019))


# From this length on a span is told apart by a digest of its content.
LONG = 256


def digest64(content) -> int:
    return int.from_bytes(blake2b(content, digest_size=8).digest(), "little")


def _with_digests(hashes: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    for i in np.flatnonzero(end - start >= LONG):
        hashes[i] = digest64(np.ascontiguousarray(values[start[i]:end[i]]))
    return hashes


def span_hashes(data: np.ndarray, h: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the byte spans [start, end) of ``data``, whose prefix values are ``h``."""
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    return _with_digests(byte_span(h, start, end), data, start, end)


def run_hashes(wh: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of word hashes."""
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    whole = mix(span(prefix(wh, WORD_BASE), start, end, WORD_BASE) + (end - start).astype(_U))
    return _with_digests(whole, wh, start, end)


_MEMOS: list = []


def keeps_memo(cached):
    """Mark a cached constructor whose object grows while tasks of one operator run."""
    _MEMOS.append(cached)
    return cached


def drop_memos() -> None:
    """Free what earlier operators left in this Python worker, which Spark uses again."""
    for cached in _MEMOS:
        if cached.cache_info().currsize:
            cached.cache_clear()


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) else col.type)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges [a, b) of about ``limit`` bytes, one document at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each maximal run of non-space bytes."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(data, s, e) -> np.ndarray:
    return span_hashes(data, byte_prefix(data), s, e)


def windows(wh: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within one document, with their start word index."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    h = prefix(wh, WORD_BASE)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(span(h, at, at + k, WORD_BASE) + _U(k)), at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n positions: those inside some [a, a + k) for a in ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1) if len(at) < 64 else d.__iadd__(np.bincount(at, minlength=n + 1).astype(np.int32))
    ends = np.bincount(np.minimum(at + k, n), minlength=n + 1) if len(at) else 0
    return np.cumsum(d - ends)[:n] > 0


def sums_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def replace_text(table: pa.Table, text: str, data: np.ndarray, off: np.ndarray, kept: np.ndarray,
                 binary: bool = False) -> pa.Table:
    """The table with its text column rebuilt from the kept bytes; nulls stay null."""
    sizes = np.concatenate(([0], np.cumsum(kept)))[off]
    old = table.column(text)
    valid = pa.array(np.asarray(old.is_valid()), pa.bool_()) if old.null_count else None
    kind = pa.large_binary() if binary else pa.large_string()
    new = pa.Array.from_buffers(kind, len(old), [
        None if valid is None else valid.buffers()[1],
        pa.py_buffer(np.ascontiguousarray(sizes, np.int64)), pa.py_buffer(np.ascontiguousarray(data[kept]))])
    return table.set_column(table.schema.get_field_index(text), text, new)
