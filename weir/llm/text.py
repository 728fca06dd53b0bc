"""Whole Arrow batches of texts as flat byte arrays: words, hashes and shingles without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240607))
_LETTER = _SEED.integers(0, 2**64, 256, dtype=U64) | U64(1)
_EXACT = _LETTER.copy()
_LETTER[65:91] = _LETTER[97:123]  # A-Z hash as a-z
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_COEF = _SEED.integers(0, 2**64, 64, dtype=U64) | U64(1)
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        n = max(n + 1, (1 << 18) + (1 << 17))
        with np.errstate(over="ignore"):
            a, b = np.full(n, _P, U64), np.full(n, _PINV, U64)
            a[0] = b[0] = 1
            _powers[:] = [np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64)]
    return _powers[0], _powers[1]


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:  # a null rarely has bytes of its own
        present = column.drop_null()
        if _size(column) != _size(present):
            column = column.fill_null("")
    return column


def _size(column: pa.Array) -> int:
    off = np.frombuffer(column.buffers()[1], np.int64)
    return int(off[column.offset + len(column)] - off[column.offset]) if len(column) else 0


# Arrow's own conversions from and to numpy load pandas, some 30 MB in every worker; these do not.


def array(x: np.ndarray) -> pa.Array:
    """Numbers or truth values as an Arrow array, without a copy of numbers."""
    x = np.ascontiguousarray(x)
    if x.dtype == bool:
        return pa.Array.from_buffers(pa.bool_(), len(x), [None, pa.py_buffer(np.packbits(x, bitorder="little").tobytes())])
    return pa.Array.from_buffers(pa.from_numpy_dtype(x.dtype), len(x), [None, pa.py_buffer(x)])


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers or truth values of a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([numbers(c) for c in column.chunks]) if column.num_chunks else column.to_numpy()
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy(zero_copy_only=False)
    at, n = column.offset, len(column)
    if pa.types.is_boolean(column.type):
        return np.unpackbits(np.frombuffer(column.buffers()[1], np.uint8), bitorder="little")[at : at + n].astype(bool) if n else np.zeros(0, bool)
    kind = np.dtype({"double": "float64", "float": "float32"}.get(str(column.type), str(column.type)))
    return np.frombuffer(column.buffers()[1], kind)[at : at + n] if n else np.zeros(0, kind)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the texts' bounds in them (one more than texts). Null is empty."""
    column = as_string(column)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Give freed memory back to the system, so that idle Python workers stay small."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes, at least one row each: what bounds the memory of a step."""
    if not batch.num_rows:
        return
    _, bounds = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    trim()


def words(raw: np.ndarray, bounds: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of bytes that are not in `sep`; no run spans two texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~sep[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[full] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words, with A-Z lower-cased if `fold`, from prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        up, down = powers(len(raw))
        sums = np.empty(len(raw) + 1, U64)
        sums[0] = 0
        np.cumsum((_LETTER if fold else _EXACT)[raw] * up[: len(raw)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (a shorter text's whole sequence is its one shingle): sorted 64-bit values and n_texts + 1 bounds."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        count = np.bincount(text, minlength=n_texts)
        if n >= k:
            whole = text[: n - k + 1] == text[k - 1 :]
            value = np.zeros(n - k + 1, U64)
            for j in range(k):
                value += hashes[j : n - k + 1 + j] * _COEF[j]
            value, owner = mix(value[whole] + U64(k)), text[: n - k + 1][whole]
        else:
            value, owner = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.searchsorted(text, short)
            extra = np.zeros(len(short), U64)
            for j in range(k - 1):
                there = count[short] > j
                extra[there] += hashes[first[there] + j] * _COEF[j]
            value = np.concatenate([value, mix(extra + count[short].astype(U64))])
            owner = np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
        return value, np.searchsorted(owner, np.arange(n_texts + 1))


def segment(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduce over each stretch; `empty` where a stretch has nothing."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out
