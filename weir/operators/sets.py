"""Sets of word shingles as sorted 64-bit hashes, by whole Arrow batches without a Python loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(85))
_LETTER = _RNG.integers(0, 2**64, 256, dtype=U64) | U64(1)
_COEF = _RNG.integers(0, 2**64, 64, dtype=U64) | U64(1)
_P, _PINV = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0C, 0x0D])
#: Bytes of texts or sets that one step works on, at least one row.
STEP = 1 << 18
#: Bits of a set's parities.
BITS = 2048
SCHEMA = "id long, n int, h1 long, h2 long, s binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a column without nulls, and their bounds."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, bounds = 0, _bytes(batch.column(column))[1] if batch.num_rows else []
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def shingled(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, and their bounds; fewer words are one shingle."""
    texts = len(bounds) - 1
    with np.errstate(over="ignore"):
        inside = np.concatenate([~_SPACE[raw], [False]])
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        start = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
        text = np.searchsorted(bounds, start, "right") - 1
        up, down = np.full(len(raw) + 1, _P), np.full(len(raw) + 1, _PINV)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_LETTER[raw] * up[:-1], dtype=U64)])
        word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
        count = np.bincount(text, minlength=texts)
        runs = max(0, len(word) - k + 1)
        whole = text[:runs] == text[k - 1 :][:runs]
        value = np.zeros(runs, U64)
        for j in range(k):
            value += word[j : j + runs] * _COEF[j]
        value, owner = _mix(value[whole] + U64(k)), text[:runs][whole]
        short = np.flatnonzero((count > 0) & (count < k))
        some = np.zeros(len(short), U64)
        at = np.searchsorted(text, short)
        for j in range(k - 1):
            there = count[short] > j
            some[there] += word[at[there] + j] * _COEF[j]
        value, owner = np.concatenate([value, _mix(some + count[short].astype(U64))]), np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(texts + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def of_texts(k: int, whole: bool = True) -> Callable:
    """(id, text) to SCHEMA: set size, two sums that identify the set and, if `whole`, the set; rows without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            value, bounds = shingled(*_bytes(part.column("text")), k)
            with np.errstate(over="ignore"):
                h1, h2 = _sums(_mix(value ^ U64(0x5851F42D4C957F2D)), bounds), _sums(_mix(value ^ U64(0x14057B7EF767814F)), bounds)
            n = np.diff(bounds)
            off = pa.py_buffer((bounds * 8 if whole else bounds * 0).astype(np.int32))
            s = pa.Array.from_buffers(pa.binary(), len(n), [None, off, pa.py_buffer(value)])
            out = pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2), s], names=["id", "n", "h1", "h2", "s"])
            yield out.filter(pa.array(n > 0))

    return run


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s) to one row for each member."""
    for part in _parts(batches, "s"):
        yield pa.RecordBatch.from_arrays([pa.array(_bytes(part.column("s"))[0].view(np.int64))], names=["g"])


def prefixes(threshold: float, common: np.ndarray) -> Callable:
    """(id, n, s) to the first n - ceil(threshold * n) + 1 members by hash, those in `common` (sorted) last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "s"):
            n = _numbers(part.column("n")).astype(np.int64)
            value, start = _bytes(part.column("s"))[0].view(U64), np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(len(n)), n)
            last = common[np.searchsorted(common, value).clip(0, len(common) - 1)] == value if len(common) else np.zeros(len(value), bool)
            order = np.lexsort((value, last, owner))
            most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            kept = value[order][np.arange(len(value)) - start[owner] < most[owner]]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), _lists(kept, np.concatenate([[0], np.cumsum(np.minimum(most, n))]))], names=["id", "n", "first"])

    return run


def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, s) with s as BITS bits: the parity of the members that fall on each."""
    for part in _parts(batches, "s"):
        value, n = _bytes(part.column("s"))[0].view(U64), _numbers(part.column("n"))
        at = np.repeat(np.arange(len(n)), n) * BITS + (value & U64(BITS - 1)).astype(np.int64)
        bits = np.packbits((np.bincount(at, minlength=len(n) * BITS) & 1).astype(np.uint8))
        off = pa.py_buffer((np.arange(len(n) + 1) * (BITS // 8)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.Array.from_buffers(pa.binary(), len(n), [None, off, pa.py_buffer(bits)])], names=["id", "n", "s"])


def near(threshold: float) -> Callable:
    """(a, b, n_a, n_b, x, y) to the pairs that can reach the threshold: parities x and y differ in no more bits than sets in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_bytes(batch.column(c))[0].reshape(batch.num_rows, BITS // 8) for c in "xy")
            total = _numbers(batch.column("n_a")).astype(np.int64) + _numbers(batch.column("n_b"))
            ok = np.bitwise_count(x ^ y).sum(axis=1) <= total * ((1 - threshold) / (1 + threshold)) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def similar(threshold: float) -> Callable:
    """(a, b, x, y) to the pairs whose sets x and y reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                m = int((both[1:] == both[:-1]).sum())
                share[i] = m / (len(x) + len(y) - m)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "jaccard"])
            yield out.filter(pa.array(share >= threshold))

    return run
