"""Hashed n-grams of UTF-8 bytes inside words, for whole Arrow batches, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.llm.base import small

#: Longest text, in code points, that may serve as a training example; every text is scored whole.
EXAMPLE_CHARS = 32_768


def padded(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes with white space as 0x20, a 0x20 before every text; new bounds."""
    n = len(bounds) - 1
    out = np.insert(raw, bounds[:-1], np.uint8(32))
    out[tx.SPACE[out]] = 32
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out, bounds + np.arange(n + 1)


def grams(data: np.ndarray, bounds: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each byte, and which n-grams count: inside one text, white space at the ends only."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    value = np.zeros(n, np.uint64)
    inner = np.zeros(n, np.uint8)
    with np.errstate(over="ignore"):
        for j in range(length):
            c = data[j : n + j]
            value = value * np.uint64(0x100000001B3) + c
            if 0 < j < length - 1:
                inner |= c == 32
        bucket = (tx.mix(value + np.uint64(length)) >> np.uint64(40)).astype(np.int64) % buckets
    ok = inner == 0
    for b in bounds[1:-1]:
        ok[max(0, b - length + 1) : b] = False
    return bucket, ok


def document_grams(raw: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram, sorted by text within each length."""
    data, edge = padded(raw, bounds)
    texts, found = [], []
    for length in lengths:
        bucket, ok = grams(data, edge, length, buckets)
        at = np.flatnonzero(ok)
        texts.append(np.searchsorted(edge, at, "right") - 1)
        found.append(bucket[at])
    return np.concatenate(texts), np.concatenate(found)


def weight_sums(raw: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' weights (one column each) and their number."""
    data, edge = padded(raw, bounds)
    n = len(bounds) - 1
    wide = weights.reshape(len(weights), -1)
    total, count = np.zeros((n, wide.shape[1])), np.zeros(n)
    for length in lengths:
        bucket, ok = grams(data, edge, length, len(weights))
        if len(bucket):
            own = wide[bucket]
            own[~ok] = 0
            starts = np.minimum(edge[:-1], len(bucket) - 1)
            there = np.minimum(edge[1:], len(bucket)) > edge[:-1]
            # stretches that start past the last n-gram hold nothing
            got = np.add.reduceat(own, starts[there], axis=0, dtype=np.float64) if there.any() else np.zeros((0, wide.shape[1]))
            total[there] += got
            many = np.add.reduceat(ok.astype(np.int64), starts[there]) if there.any() else np.zeros(0)
            count[there] += many
    return total, count


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", chars: int = EXAMPLE_CHARS, ones: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `most` labelled documents of up to `chars` code points; a share `ones` of label 1 and the rest of label 0, where there are enough.

    They are those with the smallest hashes of their ids among all that are short enough. An id labelled twice has the
    larger label; of several texts under one id the one with the smallest hash is taken. Null ids and texts are not.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    there = docs.filter(F.char_length(text) <= chars).select(key).join(small(own), key).distinct()
    ids = None
    for value in (0, 1):
        some = there.filter(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(round(most * (ones if value else 1 - ones)))
        ids = some if ids is None else ids.unionByName(some)
    pick = docs.select(key, F.col(text).alias("_text")).filter(F.char_length("_text") <= chars).join(F.broadcast(ids), key)  # at most `most` ids
    rows = pick.groupBy(key, "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("m")).select(key, "_label", "m.t").collect()
    rows = sorted(rows, key=lambda r: r[0])
    return [r[2] for r in rows], np.array([r[1] for r in rows], np.int64)


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in runs of about `most` code points."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def as_flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tx.flat(pa.array(texts, pa.large_string()))


def scored(batches: Iterator[pa.RecordBatch], score, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with `extra` columns and score(raw, bounds) as double `score`."""
    for batch in batches:
        for part in tx.parts(batch, "_text"):
            raw, bounds = tx.flat(part.column("_text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), tx.array(np.asarray(score(raw, bounds), np.float64))], names=[*extra, "score"])
