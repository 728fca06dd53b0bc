"""Packing by shortest-pack-first over the length histogram.

Each document's ids, with an end id, are cut into full pieces of `size` ids and a rest. Only the histogram of piece
lengths (at most `size` counts) reaches the driver. Lengths are placed longest first, each into the packs with the most
room left (the shortest ones) that it fits, whole groups of equal packs at a time, which gives a few thousand patterns
with counts. A pattern's copies are numbered; piece number r of a length (its rank among all pieces of that length) then
belongs to the pattern, copy and place that r falls into, so pieces join patterns by rank without a sort.

Sequences are padded to `size`, unless what they hold is a power of two already.

Defined cases: a null or empty text is the end id alone; a text longer than a sequence is cut into several pieces, in
order, each id in one piece, and takes memory in proportion to its length; null ids stay null; rows repeated under one
id, with whatever texts, are packed one by one; pieces of equal length are interchangeable; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.llm import tokens
from weir.llm.base import small
from weir.session import Scratch, table

SIZE = 1024
VOCABULARY = "byte_bpe_50k.json"
END = 0

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(copies, lengths of a pack, longest first), placing every piece of the histogram."""
    room: dict[int, list[tuple[int, list[int]]]] = {}  # packs by the room they have left
    for length in sorted(histogram, reverse=True):
        left, gap = histogram[length], size
        while left:
            while gap >= length and not room.get(gap):
                gap -= 1
            if gap < length:  # nothing has room: new packs
                room.setdefault(size - length, []).append((left, [length]))
                break
            copies, pack = room[gap].pop()
            used = min(copies, left)
            if copies > used:
                room[gap].append((copies - used, pack))
            room.setdefault(gap - length, []).append((used, [*pack, length]))
            left -= used
    return [p for gap in sorted(room) for p in room[gap]]


def layout(found: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks of a length, ascending: length << 40 | first rank, pattern's first sequence, pieces of that length in a pack, place of the first."""
    rows, taken, sequence = [], {}, 0
    for copies, pack in found:
        at = 0
        for length in dict.fromkeys(pack):
            many = pack.count(length)
            first = taken.get(length, 0)
            rows.append((length << 40 | first, sequence, many, at))
            taken[length] = first + copies * many
            at += many * length
        sequence += copies
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, spec: str, end: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces, with the number of their task and their rank among its pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for part, ids, bounds in tokens.encoded(batches, spec, "byte", end):
            n = np.diff(bounds)
            many = -(-n // size)
            owner = np.repeat(np.arange(len(n)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * size
            length = np.minimum(size, n[owner] - start)
            at = bounds[owner] + start
            sums = [tokens.crc(ids[a : a + b]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            same = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(same, same)
            rank += seen[length]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id").take(tx.array(owner)), *(tx.array(np.asarray(c, np.int64)) for c in (start, length, sums, n[owner], np.full(len(owner), task), rank))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"],
            )

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, PIECE + ", task long, rank long")


def pack(docs: DataFrame, scratch: Scratch, spec: str, end: int = END, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = scratch.put(pieces(docs, spec, end, size, key, text), "pieces")
    by_task = scratch.put(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = layout(patterns(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, sequence, many, at = runs
        for batch in batches:
            length, rank = (tx.numbers(batch.column(c)) for c in ("length", "rank"))
            run = np.searchsorted(firsts, length << 40 | rank, "right") - 1
            past = rank - (firsts[run] & ((1 << 40) - 1)) if len(run) else rank
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            none = np.zeros(0, np.int64)
            out += [tx.array(sequence[run] + past // many[run]), tx.array(at[run] + past % many[run] * length)] if len(run) else [tx.array(none)] * 2
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(small(first), ["length", "task"]).withColumn("rank", F.col("first") + F.col("rank")).drop("first", "task")
    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's content; by default that of the public byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return tokens.load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "pack"), vocabulary())
