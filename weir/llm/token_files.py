"""Token files: ids under a canonical, length-limited Huffman code from global counts, decoded by table.

Format. `codes`: a table (id, bits) of the code lengths, at most `limit` bits each; the canonical code (shorter codes
first, then smaller ids) follows from it. The limit is LIMIT, or as many bits as the number of different ids needs and one
more, up to MOST_BITS. `blocks`: rows in ascending document order, each independent of the others,
with the documents' ids (doc_ids), their numbers of ids (doc_lens), the document's codes from a byte boundary each
(bits) and checkpoints (marks): for every STEP-th id of each document the length in bits of the STEP ids before it.
Blocks carry the number of the range partition (part) they belong to and how many ids of it come before (part_start);
partitions ascend with the documents. A decoder runs all checkpoints of a block side by side, one table look-up per id.

Only counts per id, at most the vocabulary, and one row per range partition reach the driver.

Defined cases: a null or empty text is the end id alone; null document ids come first; rows repeated under one id stay
next to each other, in an order of their own; a very long text is one document of one block and takes memory in
proportion to its length; ids that occur equally often have codes in the order of the ids; more than 2 ** MOST_BITS
different ids are refused; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.llm import tokens
from weir.session import Scratch, table

LIMIT, MOST_BITS, STEP = 16, 20, 64
BLOCK_BYTES = 1 << 18
VOCABULARY = "word_bpe_49k.json"
END = 2


def limit_of(n: int) -> int:
    """Longest code for n different ids."""
    limit = max(LIMIT, (n - 1).bit_length() + 1 if n > 1 << LIMIT else LIMIT)
    if limit > MOST_BITS:
        raise ValueError("more ids than the decoding table has room for")
    return limit


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; counts are positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more ids than codes of the longest length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, row = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        pairs = row[0 : len(row) // 2 * 2 : 2] + row[1 : len(row) // 2 * 2 : 2]
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        row = both[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bits and codes, ordered by length and id."""
    order = np.lexsort((ids, bits))
    ids, bits = ids[order], bits[order]
    width = np.int64(1) << (limit - bits)
    return ids, bits, (np.cumsum(width) - width) >> (limit - bits)


def encode(ids: np.ndarray, bounds: np.ndarray, bit_of: np.ndarray, code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents, the bounds of each document's bytes, and the marks."""
    bits, code = bit_of[ids], code_of[ids]
    ends = np.concatenate([[0], np.cumsum(bits)])
    size = ends[bounds[1:]] - ends[bounds[:-1]]
    byte_bounds = np.concatenate([[0], np.cumsum(-(-size // 8))])
    n = np.diff(bounds)
    place = ends[:-1] + np.repeat(byte_bounds[:-1] * 8 - ends[bounds[:-1]], n)
    value = code << (32 - bits - (place & 7))
    at, most = place >> 3, int(byte_bounds[-1]) + 4
    out = np.zeros(most)
    for k in range(4 if len(bits) and bits.max() > 17 else 3):  # a code and up to 7 bits before it
        out += np.bincount(at + k, weights=(value >> (24 - 8 * k)) & 0xFF, minlength=most)[:most]
    within = np.arange(len(ids)) - np.repeat(bounds[:-1], n)
    first = np.flatnonzero((within % STEP == 0) & (within > 0))
    marks = (ends[first] - ends[first - STEP]).astype("<u2")  # at most STEP * MOST_BITS
    return out[: most - 4].astype(np.uint8), byte_bounds, marks


def tables(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `limit` bits: the id of the code it begins with and its length."""
    limit = limit_of(len(ids))
    ids, bits, _ = canonical(ids, bits, limit)
    many = np.int64(1) << (limit - bits)
    symbol, length = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    total = int(many.sum())
    symbol[:total], length[:total] = np.repeat(ids, many), np.repeat(bits, many)
    return symbol, length


def decode(bits: np.ndarray, marks: np.ndarray, lens: np.ndarray, byte_bounds: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """ids of all documents of a block in a row; every document has one id at least."""
    lanes = -(-lens // STEP)
    first = np.cumsum(lanes) - lanes
    total = int(lanes.sum())
    step = np.zeros(total, np.int64)
    inner = np.ones(total, bool)
    inner[first] = False
    step[inner] = marks
    run = np.cumsum(step)
    at = run - np.repeat(run[first], lanes) + np.repeat(byte_bounds[:-1] * 8, lanes)
    data = np.concatenate([bits, np.zeros(5, np.uint8)]).astype(np.int64)
    out = np.empty((STEP, total), np.uint32)
    last, limit = len(data) - 4, len(symbol).bit_length() - 1
    for k in range(STEP):
        byte = np.minimum(at >> 3, last)
        window = ((data[byte] << 24 | data[byte + 1] << 16 | data[byte + 2] << 8 | data[byte + 3]) >> (32 - limit - (at & 7))) & (len(symbol) - 1)
        out[k] = symbol[window]
        at = at + length[window]
    keep = np.arange(STEP)[None, :] < np.minimum(STEP, np.repeat(lens, lanes) - (np.arange(total) - np.repeat(first, lanes)) * STEP)[:, None]
    return out.T[keep]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about `most` bytes of ids, with their ids and bounds."""
    for batch in batches:
        size = np.cumsum([0, *(len(x) for x in batch.column("ids").to_pylist())])
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1))
            yield batch.slice(at, to - at), *_ids(batch.slice(at, to - at))
            at = to
        tx.trim()


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in a row (16 or 32 bits each) and their bounds."""
    wide = tx.numbers(batch.column("wide"))
    runs = [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(batch.column("ids").to_pylist(), wide, strict=True)]
    ids = np.concatenate([np.zeros(0, np.uint16), *runs]).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)


def write(docs: DataFrame, scratch: Scratch, spec: str, end: int = END, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write `codes` and `blocks` and return the tables as read back."""
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in tokens.encoded(batches, spec, "word", end):
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            kind = "<u4" if wide else "<u2"
            edge = (bounds * (4 if wide else 2)).astype(np.int32)
            runs = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(edge), pa.py_buffer(ids.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("_id"), tx.array(np.full(len(bounds) - 1, wide)), runs], names=["id", "wide", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for _, ids, _ in _slices(batches):
            own = np.bincount(ids)
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([tx.array(seen.astype(np.int64)), tx.array(total[seen])], names=["id", "n"])

    held = scratch.put(slim.mapInArrow(tokenize, "id long, wide boolean, ids binary"), "ids")
    counts = held.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()  # at most the vocabulary
    seen = counts["id"].to_numpy(np.int64)
    limit = limit_of(len(seen))
    bits = code_lengths(counts["n"].to_numpy(np.int64), limit)
    spark = docs.sparkSession
    codes = scratch.put(spark.createDataFrame(list(zip(seen.tolist(), bits.tolist(), strict=True)), "id long, bits long").coalesce(1), "codes")
    ids_by, bits_by, code_by = canonical(seen, bits, limit)
    bit_of, code_of = np.zeros(int(seen.max(initial=0)) + 1, np.int64), np.zeros(int(seen.max(initial=0)) + 1, np.int64)
    bit_of[ids_by], code_of[ids_by] = bits_by, code_by

    def encode_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in _slices(batches):
            data, edge, marks = encode(ids, bounds, bit_of, code_of)
            n = np.diff(bounds)
            edges = np.concatenate([[0], np.cumsum((n - 1) // STEP)]) * 2
            runs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data.tobytes())])
            checks = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(marks.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("id"), tx.array(n.astype(np.int64)), runs, checks], names=["id", "n", "bits", "marks"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal before, size
            if held:
                t = pa.Table.from_batches(held)
                n = tx.numbers(t.column("n"))
                join = lambda c: b"".join(t.column(c).to_pylist())
                row = {"part": part, "part_start": before, "doc_ids": t.column("id").to_pylist(), "doc_lens": n.tolist(), "doc_bytes": [len(x) for x in t.column("bits").to_pylist()], "bits": join("bits"), "marks": join("marks")}
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                before += int(n.sum())
                held.clear()
                size = 0

        for batch in batches:
            weight = np.cumsum([len(x) for x in batch.column("bits").to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(weight[min(to, len(weight)) - 1] - (weight[at - 1] if at else 0))
                at = to
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield from block()
        yield from block()

    schema = pa.schema([("part", pa.int64()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("doc_bytes", pa.list_(pa.int64())), ("bits", pa.binary()), ("marks", pa.binary())])
    coded = scratch.put(held.mapInArrow(encode_docs, "id long, n long, bits binary, marks binary"), "coded")
    scratch.drop(held)
    rows = coded.repartitionByRange("id").sortWithinPartitions("id")
    blocks = scratch.put(rows.mapInArrow(gather, "part long, part_start long, doc_ids array<long>, doc_lens array<long>, doc_bytes array<long>, bits binary, marks binary"), "blocks")
    scratch.drop(coded)
    return codes, blocks


def read(codes: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    own = codes.toPandas()  # at most the vocabulary
    symbol, length = tables(own["id"].to_numpy(np.int64), own["bits"].to_numpy(np.int64))
    sizes = blocks.select("part", F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    base, total = {}, 0
    for r in sizes:
        base[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lens = batch.column("doc_ids")[i].values, batch.column("doc_lens")[i].values.to_numpy()
                edge = np.concatenate([[0], np.cumsum(batch.column("doc_bytes")[i].values.to_numpy())])
                raw, marks = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("bits", np.uint8), ("marks", "<u2")))
                ids = decode(raw, marks, lens, edge, symbol, length).astype("<u4")
                ends = np.cumsum(lens)
                start = base[batch.column("part")[i].as_py()] + batch.column("part_start")[i].as_py() + ends - lens
                runs = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([doc_ids, tx.array(start), tx.array(lens), runs], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's content; by default that of the public lower-casing vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return tokens.load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), Scratch(spark, "token-files"), vocabulary())
    return read(*files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
