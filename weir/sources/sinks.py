"""Writers: line documents, JSONL, category folders, token bins, unions of splits and manifests.

A folder is written beside its place and takes it only when the whole job has succeeded, so a failed run leaves what was
there before (`atomically`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def atomically(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run `write` on a folder beside `path` and move it there; on failure it is deleted and `path` stays as it was."""
    path = path.rstrip("/")
    staged, old = f"{path}.{uuid.uuid4().hex}.part", f"{path}.{uuid.uuid4().hex}.old"
    fs, target = _path(spark, path)
    _, new = _path(spark, staged)
    _, aside = _path(spark, old)
    try:
        write(staged)
        there = fs.exists(target)
        if there and not fs.rename(target, aside):
            raise OSError(f"could not move {path} aside")
        if not fs.rename(new, target):
            if there:
                fs.rename(aside, target)
            raise OSError(f"could not move {staged} to {path}")
        if there:
            fs.delete(aside, True)
    finally:
        if fs.exists(new):
            fs.delete(new, True)


def lines(df: DataFrame, path: str, text: str = "text", gzip: bool = False) -> None:
    """One document a line, white space runs as one space."""
    out = df.select(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("value")).filter("value <> ''")
    atomically(df.sparkSession, path, out.write.option("compression", "gzip" if gzip else "none").text)


def jsonl(df: DataFrame, path: str, gzip: bool = False, by: str | None = None) -> None:
    w = df.write.option("compression", "gzip" if gzip else "none")
    atomically(df.sparkSession, path, (w.partitionBy(by) if by else w).json)


def concatenated(splits: Sequence[DataFrame], path: str, text: str = "text") -> dict:
    """The line documents of all splits as one folder, in the order of the splits; documents and bytes written."""
    own = [d.select(F.lit(i).alias("split"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("value")) for i, d in enumerate(splits)]
    rows = reduce(DataFrame.unionByName, own).filter("value <> ''")
    spark = rows.sparkSession
    atomically(spark, path, rows.select("value").write.option("compression", "none").text)
    n = spark.read.text(path).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first()
    return {"output_file": path, "docs": n["docs"], "bytes": n["bytes"]}


def _plain(x: object) -> object:
    """Mappings, lists and plain scalars as they are, anything else as text."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def _manifest_text(spark: SparkSession, path: str) -> dict:
    fs, p = _path(spark, path)
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if fs.exists(p) else {}


def start_run(spark: SparkSession, path: str, config: dict, metadata: dict, **more: object) -> None:
    """The manifest of a run that begins. It is JSON, which every YAML reader takes."""
    _write_text(spark, path, {"status": "started", "metadata": metadata, "config": config, **more})


def end_run(spark: SparkSession, path: str, reason: str, state: dict, health: dict | None = None) -> dict:
    """Adds what is known at the end to the manifest of a run; without one (or an unreadable one) it begins anew."""
    try:
        known = _manifest_text(spark, path)
    except ValueError:
        known = {}
    out = known | {"status": "finished", "exit_reason": reason, "final_state": state, "health": health or {}}
    _write_text(spark, path, out)
    return _plain(out)


def _write_text(spark: SparkSession, path: str, content: dict) -> None:
    body = json.dumps(_plain(content), ensure_ascii=False, indent=1)
    atomically(spark, path, spark.createDataFrame([(body,)], "value string").coalesce(1).write.text)


def manifest(df: DataFrame, reason: str = "reason", text: str = "text") -> dict:
    """Documents, bytes and drops by reason, from one aggregation (a row for each reason)."""
    rows = df.groupBy(reason).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).collect()
    kept = [r for r in rows if r[reason] is None]
    return {
        "docs_in": sum(r["n"] for r in rows),
        "docs_written": sum(r["n"] for r in kept),
        "bytes_written": sum(r["b"] or 0 for r in kept),
        "dropped": {r[reason]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], r[reason] or "")) if r[reason] is not None},
    }


def manifest_markdown(m: dict) -> str:
    head = ["| reason | documents |", "| --- | --- |", f"| kept | {m['docs_written']} |"]
    return "\n".join(head + [f"| {k} | {v} |" for k, v in m["dropped"].items()])


def write_manifest(m: dict, df: DataFrame, path: str) -> None:
    """The manifest as a one-line JSON text beside the data."""
    df.sparkSession.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def token_pair(df: DataFrame, path: str, end: int, order: str = "doc", tokens: str = "tokens") -> dict:
    """`path`.bin, the ids of all documents in order as little-endian uint32 with `end` after each, and `path`.idx, their places.

    Tasks write the parts of `token_bins`; the driver then appends their bytes one document at a time, so it holds one.
    The index has a pair (offset, length) of int64 for each document. Documents without ids are left out. Both files
    appear only when they are whole.
    """
    spark = df.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    token_bins(df.filter(F.size(tokens) > 0).withColumn(tokens, F.concat(tokens, F.array(F.lit(end)))), parts, order, tokens)
    fs, _ = _path(spark, path)
    staged = {s: _path(spark, f"{path}.{s}.part")[1] for s in ("bin", "idx")}
    docs = ids = 0
    out = {s: fs.create(p, True) for s, p in staged.items()}
    try:
        for row in spark.read.parquet(parts).orderBy("offset", "k").select("offset", "n", "ids").toLocalIterator():
            out["bin"].write(bytearray(row["ids"]))
            out["idx"].write(bytearray(np.array([row["offset"], row["n"]], "<i8").tobytes()))
            docs, ids = docs + 1, ids + row["n"]
    finally:
        for stream in out.values():
            stream.close()
        fs.delete(_path(spark, parts)[1], True)
    for s, p in staged.items():
        target = _path(spark, f"{path}.{s}")[1]
        fs.delete(target, False)
        fs.rename(p, target)
    return {"docs": docs, "tokens": ids}


def token_bins(df: DataFrame, path: str, order: str = "doc", tokens: str = "tokens") -> None:
    """Parts of (offset, n, ids as little-endian uint32 bytes) in ascending order: the flat file is their concatenation.

    Offsets are prefix sums that no single task computes over all rows.
    """
    from weir.operators.contains import prefix_sums

    sized = prefix_sums(df.withColumn("n", F.size(tokens)), order, "n", "offset")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = [np.array(x, "<u4").tobytes() for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("offset"), b.column("n"), pa.array(raw, pa.binary())], names=["k", "offset", "n", "ids"])

    out = sized.select(F.col(order).cast("long").alias("k"), F.col("offset").cast("long").alias("offset"), F.col("n").cast("long").alias("n"), F.col(tokens).alias("t"))
    out.mapInArrow(run, "k long, offset long, n long, ids binary").repartitionByRange("k").sortWithinPartitions("k").write.mode("overwrite").parquet(path)
