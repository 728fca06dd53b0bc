"""Readers for corpus files: line documents, JSONL, blank-line blocks, wrapped code, repository dumps, HTML, XML, token bins.

Spark has no input order, so documents carry an explicit key where a file has one (block or line number by offset).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import classify
from weir.functions import exprs as x
from weir.operators import segment
from weir.operators.contains import running

Paths = str | Sequence[str]


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """source, text: one document a line, empty lines skipped; plain or gzip."""
    df = spark.read.text(_list(paths))
    return df.select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"\r$", "").alias("text")).filter("length(text) > 0")


def plain_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """source, text, lang: one document a line with the programming language that it looks like (unknown if none)."""
    return classify.code_language(x.col("text")).spark(lines(spark, paths)).select("source", "text", F.col("label").alias("lang"))


def numbered(df: DataFrame, order: Sequence[str], wanted: DataFrame, number: str = "line_no") -> DataFrame:
    """Rows whose place in the order, from 1, is among `wanted` (a column of that name); adds it.

    Places are two-level running counts, so no task numbers all rows.
    """
    placed = running(df, order, {number: F.lit(1)}).withColumn(number, F.col(number) + 1)
    return placed.join(wanted.select(number).distinct(), number, "left_semi")


def jsonl(spark: SparkSession, paths: Paths, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and, apart, corrupt lines; plain or gzip. Bad JSON is counted, not fatal."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(_list(paths)).filter(F.trim("value") != "").select("value", F.from_json("value", T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return raw.filter(~bad).select(*(F.col("r").getField(f.name).alias(f.name) for f in wanted.fields)), raw.filter(bad).select("value")


def blocks(spark: SparkSession, paths: Paths) -> DataFrame:
    """source, block, text: documents between blank lines of a file (a file is one task's)."""
    df = spark.read.text(_list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return df.select("source", F.posexplode(segment.blocks("value")).alias("block", "text"))


def code_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    """source, lang, text of wrapped code documents; an unterminated last one counts."""
    df = spark.read.text(_list(paths), lineSep="<|endcode|>\n").select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"\n?<\|endcode\|>\s*\z", "").alias("v"))
    head = r"(?s)^.*?<\|code\|>\[([A-Za-z0-9_+#.-]+)\][ \t]*\n"
    return df.filter(F.col("v").rlike(head)).select("source", F.lower(F.regexp_extract("v", head, 1)).alias("lang"), F.regexp_replace(F.regexp_replace("v", head, ""), r"\n\z", "").alias("text"))


def repositories(spark: SparkSession, paths: Paths) -> DataFrame:
    """repo, code: pieces between <reponame> marks."""
    df = spark.read.text(_list(paths), lineSep="<reponame>").filter(F.trim("value") != "")
    return df.select(F.trim(F.substring_index("value", "\n", 1)).alias("repo"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("code"))


def detect(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """The right reader by suffix and first line."""
    if path.split(".gz")[0].endswith(("jsonl", "json")):
        return jsonl(spark, path, schema)[0]
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].startswith("<|code|>"):
        return code_documents(spark, path)
    return lines(spark, path)


def files(spark: SparkSession, paths: Paths, pattern: str = "*") -> DataFrame:
    """path, length, modified of files, without their content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(_list(paths))
    return df.select("path", "length", F.col("modificationTime").alias("modified"))


def checked(spark: SparkSession, paths: Paths, manifest: DataFrame) -> DataFrame:
    """Each manifest row (path, size_bytes, sha256) with `problem`: missing, size, hash or null."""
    found = spark.read.format("binaryFile").load(_list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "length", F.sha2("content", 256).alias("got"))
    both = manifest.withColumn("path", F.element_at(F.split("path", "/"), -1)).join(found, "path", "left")
    return both.withColumn("problem", F.when(F.col("got").isNull(), "missing").when(F.col("length") != F.col("size_bytes"), "size").when(F.col("got") != F.col("sha256"), "hash")).drop("got", "length")


def xml(spark: SparkSession, paths: Paths, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(_list(paths) if not isinstance(paths, str) else paths)


def archives(spark: SparkSession, paths: Paths, least: int = 200) -> DataFrame:
    """archive, name, text of the .xml, .html and .txt members of zip and tar files, tags stripped."""

    def run(batches):
        import io
        import re
        import tarfile
        import zipfile

        for batch in batches:
            rows = {"archive": [], "name": [], "text": []}
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = io.BytesIO(content)
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        members = [(n, z.read(n)) for n in z.namelist()]
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        members = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                for name, raw in members:
                    if name.lower().endswith((".xml", ".html", ".txt")):
                        text = " ".join(re.sub(r"<[^>]*>", " ", raw.decode("utf-8", "replace")).split())
                        if len(text) >= least:
                            for k, v in zip(rows, (path, name, text), strict=True):
                                rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("archive", pa.string()), ("name", pa.string()), ("text", pa.string())]))

    df = spark.read.format("binaryFile").load(_list(paths)).select("path", "content")
    return df.mapInArrow(run, "archive string, name string, text string")


def token_bins(spark: SparkSession, bins: str, index: str) -> DataFrame:
    """doc, tokens from a flat little-endian uint32 file and its int64 (offset, length) pairs."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                flat, pairs = np.frombuffer(a, "<u4"), np.frombuffer(b, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array([flat[o : o + n].astype(np.int64) for o, n in pairs], pa.list_(pa.int64()))], names=["doc", "tokens"])

    one = lambda p, c: spark.read.format("binaryFile").load(p).select(F.col("content").alias(c), F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("name"))
    return one(bins, "a").join(one(index, "b"), "name").select("a", "b").mapInArrow(run, "doc long, tokens array<long>")


def log_points(df: DataFrame, column: str = "value") -> DataFrame:
    """step, metric, value from training log lines; works on batch and streaming text."""
    step = F.regexp_extract(column, r"step[ =:]+(\d+)", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(column, F.lit(r"\b([a-z_]+)[=:]\s*(-?[0-9.]+(?:e-?[0-9]+)?)"), F.lit(1)).alias("metric"), F.regexp_extract_all(column, F.lit(r"\b([a-z_]+)[=:]\s*(-?[0-9.]+(?:e-?[0-9]+)?)"), F.lit(2)).alias("v"))
    out = df.filter(step != "").select(step.cast("long").alias("step"), F.explode(pairs).alias("p"))
    return out.select("step", F.col("p.metric").alias("metric"), F.col("p.v").try_cast("double").alias("value")).filter("metric <> 'step' AND value IS NOT NULL")


def tree_replies(messages: DataFrame) -> DataFrame:
    """Replies with their parent's text: a self-join on message_id = parent_id."""
    p = messages.select(F.col("message_id").alias("parent_id"), F.col("text").alias("prompt"))
    return messages.join(p, "parent_id")
