"""Paged services, shard listings and blob stores, with the fetching function passed in."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """One partition a page. Options: fetch ("module:function", page -> list of dicts), pages, done (pages read before, comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.pages = options["fetch"], int(options["pages"])
        self.done = {int(p) for p in options.get("done", "").split(",") if p}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(self.pages) if p not in self.done] or [InputPartition(-1)]

    def read(self, partition: InputPartition) -> Iterable[tuple]:
        if partition.value >= 0:
            module, _, name = self.fetch.partition(":")
            for record in getattr(importlib.import_module(module), name)(partition.value):
                yield partition.value, json.dumps(record, sort_keys=True)


def paged(spark: SparkSession, fetch: str, pages: int, schema: str, done: Iterable[int] = ()) -> DataFrame:
    """page and the records' fields; pages in `done` are skipped, which resumes a run."""
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged").options(fetch=fetch, pages=str(pages), done=",".join(map(str, done))).load()
    return raw.select("page", F.from_json("record", schema).alias("r")).select("page", "r.*")


def shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON shards of a listing; a damaged or missing shard is left out instead of failing the run (`lost_shards` tells which)."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").json(paths)


def lost_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and why (missing or damaged) of the shards that `shards` leaves out or reads in part."""
    import gzip
    import io

    import pyarrow as pa

    def run(batches):
        for b in batches:
            bad = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path.endswith(".gz"):
                    try:
                        with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
                            while f.read(1 << 20):
                                pass
                    except (OSError, EOFError):
                        bad.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string()), pa.array(["damaged"] * len(bad), pa.string())], names=["path", "why"])

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    there = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    damaged = there.select("path", "content").mapInArrow(run, "path string, why string")
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    missing = listed.withColumn("name", name).join(there.select(name.alias("name")), "name", "left_anti").select("path", F.lit("missing").alias("why"))
    return damaged.unionByName(missing)


def blobs(metadata: DataFrame, fetch: Callable[[str], bytes | None], key: str = "blob_id", keep: str = "NOT is_vendor AND NOT is_generated") -> DataFrame:
    """Metadata rows that pass `keep`, with their blob as text; the filter comes before any fetch."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [fetch(k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if g is None else g.decode("utf-8", "replace") for g in got], pa.string())], names=[key, "text"])

    wanted = metadata.filter(keep)
    return wanted.join(wanted.select(key).distinct().mapInArrow(run, f"{key} string, text string"), key).filter("text IS NOT NULL")


def append_resumable(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's micro-batches as Parquet, each under its batch number, so that a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
