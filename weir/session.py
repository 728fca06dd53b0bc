"""Sessions, tables and the scratch space that executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are long: fewer rows and bytes to an Arrow batch keep executors' and Python workers' buffers small.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_own_dirs: dict[str, str] = {}


def session(app: str = "weir", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="weir-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


class Written(NamedTuple):
    """What is known of a written table: an upper bound if tasks were run again."""

    rows: int
    bytes: int
    more: list


def counts(df: DataFrame) -> Written | None:
    """Of a table that `Scratch.put` gave; null for any other."""
    return getattr(df, "_weir_counts", None)


def width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            total = total + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(c if not isinstance(f.dataType, T.ArrayType) else F.struct(c))), F.lit(0))
    return total


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES if they are higher: results are lazy, so
    the bounds must hold when they are computed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for bound, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            own = spark.conf.get(f"spark.sql.execution.arrow.{bound}")
            size = own.removesuffix("b")
            if not size.isdigit() or not 0 < int(size) <= most:
                spark.conf.set(f"spark.sql.execution.arrow.{bound}", most)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str = "t", *more: Column) -> DataFrame:
        """`df` written and read back. Its rows, bytes and `more` aggregates (`Written`) are counted as it is written."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width(df)), F.lit(0)).alias("bytes"), *more]
        df.observe(seen, *counts).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        got = seen.get
        out._weir_path, out._weir_counts = path, Written(got["rows"], got["bytes"], [got[k] for k in got if k not in ("rows", "bytes")])
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_weir_path", None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
