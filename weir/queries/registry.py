"""Named queries over the driver's tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.functions.exprs import E, Steps
from weir import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPLIT = 4 << 20
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts of less than SPLIT bytes a core are dealt out first, since Spark reads them in fewer tasks than there are cores."""
    df = session.table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    few = name in ("documents", "pages", "conversations") and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPLIT * cores
    return df.repartition(cores) if few else df


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def steps(name: str, source: str, plan: Steps, out: str, condition: str = "") -> None:
    """A projection of steps over one table; `out` is a list of columns that both engines read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan.spark(table(spark, sf_dir, source)).selectExpr(*[c.strip() for c in out.split(";")])

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(out.split(';'))} FROM {plan.duck(source)} t {condition}"


def grouped(name: str, source: str, plan: Steps, by: str, aggs: str) -> None:
    """A grouped aggregation after steps; `aggs` is read alike by both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = plan.spark(table(spark, sf_dir, source))
        return spark.sql(f"SELECT {by}, {aggs} FROM {{t}} GROUP BY ALL", t=view)

    QUERIES[name] = run
    SQL[name] = f"SELECT {by}, {aggs} FROM {plan.duck(source)} t GROUP BY ALL"


def sql(name: str, text: str, duck: str | None = None, spark_only: bool = False) -> None:
    """A relational query: `text` with tables in braces runs on Spark; `duck` (or the same text) is the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
        return spark.sql(text, **used)

    QUERIES[name] = run
    if not spark_only:
        plain = duck if duck is not None else text
        for t in TABLES:
            plain = plain.replace("{" + t + "}", t)
        SQL[name] = plain


def expression(e: E) -> str:
    return e.spark
