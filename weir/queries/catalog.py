"""All queries but those of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.operators import policies
from weir.queries import aggregates, dedup, mixing, models, records, scalars, segments, shaped, tabular  # noqa: F401
from weir.queries.registry import QUERIES, SQL, table  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reject reasons of the quality filter by source, with documents and bytes."""
    return policies.report(table(spark, sf_dir, "documents"), policies.quality("english"), "source")
