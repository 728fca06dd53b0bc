"""Mixing, budgets, splits, samples and offsets with an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.contains import running


def hash_key(seed: object, *cols: str) -> Column:
    """A digest that orders rows by seed and columns, alike on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def budget(df: DataFrame, target: int | Column, by: Sequence[str], order: Sequence[str], size: Column, at_least_one: bool = True) -> DataFrame:
    """Whole rows of each group in order until the budget is reached; one row at least if asked for.

    Running sums are two-level (`contains.running`), so a group may hold any share of the rows.
    """
    out = running(df, order, {"_before": size, "_rank": F.lit(1)}, by)
    keep = F.col("_before") + size <= target
    return out.filter((keep | (F.col("_rank") == 0)) if at_least_one else keep).drop("_before", "_rank")


def every_nth(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group and every n-th after it."""
    return running(df, order, {"_rank": F.lit(1)}, by).filter(F.col("_rank") % n == 0).drop("_rank")


def length_buckets(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds `bucket` from 1 to n: each group's rows in order in n parts, the first ones a row larger (as ntile)."""
    out = running(df, order, {"_rank": F.lit(1)}, by, totals=True)
    small = F.floor(F.col("_rank_total") / n)
    large = F.col("_rank_total") % n
    edge = large * (small + 1)
    at = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (small + 1))).otherwise(large + F.floor((F.col("_rank") - edge) / F.greatest(small, F.lit(1))))
    return out.withColumn("bucket", (at + 1).cast("int")).drop("_rank", "_rank_total")


def first_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def interleave(df: DataFrame, chunk: int, source_rank: str, order: Sequence[str]) -> DataFrame:
    """Round-robin by chunks of each source: adds `round` and `slot`, by which (with the source's rank) to sort."""
    at = running(df, order, {"_rank": F.lit(1)}, [source_rank])
    return at.withColumn("round", F.floor(F.col("_rank") / chunk).cast("long")).withColumn("slot", (F.col("_rank") % chunk).cast("long")).drop("_rank")


def tail_holdout(df: DataFrame, share: float, by: str, order: Sequence[str], size: Column) -> DataFrame:
    """Adds `holdout`: rows that start in the last `share` of their group's bytes."""
    out = running(df, order, {"_before": size}, [by], totals=True)
    return out.withColumn("holdout", F.col("_before") >= F.col("_before_total") * (1 - share)).drop("_before", "_before_total")


def bucket(key: Column, buckets: int = 1000) -> Column:
    """First eight bytes of sha256, big-endian, modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)")).cast("int")


def hash_split(df: DataFrame, key: Column, holdout: int = 5, buckets: int = 1000) -> DataFrame:
    """Adds bucket and split; rows of one key are on one side."""
    b = bucket(key, buckets)
    return df.withColumn("bucket", b).withColumn("split", F.when(F.col("bucket") < holdout, "holdout").otherwise("train"))


def reservoir(df: DataFrame, n: int, by: Sequence[str], seed: object, *key: str) -> DataFrame:
    """n rows of each group, uniformly, by seeded hash order; the same rows whatever the partitioning."""
    return first_n(df.withColumn("_h", hash_key(seed, *key)), n, by, ["_h", *key]).drop("_h")


def bernoulli(df: DataFrame, share: float, seed: object, *key: str) -> DataFrame:
    """Rows whose hash falls in the first `share` of its range."""
    unit = F.conv(F.substring(hash_key(seed, *key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return df.filter(unit < share)


def shuffled(df: DataFrame, seed: object, *key: str) -> DataFrame:
    """A global order by hash: a range-partitioned sort."""
    return df.withColumn("shuffle_key", hash_key(seed, *key)).orderBy("shuffle_key", *key)


def replicated(df: DataFrame, copies: Column) -> DataFrame:
    """Each row as often as `copies` says; adds `copy` from 1."""
    return df.withColumn("copy", F.explode(F.when(copies >= 1, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))


def weighted_order(df: DataFrame, weight: Column, seed: object, *key: str) -> DataFrame:
    """Efraimidis-Spirakis keys: the n smallest are a weighted sample without replacement."""
    unit = (F.conv(F.substring(hash_key(seed, *key), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return df.withColumn("sample_key", -F.log(unit) / weight)
