"""Plans against what is there: budgets, inventories, splits, presets and the shares of training ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators import policies


def budgets(plan: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Plan (language, name, target_tokens, bytes_per_token) with files (name, lines, bytes): target_bytes, bytes and status.

    A planned source without a file is `missing` with 0 bytes, one with fewer bytes than planned `short`; both raise
    ValueError if `strict`.
    """
    out = plan.join(files, "name", "left").withColumn("target_bytes", F.floor(F.col("target_tokens") * F.col("bytes_per_token")).cast("long"))
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < F.col("target_bytes"), "short").otherwise("ok")
    out = out.withColumn("status", status).withColumns({"bytes": F.coalesce("bytes", F.lit(0)), "lines": F.coalesce("lines", F.lit(0))})
    if strict:
        bad = [f"{r['name']}: {r['status']}" for r in out.filter("status <> 'ok'").select("name", "status").orderBy("name").limit(10).collect()]
        if bad:
            raise ValueError(", ".join(bad))
    return out


def inventory(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Each planned source with whether its file exists and its size."""
    return plan.join(files.select("name", F.col("bytes").alias("size_bytes")), "name", "left").withColumns({"exists": F.col("size_bytes").isNotNull(), "size_bytes": F.coalesce("size_bytes", F.lit(0))})


def available(targets: DataFrame, splits: DataFrame, on: Sequence[str], skip_missing: bool = True) -> DataFrame:
    """Targets whose split is there; those without one are left out, or raise ValueError."""
    on = list(on)
    if not skip_missing:
        lost = targets.join(splits, on, "left_anti").select(*on).limit(10).collect()
        if lost:
            raise ValueError(f"missing splits {[tuple(r) for r in lost]}")
    return targets.join(splits, on)


@dataclass(frozen=True)
class Preset:
    """Parameters of the strict filter for one source."""

    source: str
    language: str
    profile: str = "prose"
    least: int | None = None
    most: int | None = None


def by_preset(df: DataFrame, presets: Sequence[Preset], source: str = "source") -> DataFrame:
    """Rows of each preset's source under its policy; adds `reason`. A preset whose source has no rows raises ValueError."""
    there = {r[0] for r in df.filter(F.col(source).isin([p.source for p in presets])).select(source).distinct().collect()}  # at most the presets
    lost = [p.source for p in presets if p.source not in there]
    if lost:
        raise ValueError(f"no rows of {lost}")
    out = None
    for p in presets:
        own = policies.apply(df.filter(F.col(source) == p.source), policies.strict(p.language, p.profile, least=p.least, most=p.most)).select(*df.columns, "reason")
        out = own if out is None else out.unionByName(own)
    return out


def rank_window(start: int, end: int, rank: int, world: int, seq_length: int, name: str = "slice") -> tuple[int, int]:
    """The tokens [from, to) of a contiguous slice that one of `world` ranks reads."""
    if world < 1 or not 0 <= rank < world:
        raise ValueError(f"rank {rank} of {world}")
    if world == 1:
        return start, end
    low, high = (start + (end - start) * r // world for r in (rank, rank + 1))
    if high - low < seq_length + 1:
        raise ValueError(f"{name}: rank {rank} has {high - low} tokens, needs {seq_length + 1}")
    return low, high


def rank_windows(slices: DataFrame, world: int, seq_length: int) -> DataFrame:
    """Slices (name, start, end) -> name, rank, low, high for each rank; a share too small for a sequence raises an error."""
    span = F.col("end") - F.col("start")
    edge = lambda r: (F.col("start") + F.floor(span * r / world)).cast("long")
    out = slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(world - 1))).alias("rank"))
    out = out.select("name", "rank", edge(F.col("rank")).alias("low"), edge(F.col("rank") + 1).alias("high"))
    enough = (F.col("high") - F.col("low") >= seq_length + 1) | F.lit(world == 1)
    return out.withColumn("high", F.when(enough, F.col("high")).otherwise(F.raise_error(F.concat(F.lit("rank share too small: "), "name"))))
