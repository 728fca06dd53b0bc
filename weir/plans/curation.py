"""A whole curation run as one plan: read, policy, deduplicate, budget, split, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators import dedup, mix, policies


@dataclass
class Source:
    """One row of a run's plan."""

    name: str
    language: str = "english"
    profile: str = "prose"
    target_bytes: int | None = None


@dataclass
class Run:
    """Sources with their policies; `execute` gives kept rows, `report` reasons by source."""

    sources: list[Source] = field(default_factory=list)

    def judged(self, docs: DataFrame) -> DataFrame:
        """Documents of the planned sources with the reason of their source's policy."""
        out = None
        for key in dict.fromkeys((s.language, s.profile) for s in self.sources):
            names = [s.name for s in self.sources if (s.language, s.profile) == key]
            part = policies.apply(docs.filter(F.col("source").isin(names)), policies.strict(*key))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("a run needs sources")
        return out

    def execute(self, docs: DataFrame, holdout: int = 5) -> DataFrame:
        kept = self.judged(docs).filter("reason IS NULL").drop("reason")
        kept = dedup.first_by(kept, dedup.text_key("text"), ["source", "doc_id"])
        targets = {s.name: s.target_bytes for s in self.sources if s.target_bytes is not None}
        if targets:
            limit = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in targets.items()), F.lit(2**62))
            kept = mix.budget(kept, limit, ["source"], ["doc_id"], F.octet_length("text"))
        return mix.hash_split(kept, F.concat_ws(":", "source", F.sha2("text", 256)), holdout)

    def report(self, docs: DataFrame) -> DataFrame:
        return self.judged(docs).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"))
