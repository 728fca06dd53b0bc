"""Operators of `operators.tables` under the names whose SQL the other modules give."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import dedup
from weir.operators import tables as t
from weir.queries.registry import QUERIES, SQL, table

D = lambda s, f: table(s, f, "documents")
E = lambda s, f: table(s, f, "events")
C = lambda s, f: table(s, f, "conversations")
L = lambda s, f: table(s, f, "labels")


def words():
    return F.expr("1 + length(text) - length(replace(text, ' ', ''))")


def labelled(s, f):
    return D(s, f).join(L(s, f), "doc_id")


OPERATORS = {
    "a07_length_bands": lambda s, f: t.length_bands(D(s, f).withColumn("n", words()), "source", "n"),
    "a08_source_stats": lambda s, f: t.source_stats(D(s, f), "source"),
    "a09_weighted_estimate": lambda s, f: t.weighted_estimate(labelled(s, f).groupBy("source").agg(F.avg("quality").alias("rate")), D(s, f).groupBy("source").agg(F.sum("n_chars").alias("bytes")), "source").select(F.round("estimate", 3).alias("estimate")),
    "a10_nullable_metadata": lambda s, f: t.nullable_metadata(D(s, f).join(L(s, f).withColumn("present", F.col("doc_id")), "doc_id", "left"), "source", ["quality"], ["toxic"], "present"),
    "a11_score_histogram": lambda s, f: t.score_histogram(E(s, f), F.col("value") / 20),
    "a13_mean_by_category": lambda s, f: t.mean_by(E(s, f).withColumn("split", (F.col("user_id") % 3).cast("int")), "value", "event_type", "split"),
    "e04_review_pool": lambda s, f: t.most_uncertain(E(s, f), "value", 50, 200, "event_id", 5).select("event_id", "value"),
    "e08_tokens_per_byte": lambda s, f: t.tokens_per_byte(D(s, f), "lang", words()).select("lang", F.round("tokens_per_byte", 9).alias("tokens_per_byte")),
    "u13_prefix_dup_rate": lambda s, f: t.prefix_dup_rate(D(s, f), "source"),
    "u14_duplicate_accounting": lambda s, f: t.duplicate_accounting(D(s, f), "source"),
    "v03b_gate_summary": lambda s, f: t.gate_summary(E(s, f).withColumnRenamed("event_type", "split"), "split", F.col("value") > 20),
    "b10_knowledge_boundary": lambda s, f: t.boundary_labels(E(s, f), "user_id", F.col("value") > 50),
    "b18_threshold_proposal": lambda s, f: t.proposed_thresholds(E(s, f), "event_type", "value"),
    "o01_union_all": lambda s, f: t.ranked_union(*(D(s, f).filter(F.col("lang") == x).select("doc_id") for x in ("de", "en"))).withColumnRenamed("rank", "source_rank"),
    "o02_union_first_wins": lambda s, f: t.first_rank(t.ranked_union(D(s, f).filter("lang = 'de'").select("text"), D(s, f).select("text")), F.md5("text")),
    "j01_reply_prompt": lambda s, f: t.replies(C(s, f)).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.md5("text").alias("reply_md5")),
    "j02_holdout_skip": lambda s, f: t.without(D(s, f).select("doc_id"), L(s, f).filter("quality = 0"), "doc_id"),
    "j03_resume_done": lambda s, f: t.without(D(s, f).select("doc_id"), L(s, f), "doc_id"),
    "j04_score_band": lambda s, f: t.within(D(s, f).select("doc_id", "source"), L(s, f).filter("quality = 1 AND toxic = 0"), "doc_id"),
    "b04_gate_exclusion": lambda s, f: t.without_questions(C(s, f), table(s, f, "benchmark")).select("conv_id", "turn"),
    "b05_provenance": lambda s, f: dedup.first_by(D(s, f), F.md5("text"), ["doc_id"]).select("doc_id", F.concat("source", F.lit(":"), F.coalesce("lang", F.lit("unknown"))).alias("family")),
    "b07_verification_routing": lambda s, f: t.routed(D(s, f), ("src1", "src2"), "4ccccccc", "v", "doc_id").select("doc_id", "verify"),
    "t01_most_uncertain": lambda s, f: t.most_uncertain(E(s, f), "value", 50, 25, "event_id").select("event_id", "gap"),
    "t02_top_k": lambda s, f: t.most_common(E(s, f), "event_type", 3),
    "t10_exact_n": lambda s, f: t.exact_sample(D(s, f).select("doc_id"), 100, 17, "doc_id"),
    "s17_hash_sample": lambda s, f: t.hash_sample(D(s, f), "1", "s", "doc_id").select("doc_id"),
    "s18_head": lambda s, f: t.head(D(s, f).select("doc_id"), 50, "doc_id"),
    "s18b_tail": lambda s, f: t.tail(D(s, f).select("doc_id"), 50, "doc_id"),
    "w09_source_spans": lambda s, f: t.source_spans(D(s, f), "source"),
    "w12_family_quota": lambda s, f: t.family_quota(D(s, f), "source", D(s, f).groupBy("source").agg((F.floor(F.count("*") / 10) + 1).alias("quota")), "doc_id").select("doc_id", "source"),
    "w16_latest_delta": lambda s, f: t.latest_delta(E(s, f), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "value", "delta"),
    "p01_weight_plan": lambda s, f: t.weight_plan(labelled(s, f), "source", "quality", F.avg("quality") >= 0.9, F.sum("toxic") > 2).select("source", F.round("weight", 6).alias("weight")),
    "p02_budget_bytes": lambda s, f: t.budget_bytes(D(s, f), "source", 1_000_000, words()),
    "g10_templated": lambda s, f: t.templated(t.replies(C(s, f))).select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("document").alias("h")),
    "g12_best_answer": lambda s, f: t.best_answers(C(s, f), F.char_length("text")).select("conv_id", F.md5("chosen").alias("h")),
    "g13_threaded_answer": lambda s, f: t.threaded(C(s, f)).select("conv_id", F.size("answers").cast("long").alias("answers")),
    "g18_preference_pair": lambda s, f: t.best_answers(C(s, f), F.char_length("text")).filter("rejected IS NOT "
        "NULL").select("conv_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected")),
    "g19_last_user_turn": lambda s, f: t.last_request(C(s, f)).select("conv_id", F.md5("request").alias("request")),
}
assert set(OPERATORS) <= set(SQL)
QUERIES.update(OPERATORS)
