"""Record decisions, generators and the remaining file-level operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import records as r
from weir.functions.exprs import Steps
from weir.operators import generate
from weir.queries.registry import table, query, sql, steps

T = x.col("text")
steps("n17_without_license_banner", "documents", Steps().add(code=x.both("concat('# Copyright 2020', {}, '# License: MIT', {}, {}, "
    "text)", *[x.two("'\\n'", "chr(10)")] * 3)).add(out=r.without_banner(x.col("code"))), "doc_id; md5(out) AS out_md5; length(out) AS n_out")
steps("n18b_fenced_tabs", "conversations", Steps().add(code=x.both("concat('```', {0}, '    a', {0}, '        b', {0}, '```', {0}, '    c ', "
    "text)", x.two("'\\n'", "chr(10)"))).add(out=r.fenced_tabs("code")), "conv_id; turn; md5(out) AS out_md5")
steps("x20_polarity", "conversations", Steps().add(polarity=r.polarity(T)), "conv_id; turn; polarity")
steps("c14_card_score", "part", r.card_score(x.col("p_size") * 1000, x.col("p_size"), x.both("(p_partkey % 3 = 0)"), x.both("(p_partkey % 2 = 0)")), "p_partkey; score; label")
steps("c15_license", "part", Steps().add(raw=x.case((x.both("(p_partkey % 6 = 0)"), "CC BY 4.0"), (x.both("(p_partkey % 6 = 1)"), "cc-by-nc-4.0"), (x.both("(p_partkey % "
    "6 = 2)"), "CC_BY_ND"), (x.both("(p_partkey % 6 = 3)"), "MIT"), (x.both("(p_partkey % 6 = "
    "4)"), "GPL-3.0"), otherwise="cc-by-sa-4.0")).add(**r.license_ok(x.col("raw")).steps[0]).add(**r.license_ok(x.col("raw")).steps[1]), "p_partkey; verdict")
steps("f13_metadata_guard", "part", Steps().add(reason=r.metadata_guard(x.both("CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 2.0 END"), x.col("p_retailprice"), 40.0, 1500.0)), "p_partkey; reason")
steps("f14_forum_comment", "conversations", r.forum_comment(T, x.both("(turn * 3 + 1)")), "conv_id; turn; reason")
steps("f20_safe_code", "documents", Steps().add(verdict=r.safe_code(T)), "doc_id; verdict")
steps("f21_term_search", "documents", Steps().add(hit=r.terms_match(T, ["the", "und"], ["idiot", "password"])), "doc_id; hit")
steps("g14_memories", "conversations", Steps().add(kinds=x.joined(r.memories(T), ",")), "conv_id; turn; kinds")
sql("f17_completeness", "SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'parse_failed' WHEN text LIKE '%<div%' THEN 'garbage_or_html' WHEN role = "
    "'assistant' AND length(text) >= 80 AND right(trim(text), 1) NOT IN ('.', '!', '?', ')') THEN 'truncated_assistant' END AS reason FROM {conversations}")
sql("x19_sample_quality", r.sample_signals("{documents}"))
sql("s11_parquet_scan", "SELECT doc_id, lang FROM {documents} WHERE lang = 'de'")


def _report(view: str) -> str:
    plan = Steps().add(advice=r.recommendation(x.col("n"), x.col("trash"), x.col("repair"), x.col("chat"), x.col("toc")), decision=r.split_decision(x.col("source"), x.col("n"), x.both("(1 "
        "- CAST(trash AS DOUBLE) / n)"), x.both("CAST(NULL AS DOUBLE)"), x.col("perplexity")))
    return plan, f"SELECT source, count(*) AS n, count_if(n_chars > 8000) AS trash, count_if(n_chars < 300) AS repair, count_if(contains(text, '<|')) AS chat, count_if(contains(text, '....')) AS toc, median(n_chars) AS perplexity FROM {view} GROUP BY source"


_plan, _agg = _report("documents")


@query("c12_c13_source_decisions", f"SELECT source, advice, decision FROM {_plan.duck('(' + _agg + ')')} t")
def c12(spark, sf):
    plan, agg = _report("{d}")
    return plan.spark(spark.sql(agg, d=table(spark, sf, "documents"))).select("source", "advice", "decision")


@query("g11_answer_sentence", r"SELECT conv_id, turn, md5(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: "
    r"contains(s, 'the'))[1]) AS h FROM conversations")
def g11(spark, sf):
    s = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda v: F.contains(v, F.lit("the")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.get(s, F.lit(0))).alias("h"))


@query("g15_generated_sums", "SELECT i AS item, a, b, 'Rechne: ' || a || ' + ' || b || ' = ' || (a + b) AS text FROM (SELECT i, (('0x' || substring(md5('21:' || i || "
    "':a'), 1, 6))::BIGINT % 1000) AS a, (('0x' || substring(md5('21:' || i || ':b'), 1, 6))::BIGINT % 1000) AS b FROM range(2000) t(i))")
def g15(spark, sf):
    return generate.sums(spark, 2000, 21)


@query("z06_sampled_windows", "SELECT i AS step, (('0x' || substring(md5('5:' || i || ':w'), 1, 8))::BIGINT % 100000) AS start FROM range(500) t(i)")
def z06(spark, sf):
    return generate.windows(spark, 0, 500, 100_000, 5)


@query("e07_lexed_tokens", r"SELECT doc_id, least(len(l) + 1, 2048) AS n_tokens FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]') AS l FROM documents)")
def e07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.least(F.size(generate.lexemes("text")) + 1, F.lit(2048)).alias("n_tokens"))


assert m
