"""Queries of operators whose inputs the driver's tables don't have: small views shape them alike for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import exprs as x
from weir.functions import normalise as nz
from weir.functions.exprs import Steps
from weir.operators import evaluate, execute, gates, generate, knowledge, plan, policies, retrieve, segment, structure
from weir.queries.registry import TABLES, query, table
from weir.sources import readers, schemas


class View:
    """A relation over the driver's tables as text that both engines read; `duck` where theirs differs."""

    def __init__(self, text: str, duck: str | None = None):
        self.text, self.own = text, duck or text

    def spark(self, spark, sf) -> DataFrame:
        used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in self.text}
        return spark.sql(self.text, **used)

    @property
    def duck(self) -> str:
        out = self.own
        for t in TABLES:
            out = out.replace("{" + t + "}", t)
        return f"({out})"


def register(name: str, sql: str | None, make: Callable) -> None:
    query(name, sql)(make)


def steps(name: str, view: View, plan_: Steps, out: str) -> None:
    """A projection of steps over a view; out is separated by semicolons."""
    cols = [c.strip() for c in out.split(";")]
    register(name, f"SELECT {', '.join(cols)} FROM {plan_.duck(view.duck)} t", lambda spark, sf: plan_.spark(view.spark(spark, sf)).selectExpr(*cols))


# Evaluation
LOSSES = View("SELECT doc_id, lang, 2.0 + (doc_id % 7) / 10.0 AS loss, 1 + length(text) - length(replace(text, ' ', '')) AS tokens, octet_length(text) AS bytes FROM "
    "{documents}", "SELECT doc_id, lang, 2.0 + (doc_id % 7) / 10.0 AS loss, 1 + length(text) - length(replace(text, ' ', '')) AS tokens, strlen(text) AS bytes FROM "
    "{documents}")
register(
    "a16_bits_per_byte",
    f"WITH p AS (SELECT lang, sum(loss * tokens)::DOUBLE / sum(bytes) / ln(2::DOUBLE) AS bpb FROM {LOSSES.duck} GROUP BY lang) SELECT lang, round(bpb, 9) AS bpb, (SELECT "
        f"round(max(bpb) / min(bpb), 9) FROM p) AS gap FROM p",
    lambda s, sf: evaluate.bits_per_byte(LOSSES.spark(s, sf).withColumn("loss", F.col("loss").cast("double"))).select("lang", F.round("bpb", 9).alias("bpb"), F.round("gap", 9).alias("gap")),
)
register(
    "b19_perplexity",
    f"SELECT lang, count(*) AS docs, round(exp(sum(loss * (tokens - 1))::DOUBLE / sum(tokens - 1)), 9) AS ppl FROM {LOSSES.duck} WHERE tokens >= 8 GROUP BY lang",
    lambda s, sf: evaluate.perplexity(LOSSES.spark(s, sf).selectExpr("lang", "CAST(loss * (tokens - 1) AS DOUBLE) AS loss", "tokens - 1 AS "
        "tokens"), "lang").select("lang", "docs", F.round("ppl", 9).alias("ppl")),
)
RECORDS = View("SELECT user_id AS id, event_id AS place, event_type AS task_type, concat('m', CAST(event_id % 5 AS STRING)) AS model, concat('b', CAST(event_id % 3 AS "
    "STRING)) AS source_batch FROM {events}")
_last = "(SELECT id, max_by(task_type, place) AS task_type, max_by(model, place) AS model, max_by(source_batch, place) AS source_batch FROM " + RECORDS.duck + " GROUP BY id)"
register(
    "a18_counts",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM {_last} GROUP BY {d}" for d in ("task_type", "model", "source_batch")),
    lambda s, sf: evaluate.counted(RECORDS.spark(s, sf), ("task_type", "model", "source_batch"), order="place"),
)
PROBES = View("SELECT event_id AS id, event_type AS family, CASE WHEN user_id % 3 = 0 THEN 'retention' ELSE 'target' END AS split, 100 - 2 * value AS margin, CASE WHEN "
    "value < 97 THEN 1.0 ELSE 0.5 END AS semantic_score FROM {events}")
register(
    "a19_margins",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS name, count(*) AS n, {r} AS pass_rate, round(avg(margin), 6) AS mean_margin FROM {PROBES.duck} GROUP "
        f"BY {k}" for k, r in (("split", "round(avg((margin > 0)::INT), 6)"), ("family", "NULL"))),
    lambda s, sf: evaluate.margins(PROBES.spark(s, sf)).select("kind", "name", "n", F.round("pass_rate", 6).alias("pass_rate"), F.round("mean_margin", 6).alias("mean_margin")),
)
register(
    "a19b_promotable",
    "SELECT " + ", ".join(f"round(count_if(split = '{p}' AND semantic_score = 1) / count_if(split = '{p}')::DOUBLE, 9) AS {p}_pass, count_if(split = '{p}' AND "
        f"semantic_score <> 1) AS {p}_failures" for p in ("target", "retention")) + f", count_if(semantic_score <> 1) = 0 AS promotable FROM {PROBES.duck}",
    lambda s, sf: evaluate.promotable(PROBES.spark(s, sf)).select(F.round("target_pass", 9).alias("target_pass"), "target_failures", F.round("retention_pass", 9).alias("retention_pass"), "retention_failures", "promotable"),
)
CHOICES = View("SELECT user_id AS question, CAST(event_id % 4 AS INT) AS choice, -max(value) AS loglik, 1 + max(event_id) % 7 AS tokens, CAST(user_id % 4 AS INT) AS gold "
    "FROM {events} GROUP BY user_id, event_id % 4")
for _name, _score in (("a20_multiple_choice", "loglik"), ("a20c_normalised_choice", "loglik / tokens")):
    register(
        _name,
        f"SELECT question, choice AS chosen, choice = gold AS right FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY {_score} DESC, choice) AS r FROM {CHOICES.duck}) WHERE r = 1",
        lambda s, sf, n=_name != "a20_multiple_choice": evaluate.choices(CHOICES.spark(s, sf), n).select("question", "chosen", "right"),
    )
register(
    "a20b_last_number",
    r"SELECT doc_id, CAST(list_last(regexp_extract_all(replace(text, ',', ''), '-?\d+(?:[.,]\d+)?')) AS DOUBLE) AS answer FROM documents",
    lambda s, sf: table(s, sf, "documents").select("doc_id", evaluate.last_number("text").alias("answer")),
)
REPLIES = View("SELECT a.conv_id, a.turn, a.text AS answer, array(p.text, substring(a.text, 1, 40)) AS golds FROM {conversations} a JOIN {conversations} p ON a.conv_id = "
    "p.conv_id AND a.turn = p.turn + 1", "SELECT a.conv_id, a.turn, a.text AS answer, [p.text, substring(a.text, 1, 40)] AS golds FROM {conversations} a JOIN "
    "{conversations} p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1")
_words = r"list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''))".format
_f1 = f"CASE WHEN len(list_intersect({_words('answer')}, {_words('g')})) > 0 THEN 2.0::DOUBLE * len(list_intersect({_words('answer')}, {_words('g')})) / (len({_words('answer')}) + len({_words('g')})) ELSE 0 END"
register("a20d_answer_f1", f"SELECT conv_id, turn, round(coalesce(list_max(list_transform(golds, lambda g: {_f1})), 0), 6) AS f1 "
    f"FROM {REPLIES.duck}", lambda s, sf: REPLIES.spark(s, sf).select("conv_id", "turn", F.round(evaluate.best_f1("answer", F.col("golds")), 6).alias("f1")))
ANSWERS = View(
    "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE array('the', 'und') END AS gold, CASE WHEN conv_id % 3 = 1 THEN 'capital' ELSE 'other' END AS cat, "
        "collect_list(text) AS answers FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id",
    "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE ['the', 'und'] END AS gold, CASE WHEN conv_id % 3 = 1 THEN 'capital' ELSE 'other' END AS cat, list(text) AS "
        "answers FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id",
)
_ab = "len(list_filter(answers, lambda a: contains(lower(a), 'que') OR contains(lower(a), 'por')))"
_hit = "len(list_filter(answers, lambda a: contains(lower(a), 'the') OR contains(lower(a), 'und')))"
register(
    "b12_answer_gate",
    f"SELECT count_if(gold IS NULL) AS invented, count_if(gold IS NULL AND {_ab} >= greatest(1, len(answers) // 2)) AS invented_abstained, count_if(gold IS NOT NULL AND "
        f"cat = 'capital') AS special, count_if(gold IS NOT NULL AND cat = 'capital' AND {_hit} >= 0.6::DOUBLE * len(answers)) AS special_known, count_if(gold IS NOT "
        f"NULL AND cat <> 'capital') AS other, count_if(gold IS NOT NULL AND cat <> 'capital' AND {_ab} >= 0.5::DOUBLE * len(answers)) AS other_abstained "
        f"FROM {ANSWERS.duck}",
    lambda s, sf: evaluate.answer_gate(ANSWERS.spark(s, sf), ("que", "por")),
)
GENERATED = View(
    "SELECT conv_id, turn, text AS generated, 'the' AS answer, CASE WHEN turn % 2 = 0 THEN array('  Une ', 'und') ELSE array() END AS aliases, array('idiot', 'a  la') AS "
        "forbidden FROM {conversations}",
    "SELECT conv_id, turn, text AS generated, 'the' AS answer, CASE WHEN turn % 2 = 0 THEN ['  Une ', 'und'] ELSE [] END AS aliases, ['idiot', 'a  la'] AS forbidden FROM {conversations}",
)
_flat = r"trim(regexp_replace(lower(generated), '\s+', ' ', 'g'))"
register(
    "b14_generation_match",
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN contains({_flat}, 'une') OR contains({_flat}, 'und') ELSE contains({_flat}, 'the') END AS matched, "
        f"contains({_flat}, 'idiot') OR contains({_flat}, 'a la') AS forbidden_hit, contains(generated, '<memory>') OR contains(generated, '<recall>') AS tag_echo "
        f"FROM {GENERATED.duck}",
    lambda s, sf: evaluate.generation_match(GENERATED.spark(s, sf)).select("conv_id", "turn", "matched", "forbidden_hit", "tag_echo"),
)
HISTORY = View("SELECT CAST(floor(event_id / 50) AS BIGINT) AS step, event_id, user_id AS id, CASE WHEN event_type = 'view' THEN NULL ELSE (value - 50) / 50 END AS "
    "margin, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM {events}")
_row = f"(SELECT step, id, max(margin) AS margin, max(bad) AS bad FROM {HISTORY.duck} GROUP BY step, id)"


def _history(s, sf) -> DataFrame:
    own = HISTORY.spark(s, sf).groupBy("step", "id").agg(F.max("margin").alias("margin"), F.max("bad").alias("bad"))
    probe = F.struct("id", "margin", F.when(F.col("bad") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("forbidden_hits"))
    return own.groupBy("step").agg(F.collect_list(probe).alias("probes"))


register(
    "b17_trace_status",
    f"SELECT id, steps, round(margin, 9) AS margin, CASE WHEN bad = 1 THEN 'danger' WHEN margin IS NULL THEN 'unknown' WHEN margin >= 0.75 THEN 'strong' WHEN margin >= 0 "
        f"THEN 'watch' ELSE 'weak' END AS status FROM (SELECT id, margin, bad, count(*) OVER (PARTITION BY id) AS steps, row_number() OVER (PARTITION BY id ORDER BY step "
        f"DESC) AS r FROM {_row}) WHERE r = 1",
    lambda s, sf: evaluate.trace_status(_history(s, sf)).select("id", "steps", F.round("margin", 9).alias("margin"), "status"),
)
RESULTS = View("SELECT doc_id, concat('f', CAST(doc_id AS STRING)) AS func, n_chars > 1000 AS passed, n_chars > 300 AS syntax_ok, doc_id % 5 <> 0 AS stopped FROM {documents}")
TRAINED = View("SELECT concat('f', CAST(doc_id AS STRING)) AS func FROM {labels}")
register(
    "b20_seen_gate",
    f"SELECT count(*) AS n, round(avg(syntax_ok::INT), 2) AS syntax_rate, count_if(passed) AS passed, round(avg(stopped::INT), 2) AS stop_rate, count_if(NOT seen) AS "
        f"unseen, count_if(NOT seen AND passed) AS unseen_passed FROM (SELECT *, func IN (SELECT func FROM {TRAINED.duck}) AS seen FROM {RESULTS.duck})",
    lambda s, sf: evaluate.code_gate(RESULTS.spark(s, sf), TRAINED.spark(s, sf)),
)
CASES = View(
    "SELECT DISTINCT conv_id AS id, conv_id % 4 = 0 AS fake, array('the', 'que') AS in_text, array('and', 'der') AS in_answer FROM {conversations}",
    "SELECT DISTINCT conv_id AS id, conv_id % 4 = 0 AS fake, ['the', 'que'] AS in_text, ['and', 'der'] AS in_answer FROM {conversations}",
)
PASSAGES = View("SELECT conv_id AS id, role AS title, substring(text, 1, 200) AS intro FROM {conversations} WHERE role = 'user'")
SAID = View("SELECT conv_id AS id, max_by(text, turn) AS answer FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id")
_case = f"(SELECT c.id, c.fake, coalesce((SELECT bool_or(contains(lower(title || ' ' || intro), 'the') OR contains(lower(title || ' ' || intro), 'que')) FROM {PASSAGES.duck} p WHERE p.id = c.id), false) AS in_text, lower(coalesce(a.answer, '')) AS said FROM {CASES.duck} c LEFT JOIN {SAID.duck} a ON a.id = c.id)"
register(
    "b22_rag_gate",
    f"SELECT count_if(NOT fake) AS real, count_if(NOT fake AND in_text) AS retrieval_hit, count_if(NOT fake AND NOT contains(said, 'pour') AND (contains(said, 'and') OR "
        f"contains(said, 'der'))) AS reader_hit, count_if(fake) AS fake, count_if(fake AND contains(said, 'pour')) AS safe_abstain, count_if(fake AND NOT contains(said, "
        f"'pour')) AS bad_answer FROM {_case}",
    lambda s, sf: evaluate.rag_gate(CASES.spark(s, sf), PASSAGES.spark(s, sf), SAID.spark(s, sf), ("pour",)),
)
CONTINUATIONS = View("SELECT user_id AS id, concat('c', CAST(user_id % 5 AS STRING)) AS cat, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'easy' WHEN 2 THEN 'med' WHEN "
    "3 THEN 'hard' END AS hardness, min(value) AS nll FROM {events} WHERE event_id % 5 < 4 GROUP BY ALL")
_best = f"(SELECT id, cat, min(nll) FILTER (hardness IS NULL) AS own, min(nll) FILTER (hardness = 'easy') AS easy, min(nll) FILTER (hardness = 'med') AS med, min(nll) FILTER (hardness = 'hard') AS hard FROM {CONTINUATIONS.duck} GROUP BY id, cat)"
register(
    "v06_beats_distractor",
    f"SELECT cat, count(*) AS n, round(avg(coalesce(hard > own, med > own, easy > own, false)::INT), 9) AS strict, round(avg((easy > own)::INT), 9) AS easy, "
        f"round(avg((med > own)::INT), 9) AS med, round(avg((hard > own)::INT), 9) AS hard FROM {_best} GROUP BY cat",
    lambda s, sf: evaluate.strict_profile(CONTINUATIONS.spark(s, sf)).select("cat", "n", *(F.round(c, 9).alias(c) for c in ("strict", *evaluate.HARDNESS))),
)
ASKED, GIVEN = View("SELECT doc_id AS id, lang AS split FROM {documents}"), View("SELECT doc_id AS id, quality AS answer FROM {labels}")
register(
    "j06_probe_results",
    f"SELECT p.id, p.split, r.answer, r.id IS NULL AS missing FROM {ASKED.duck} p LEFT JOIN {GIVEN.duck} r ON r.id = p.id",
    lambda s, sf: (lambda a, b: evaluate.probe_results(a, b, complete=False).withColumn("missing", F.lit(False)).unionByName(evaluate.missing_results(a, b).withColumn("missing", F.lit(True)), allowMissingColumns=True))(ASKED.spark(s, sf), GIVEN.spark(s, sf)),
)
SCORED = View("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(text, ' Bewertung: ', CAST(conv_id % 6 AS STRING), ' von 9') ELSE concat('Note ', CAST(conv_id % "
    "8 AS STRING), ' ', text) END AS text FROM {conversations}")
register(
    "e05_parsed_score",
    rf"SELECT conv_id, turn, CAST(coalesce(list_last(regexp_extract_all(text, 'Bewertung:\s*([0-5])', 1)), list_last(regexp_extract_all(text, '\b([0-5])\b', 1))) AS INT) AS score FROM {SCORED.duck}",
    lambda s, sf: SCORED.spark(s, sf).select("conv_id", "turn", evaluate.parsed_score("text").alias("score")),
)
EDU = View("SELECT doc_id, CAST(n_chars % 600 AS DOUBLE) / 100 AS score FROM {documents}")
register("f19_score_threshold", f"SELECT doc_id FROM {EDU.duck} WHERE score >= 3", lambda s, sf: evaluate.edu_keep(EDU.spark(s, sf)).select("doc_id"))
register("f19b_score_band", f"SELECT doc_id, score FROM (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS r FROM {EDU.duck} WHERE score >= 1.5 AND score < 3) "
    f"WHERE r <= 100", lambda s, sf: evaluate.score_band(EDU.spark(s, sf), 1.5, 3.0, 100))

# Chat records
CHATS = View(
    "SELECT conv_id, transform(t, v -> v.role) AS roles, transform(t, v -> v.text) AS contents, CASE WHEN conv_id % 9 = 0 THEN 'coding' ELSE 'talk' END AS category, CASE "
        "WHEN conv_id % 5 = 0 THEN 'guard_v1' ELSE 'mix' END AS source FROM (SELECT conv_id, array_sort(collect_list(struct(turn, role, concat(text, CASE WHEN conv_id % "
        "2 = 0 THEN ' Das ist die Antwort und sie wird nicht länger.' ELSE '' END) AS text))) AS t FROM {conversations} GROUP BY conv_id)",
    "SELECT conv_id, list(role ORDER BY turn) AS roles, list(concat(text, CASE WHEN conv_id % 2 = 0 THEN ' Das ist die Antwort und sie wird nicht länger.' ELSE '' END) "
        "ORDER BY turn) AS contents, CASE WHEN conv_id % 9 = 0 THEN 'coding' ELSE 'talk' END AS category, CASE WHEN conv_id % 5 = 0 THEN 'guard_v1' ELSE 'mix' END AS "
        "source FROM {conversations} GROUP BY conv_id",
)
steps("b01_response_fix", CHATS, gates.response_fix(), "conv_id; reason")
steps("b02_prompt_category", CHATS, gates.prompt_category(), "conv_id; prompt_category")
RENDERED = View(
    r"SELECT conv_id, turn, concat('<|system|>\nx\n<|end|>\n<|user|>\n', substring(text, 1, 30), '\n<|end|>\n<|assistant|>\n', substring(text, 1, 20 + CAST(turn * 300 AS "
        r"INT)), '\n<|end|>\n') AS text, CASE conv_id % 3 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'translation' ELSE 'code_general' END AS category FROM {conversations}",
    "SELECT conv_id, turn, concat('<|system|>', chr(10), 'x', chr(10), '<|end|>', chr(10), '<|user|>', chr(10), substring(text, 1, 30), chr(10), '<|end|>', chr(10), "
        "'<|assistant|>', chr(10), substring(text, 1, (20 + turn * 300)::INT), chr(10), '<|end|>', chr(10)) AS text, CASE conv_id % 3 WHEN 0 THEN 'rewrite' WHEN 1 THEN "
        "'translation' ELSE 'code_general' END AS category FROM {conversations}",
)
steps("b03_answer_shape", RENDERED, gates.clean_sft(), "conv_id; turn; keep; length(answer) AS n_answer")

# Code and forum records
FILES = View("SELECT doc_id, text AS content, coalesce(lang, 'unknown') AS lang, doc_id % 50 AS stars FROM {documents}")
steps("b06_code_gates", FILES, gates.code_file(), "doc_id; reason; md5(wrapped) AS wrapped_md5")
CODE = View("SELECT doc_id, concat(text, CASE WHEN doc_id % 11 = 0 THEN ' # do not edit' WHEN doc_id % 13 = 0 THEN ' password: \"abcdefghijklmnop\"' ELSE '' END) AS "
    "content, CASE WHEN doc_id % 7 = 0 THEN 'lib/vendor/a.py' ELSE 'src/a.py' END AS path, CASE doc_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'gpl-3.0' WHEN 2 THEN NULL ELSE "
    "'isc' END AS license, doc_id % 17 = 0 AS autogenerated, doc_id % 9 AS copies, n_chars % 400 AS line_max, n_chars % 200 AS line_mean FROM {documents}")
steps("f12_record_gate", CODE, gates.code_record(), "doc_id; concat_ws(',', reasons) AS reasons")
FORUM = View("SELECT page_id, html AS question, concat('<p>', substring(url, 1, 60), CASE WHEN page_id % 3 = 0 THEN '</p><pre><code>x = 1</code></pre>' ELSE '</p>' END, "
    "html) AS answer, page_id % 12 AS score FROM {pages}")
steps("f18_preference_gate", FORUM, gates.preference(), "page_id; reason; md5(problem) AS problem_md5")
_mod = ", ".join(f"{v} AS {k}" for k, v in zip(gates.MODERATION, ("value / 100", "value / 200", "0.0D", "CAST(NULL AS DOUBLE)", "0.1D", "value / 150", "0.0D"), strict=True))
_dmod = ", ".join(f"'{k}': {v}" for k, v in zip(gates.MODERATION, ("value / 100", "value / 200", "0.0::DOUBLE", "NULL::DOUBLE", "0.1::DOUBLE", "value / 150", "0.0::DOUBLE"), strict=True))
MODERATED = View(f"SELECT event_id, event_type = 'error' AS toxic, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 7 = 0 END AS redacted, CASE WHEN event_id % 6 = 0 "
    f"THEN NULL ELSE array(struct({_mod})) END AS moderation FROM {{events}}", f"SELECT event_id, event_type = 'error' AS toxic, CASE WHEN user_id % 4 = 0 THEN NULL ELSE "
    f"user_id % 7 = 0 END AS redacted, CASE WHEN event_id % 6 = 0 THEN NULL ELSE [{{{_dmod}}}] END AS moderation FROM {{events}}")
steps("c16_detox_gate", MODERATED, Steps().add(safe=gates.detox_ok(0.5)), "event_id; safe")

# Filters by metadata
META = View(
    "SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'List of rivers' WHEN 1 THEN 'Ort (Begriffsklärung)' WHEN 2 THEN NULL ELSE 'River' END AS title, CASE doc_id % 5 "
        "WHEN 0 THEN 'C4' WHEN 1 THEN 'Wikipedia' WHEN 2 THEN '' ELSE 'arXiv' END AS source, (n_chars % 50) / 10.0 AS score, substring(text, 1, CAST(doc_id % 4 AS INT)) "
        "AS problem, text AS solution, CASE doc_id % 3 WHEN 0 THEN 'Cultural' WHEN 1 THEN 'web' ELSE 'law' END AS subset, n_chars % 900 AS perplexity, CASE WHEN doc_id % "
        "8 = 0 THEN array('tiny') WHEN doc_id % 8 = 1 THEN array() END AS warnings FROM {documents}",
    "SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'List of rivers' WHEN 1 THEN 'Ort (Begriffsklärung)' WHEN 2 THEN NULL ELSE 'River' END AS title, CASE doc_id % 5 "
        "WHEN 0 THEN 'C4' WHEN 1 THEN 'Wikipedia' WHEN 2 THEN '' ELSE 'arXiv' END AS source, (n_chars % 50) / 10.0 AS score, substring(text, 1, (doc_id % 4)::INT) AS "
        "problem, text AS solution, CASE doc_id % 3 WHEN 0 THEN 'Cultural' WHEN 1 THEN 'web' ELSE 'law' END AS subset, n_chars % 900 AS perplexity, CASE WHEN doc_id % 8 "
        "= 0 THEN ['tiny'] WHEN doc_id % 8 = 1 THEN [] END AS warnings FROM {documents}",
)
for _name, _filter in {
    "s09_scored_web": gates.scored_web(), "s09b_encyclopedia": gates.encyclopedia(), "s09c_wanted_sources": gates.wanted_sources(), "s09d_problem_pairs": gates.problem_pairs(),
    "s09e_licensed_commons": gates.licensed_commons(("law",)), "s09f_warned_web": gates.warned_web(), "s09g_plain_web": gates.plain_web(),
}.items():
    steps(_name, META, _filter, "doc_id; reason; md5(out) AS out_md5")

# Presets
PRESETS = (plan.Preset("src1", "english", least=260, most=28_000), plan.Preset("src2", "german", least=260), plan.Preset("src3", "english", "math"))
register(
    "f22_presets",
    " UNION ALL ".join(f"SELECT doc_id, source, reason "
        f"FROM {policies.strict(p.language, p.profile, least=p.least, most=p.most).steps.duck(f'(SELECT * FROM documents WHERE source = {x.quote(p.source)})')} t" for p in PRESETS),
    lambda s, sf: plan.by_preset(table(s, sf, "documents"), PRESETS).select("doc_id", "source", "reason"),
)

# Plans
PLANNED = View("SELECT 'de' AS language, source AS name, 1000 * count(*) AS target_tokens, 1.5 AS bytes_per_token FROM {documents} GROUP BY source UNION ALL SELECT 'en', 'lost', 500, 2.0")
HELD = View("SELECT source AS name, count(*) AS lines, sum(octet_length(text)) AS bytes FROM {documents} GROUP BY source", "SELECT source AS name, count(*) AS lines, "
    "sum(strlen(text))::BIGINT AS bytes FROM {documents} GROUP BY source")
_budget = "floor(target_tokens * bytes_per_token)::BIGINT"
register(
    "j12_budget_sources",
    f"SELECT language, p.name, {_budget} AS target_bytes, coalesce(lines, 0) AS lines, coalesce(bytes, 0) AS bytes, CASE WHEN bytes IS NULL THEN 'missing' WHEN bytes "
        f"< {_budget} THEN 'short' ELSE 'ok' END AS status FROM {PLANNED.duck} p LEFT JOIN {HELD.duck} h ON h.name = p.name",
    lambda s, sf: plan.budgets(PLANNED.spark(s, sf), HELD.spark(s, sf), strict=False).select("language", "name", "target_bytes", "lines", "bytes", "status"),
)
register("p03_inventory", f"SELECT language, p.name, h.bytes IS NOT NULL AS exists, coalesce(h.bytes, 0) AS size_bytes FROM {PLANNED.duck} p LEFT JOIN {HELD.duck} h ON "
    f"h.name = p.name", lambda s, sf: plan.inventory(PLANNED.spark(s, sf), HELD.spark(s, sf)).select("language", "name", "exists", "size_bytes"))
TARGETS, SPLITS = View("SELECT DISTINCT source AS config, lang AS split, length(source) AS weight FROM {documents}"), View("SELECT source AS config, lang AS split, "
    "count(*) AS docs FROM {documents} WHERE n_chars > 3000 GROUP BY source, lang")
register("j13_available_splits", f"SELECT t.config, t.split, t.weight, s.docs FROM {TARGETS.duck} t JOIN {SPLITS.duck} s ON s.config = t.config AND s.split = "
    f"t.split", lambda s, sf: plan.available(TARGETS.spark(s, sf), SPLITS.spark(s, sf), ("config", "split")))
register("j14_preset_join", "SELECT source, count(*) AS docs FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY "
    "source", lambda s, sf: plan.by_preset(table(s, sf, "documents"), PRESETS).groupBy("source").agg(F.count("*").alias("docs")))
SLICES = View("SELECT lang AS name, min(doc_id) * 1000 AS start, min(doc_id) * 1000 + sum(n_chars) AS `end` FROM {documents} GROUP BY lang", 'SELECT lang AS name, '
    'min(doc_id) * 1000 AS start, (min(doc_id) * 1000 + sum(n_chars))::BIGINT AS "end" FROM {documents} GROUP BY lang')
register(
    "w10_rank_windows",
    f'SELECT name, rank::INT AS rank, (start + ("end" - start) * rank // 4)::BIGINT AS low, (start + ("end" - start) * (rank + 1) // 4)::BIGINT AS high FROM {SLICES.duck}, range(4) r(rank)',
    lambda s, sf: plan.rank_windows(SLICES.spark(s, sf), 4, 128),
)
register("b16_fixed_windows", "SELECT i AS item, 60000 + ('0x' || substring(md5('11:' || i || ':tail'), 1, 12))::BIGINT % (100000 - 513 - 60000) AS low, 60000 + ('0x' || "
    "substring(md5('11:' || i || ':tail'), 1, 12))::BIGINT % (100000 - 513 - 60000) + 513 AS high FROM range(200) "
    "t(i)", lambda s, sf: generate.evaluation_windows(s, 100_000, 512, 200, 11, "tail", 40_000))

# Knowledge
ENTRIES_SQL = "SELECT n_nationkey, n_name AS term, {c}({l}'Land in ', r_name) AS definition, {a}({q}n_name, n_name) AS facts FROM {{nation}} JOIN {{region}} ON r_regionkey = n_regionkey"
NATIONS = View("SELECT n.n_nationkey, n.n_name AS term, concat('Ein Land in ', r.r_name, '.') AS definition, r.r_name AS region FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey")


def _entries(s, sf) -> DataFrame:
    text = lambda *p: F.concat(*(F.lit(q) if q[0] == "'" or " " in q or q in ".?" else F.col(q) for q in p))
    empty = F.array().cast("array<string>")
    probe = lambda q, a, kind: F.struct(q.alias("question"), a.alias("answer"), F.lit(kind).alias("kind"), F.array(a).alias("aliases"), empty.alias("forbidden"))
    every = F.array(
        probe(text("Wo liegt ", "term", "?"), F.col("region"), "fact"),
        probe(text("Was ist ", "term", "?"), F.col("definition"), "definition"),
        probe(text("Liegt ", "term", " auf dem Mond?"), F.lit("Nein."), "counterfact"),
    )
    odd = F.col("n_nationkey") % 2 == 1
    return NATIONS.spark(s, sf).select(
        "n_nationkey", "term", "definition",
        F.array(text("term", " ist ein Land."), text("term", " liegt in ", "region", ".")).alias("facts"),
        F.when(odd, F.array(text("term", " ist kein Ort auf dem Mond."))).otherwise(empty).alias("counterfacts"),
        F.when(odd, empty).otherwise(F.array(text("Wir reisen nach ", "term", "."))).alias("examples"),
        F.array("region").alias("related"), F.lit("atlas").alias("source"), every.alias("probes"),
    )


_n = " || chr(10) || "
_plain = _n.join(["term || ': ' || definition", "term || ' ist ein Land.'", "term || ' liegt in ' || region || '.'", "CASE WHEN n_nationkey % 2 = 1 THEN term || ' ist "
    "kein Ort auf dem Mond.' ELSE 'Beispiel: Wir reisen nach ' || term || '.' END", "'Verwandte Begriffe: ' || region || '.'"])
_tag = _n.join(
    ["'<memory>'", "'Typ: knowledge_dna'", "'Begriff: ' || term", "'Definition: ' || definition", "'Fakten:'", "'- ' || term || ' ist ein Land.'", "'- ' || term || ' liegt in ' || region || '.'"]
    + ["CASE WHEN n_nationkey % 2 = 1 THEN 'Abgrenzung:' || chr(10) || '- ' || term || ' ist kein Ort auf dem Mond.' ELSE 'Beispiele:' || chr(10) || 'Wir reisen nach ' "
        "|| term || '.' END", "'Verwandte Begriffe: ' || region", "'Quelle: atlas'", "'</memory>'"]
)
_recall = lambda q, a: _n.join(["'<recall>'", "'Begriff: ' || term", f"'Frage: ' || {q}", f"'Antwort: ' || {a}", "'</recall>'"])
_easy, _def, _hard = _recall("'Wo liegt ' || term || '?'", "region"), _recall("'Was ist ' || term || '?'", "definition"), _recall("'Liegt ' || term || ' auf dem Mond?'", "'Nein.'")
_gap = " || chr(10) || chr(10) || "
register(
    "b13_knowledge_blocks",
    f"SELECT n_nationkey, md5({_plain}) AS plain, md5({_gap.join([_tag, _easy, _def, _hard])}) AS tagged, md5({_gap.join([_plain, _tag, _hard, _easy])}) AS hybrid FROM {NATIONS.duck}",
    lambda s, sf: knowledge.blocks(_entries(s, sf)).select("n_nationkey", *(F.md5(c).alias(c) for c in ("plain", "tagged", "hybrid"))),
)
register(
    "b13b_knowledge_probes",
    " UNION ALL ".join(f"SELECT term, {q} AS question, {a} AS answer, '{k}' AS kind, 'atlas' AS source FROM {NATIONS.duck}" for q, a, k in (("'Wo liegt ' || term || "
        "'?'", "region", "fact"), ("'Was ist ' || term || '?'", "definition", "definition"), ("'Liegt ' || term || ' auf dem Mond?'", "'Nein.'", "counterfact"))),
    lambda s, sf: knowledge.probes(_entries(s, sf)).select("term", "question", "answer", "kind", "source"),
)
CAPITALS = View(
    "SELECT concat('Was ist die Hauptstadt von ', n_name, '?') AS q, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE array(lower(n_name)) END AS gold, CASE n_nationkey % 5 "
        "WHEN 0 THEN 'invented' WHEN 1 THEN 'other' ELSE 'capital' END AS cat, CASE n_nationkey % 3 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'SHAKY' ELSE 'UNKNOWN' END AS label "
        "FROM {nation}",
    "SELECT concat('Was ist die Hauptstadt von ', n_name, '?') AS q, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE [lower(n_name)] END AS gold, CASE n_nationkey % 5 WHEN "
        "0 THEN 'invented' WHEN 1 THEN 'other' ELSE 'capital' END AS cat, CASE n_nationkey % 3 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'SHAKY' ELSE 'UNKNOWN' END AS label FROM "
        "{nation}",
)
TOOLS, ANCHORS = View("SELECT text, CASE WHEN turn = 0 THEN 'tool_math' ELSE 'x' END AS source FROM {conversations}"), View("SELECT text, CASE WHEN lang = 'de' THEN "
    "'reasoning_de' ELSE source END AS source FROM {documents}")
_pick = lambda view, where, n, name: f"SELECT '{name}' AS source, text FROM (SELECT text, row_number() OVER (ORDER BY md5('20260607:' || text), text) AS r FROM {view.duck} WHERE {where}) WHERE r <= {n}"
_first = "upper(gold[1][1]) || substring(gold[1], 2)"
register(
    "b11_calibration_set",
    f"SELECT source, CASE WHEN source = 'calib_abstain' THEN NULL ELSE md5(text) END AS text_md5, count(*) AS n FROM (SELECT CASE WHEN cat = 'invented' THEN "
        f"'calib_abstain' ELSE 'calib_confident' END AS source, concat('<|system|>', chr(10), '{knowledge.SYSTEM}', chr(10), '<|end|>', chr(10), '<|user|>', chr(10), q, "
        f"chr(10), '<|end|>', chr(10), '<|assistant|>', chr(10), CASE WHEN cat = 'capital' THEN 'Die Hauptstadt von ' || regexp_extract(q, 'Hauptstadt von (.+?)\\?', 1) "
        f"|| ' ist ' || {_first} || '.' ELSE {_first} || '.' END, chr(10), '<|end|>', chr(10)) AS text FROM {CAPITALS.duck} WHERE cat = 'invented' OR (gold IS NOT NULL "
        f"AND label = 'KNOWN') UNION ALL {_pick(TOOLS, 'source = ' + x.quote('tool_math'), 40, 'tool')} UNION "
        f"ALL {_pick(ANCHORS, 'source <> ' + x.quote('reasoning_de'), 50, 'anchor')}) GROUP BY ALL",
    lambda s, sf: knowledge.calibration(CAPITALS.spark(s, sf), TOOLS.spark(s, sf), ANCHORS.spark(s, sf), 40, 50).groupBy("source", F.when(F.col("source") != "calib_abstain", F.md5("text")).alias("text_md5")).agg(F.count("*").alias("n")),
)

# Titles and aliases
WIKI = View("SELECT page_id, 0 AS namespace, concat('Seite_', CAST(page_id AS STRING)) AS title, page_id % 2 = 1 AS is_redirect, substring(url, 1, 80) AS intro FROM {pages}")
MOVED = View("SELECT page_id AS rd_from, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS namespace, concat('Seite_', CAST(page_id - 1 - page_id % 3 AS STRING)) AS target "
    "FROM {pages} WHERE page_id % 2 = 1")


def _titles(s, sf) -> DataFrame:
    return retrieve.titles(WIKI.spark(s, sf).filter("NOT is_redirect").withColumn("title", F.replace("title", F.lit("_"), F.lit(" "))))


_alias = f"SELECT DISTINCT lower(replace(w.title, '_', ' ')) AS alias, replace(m.target, '_', ' ') AS target FROM {WIKI.duck} w JOIN {MOVED.duck} m ON m.rd_from = w.page_id WHERE w.is_redirect AND m.namespace = 0 AND replace(m.target, '_', ' ') IN (SELECT replace(title, '_', ' ') FROM {WIKI.duck} WHERE NOT is_redirect)"
register("j05_alias_target", _alias, lambda s, sf: retrieve.aliases(WIKI.spark(s, sf), MOVED.spark(s, sf), _titles(s, sf)))
register("k11_title_table", f"SELECT lower(replace(title, '_', ' ')) AS key, replace(title, '_', ' ') AS title, intro FROM {WIKI.duck} WHERE NOT is_redirect", _titles)
BARE = View("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN 'beste gpu' WHEN 2 THEN concat('wer ', split_part(text, ' ', 2)) WHEN 3 "
    "THEN text ELSE ' katze' END AS text FROM {conversations}")
_ac, _qw = ", ".join(map(x.quote, retrieve.ACRONYMS)), ", ".join(map(x.quote, retrieve.QUESTION_WORDS))
_w = r"string_split_regex(trim(text), '\s+')"
_named = f"list_transform({_w}, lambda w, i: CASE WHEN lower(w) IN ({_ac}) THEN upper(w) WHEN i = 1 THEN upper(w[1]) || substring(w, 2) ELSE w END)"
_bare = rf"(trim(text) <> '' AND NOT regexp_matches(trim(text), '[?.\n,\p{{Nd}}]') AND len({_w}) <= 3 AND regexp_replace(lower({_w}[1]), ':+$', '') NOT IN ({_qw}))"
register(
    "r03b_bare_rewrite",
    f"SELECT conv_id, turn, md5(CASE WHEN {_bare} THEN 'Was ist ' || array_to_string({_named}, ' ') || '?' ELSE text END) AS asked FROM {BARE.duck}",
    lambda s, sf: BARE.spark(s, sf).select("conv_id", "turn", F.md5(retrieve.rewritten("text")).alias("asked")),
)
_stop = ", ".join(map(x.quote, retrieve.STOP))
_tw = rf"list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w) NOT IN ({_stop}) AND length(w) > 1)"
_te = f"list_transform({_tw}, lambda w: CASE WHEN lower(w) IN ({_ac}) THEN upper(w) ELSE CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || substring(w, 2) END)"
register(
    "r03_title_candidates",
    f"SELECT item_id, len({_te}) + CASE WHEN len({_tw}) > 1 THEN 1 ELSE 0 END AS n, md5(array_to_string(CASE WHEN len({_tw}) > 1 THEN list_append({_te}, "
        f"array_to_string({_te}, ' ')) ELSE {_te} END, '|')) AS titles FROM benchmark",
    lambda s, sf: table(s, sf, "benchmark").select("item_id", F.size(retrieve.title_candidates("text")).alias("n"), F.md5(F.array_join(retrieve.title_candidates("text"), "|")).alias("titles")),
)
ASKING = View("SELECT page_id AS item_id, CASE WHEN page_id % 3 = 0 THEN concat('Was ist Seite ', CAST(page_id AS STRING), '?') ELSE 'was' END AS text FROM {pages}")
register(
    "j15_exact_else_fallback",
    f"WITH a AS ({_alias}), t AS (SELECT lower(replace(title, '_', ' ')) AS key, replace(title, '_', ' ') AS title FROM {WIKI.duck} WHERE NOT is_redirect), e AS (SELECT "
        f"item_id, title FROM (SELECT item_id, lower(coalesce((SELECT min(target) FROM a WHERE alias = 'seite ' || item_id), 'seite ' || item_id)) AS key "
        f"FROM {ASKING.duck} WHERE text <> 'was' AND length(item_id::VARCHAR) > 1) q JOIN t USING (key)) SELECT item_id, title, 'exact' AS via FROM e UNION ALL SELECT "
        f"item_id, 'none', 'fallback' FROM {ASKING.duck} WHERE item_id NOT IN (SELECT item_id FROM e)",
    lambda s, sf: (lambda q, k: retrieve.with_fallback(q, retrieve.by_title(q, k, retrieve.aliases(WIKI.spark(s, sf), MOVED.spark(s, sf), k)).select("item_id", "title", F.lit("exact").alias("via")), q.select("item_id", F.lit("none").alias("title"), F.lit("fallback").alias("via"))))(ASKING.spark(s, sf), _titles(s, sf)),
)

# Schemas and segments
SQUAD = View(
    "SELECT doc_id AS id, source AS title, text AS context, substring(text, 1, 40) AS question, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN "
        "named_struct('text', array()) ELSE named_struct('text', array(lang, source)) END AS answers FROM {documents}",
    "SELECT doc_id AS id, source AS title, text AS context, substring(text, 1, 40) AS question, lang, source FROM {documents}",
)
register(
    "s16_reading_records",
    f"SELECT id, title, md5(context) AS context_md5, question, CASE WHEN id % 3 = 2 THEN lang ELSE '' END AS answer, id % 3 <> 2 AS is_impossible FROM {SQUAD.duck}",
    lambda s, sf: schemas.reading(SQUAD.spark(s, sf)).select("id", "title", F.md5("context").alias("context_md5"), "question", "answer", "is_impossible"),
)
RANKED = View(
    "SELECT conv_id AS query_id, max(CASE WHEN turn = 0 THEN substring(text, 1, 50) END) AS query, CASE WHEN conv_id % 4 = 0 THEN array('No Answer Present.') WHEN "
        "conv_id % 4 = 1 THEN array() ELSE array('kurz') END AS answers, CASE WHEN conv_id % 4 = 2 THEN array('Lang und gut.') END AS wellFormedAnswers, "
        "named_struct('passage_text', transform(array_sort(collect_list(struct(turn, text))), t -> t.text), 'is_selected', transform(array_sort(collect_list(struct(turn, "
        "text))), t -> CAST(t.turn = 1 AND conv_id % 2 = 0 AS INT))) AS passages FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id AS query_id, max(CASE WHEN turn = 0 THEN substring(text, 1, 50) END) AS query, list(text ORDER BY turn) AS p, list(turn ORDER BY turn) AS t FROM {conversations} GROUP BY conv_id",
)
register(
    "s16b_ranked_passages",
    f"SELECT query_id, coalesce(query, '') AS query, CASE WHEN query_id % 4 = 2 THEN 'Lang und gut.' ELSE 'kurz' END AS answer, md5(CASE WHEN query_id % 2 = 0 AND "
        f"list_position(t, 1) IS NOT NULL THEN p[list_position(t, 1)] ELSE p[1] END) AS passage_md5 FROM {RANKED.duck} WHERE query_id % 4 >= 2",
    lambda s, sf: schemas.ranked_passages(RANKED.spark(s, sf)).select("query_id", "query", "answer", F.md5("selected_passage").alias("passage_md5")),
)
LOGGED = View(
    "SELECT conv_id, transform(array_sort(collect_list(struct(turn, role, text))), t -> named_struct('role', t.role, 'content', t.text)) AS conversation, conv_id % 5 = 0 "
        "AS toxic, conv_id % 7 = 0 AS redacted FROM {conversations} GROUP BY conv_id",
    "SELECT * FROM {conversations}",
)
register(
    "s16c_logged_chats",
    "WITH o AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT "
        "md5(text) AS user_md5, md5(CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END) AS preferred_md5, CASE WHEN conv_id % 5 = 0 THEN 'jailbreak' WHEN "
        "conv_id % 7 = 0 THEN 'redacted' ELSE 'normal' END AS category FROM o WHERE role = 'user'",
    lambda s, sf: schemas.logged_chats(LOGGED.spark(s, sf)).select(F.md5("user").alias("user_md5"), F.md5("preferred").alias("preferred_md5"), "category"),
)
PLENARY = View("SELECT doc_id, lang AS wp, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS sitzung, 'R' AS redner, CAST(NULL AS STRING) AS fraktion, text, CASE "
    "WHEN doc_id % 2 = 0 THEN concat('http://', CAST(doc_id AS STRING)) END AS source_url FROM {documents}")
register(
    "b21_record_projection",
    f"SELECT coalesce(wp, '?') AS wp, coalesce(sitzung, '?') AS sitzung, redner, '?' AS fraktion, md5(substring(text, 1, 6000)) AS text_md5, coalesce(source_url, "
        f"'plenary_' || doc_id) AS raw_id FROM {PLENARY.duck}",
    lambda s, sf: schemas.grounded(PLENARY.spark(s, sf), "plenary", "doc_id").select("wp", "sitzung", "redner", "fraktion", F.md5("text").alias("text_md5"), "raw_id"),
)
THREADS = View("SELECT conv_id, concat('op_', CAST(conv_id AS STRING), ': ', text, ' user-b: ', substring(text, 1, 20), ' cc: ') AS text FROM {conversations} WHERE turn = 0")
register(
    "g04_turn_split",
    r"SELECT conv_id, list_transform(list_zip(a, b[2:]), lambda t: t[1])[i] AS author, md5(trim(regexp_replace(b[i + 1], '\s+', ' ', 'g'))) AS text_md5 FROM (SELECT *, "
        r"unnest(range(1, len(a) + 1)) AS i FROM (SELECT conv_id, regexp_extract_all(text, '(?:^|\s)([A-Za-z0-9_-]{2,24}):\s', 1) AS a, string_split_regex(text, "
        r"'(?:^|\s)([A-Za-z0-9_-]{2,24}):\s') AS b FROM " + THREADS.duck + r")) WHERE trim(regexp_replace(b[i + 1], '\s+', ' ', 'g')) <> ''",
    lambda s, sf: THREADS.spark(s, sf).select("conv_id", F.explode(segment.author_turns("text")).alias("t")).select("conv_id", "t.author", F.md5("t.text").alias("text_md5")),
)
FENCED = View(r"SELECT conv_id, turn, concat(substring(text, 1, 30), '\n```py\n', substring(text, 31, 50), '\n```\n', '```\nx = 1```') AS text FROM "
    r"{conversations}", "SELECT conv_id, turn, concat(substring(text, 1, 30), chr(10), '```py', chr(10), substring(text, 31, 50), chr(10), '```', chr(10), '```', "
    "chr(10), 'x = 1```') AS text FROM {conversations}")
register(
    "g16_fenced_code",
    f"SELECT conv_id, turn, t.lang AS lang, md5(t.code) AS code_md5 FROM (SELECT conv_id, turn, unnest([{{'lang': 'py', 'code': substring(text, length(text) - "
        f"length(regexp_replace(text, '^(?s).*?```py' || chr(10), '')) + 1, position('```' IN regexp_replace(text, '^(?s).*?```py' || chr(10), '')) - 1)}}, {{'lang': '', "
        f"'code': 'x = 1'}}]) AS t FROM {FENCED.duck})",
    lambda s, sf: FENCED.spark(s, sf).select("conv_id", "turn", F.explode(segment.fences("text")).alias("f")).select("conv_id", "turn", "f.lang", F.md5("f.code").alias("code_md5")),
)
register("n06b_repaired", f"SELECT doc_id, md5({nz.repaired(x.col('text'), nz.STRICT_HINTS).duck}) AS out_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN "
    f"replace(text, 'ä', 'Ã¤') ELSE text END AS text FROM documents)", lambda s, sf: table(s, sf, "documents").withColumn("text", F.expr("CASE WHEN doc_id % 4 = 0 THEN "
    "replace(text, 'ä', 'Ã¤') ELSE text END")).select("doc_id", F.md5(F.expr(nz.repaired(x.col("text"), nz.STRICT_HINTS).spark)).alias("out_md5")))

# What Python judges
register(
    "v05_arithmetic",
    "SELECT i AS item, CAST((a + b) * 2 AS VARCHAR) AS result FROM (SELECT i, (('0x' || substring(md5('21:' || i || ':a'), 1, 6))::BIGINT % 1000) AS a, (('0x' || "
        "substring(md5('21:' || i || ':b'), 1, 6))::BIGINT % 1000) AS b FROM range(500) t(i))",
    lambda s, sf: generate.sums(s, 500, 21).select("item", execute.evaluate(F.concat(F.lit("print(("), "a", F.lit(" + "), "b", F.lit(") * 2)"))).alias("result")),
)
register(
    "v04_code_verified",
    "SELECT i AS id, CASE i % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'refused' ELSE 'error' END AS outcome FROM range(32) t(i)",
    lambda s, sf: execute.verified(
        s.range(32).select(
            "id",
            F.get(F.array(F.lit("def f(a, b):\n    return a + b"), F.lit("def f(a, b):\n    return a - b - 1"), F.lit("import socket"), F.lit("def g():\n    "
                "pass")), (F.col("id") % 4).cast("int")).alias("code"),
            F.lit("f").alias("entrypoint"),
            F.concat(F.lit('[{"args": [1, '), "id", F.lit('], "expected": '), F.col("id") + 1, F.lit("}]")).alias("tests"),
        )
    ),
)
PROGRAMS = View("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('<filename>a.py\\nx = ', CAST(turn AS STRING)) WHEN 1 THEN concat('x = (', substring(text, 1, 0)) "
    "ELSE 'a b c' END AS text, 'python' AS lang FROM {conversations}")
register("c19_python_syntax", "SELECT conv_id, turn, turn % 3 = 0 AS ok FROM "
    "conversations", lambda s, sf: PROGRAMS.spark(s, sf).select("conv_id", "turn", execute.python_ok(execute.python_part(F.col("text"), F.col("lang"))).alias("ok")))
TRAILS = View("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Startseite > Thema > ', split_part(text, ' ', 1), ' und mehr') WHEN 1 THEN concat('Home | Teil | "
    "', split_part(text, ' ', 2)) WHEN 2 THEN concat('Sie sind hier: Ort Haus Garten Haus Garten ', split_part(text, ' ', 1)) ELSE split_part(text, ' ', 1) END AS line "
    "FROM {conversations}")
register(
    "n19_without_trail",
    f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(regexp_replace(substring(line, 22), '^.*(?:>|//|/|›|»|·|\\|)\\s*', '')) WHEN 1 THEN trim(regexp_replace(line, "
        f"'^.*\\|', '')) WHEN 2 THEN trim(regexp_replace(substring(line, 32), '\\s+', ' ', 'g')) ELSE line END AS text FROM {TRAILS.duck}",
    lambda s, sf: TRAILS.spark(s, sf).select("conv_id", "turn", structure.without_trail(F.col("line")).alias("text")),
)
register(
    "s19_line_numbers",
    "SELECT doc_id, line_no FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents) WHERE line_no IN (SELECT event_id FROM events WHERE event_type = 'error')",
    lambda s, sf: readers.numbered(table(s, sf, "documents"), ["doc_id"], table(s, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("line_no"))).select("doc_id", "line_no"),
)
