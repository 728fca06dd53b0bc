"""Aggregations and reports (A) and evaluation (V), most as one query for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import metrics as m
from weir.functions import exprs as x
from weir.functions.exprs import Steps
from weir.operators import policies as p
from weir.queries.registry import table, QUERIES, SQL, grouped, query, sql

_quality = p.quality("english").steps
grouped("a01_drop_histogram", "documents", _quality, "coalesce(reason, 'kept') AS reason", "count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars")
grouped("a02_keep_rate", "documents", _quality, "source", "count(*) AS docs, count_if(reason IS NULL) AS kept, round(count_if(reason IS NULL) / CAST(count(*) AS DOUBLE), 6) AS keep_rate")


def _signals(view: str) -> str:
    return f"SELECT source, count_if(long_lines > 0) AS long_seen, count_if(reason IS NOT NULL AND long_lines > 0) AS long_skipped, round(CAST(100 * count_if(reason IS NOT NULL AND long_lines > 0) AS DOUBLE) / greatest(1, count_if(long_lines > 0)), 3) AS pct_of_observed FROM {view} GROUP BY source"


_seen = Steps([*_quality.steps, {"long_lines": m.long_lines(x.col("text"))}])


@query("a03_observed_skipped", _signals(_seen.duck("documents") + " t"))
def a03(spark, sf):
    return spark.sql(_signals("{t}"), t=_seen.spark(table(spark, sf, "documents")))


_flags = p.code(audit=True).steps


@query("a04_flag_rates", f"SELECT lang, flag, count(*) AS n FROM (SELECT lang, unnest(flags) AS flag FROM {_flags.duck('documents')} t) GROUP BY lang, flag")
def a04(spark, sf):
    return p.apply(table(spark, sf, "documents"), p.code(audit=True)).select("lang", F.explode("flags").alias("flag")).groupBy("lang", "flag").agg(F.count("*").alias("n"))


@query("a04b_flag_by_language", f"SELECT flag, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') "
    f"AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM (SELECT lang, unnest(flags) AS flag FROM {_flags.duck('documents')} t) GROUP BY flag")
def a04b(spark, sf):
    f = p.apply(table(spark, sf, "documents"), p.code(audit=True)).select("lang", F.explode("flags").alias("flag"))
    return f.groupBy("flag").agg(*(F.count_if(F.col("lang") == v).alias(v) for v in ("de", "en", "es", "fr")))


def _sets(view: str) -> str:
    return f"SELECT source, lang, grouping(source) AS all_sources, grouping(lang) AS all_langs, count(*) AS docs, count_if(reason IS NOT NULL) AS dropped FROM {view} GROUP BY GROUPING SETS ((source), (lang), ())"


@query("a05_source_profile_tables", _sets(_quality.duck("documents") + " t"))
def a05(spark, sf):
    return spark.sql(_sets("{t}"), t=_quality.spark(table(spark, sf, "documents"))).withColumns({"all_sources": F.col("all_sources").cast("long"), "all_langs": F.col("all_langs").cast("long")})


@query("a06_nearest_rank", "SELECT lang, max(n_chars) FILTER (WHERE r = round_even((c - 1) * 0.5, 0) + 1) AS median, max(n_chars) FILTER (WHERE r = round_even((c - 1) * "
    "0.95, 0) + 1) AS p95, max(n_chars) AS most, avg(n_chars) AS mean FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, "
    "count(*) OVER (PARTITION BY lang) AS c FROM documents) GROUP BY lang")
def a06(spark, sf):
    """Nearest-rank quantiles from a histogram of values: counts are summed, not rows sorted in one task."""
    from pyspark.sql import Window

    h = table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    cum = h.withColumn("hi", F.sum("k").over(w)).withColumn("c", F.sum("k").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("hi") >= F.bround((F.col("c") - 1) * q) + 1, F.col("n_chars")))
    return cum.groupBy("lang").agg(at(0.5).alias("median"), at(0.95).alias("p95"), F.max("n_chars").alias("most"), (F.sum(F.col("n_chars") * F.col("k")) / F.sum("k")).alias("mean"))


sql("a06b_linear_quantiles", "SELECT event_type, percentile(value, 0.25) AS p25, percentile(value, 0.5) AS p50, percentile(value, 0.95) AS p95 FROM {events} GROUP BY "
    "event_type", "SELECT event_type, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY "
    "event_type")
sql("a07_length_bands", "SELECT source, count_if(n < 64) AS under_64, count_if(n < 100) AS under_100, count_if(n < 200) AS under_200, count_if(n > 4096) AS over_4096, "
    "avg(n) AS mean FROM (SELECT source, 1 + length(text) - length(replace(text, ' ', '')) AS n FROM {documents}) x GROUP BY source")
sql("a08_source_stats", "SELECT source, count(*) AS docs, CAST(sum(octet_length(text)) AS BIGINT) AS bytes, avg(length(text)) AS mean_chars, median(length(text)) AS "
    "median_chars FROM {documents} GROUP BY source", "SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, avg(length(text)) AS mean_chars, "
    "median(length(text)) AS median_chars FROM documents GROUP BY source")
sql("a09_weighted_estimate", "SELECT round(sum(r.rate * b.bytes), 3) AS estimate FROM (SELECT d.source, avg(CAST(l.quality AS DOUBLE)) AS rate FROM {documents} d JOIN "
    "{labels} l ON l.doc_id = d.doc_id GROUP BY d.source) r JOIN (SELECT source, sum(n_chars) AS bytes FROM {documents} GROUP BY source) b ON b.source = r.source")
sql("a10_nullable_metadata", "SELECT d.source, median(l.quality) AS median_quality, avg(l.toxic) AS mean_toxic, count(l.doc_id) AS labelled FROM {documents} d LEFT JOIN "
    "{labels} l ON l.doc_id = d.doc_id GROUP BY d.source")


@query("a10b_collected_set", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def a10b(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


sql("a11_score_histogram", "SELECT CAST(bround(value / 20) AS INT) AS band, count(*) AS n, avg(value) AS mean FROM {events} GROUP BY CAST(bround(value / 20) AS "
    "INT)", "SELECT round_even(value / 20, 0)::INT AS band, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
sql("a12_column_profile", "SELECT 'text' AS name, count_if(text <> '') AS filled, count(DISTINCT text) AS n_distinct FROM {documents} UNION ALL SELECT 'lang', "
    "count_if(lang <> ''), count(DISTINCT lang) FROM {documents} UNION ALL SELECT 'source', count_if(source <> ''), count(DISTINCT source) FROM {documents}")
sql("a13_mean_by_category", "SELECT event_type, CAST(user_id % 3 AS INT) AS split, avg(value) AS mean, grouping(event_type) AS g FROM {events} GROUP BY GROUPING SETS "
    "((event_type, CAST(user_id % 3 AS INT)), (event_type), ())", "SELECT event_type, (user_id % 3)::INT AS split, avg(value) AS mean, grouping(event_type) AS g FROM "
    "events GROUP BY GROUPING SETS ((event_type, (user_id % 3)::INT), (event_type), ())")
sql("a14_regression_metrics", "SELECT round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(avg(abs(a - b)), 6) AS mae, round(corr(a, b), 6) AS pearson, count_if(a >= "
    "0.5 AND b >= 0.5) AS tp, count_if(a >= 0.5 AND b < 0.5) AS fp, count_if(a < 0.5 AND b >= 0.5) AS fn FROM (SELECT CAST(l.quality AS DOUBLE) AS b, least(1.0, "
    "d.n_chars / 3000.0) AS a FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id) x")


@query("a15_best_threshold", """WITH s AS (SELECT l.quality AS y, 1 + 3 * least(1.0, d.n_chars / 3000.0)::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT i, 1 + i * 0.05::DOUBLE AS t FROM range(61) r(i)),
f AS (SELECT i, t, count_if(score >= t AND y = 1) AS tp, count_if(score >= t AND y = 0) AS fp, count_if(score < t AND y = 1) AS fn FROM s, t GROUP BY i, t)
SELECT round(t, 2) AS threshold, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM f ORDER BY 2.0 * tp / greatest(1, 2 * tp + fp + fn) DESC, i LIMIT 1""")
def a15(spark, sf):
    """Counts per step of the sweep, then sums over the 61 steps: rows are read once, not once a threshold."""
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (1 + 3 * F.least(F.lit(1.0), F.col("n_chars") / 3000.0)).alias("score"))
    steps = F.expr("size(filter(sequence(0, 60), i -> score >= 1 + i * 0.05D))")  # passes the first so many thresholds
    h = s.groupBy(steps.alias("k"), "y").agg(F.count("*").alias("n"))
    t = spark.range(61).withColumnRenamed("id", "i")
    past = (F.col("k") > F.col("i")).cast("int")
    f = t.join(F.broadcast(h)).groupBy("i").agg(F.sum(past * F.col("n") * F.col("y")).alias("tp"), F.sum(past * F.col("n") * (1 - F.col("y"))).alias("fp"), F.sum((1 - past) * F.col("n") * F.col("y")).alias("fn"))  # 61 x 124 rows at most
    f1 = 2.0 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return f.orderBy(F.desc(f1), "i").limit(1).select(F.round(1 + F.col("i") * 0.05, 2).alias("threshold"), F.round(f1, 6).alias("f1"))


grouped("a17_fertility", "documents", Steps().add(n_tok=x.hits(x.col("text"), r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]"), n_word=x.size(x.spaced(x.col("text")))), "lang", "round(sum(n_tok) "
    "/ CAST(sum(n_word) AS DOUBLE), 6) AS tokens_per_word, round(sum(length(text)) / CAST(sum(n_tok) AS DOUBLE), 6) AS chars_per_token")


# Evaluation
_kw = x.lower(x.col("text"))
for _name, _steps, _out in (
    ("v01_keyword_score", Steps().add(low=_kw).add(any_hit=x.contains_any(x.col("low"), ["the", "und", "que"]), all_hit=x.contains(x.col("low"), "the") & x.contains(x.col("low"), "and")), "doc_id; "
        "any_hit; all_hit"),
    ("v02_probe_score", Steps().add(low=_kw).add(anyp=x.case((x.contains_any(x.col("low"), ["the", "und"]), 1.0), otherwise=0.0), allp=x.both("(CASE WHEN contains(low, "
        "'the') THEN 0.5 ELSE 0.0 END + CASE WHEN contains(low, 'and') THEN 0.5 ELSE 0.0 "
        "END)"), bad=x.contains(x.col("low"), "idiot"), toks=x.spaced(x.col("low"))).add(rep=m.gram_repetition("toks", 3, 3)).add(score=x.both("greatest(0.0, least(1.0, "
        "(anyp + allp) / 2 - CASE WHEN bad THEN 0.4 ELSE 0.0 END - CASE WHEN rep > 0.25 THEN least(0.3, rep) ELSE 0.0 END))")), "doc_id; round(CAST(score AS DOUBLE), 6) "
        "AS score"),
    ("v03_semantic_gate", Steps().add(low=_kw).add(flags=x.flags((~x.contains(x.col("low"), "the"), "missing_must"), (~(x.contains_any(x.col("low"), ["und", "and"]) & x.contains_any(x.col("low"), ["ing", "ung"])), "missing_group"), (x.contains_any(x.col("low"), ["idiot", "moron"]), "forbidden"))), "doc_id; "
        "FLAGS"),
):
    _out = _out.replace("FLAGS", "issues")
    if "issues" in _out:
        _steps = _steps.add(issues=x.joined(x.col("flags"), ","))
    from weir.queries.registry import steps as _register

    _register(_name, "documents", _steps, _out)
sql("v03b_gate_summary", "SELECT event_type AS split, count(*) AS probes, count_if(value > 20) AS passed, CASE WHEN count_if(value <= 20) = 0 THEN 'pass' ELSE 'fail' END "
    "AS verdict FROM {events} GROUP BY event_type")
assert QUERIES and SQL
