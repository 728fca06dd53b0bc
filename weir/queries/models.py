"""Scoring (E), retrieval (R), signals (W13-W15, Z) and remaining operators (B)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weir.operators import retrieve, scoring, signals
from weir.queries.registry import table, query, sql
from weir.session import Scratch


@query("e01_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * "
    "y::DOUBLE))))), 6) AS total FROM embeddings")
def e01(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", scoring.unit("embedding").alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("e02_ridge_scores")
def e02(spark, sf):
    """Ridge on embeddings and labels, prediction for all rows; checked against numpy in the tests."""
    e = table(spark, sf, "embeddings")
    w = scoring.ridge(e, "embedding", "label", 1.0)
    return e.select("vec_id", F.round(scoring.predicted(F.col("embedding"), w, -10.0, 10.0), 6).alias("score"))


@query("e03_fixed_linear_scores", "SELECT vec_id, round(least(5, greatest(0, list_sum(list_transform(list_zip(embedding, range(len(embedding))), lambda z: z[1]::DOUBLE * "
    "((z[2] % 3) - 1))) + 2.5)), 6) AS score FROM embeddings")
def e03(spark, sf):
    e = table(spark, sf, "embeddings")
    w = F.transform("embedding", lambda x, i: (i % 3 - 1).cast("double"))
    return e.select("vec_id", F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.0), scoring.dot(F.col("embedding"), w) + 2.5)), 6).alias("score"))


sql("e04_review_pool", "SELECT event_id, value FROM {events} WHERE abs(value - 50) < 5 ORDER BY abs(value - 50), event_id LIMIT 200")


sql("e08_tokens_per_byte", "SELECT lang, round(CAST(sum(1 + length(text) - length(replace(text, ' ', ''))) AS DOUBLE) / sum(octet_length(text)), 9) AS tokens_per_byte "
    "FROM {documents} GROUP BY lang", "SELECT lang, round(CAST(sum(1 + length(text) - length(replace(text, ' ', ''))) AS DOUBLE) / sum(strlen(text)), 9) AS "
    "tokens_per_byte FROM documents GROUP BY lang")


TERM = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}_]+')"


@query("r01_postings", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERM}) AS term "
    f"FROM documents) GROUP BY ALL) GROUP BY term")
def r01(spark, sf):
    p, _ = retrieve.index(table(spark, sf, "documents"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("r02_bm25_top", f"""WITH t AS (SELECT doc_id, {TERM} AS l FROM documents), s AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM t),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERM}) AS term FROM benchmark),
c AS (SELECT item_id, p.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(l) / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN t ON t.doc_id = p.doc_id, s GROUP BY item_id, p.doc_id)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM c) WHERE r <= 5""")
def r02(spark, sf):
    p, n = retrieve.index(table(spark, sf, "documents"))
    scratch = Scratch(spark, "bm25")
    p, n = scratch.put(p, "postings"), scratch.put(n, "statistics")
    return retrieve.search(table(spark, sf, "benchmark"), p, n, 5).select("item_id", "doc_id", F.round("score", 6).alias("score"))


sql("r04_without_stubs", "SELECT doc_id FROM {documents} WHERE NOT contains(lower(text), 'begriffsklärung') AND NOT contains(lower(text), 'may refer to') AND length(text) >= 60")

SERIES = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}"


@query("w13_ema", """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, value AS e FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.3::DOUBLE * s.value + 0.7::DOUBLE * r.e FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, round(max_by(e, i), 6) AS ema FROM r GROUP BY user_id""")
def w13(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return s.select("user_id", F.round(signals.ema(F.col("v")), 6).alias("ema"))


@query("w13b_slope", "SELECT user_id, round(coalesce(regr_slope(value, i), 0), 6) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY "
    "ts, event_id)::DOUBLE AS i FROM events) GROUP BY user_id")
def w13b(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return signals.slope(e, "user_id", "at", "value").select("user_id", F.round("slope", 6).alias("slope"))


@query("w13c_plateau", "WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, len(v) >= 6 AND "
    "coalesce(list_max(v[-5:]) <= list_max(v[:-6]) + 0.5, false) AS plateau FROM s")
def w13c(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return s.select("user_id", signals.plateau(F.col("v"), 5, 0.5).alias("plateau"))


@query("w14_alerts", """WITH s AS (SELECT *, sum(CASE WHEN value > 80 THEN 0 ELSE 1 END) OVER w AS isl, avg(value) OVER p AS m, count(value) OVER p AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM s)
SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN streak >= 3 THEN 'STOP' WHEN c >= 4 AND value > 1.9::DOUBLE * m THEN 'WARN' END AS alert FROM r""")
def w14(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return signals.alerts(e, "user_id", "at", "value", 80, 3, 1.9).select("event_id", "streak", "alert")


@query("w15_regression", "SELECT event_id, coalesce(value - min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) >= 60, "
    "false) AS regressed FROM events")
def w15(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return signals.regression(e, "user_id", "at", "value", 60).select("event_id", "regressed")


@query("w17_curriculum", """WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, stage, n, last, event_id, decision) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0, []::DOUBLE[], NULL::BIGINT, '' FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT user_id, i, CASE WHEN d IN ('mastery', 'timeout') THEN stage + 1 ELSE stage END, CASE WHEN d IN ('mastery', 'timeout') THEN 0 ELSE n END,
    CASE WHEN d IN ('mastery', 'timeout') THEN [] ELSE last END, event_id, d
  FROM (SELECT *, CASE WHEN value < 5 THEN 'hold' WHEN n >= 5 AND len(last) = 3 AND list_sum(last) / 3 >= 60 THEN 'mastery' WHEN n >= 20 THEN 'timeout' ELSE 'stay' END AS d
    FROM (SELECT r.user_id, s.i, r.stage, r.n + 1 AS n, list_append(r.last, s.value)[-3:] AS last, s.event_id, s.value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)))
SELECT event_id, stage, decision FROM r WHERE i > 0""")
def w17(spark, sf):
    """Stage of each run after each point, by the stateful controller; tested against a plain loop."""
    from weir.streaming.controller import staged

    return staged(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")


# Batch forms of the stream operators
sql("z00_event_windows", "SELECT event_type, CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP "
    "BY event_type, CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT)", "SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS n, round(sum(value), 6) "
    "AS total FROM events GROUP BY 1, 2")

# Remaining operators
sql("b04_gate_exclusion", "SELECT c.conv_id, c.turn FROM {conversations} c LEFT JOIN {benchmark} b ON lower(trim(c.text)) = lower(trim(b.text)) WHERE c.role = 'user' AND b.item_id IS NULL")
sql("b05_provenance", "SELECT doc_id, concat(source, ':', coalesce(lang, 'unknown')) AS family FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) "
    "AS r FROM {documents}) x WHERE r = 1")
sql("b07_verification_routing", "SELECT doc_id, source IN ('src1', 'src2') OR md5(concat('v:', CAST(doc_id AS STRING))) < '4ccccccc' AS verify FROM {documents}", "SELECT "
    "doc_id, source IN ('src1', 'src2') OR md5('v:' || doc_id) < '4ccccccc' AS verify FROM documents")


@query("b08_verdicts", "SELECT event_id, CASE WHEN k IS NULL THEN 'parse_failure' WHEN k >= 50 THEN 'accept' WHEN k >= 10 THEN 'fix' ELSE 'drop' END AS verdict FROM "
    "(SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def b08(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select("event_id", F.when(k.isNull(), "parse_failure").when(k >= 50, "accept").when(k >= 10, "fix").otherwise("drop").alias("verdict"))


@query("b09_line_quota", r"""WITH l AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), d AS (SELECT source, line, min(doc_id) AS doc_id FROM l WHERE length(line) BETWEEN 8 AND 240 GROUP BY source, line)
SELECT source, md5(line) AS h FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS r FROM d) WHERE r <= 40""")
def b09(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).filter(F.length("line").between(8, 240))
    d = lines.groupBy("source", "line").agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy("source").orderBy("doc_id", "line")
    return d.withColumn("r", F.row_number().over(w)).filter("r <= 40").select("source", F.md5("line").alias("h"))


sql("b10_knowledge_boundary", "SELECT user_id, CASE WHEN avg(CASE WHEN value > 50 THEN 1.0D ELSE 0.0D END) >= 0.6D THEN 'KNOWN' WHEN avg(CASE WHEN value > 50 THEN 1.0D "
    "ELSE 0.0D END) >= 0.25D THEN 'SHAKY' ELSE 'UNKNOWN' END AS label FROM {events} GROUP BY user_id", "SELECT user_id, CASE WHEN avg((value > 50)::INT) >= 0.6::DOUBLE "
    "THEN 'KNOWN' WHEN avg((value > 50)::INT) >= 0.25::DOUBLE THEN 'SHAKY' ELSE 'UNKNOWN' END AS label FROM events GROUP BY user_id")
sql("b18_threshold_proposal", "SELECT event_type, greatest(0.5, 0.8 * median(value)) AS pass_at, greatest(0.1, 0.25 * abs(median(value))) AS margin FROM {events} GROUP "
    "BY event_type", "SELECT event_type, greatest(0.5, 0.8::DOUBLE * median(value)) AS pass_at, greatest(0.1, 0.25::DOUBLE * abs(median(value))) AS margin FROM events "
    "GROUP BY event_type")

# Sources and sinks that tables can stand for
sql("s17_hash_sample", "SELECT doc_id FROM {documents} WHERE md5(concat('s:', CAST(doc_id AS STRING))) < '1'", "SELECT doc_id FROM documents WHERE md5('s:' || doc_id) < '1'")
sql("s18_head", "SELECT doc_id FROM {documents} ORDER BY doc_id LIMIT 50")
sql("s18b_tail", "SELECT doc_id FROM {documents} ORDER BY doc_id DESC LIMIT 50")
sql("k06_reject_samples", "SELECT source, doc_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY source, reason ORDER BY doc_id) AS r FROM (SELECT doc_id, "
    "source, CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 10000 THEN 'too_long' END AS reason FROM {documents}) x WHERE reason IS NOT NULL) y WHERE r <= 5")
sql("k07_category_counts", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source")

# Generic relational coverage on the star schema and events (not derived from the curation operators)
sql("q01_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS "
    "BIGINT) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("q03_shipping", "SELECT o.o_orderkey, CAST(sum(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue FROM {customer} c JOIN "
    "{orders} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey")
sql("q05_nations", "SELECT n.n_name, CAST(sum(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue FROM {customer} c JOIN {orders} "
    "o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = "
    "s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY n.n_name")
sql("q_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("q_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("q_full_outer", "SELECT count(*) AS n, count(d.doc_id) AS docs, count(l.doc_id) AS labels FROM {documents} d FULL OUTER JOIN {labels} l ON l.doc_id = d.doc_id + 5")
