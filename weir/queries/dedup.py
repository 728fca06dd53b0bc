"""Deduplication queries (U), set operations (O) and joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import contains, dedup
from weir.queries.registry import table, query, sql

KEY = r"sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
NUM = "CAST(regexp_extract(source, '[0-9]+') AS INT)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fresh documents are those of even sources, references those of odd ones."""
    d = docs(spark, sf).withColumn("num", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return d.filter("num % 2 = 0"), d.filter("num % 2 = 1")


@query("u01_exact_first", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def u01(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.text_key("text"), ["doc_id"]).select("doc_id", "source")


@query("u02_exact_source_order", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def u02(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.text_key("text"), ["source", "doc_id"]).select("doc_id", "source")


@query("u03_prefix_first", r"SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500) ORDER BY "
    r"doc_id) AS r FROM documents) WHERE r = 1")
def u03(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.prefix_key("text"), ["doc_id"]).select("doc_id")


@query("u04_code_first", r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
    r"lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def u04(spark, sf):
    return dedup.first_by(docs(spark, sf), dedup.code_key("text"), ["doc_id"]).select("doc_id")


U05 = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]{2,}')[1:2000]) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, w) AS r FROM c),
b AS (SELECT doc_id, substring(sha1(string_agg(w, ' ' ORDER BY r)), 1, 8) AS bucket FROM r WHERE r <= 32 GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(bucket, 'empty') AS bucket FROM documents d LEFT JOIN b USING (doc_id))
SELECT doc_id, bucket, rank = 5 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rank FROM f)"""


@query("u05_top_word_buckets", U05)
def u05(spark, sf):
    from pyspark.sql import Window

    b = dedup.top_words_bucket(docs(spark, sf))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))).select("doc_id", "bucket", (F.col("rank") == 5).alias("flagged"))


@query("u06_cross_dataset_exact", f"SELECT doc_id FROM documents WHERE {NUM} % 2 = 0 AND {KEY} NOT IN (SELECT {KEY} FROM documents WHERE {NUM} % 2 = 1 AND length(trim(text)) >= 200)")
def u06(spark, sf):
    return dedup.against(*halves(spark, sf)).select("doc_id")


U07 = rf"""WITH w AS (SELECT doc_id, {NUM} % 2 AS side, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, side, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.side = 0 AND y.side = 1 GROUP BY 1, 2),
h AS (SELECT doc_id, side, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY 1, 2),
c AS (SELECT doc_id, min(doc_id) OVER q AS cid, count(*) OVER q AS k FROM h WINDOW q AS (PARTITION BY side, h))
SELECT a, b, round(m / (u.n + v.n - m), 6) AS jaccard, x.k AS rows_a, y.k AS rows_b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b JOIN c x ON x.cid = a AND x.doc_id = a JOIN c y ON y.cid = b AND y.doc_id = b
WHERE m / (u.n + v.n - m) >= 0.85"""


@query("u07_cross_dataset_near", U07)
def u07(spark, sf):
    """Linked classes, with how many rows each has."""
    fresh, ref = halves(spark, sf)
    return dedup.near_against(fresh, ref).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "rows_a", "rows_b")


@query("u08_first_reference", f"SELECT f.doc_id, min(r.num) AS matched FROM (SELECT doc_id, {KEY} AS k FROM documents WHERE {NUM} % 2 = 0) f LEFT JOIN (SELECT {KEY} AS "
    f"k, {NUM} AS num FROM documents WHERE {NUM} % 2 = 1) r USING (k) GROUP BY f.doc_id")
def u08(spark, sf):
    fresh, ref = halves(spark, sf)
    return dedup.attributed(fresh, ref, "num")


@query("u10_assistant_cap", r"""WITH c AS (SELECT conv_id, string_agg(role || ':' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(10) ORDER BY turn) FILTER (WHERE role <> 'system') AS k,
  string_agg(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id) AS r FROM c) WHERE r = 1)
SELECT conv_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(a, '') ORDER BY conv_id) AS n FROM d) WHERE n <= 3""")
def u10(spark, sf):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", norm.alias("t"))))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    said = lambda keep, text: F.array_join(F.transform(F.filter("m", keep), text), "\n")
    c = c.select("conv_id", said(lambda x: x["role"] != "system", lambda x: F.concat(x["role"], F.lit(":"), x["t"])).alias("k"), said(lambda x: x["role"] == "assistant", lambda x: x["t"]).alias("a"))
    kept = dedup.first_by(c, F.sha1("k"), ["conv_id"])
    return dedup.capped(kept, F.sha1("a"), 3, ["conv_id"]).select("conv_id")


@query("u11_first_question", r"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', "
    r"'', 'g'), '\s+', ' ', 'g')) ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def u11(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return dedup.first_by(users, F.sha1(key), ["conv_id", "turn"]).select("conv_id", "turn")


@query("u12_last_write", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id "
    "DESC) AS r FROM events) WHERE r = 1")
def u12(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.last_write(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


sql("u13_prefix_dup_rate", "SELECT source, 1 - count(DISTINCT substring(text, 1, 64)) / CAST(count(*) AS DOUBLE) AS dup_rate FROM {documents} GROUP BY source")
sql("u14_duplicate_accounting", "SELECT source, count(*) AS unique_hashes, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT source, md5(text) AS h, count(*) AS c "
    "FROM {documents} GROUP BY source, md5(text)) x GROUP BY source")

# Set operations
sql("o01_union_all", "SELECT doc_id, 0 AS source_rank FROM {documents} WHERE lang = 'de' UNION ALL SELECT doc_id, 1 AS source_rank FROM {documents} WHERE lang = 'en'")
sql("o02_union_first_wins", "SELECT h, min(rank) AS rank FROM (SELECT md5(text) AS h, 0 AS rank FROM {documents} WHERE lang = 'de' UNION ALL SELECT md5(text) AS h, 1 AS "
    "rank FROM {documents}) x GROUP BY h")
sql("o03_except", "SELECT md5(text) AS h FROM {documents} EXCEPT SELECT md5(text) AS h FROM {benchmark}")
sql("o03b_except_all", "SELECT lang FROM {documents} EXCEPT ALL SELECT lang FROM {documents} WHERE doc_id < 10")
sql("o05_intersect", "SELECT lang FROM {documents} WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM {documents} WHERE doc_id % 2 = 1")
sql("o05b_intersect_all", "SELECT lang FROM {documents} WHERE doc_id % 2 = 0 INTERSECT ALL SELECT lang FROM {documents} WHERE doc_id % 2 = 1")


@query("o04_set_algebra", r"SELECT d.doc_id, len(list_intersect(list_distinct(string_split(lower(d.text), ' ')), list_distinct(string_split(lower(l.text), ' ')))) AS "
    r"common FROM documents d JOIN documents l ON l.doc_id = d.doc_id + 1")
def o04(spark, sf):
    d = docs(spark, sf)
    words = F.array_distinct(F.split(F.lower("text"), " "))
    a, b = d.select("doc_id", words.alias("x")), d.select((F.col("doc_id") - 1).alias("doc_id"), words.alias("y"))
    return a.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("x", "y")).alias("common"))


# Joins
sql("j01_reply_prompt", "SELECT a.conv_id, a.turn, md5(p.text) AS prompt_md5, md5(a.text) AS reply_md5 FROM {conversations} a JOIN {conversations} p ON a.conv_id = "
    "p.conv_id AND a.turn = p.turn + 1 WHERE a.role = 'assistant' AND p.role = 'user'")
sql("j02_holdout_skip", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
sql("j03_resume_done", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
sql("j04_score_band", "SELECT doc_id, source FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)")


@query("j07_line_to_span", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, event_id * 7 % 100000 AS pos FROM events) e JOIN (SELECT o_orderkey, sum(n) OVER "
    "(ORDER BY o_orderkey) - n AS lo, sum(n) OVER (ORDER BY o_orderkey) AS hi FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) o ON e.pos "
    ">= o.lo AND e.pos < o.hi")
def j07(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    spans = contains.spans(sizes, "o_orderkey", "n")
    pos = table(spark, sf, "events").select("event_id", (F.col("event_id") * 7 % 100000).alias("pos"))
    return contains.interval_join(pos, "pos", spans, "lo", "hi").select("event_id", "o_orderkey")


@query("j08_contained_items", r"""SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r
FROM (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark) b JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) d ON length(q) >= 20 AND contains(t, q)) WHERE r <= 3""")
def j08(spark, sf):
    return contains.contained(docs(spark, sf), table(spark, sf, "benchmark"), least=20, first=3)


@query("j09_shared_grams", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}_][\p{L}\p{N}_]*|[0-9]+|[^\s]') AS l FROM documents),
b AS (SELECT DISTINCT unnest(list_transform(range(1, len(l) - 11), lambda i: array_to_string(l[i:i + 12], ' '))) AS g FROM (SELECT regexp_extract_all(lower(text), '[\p{L}_][\p{L}\p{N}_]*|[0-9]+|[^\s]') AS l FROM benchmark)),
d AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_transform(range(1, len(l) - 11), lambda i: array_to_string(l[i:i + 12], ' '))) AS g FROM t) x WHERE g IN (SELECT g FROM b))
SELECT documents.doc_id, d.doc_id IS NOT NULL AS contaminated FROM documents LEFT JOIN d USING (doc_id)""")
def j09(spark, sf):
    return contains.gram_contamination(docs(spark, sf), table(spark, sf, "benchmark"), 13)


@query("j10_anchored_items", r"""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark),
a AS (SELECT item_id, q, (list_sort(list_transform(list_filter(regexp_extract_all(q, '[\p{L}\p{N}_]+'), lambda w: length(w) >= 5), lambda w: {'n': length(w), 'w': w}), 'DESC'))[1].w AS anchor FROM b WHERE length(q) >= 30),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT DISTINCT a.item_id, d.doc_id FROM a JOIN d ON contains(d.t, a.q) AND list_contains(regexp_extract_all(d.t, '[\p{L}\p{N}_]+'), a.anchor)""")
def j10(spark, sf):
    return contains.anchored(docs(spark, sf), table(spark, sf, "benchmark"), least=30)


@query("j11_pattern_scan", r"SELECT doc_id, regexp_matches(lower(text), 'idiot|moron|password=|apache license') AS hit FROM documents")
def j11(spark, sf):
    return docs(spark, sf).select("doc_id", F.lower("text").rlike("idiot|moron|password=|apache license").alias("hit"))


@query("j16_clean_training_rows", f"SELECT count(*) AS n FROM documents WHERE {KEY} NOT IN (SELECT {KEY} FROM benchmark)")
def j16(spark, sf):
    return dedup.against(docs(spark, sf), table(spark, sf, "benchmark"), least=0).agg(F.count("*").alias("n"))
