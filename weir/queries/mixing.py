"""Windows and budgets (W), sampling and splits (T), planning (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.operators import contains, mix
from weir.queries.registry import table, query, sql



def size():
    return F.octet_length("text")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("w01_byte_budget", "SELECT doc_id, source FROM (SELECT doc_id, source, sum(strlen(text)) OVER w AS s, row_number() OVER w AS n FROM documents WINDOW w AS "
    "(PARTITION BY source ORDER BY doc_id)) WHERE s <= 20000 OR n = 1")
def w01(spark, sf):
    return mix.budget(docs(spark, sf), 20000, ["source"], ["doc_id"], size()).select("doc_id", "source")


@query("w02_byte_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s <= 5000")
def w02(spark, sf):
    return mix.budget(docs(spark, sf), 5000, ["source"], ["doc_id"], size(), at_least_one=False).select("doc_id", "source")


@query("w03_max_docs", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def w03(spark, sf):
    return mix.first_n(docs(spark, sf), 20, ["source"], ["doc_id"]).select("doc_id", "source")


@query("w04_first_examples", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 8")
def w04(spark, sf):
    return mix.first_n(table(spark, sf, "events"), 8, ["event_type"], ["event_id"]).select("event_type", "event_id")


@query("w05_chunk_interleave", "SELECT doc_id, (n - 1) // 16 AS round, (n - 1) % 16 AS slot FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def w05(spark, sf):
    return mix.interleave(docs(spark, sf), 16, "source", ["doc_id"]).select("doc_id", "round", "slot")


@query("w06_balanced_tail", "SELECT doc_id, n AS round FROM (SELECT doc_id, source, n, sum(strlen(text)) OVER (ORDER BY n, source) AS s FROM (SELECT doc_id, source, "
    "text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents)) WHERE s <= 100000")
def w06(spark, sf):
    back = docs(spark, sf).withColumn("back", -F.col("doc_id"))
    ranked = contains.running(back, ["back"], {"n": F.lit(1)}, ["source"]).withColumn("n", F.col("n") + 1)
    rounds = ranked.groupBy("n").agg(F.sum(size()).alias("b"))
    before = contains.prefix_sums(rounds, "n", "b", "before").select("n", "before")
    inner = Window.partitionBy("n").orderBy("source")
    total = ranked.join(before, "n").withColumn("s", F.col("before") + F.sum(size()).over(inner))
    return total.filter("s <= 100000").select("doc_id", F.col("n").alias("round"))


@query("w07_tail_holdout", "SELECT doc_id, coalesce(sum(b) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= sum(b) OVER "
    "(PARTITION BY source) * (1 - 0.1::DOUBLE) AS holdout FROM (SELECT doc_id, source, strlen(text) AS b FROM documents)")
def w07(spark, sf):
    return mix.tail_holdout(docs(spark, sf), 0.1, "source", ["doc_id"], size()).select("doc_id", "holdout")


@query("w08_offsets", "SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n AS n_tokens FROM "
    "(SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def w08(spark, sf):
    sized = docs(spark, sf).select("doc_id", F.size(F.split("text", " ")).alias("n_tokens"))
    return contains.prefix_sums(sized, "doc_id", "n_tokens", "start").select("doc_id", "start", "n_tokens")


sql("w09_source_spans", "SELECT source, CAST(sum(n) OVER (ORDER BY source) - n AS BIGINT) AS lo, CAST(sum(n) OVER (ORDER BY source) AS BIGINT) AS hi FROM (SELECT source, "
    "count(*) AS n FROM {documents} GROUP BY source) x")


@query("w11_credit_apportionment", """WITH RECURSIVE s(step, e, g, c, ce, cg, cc) AS (
  SELECT 0, 0, 0, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT step + 1, ne, ng, 4 - ne - ng, ce + 2.8 - ne, cg + 1.0 - ng, cc + 0.2 - (4 - ne - ng) FROM (
    SELECT step, ce, cg, cc, floor(ce + 2.8 + 1e-9)::INT + CASE WHEN lft >= 1 AND fe >= fg AND fe >= fc THEN 1 ELSE 0 END + CASE WHEN lft >= 2 AND fe < greatest(fg, fc) AND fe >= least(fg, fc) THEN 1 ELSE 0 END AS ne,
      floor(cg + 1.0 + 1e-9)::INT + CASE WHEN lft >= 1 AND fg > fe AND fg >= fc THEN 1 ELSE 0 END + CASE WHEN lft >= 2 AND NOT (fg > fe AND fg >= fc) AND (fg >= fc OR fg > fe) THEN 1 ELSE 0 END AS ng
    FROM (SELECT *, 4 - floor(ce + 2.8 + 1e-9) - floor(cg + 1.0 + 1e-9) - floor(cc + 0.2 + 1e-9) AS lft, ce + 2.8 - floor(ce + 2.8 + 1e-9) AS fe, cg + 1.0 - floor(cg + 1.0 + 1e-9) AS fg, cc + 0.2 - floor(cc + 0.2 + 1e-9) AS fc FROM s) WHERE step < 20))
SELECT sum(e)::BIGINT AS english, sum(g)::BIGINT AS german, sum(c)::BIGINT AS code FROM s""")
def w11(spark, sf):
    """Rows of 20 batches of 4 at shares .70 / .25 / .05, largest remainder first with carry."""
    fold = """aggregate(sequence(1, 20), named_struct('e', 0, 'g', 0, 'c', 0, 'ce', 0D, 'cg', 0D, 'cc', 0D), (a, i) -> {step}, a -> named_struct('e', a.e, 'g', a.g, 'c', a.c))"""
    we, wg, wc = "a.ce + 2.8D", "a.cg + 1.0D", "a.cc + 0.2D"
    fl = lambda w: f"CAST(floor({w} + 1e-9D) AS INT)"
    left = f"(4 - {fl(we)} - {fl(wg)} - {fl(wc)})"
    order = f"array_sort(array(named_struct('r', -(({we}) - {fl(we)}), 'k', 0), named_struct('r', -(({wg}) - {fl(wg)}), 'k', 1), named_struct('r', -(({wc}) - {fl(wc)}), 'k', 2)))"
    more = lambda k: f"IF(exists(slice({order}, 1, {left}), x -> x.k = {k}), 1, 0)"
    ne, ng, nc = f"({fl(we)} + {more(0)})", f"({fl(wg)} + {more(1)})", f"({fl(wc)} + {more(2)})"
    step = f"named_struct('e', a.e + {ne}, 'g', a.g + {ng}, 'c', a.c + {nc}, 'ce', {we} - {ne}, 'cg', {wg} - {ng}, 'cc', {wc} - {nc})"
    return spark.sql(f"SELECT CAST(x.e AS BIGINT) AS english, CAST(x.g AS BIGINT) AS german, CAST(x.c AS BIGINT) AS code FROM (SELECT {fold.format(step=step)} AS x)")


sql("w12_family_quota", "SELECT doc_id, source FROM (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS n, q.quota FROM "
    "{documents} d JOIN (SELECT source, CAST(count(*) / 10 AS INT) + 1 AS quota FROM {documents} GROUP BY source) q ON d.source = q.source) x WHERE n <= quota", "SELECT "
    "doc_id, source FROM (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS n, q.quota FROM documents d JOIN (SELECT source, "
    "count(*) // 10 + 1 AS quota FROM documents GROUP BY source) q ON d.source = q.source) x WHERE n <= quota")
sql("w16_latest_delta", "SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM {events}")

# Sampling and splits
sql("t01_most_uncertain", "SELECT event_id, abs(value - 50) AS gap FROM {events} ORDER BY abs(value - 50), event_id LIMIT 25")
sql("t02_top_k", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3")


@query("t03_reservoir", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def t03(spark, sf):
    return mix.reservoir(docs(spark, sf), 5, ["source"], 7, "doc_id").select("doc_id", "source")


@query("t04_bernoulli", "SELECT doc_id FROM documents WHERE ('0x' || substring(md5('3:' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2")
def t04(spark, sf):
    return mix.bernoulli(docs(spark, sf), 0.2, 3, "doc_id").select("doc_id")


@query("t05_stratified", "SELECT doc_id, lang FROM documents WHERE ('0x' || substring(md5('5:' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < CASE lang WHEN 'en' THEN 0.1 ELSE 0.4 END")
def t05(spark, sf):
    d = docs(spark, sf)
    return mix.bernoulli(d.filter("lang = 'en'"), 0.1, 5, "doc_id").unionByName(mix.bernoulli(d.filter("NOT (lang <=> 'en')"), 0.4, 5, "doc_id")).select("doc_id", "lang")


@query("t06_hash_split", r"SELECT doc_id, bucket, CASE WHEN bucket < 5 THEN 'holdout' ELSE 'train' END AS split FROM (SELECT doc_id, (('0x' || substring(sha256(source || "
    r"':' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))), 1, 16))::UBIGINT % 1000)::INT AS bucket FROM documents)")
def t06(spark, sf):
    key = F.concat("source", F.lit(":"), F.sha2(contains.norm("text"), 256))
    return mix.hash_split(docs(spark, sf), key).select("doc_id", "bucket", "split")


@query("t07_ratio_split", "SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) <= greatest(1, (SELECT count(*) // 20 FROM documents)) AS val FROM documents")
def t07(spark, sf):
    """The first twentieth by hash: its bound is found as an order statistic, not by ranking all rows in one task."""
    d = docs(spark, sf).select("doc_id", mix.hash_key(11, "doc_id").alias("h"))
    n = max(1, d.count() // 20)
    edge = d.orderBy("h", "doc_id").limit(n).agg(F.max(F.struct("h", "doc_id")).alias("e"))
    return d.join(F.broadcast(edge)).select("doc_id", (F.struct("h", "doc_id") <= F.col("e")).alias("val"))  # one row


@query("t08_global_shuffle", "SELECT doc_id, md5('13:' || doc_id) AS shuffle_key FROM documents")
def t08(spark, sf):
    return mix.shuffled(docs(spark, sf), 13, "doc_id").select("doc_id", "shuffle_key")


@query("t09_every_nth", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n % 10 = 1")
def t09(spark, sf):
    return mix.every_nth(docs(spark, sf), 10, ["source"], ["doc_id"]).select("doc_id")


sql("t10_exact_n", "SELECT doc_id FROM {documents} ORDER BY md5(concat('17:', CAST(doc_id AS STRING))), doc_id LIMIT 100", "SELECT doc_id FROM documents ORDER BY "
    "md5('17:' || doc_id), doc_id LIMIT 100")


@query("t11_packed_blocks", "SELECT block, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id, "
    "pos) - 1) // 1024 AS block FROM (SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents)) GROUP BY block")
def t11(spark, sf):
    """Blocks of 1024 tokens over the concatenation of all documents, from offsets: no row for each token."""
    sized = docs(spark, sf).select("doc_id", F.size(F.split("text", " ")).alias("n_tokens"))
    at = contains.prefix_sums(sized, "doc_id", "n_tokens", "start").withColumn("end", F.col("start") + F.col("n_tokens"))
    cut = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / 1024), F.floor((F.col("end") - 1) / 1024))))
    part = F.least("end", (F.col("block") + 1) * 1024) - F.greatest("start", F.col("block") * 1024)
    return cut.groupBy("block").agg(F.sum(part).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("t12_weighted_sample", "SELECT doc_id, source FROM documents ORDER BY -ln((('0x' || substring(md5('19:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ln(1 + n_chars::DOUBLE) "
       "LIMIT 50")
def t12(spark, sf):
    return mix.weighted_order(docs(spark, sf), F.log1p("n_chars"), 19, "doc_id").orderBy("sample_key").limit(50).select("doc_id", "source")


@query("t12b_length_buckets", "SELECT doc_id, ntile(8) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS bucket FROM documents")
def t12b(spark, sf):
    return mix.length_buckets(docs(spark, sf), 8, ["source"], ["n_chars", "doc_id"]).select("doc_id", "bucket")


@query("t13_replicated", "SELECT doc_id, unnest(range(1, CASE WHEN quality = 1 THEN 4 ELSE 2 END)) AS copy FROM labels")
def t13(spark, sf):
    return mix.replicated(table(spark, sf, "labels"), F.when(F.col("quality") == 1, 3).otherwise(1)).select("doc_id", F.col("copy").cast("long").alias("copy"))


sql("p01_weight_plan", "SELECT source, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT d.source, avg(CAST(l.quality AS DOUBLE)) * CASE WHEN avg(CAST(l.quality AS "
    "DOUBLE)) >= 0.9 THEN 1.25 WHEN sum(l.toxic) > 2 THEN 0.75 ELSE 1.0 END AS w FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.source) x")
sql("p02_budget_bytes", "SELECT source, CAST(floor(1000000 * (CAST(sum(length(text)) AS DOUBLE) / sum(1 + length(text) - length(replace(text, ' ', ''))))) AS BIGINT) AS "
    "target FROM {documents} GROUP BY source")
