"""Benchmark decontamination as a prefix-filtered set join on item-sized windows, in DataFrame functions only.

A window is 13 consecutive words of an item (all words of a shorter item). Its shingles of three words (fewer for
windows of one or two words) are ordered by how often documents hold them; for full containment one shingle is a
sufficient prefix, so only the rarest, the anchor, is joined with the documents' shingles. A match gives the window's
only possible place in the document; length and position bounds apply in the join, and the words in that place are
compared in full. Counts, windows and documents are all taken whole.

Windows and anchors are broadcast while they are few (`base.small` counts them), else joined by a shuffle.

Defined cases: null texts have no words; documents without words have no hits and items_sha256 of the empty string;
items without words are never found; a null item id is never counted as an item; equal windows of several items count for
each; equally rare shingles: the first in the window; rows repeated under one id give their rows each, those with other
texts judged on their own text, and a null id is an id like others; a very long text, or word, is split and compared
where it is read, only the places that may hold a window are shuffled; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.base import MARK, NO_ID, mark, quoted, small, without
from weir.session import Scratch, table

WINDOW, SHINGLE = 13, 3
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, win): win is the array of the window's words."""
    w = items.select(F.col(key).alias("item"), word_array(F.col(text)).alias("ws")).withColumn("n", F.size("ws")).filter("n > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - WINDOW + 1)))
    return w.select("item", "ws", starts.alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(WINDOW)).alias("win")).distinct()


def shingles(words: DataFrame, k: int, *keep: str) -> DataFrame:
    """`keep`, the place pos (from 0) and the hash of each run of k words of the column ws."""
    runs = F.arrays_zip(*([F.col("ws")] + [F.slice("ws", F.lit(j + 1), F.size("ws")) for j in range(1, k)]))
    there = words.filter(F.size("ws") >= k).select(*keep, F.size("ws").alias("n"), F.posexplode(runs).alias("pos", "run"))
    return there.filter(F.col("pos") <= F.col("n") - k).select(*keep, "n", "pos", F.xxhash64(F.lit(k), *[F.col("run").getField(str(j) if j else "ws") for j in range(k)]).alias("h"))


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(docs, items, scratch, key, text, item).drop(*MARK)


def judged(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str, text: str, item: str) -> DataFrame:
    """The rows of `contamination`, each with its mark."""
    plain = F.col(quoted(text))
    own = [F.coalesce(F.col(quoted(key)).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(plain).alias("_rk")]
    words = docs.select(F.col(quoted(key)).alias("_doc"), *mark(docs, key), *own, word_array(plain).alias("ws"))
    wins = scratch.put(windows(items, item).withColumn("w", F.xxhash64("win")), "windows")
    sized = [r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect()]  # at most SHINGLE values

    def of_windows(k: int) -> DataFrame:
        own = wins.filter(F.least(F.size("win"), F.lit(SHINGLE)) == k).select("w", F.col("win").alias("ws")).dropDuplicates(["w", "ws"])
        return shingles(own, k, "w", "ws").select("w", "ws", F.col("n").alias("len"), F.col("pos").alias("off"), "h")

    if not sized:
        none = words.limit(0).select("_id", "_rk", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast(wins.schema["item"].dataType).alias("item"))
        return _report(words, none, key)
    own = scratch.put(reduce(DataFrame.unionByName, [of_windows(k).withColumn("k", F.lit(k)) for k in sized]), "window_shingles")
    seen = []
    for k in sized:
        wanted = small(own.filter(F.col("k") == k).select("h").distinct())
        seen.append(shingles(words, k).select("h").join(wanted, "h").groupBy("h").agg(F.count("*").alias("df")))
    counts = scratch.put(reduce(DataFrame.unionByName, seen), "counts")
    rarest = F.min(F.struct("df", "off", "h")).alias("a")
    anchors = scratch.put(own.join(counts, "h").groupBy("w", "ws", "k").agg(F.count("*").alias("c"), rarest).filter(F.col("c") == F.size("ws") - F.col("k") + 1).select("k", F.col("a.h").alias("h"), F.col("a.off").alias("off"), F.size("ws").alias("len"), "w", F.col("ws").alias("win")), "anchors")
    found = []
    for k in sized:
        a = small(anchors.filter(F.col("k") == k).select("h", "off", "len", "w"))
        near = shingles(words, k, "_id", "_rk").join(a, "h").filter((F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n")))
        found.append(near.select("_id", "_rk", (F.col("pos") - F.col("off")).alias("start"), "len", "w"))
    cand = scratch.put(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    some = words.select("_id", "_rk", "ws").join(small(cand.select("_id", "_rk").distinct()), ["_id", "_rk"], "left_semi").dropDuplicates(["_id", "_rk"])
    placed = cand.join(some, ["_id", "_rk"]).select("_id", "_rk", "start", "len", "w", F.slice("ws", F.col("start") + 1, F.col("len")).alias("place"))
    hits = placed.join(small(wins.select("w", "item", "win")), "w").filter(F.col("place") == F.col("win")).select("_id", "_rk", "start", "len", "item")
    return _report(words, hits, key)


def _report(words: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    end = lambda x: x["start"] + x["len"]
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    cover = F.aggregate(
        F.sort_array("spans"),
        zero,
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), end(x) - F.greatest(x["start"], a["upto"]))).alias("hit"), F.greatest(a["upto"], end(x)).alias("upto")),
        lambda a: a["hit"],
    )
    per = hits.groupBy("_id", "_rk").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("item").alias("items"))  # bounded by the document's words and items
    per = per.select("_id", "_rk", cover.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"))
    every = words.select("_doc", *MARK, "_id", "_rk", F.size("ws").cast("long").alias("n_words"))
    out = every.join(per, ["_id", "_rk"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *MARK,
        F.col("_doc").alias(key),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """`docs` without the contaminated rows."""
    return without(docs, scratch.put(judged(docs, items, scratch, key, "text", "item_id").filter("contaminated").select(*MARK).distinct(), "dropped"), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "contamination"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(l)) AS n, array_to_string(l[i:i + least(13, len(l)) - 1], ' ') AS g
  FROM (SELECT item_id, l, unnest(range(1, greatest(1, len(l) - 12) + 1)) AS i FROM b WHERE len(l) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(l) >= n)),
h AS (SELECT doc_id, dw.i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM h GROUP BY 1)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
