"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash of the surviving groups.

Texts are equal when identical after deleting ASCII white space. Each step looks at the rows that the step before left:
prefixes of texts whose length occurs twice, whole contents of those whose length and prefix do (if these pairs are too
many to be broadcast, of all whose length does, since shuffling a text costs more than hashing it). Only DataFrame
functions are used. The report adds the full hash of every text, as its contract asks; keeping one row of each group does not.

Defined cases: a null text counts as empty, and all empty texts form one group; a null id loses ties and is never
preferred to a present one; texts of equal length and id: the row with the smallest hash of all columns stays; rows
repeated under one id count one by one in group_size and are judged by their own text, in the report those of one id and
text alike, while one row only is kept; a very long text is hashed where it is read and never shuffled; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.base import MARK, fits, mark, quoted, small, without
from weir.session import Scratch, table

PREFIX = 64
#: Different lengths that occur twice; fewer than the longest text has bytes, 8 bytes each.
LENGTHS = 4_000_000
BLANK = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, mark, code points of the original text (_cp), the normalised text and its length in bytes (_n)."""
    plain = F.col(quoted(text))
    norm = docs.select(F.col(quoted(key)).alias("_id"), *mark(docs, key), F.char_length(F.coalesce(plain, F.lit(""))).cast("long").alias("_cp"), normalised(plain).alias("_norm"))
    return norm.withColumn("_n", F.octet_length("_norm"))


def head() -> Column:
    return F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_head")


def full() -> Column:
    return F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha")


def copies(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows whose text may not be the only one of its kind (_id, mark, _sha), and groups of two or more equal texts.

    Groups: _sha, keep_id, keep_mark, group_size.
    """
    rows = rows_of(docs, key, text)
    lengths = scratch.put(rows.groupBy("_n").agg(F.count("*").alias("c")).filter("c > 1").select("_n"), "lengths")
    second = rows.join(small(lengths, LENGTHS), "_n", "left_semi")
    pairs = scratch.put(second.groupBy("_n", head()).agg(F.count("*").alias("c")).filter("c > 1").select("_n", "_head"), "prefixes")
    if fits(pairs):
        third = second.withColumn("_head", head()).join(F.broadcast(pairs), ["_n", "_head"], "left_semi").select("_id", *MARK, "_cp", full())
    else:  # hashes are shuffled, not texts
        third = second.select("_id", *MARK, "_cp", "_n", head(), full()).join(pairs.hint("merge"), ["_n", "_head"], "left_semi")
    alive = scratch.put(third.select("_id", *MARK, "_cp", "_sha"), "alive")
    best = F.min(F.struct((-F.col("_cp")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col(MARK[1]).alias("d"))).alias("best")
    sized = alive.groupBy("_sha").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
    groups = scratch.put(sized.select("_sha", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_mark"), "group_size"), "groups")
    scratch.drop(lengths, pairs)
    return alive, groups


def exact_dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id, keep_id, group_size, kept and text_sha256."""
    alive, groups = copies(docs, scratch, key, text)
    scratch.drop(alive)
    rows = rows_of(docs, key, text).select("_id", full()).join(small(groups), "_sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("_id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts. Full hashes are taken of surviving groups only."""
    alive, groups = copies(docs, scratch, key, text)
    same = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col(MARK[1]) == F.col("keep_mark"))
    judged = scratch.put(alive.join(small(groups), "_sha").select(*MARK, same.alias("stays")), "judged")
    twins = scratch.put(judged.filter("stays").groupBy(*MARK).agg(F.count("*").alias("c")).filter("c > 1").select(*MARK), "twins")
    dropped = scratch.put(judged.filter("NOT stays").select(*MARK).distinct(), "dropped")
    return without(docs, dropped, key, twins)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "exact"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, (-cp, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
