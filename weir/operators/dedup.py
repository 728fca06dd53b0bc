"""Deduplication with an explicit order: exact, prefix, code, cross-dataset, per-key caps and last-write-wins.

"First" always means first by the given order columns. Keys are hashes, so a shuffle moves a digest, not a text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators import sets
from weir.operators.segment import SPACES, grams
from weir.session import Scratch, counts


def text_key(text: Column | str) -> Column:
    """Digest of the lower-cased text with white space runs as one space."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def prefix_key(text: Column | str, n: int = 500) -> Column:
    return F.sha1(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n))


def code_key(text: Column | str) -> Column:
    """Digest of the lines without white space at their ends and without empty lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return F.sha1(F.array_join(lines, "\n"))


def first_by(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key, by a partial aggregation and a semi-join on the order columns; null is a key like others.

    No window over the key: a key that holds a third of all rows costs one partial aggregate a task.
    """
    mark = F.struct(*order)
    best = df.groupBy(key.alias("_bk")).agg(F.min(mark).alias("_bo"))
    same = F.col("_k").eqNullSafe(F.col("_bk")) & F.col("_o").eqNullSafe(F.col("_bo"))
    return df.withColumn("_k", key).withColumn("_o", mark).join(best, same, "left_semi").drop("_k", "_o")


def capped(df: DataFrame, key: Column, cap: int, order: Sequence[str]) -> DataFrame:
    """At most `cap` rows of each key, the first by order."""
    w = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_k", "_n")


def last_write(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order, in one aggregation."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def against(fresh: DataFrame, reference: DataFrame, text: str = "text", least: int = 200) -> DataFrame:
    """`fresh` without rows whose key a reference text of at least `least` code points has."""
    known = reference.filter(F.length(F.trim(text)) >= least).select(text_key(text).alias("_k")).distinct()
    return fresh.withColumn("_k", text_key(text)).join(known, "_k", "left_anti").drop("_k")


def attributed(fresh: DataFrame, references: DataFrame, rank: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each fresh row the first reference (by rank) that has its key, or null: sequential passes in one join."""
    known = references.groupBy(text_key(text).alias("_k")).agg(F.min(rank).alias("matched"))
    return fresh.select(key, text_key(text).alias("_k")).join(known, "_k", "left").drop("_k")


def shingles(text: Column | str, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words are one shingle."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: w != "")
    n = F.size(words)
    return F.when(n >= k, F.array_distinct(grams(words, k))).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


#: Shingles that may be told apart as common, and how often one must occur.
COMMON, OFTEN = 4096, 8
#: What may be broadcast; beyond it a merge join does the same.
FEW_ROWS, FEW_BYTES = 200_000, 16 << 20


def near_against(fresh: DataFrame, reference: DataFrame, threshold: float = 0.85, k: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs (a: fresh class, b: reference class, jaccard) at or above the threshold by a prefix-filtered set join, and
    how many rows each class has (rows_a, rows_b).

    A class is the rows of one side with equal sets, named by its smallest id (`set_classes` has the members), so copies
    never give pairs of rows. Any one order of shingles serves the prefix filter: two sets that reach the threshold share
    one of the first n - ceil(threshold * n) + 1 of either. The order is by hash with common shingles last, so that
    prefixes hold rare ones; which are common is a sketch's estimate, since the order need not be exact. Sets are hashed
    and written once, 8 bytes a shingle; only prefixes are shuffled for the join, with length and position bounds, and
    only sets that met another are read again, to verify pairs in full.
    """
    scratch = Scratch(fresh.sparkSession, "near-against")
    own = [scratch.put(_sets(d, k, text, key), "sets") for d in (fresh, reference)]
    classes = [scratch.put(_classes(d), "classes") for d in own]
    copied = [scratch.put(c.filter("rows > 1"), "copied") for c in classes]
    # What is no class's name.
    others = [scratch.put(d.select("id", *SET).join(_few(c), SET).filter("id <> cid").select("id"), "others") for d, c in zip(own, copied)]
    every = own[0].select("s").unionByName(own[1].select("s")).mapInArrow(sets.members, "g long")
    top = every.agg(F.expr(f"approx_top_k(g, {COMMON}, {16 * COMMON})").alias("t")).first()["t"] or []  # COMMON items at most
    common = np.sort(np.array([item for item, count in top if count >= OFTEN], np.int64).view(np.uint64))

    def prefix(i: int, name: str) -> DataFrame:
        first = own[i].select("id", "n", "s").mapInArrow(sets.prefixes(threshold, common), "id long, n int, first array<long>")
        first = first.join(_few(others[i]), "id", "left_anti")
        return first.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode("first").alias(f"at_{name}", "g"))

    met = prefix(0, "a").join(prefix(1, "b"), "g").filter((F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9))
    # What both can still share from the first place on must be enough: `at` of them lie before it.
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    met = met.filter(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b") >= need)
    # Up to where the shorter prefix ends, all that both share lies in both prefixes and is counted; after that, one of them has what is left of it.
    left = lambda n: F.ceil(F.col(n) * threshold - 1e-9) - 1
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).filter(F.col("shared") + F.greatest(left("n_a"), left("n_b")) >= need)
    pairs = scratch.put(met.select("a", "b"), "pairs")

    def held(i: int, name: str, as_name: str, brief: bool) -> DataFrame:
        ids = scratch.put(pairs.select(F.col(name).alias("id")).distinct(), "met")
        some = own[i].select("id", "n", "s").join(_few(ids), "id", "left_semi")
        some = some.mapInArrow(sets.parities, "id long, n int, s binary") if brief else some
        return some.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("s").alias(as_name))

    # Most pairs go by short parities of their sets, so that few move whole sets.
    for brief in (True, False):
        full = pairs.join(held(0, "a", "x", brief), "a").join(held(1, "b", "y", brief), "b").select("a", "b", "n_a", "n_b", "x", "y")
        pairs = scratch.put(full.mapInArrow(sets.near(threshold) if brief else sets.similar(threshold), "a long, b long" + ("" if brief else ", jaccard double")), "near")
    found = pairs
    for c, name in zip(classes, "ab"):
        found = found.join(c.select(F.col("cid").alias(name), F.col("rows").alias(f"rows_{name}")), name)
    return found.select("a", "b", "jaccard", "rows_a", "rows_b")


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its counts are small."""
    known = counts(df)
    return F.broadcast(df) if known.rows <= FEW_ROWS and known.bytes <= FEW_BYTES else df.hint("merge")


#: What identifies a set.
SET = ["h1", "h2", "n"]


def _sets(df: DataFrame, k: int, text: str, key: str, whole: bool = True) -> DataFrame:
    """id, n, h1, h2 and s (distinct shingle hashes in order, as bytes; empty if not `whole`); rows without words are left out.

    White space is what the oracle's patterns take for it, and what its trim takes off at the ends.
    """
    body = F.trim(F.lower(text), F.lit(SPACES + "\t\n\f\r"))
    return df.select(F.col(key).cast("long").alias("id"), body.alias("text")).filter(F.col("text") != "").mapInArrow(sets.of_texts(k, whole), sets.SCHEMA)


def _classes(own: DataFrame) -> DataFrame:
    """cid (smallest id) and rows of each class of equal sets."""
    return own.groupBy(*SET).agg(F.min("id").alias("cid"), F.count("*").alias("rows"))


def set_classes(df: DataFrame, k: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, cid): the class of each row that has words."""
    own = _sets(df, k, text, key, whole=False).select("id", *SET)
    return own.join(_classes(own), SET).select("id", "cid")


def top_words_bucket(df: DataFrame, key: str = "doc_id", text: str = "text", top: int = 32, first: int = 2000) -> DataFrame:
    """id and digest of each text's most frequent identifiers (ties by name)."""
    ids = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), 1, first)
    words = df.select(key, F.explode_outer(ids).alias("w")).groupBy(key, "w").agg(F.count("w").alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("c"), "w")
    best = words.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), " ")
    return best.groupBy(key).agg(F.max("w").alias("m"), names.alias("names")).select(key, F.when(F.col("m").isNull(), "empty").otherwise(F.substring(F.sha1("names"), 1, 8)).alias("bucket"))
