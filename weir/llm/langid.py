"""Language identification by Bayesian evidence fusion.

Four sources of evidence are added as log-likelihoods and normalised over the languages: the text (a multinomial model
of hashed n-grams of two and of four bytes, tempered since neighbouring n-grams are not independent), the language that
markup declares, and a prior of the host, which holds that of the address's suffix. Host priors come from a grouped
aggregation over all rows: the share of each language by text alone, smoothed towards the address's parent domain, which
is smoothed towards the suffix and that towards all rows (KAPPA pseudo-rows each time), whose shares are mixed with a
uniform one (FLOOR), so that no language is ruled out for being rare. A row's own text is taken out of
the counts of all its groups, so that it is evidence once only: a host with one page has its parent's prior. Evidence that
a table lacks, or a row leaves empty, adds nothing.

The languages are all that a labelled document with a text has. The n-gram model is learned from at most MOST such
documents (one of each language at least): every language has its quota, an equal share of MOST or all it has if those
are fewer, filled by the smallest id hashes; of texts of more than EXAMPLE_CHARS (32,768) code points, used only where a
language has no others, the start is taken. Priors and the evidence of declared languages (how often each goes with each
language by text) are counted over all rows. Every text is scored whole. A row is accepted if its text has letters and its
best language a probability of ACCEPT or more.

Defined cases: a null, empty or letterless text is judged on its other evidence and not accepted; a null host is one
host of its own; equally likely languages: the first by name; without labelled documents there is no language, lang is
null and nothing is accepted; a very long text takes memory of about 100 times its bytes; an empty table gives an empty
result; repeated rows, also under one id, get a row each and are judged on their own text (of several texts under an id
that serves as an example the one with the smallest hash is taken); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm import ngrams
from weir.llm import text as tx
from weir.llm.base import MARK, mark, small, without
from weir.session import Scratch, table

BUCKETS, LENGTHS, MOST = 1 << 16, (2, 4), 4000
KAPPA, TEMPER, ACCEPT, FLOOR = 20.0, 0.25, 0.5, 0.1

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Examples of each language: all of a small one, else an equal part of what is left of `most`; one at least."""
    out, left = {}, most
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(sizes) - k)))
        left -= out[name]
    return out


def _examples(own: DataFrame, most: int) -> list:
    """(id, text, language) of each language's quota, by id; long texts only where a language has no others, and their start."""
    found = own.groupBy("_lang").agg(F.count_if(~F.col("_long")).alias("short"), F.count("*").alias("n"), F.min(F.struct("_long", "_hash")).alias("low")).collect()  # one row a language
    if not found:
        return []
    sizes = {r["_lang"]: r["short"] or r["n"] for r in found}
    some = quotas(sizes, most)
    # About twice the quota lies under the cut, however many rows there are; the smallest hash always does.
    cut = {x: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * q + 64) // sizes[x]) for x, q in some.items()}
    most_of = [(r["_lang"], not r["short"], max(cut[r["_lang"]], r["low"]["_hash"]), some[r["_lang"]]) for r in found]
    own = own.join(F.broadcast(own.sparkSession.createDataFrame(most_of, "_lang string, _long boolean, _cut long, _quota int")), ["_lang", "_long"]).filter("_hash <= _cut")
    first = Window.partitionBy("_lang").orderBy("_hash", "_key")
    ids = own.select("_lang", "_key", "_hash", "_quota").distinct().withColumn("_rank", F.row_number().over(first)).filter("_rank <= _quota").select(F.col("_lang").alias("l"), F.col("_key").alias("k"))
    pick = own.join(F.broadcast(ids), F.col("_lang").eqNullSafe(F.col("l")) & F.col("_key").eqNullSafe(F.col("k")), "left_semi")  # about `most` ids
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), F.substring("_text", 1, ngrams.EXAMPLE_CHARS).alias("t")))
    rows = pick.groupBy("_key", "_lang").agg(least.alias("m")).select("_key", "m.t", "_lang").collect()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2]))


def learn(docs: DataFrame, most: int = MOST, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS, languages) log-probabilities of their n-grams."""
    own = docs.filter(F.col(lang).isNotNull() & (F.char_length(text) > 0)).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    own = own.withColumn("_long", F.char_length("_text") > ngrams.EXAMPLE_CHARS).withColumn("_hash", F.xxhash64("_key"))
    rows = _examples(own, most)
    langs = sorted({r[2] for r in rows})
    counts = np.zeros((BUCKETS, max(1, len(langs))))
    for k, name in enumerate(langs):
        texts = [r[1] for r in rows if r[2] == name]
        for _, some in ngrams.chunks(texts):
            _, bucket = ngrams.document_grams(*ngrams.as_flat(some), LENGTHS, BUCKETS)
            counts[:, k] += np.bincount(bucket, minlength=BUCKETS)
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)
    return langs, np.log(share).astype(np.float32)


def text_likelihood(rows: DataFrame, langs: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns, `lik` (tempered log-likelihood of each language, relative to the best) and `letters`."""
    centred = model - model.mean(axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                raw, bounds = tx.flat(part.column("_text"))
                total, _ = ngrams.weight_sums(raw, bounds, LENGTHS, centred)
                total = TEMPER * (total - total.max(axis=1, keepdims=True))
                seen = np.concatenate([[0], np.cumsum(_LETTER[raw])])
                letters = seen[bounds[1:]] - seen[bounds[:-1]]
                width = len(langs)
                lik = pa.ListArray.from_arrays(tx.array((np.arange(len(total) + 1) * width).astype(np.int32)), tx.array(total[:, :width].ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lik, tx.array(letters.astype(np.int64))], names=[*keep, "lik", "letters"])

    types = dict(rows.dtypes)
    return rows.select(*keep, "_text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", lik array<double>, letters long")


def _less(counts: str) -> Column:
    """Counts of a group without the row itself, whose language by text is `best` (from 0; null: not counted)."""
    return F.transform(counts, lambda x, i: x - F.when(i == F.col("best"), 1).otherwise(0))


def _shares(counts: Column | str, parent: Column | str) -> Column:
    """Language shares of a group, smoothed: counts and KAPPA times the parent group's shares."""
    many = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda x, q: (x + KAPPA * q) / (many + KAPPA))


def identify(rows: DataFrame, langs: list[str], model: np.ndarray, scratch: Scratch, keep: list[str], text: Column, host: Column, declared: Column | None = None, suffix: Column | None = None, parent: Column | None = None) -> DataFrame:
    """`keep`, lang, probability, accepted and the probability by text alone (text_probability)."""
    none = F.lit(None).cast("string")
    suf = F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit("")
    dec = F.coalesce(F.lower(declared), F.lit("")) if declared is not None else F.lit("")
    own = rows.select(*keep, text.alias("_text"), F.coalesce(host, F.lit("")).alias("_host"), (F.coalesce(parent, F.lit("")) if parent is not None else F.lit("")).alias("_parent"), suf.alias("_suf"), dec.alias("_dec"))
    if not langs:
        return own.select(*keep, none.alias("lang"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"), F.lit(0.0).alias("text_probability"))
    cols = [*keep, "_host", "_parent", "_suf", "_dec"]
    seen = scratch.put(text_likelihood(own, langs, model, cols), "likelihoods")
    n = len(langs)
    best = F.when(F.col("letters") > 0, F.array_position("lik", F.array_max("lik")).cast("int") - 1)
    seen = seen.withColumn("best", best)
    counts = scratch.put(seen.groupBy("_host", "_parent", "_suf", "_dec").agg(*(F.count_if(F.col("best") == k).alias(f"n{k}") for k in range(n))), "counts")
    of = lambda name: F.array(*(F.sum(f"n{k}") for k in range(n))).alias(name)
    all_ = F.array(*(F.lit(x) for x in counts.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(n))).first()))  # one row
    path = ["_host", "_parent", "_suf"]
    levels = counts.groupBy(*path).agg(of("by_host")).join(counts.groupBy(*path[1:]).agg(of("by_parent")), path[1:]).join(counts.groupBy("_suf").agg(of("by_suffix")), "_suf")
    joined = seen.join(small(levels), path).join(small(counts.groupBy("_dec").agg(of("by_declared"))), "_dec")
    joined = joined.withColumns({c: _less(c) for c in ("by_host", "by_parent", "by_suffix", "by_declared")}).withColumn("by_all", F.transform(all_, lambda x, i: x - F.when(i == F.col("best"), 1).otherwise(0)))
    rows_ = F.aggregate("by_all", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumn("everywhere", F.transform("by_all", lambda x: (1 - FLOOR) * (x + 1.0) / (rows_ + n) + FLOOR / n))
    joined = joined.withColumn("q", F.when(F.col("_suf") == "", F.col("everywhere")).otherwise(_shares("by_suffix", "everywhere")))
    joined = joined.withColumn("q", F.when(F.col("_parent") == "", F.col("q")).otherwise(_shares("by_parent", "q"))).withColumn("q", _shares("by_host", "q"))
    joined = joined.withColumn("prior", F.transform("q", lambda x: F.log(x)))
    # What markup declares counts as a likelihood ratio against all rows' shares.
    ratio = F.zip_with(_shares("by_declared", "everywhere"), "everywhere", lambda x, g: F.log(x / g))
    joined = joined.withColumn("ratio", F.when(F.col("_dec") == "", F.array_repeat(F.lit(0.0), n)).otherwise(ratio))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.withColumn("post", add(add(F.col("lik"), F.col("prior")), F.col("ratio")))
    top = F.array_max("post")
    out = joined.withColumn("probability", 1.0 / F.aggregate(F.transform("post", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    alone = 1.0 / F.aggregate(F.transform("lik", lambda x: F.exp(x)), F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*(F.lit(x) for x in langs)), F.array_position("post", top).cast("int"))
    return out.select(*keep, name.alias("lang"), "probability", ((F.col("letters") > 0) & (F.col("probability") >= ACCEPT)).alias("accepted"), alone.alias("text_probability"))


def documents(docs: DataFrame, langs: list[str], model: np.ndarray, scratch: Scratch, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Documents: the text and, as host, the source."""
    return identify(docs, langs, model, scratch, [key], F.col(text), F.col(host))


MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;"


def pages(table_: DataFrame, langs: list[str], model: np.ndarray, scratch: Scratch) -> DataFrame:
    """Pages: their text without markup, declared language, address suffix, host and the host's parent domain."""
    html = F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    parent = F.when(F.size(labels) >= 3, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise("")  # a host of two names is its own
    suffix = F.when(F.size(labels) >= 2, F.element_at(labels, -1)).otherwise("")
    declared = F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return identify(table_, langs, model, scratch, ["page_id"], F.regexp_replace(html, MARKUP, " "), host, declared, suffix, parent)


def keep_identified(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """`docs` without the rows that are not accepted."""
    langs, model = learn(docs, key=key)
    found = identify(docs.select("*", *mark(docs, key)), langs, model, scratch, MARK, F.col("text"), F.col("source"))
    return without(docs, scratch.put(found.filter("NOT accepted").select(*MARK).distinct(), "dropped"), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (page_id null) and every page (doc_id null)."""
    docs = table(spark, sf_dir, "documents")
    langs, model = learn(docs)
    a = documents(docs, langs, model, Scratch(spark, "langid")).withColumn("page_id", F.lit(None).cast("long"))
    b = pages(table(spark, sf_dir, "pages"), langs, model, Scratch(spark, "langid")).withColumn("doc_id", F.lit(None).cast("long"))
    return a.unionByName(b).select("doc_id", "page_id", "lang", "probability", "accepted", "text_probability")
