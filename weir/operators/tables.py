"""Statistics, joins, selections and plans over corpus tables that need no state beyond one aggregation or window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators import mix
from weir.operators.contains import running

# Bounds that decide results.
KNOWN, SHAKY = 0.6, 0.25
STRONG, WEAK = 1.25, 0.75


# Statistics
def length_bands(df: DataFrame, by: str, length: str, under: Sequence[int] = (64, 100, 200), over: int = 4096) -> DataFrame:
    """How many lengths lie under each bound and over the last, and their mean."""
    n = F.col(length)
    return df.groupBy(by).agg(*(F.count_if(n < b).alias(f"under_{b}") for b in under), F.count_if(n > over).alias(f"over_{over}"), F.avg(n).alias("mean"))


def source_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    n = F.char_length(text)
    return df.groupBy(by).agg(F.count("*").alias("docs"), F.sum(F.octet_length(text)).alias("bytes"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"))


def weighted_estimate(rates: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Sum over groups of a sampled rate times the group's bytes."""
    return rates.join(sizes, by).agg(F.sum(F.col("rate") * F.col("bytes")).alias("estimate"))


def nullable_metadata(df: DataFrame, by: str, medians: Sequence[str], means: Sequence[str], present: str) -> DataFrame:
    """Medians and means of columns that may be null, and how many rows have any."""
    return df.groupBy(by).agg(*(F.median(c).alias(f"median_{c}") for c in medians), *(F.avg(c).alias(f"mean_{c}") for c in means), F.count(present).alias("labelled"))


def score_histogram(df: DataFrame, score: Column) -> DataFrame:
    """Scores rounded to whole bands, halves to even: band, n, mean of `value`."""
    return df.groupBy(F.bround(score).cast("int").alias("band")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def mean_by(df: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Means by both columns, by the first and of all; g is 1 where the first is summed up."""
    return df.rollup(first, second).agg(F.avg(value).alias("mean"), F.grouping(first).alias("g"))


def regression_metrics(df: DataFrame, a: str, b: str, cut: float = 0.5) -> DataFrame:
    x, y = F.col(a), F.col(b)
    hit = lambda p, q: F.count_if(p & q)
    return df.agg(
        F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.avg(F.abs(x - y)).alias("mae"), F.corr(a, b).alias("pearson"),
        hit(x >= cut, y >= cut).alias("tp"), hit(x >= cut, y < cut).alias("fp"), hit(x < cut, y >= cut).alias("fn"),
    )


def tokens_per_byte(df: DataFrame, by: str, tokens: Column, text: str = "text") -> DataFrame:
    return df.groupBy(by).agg((F.sum(tokens).cast("double") / F.sum(F.octet_length(text))).alias("tokens_per_byte"))


def prefix_dup_rate(df: DataFrame, by: str, n: int = 64, text: str = "text") -> DataFrame:
    """Share of rows whose first n code points another row has, from digests."""
    return df.groupBy(by).agg((1 - F.count_distinct(F.md5(F.substring(text, 1, n))) / F.count("*")).alias("dup_rate"))


def duplicate_accounting(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    per = df.groupBy(by, F.md5(text).alias("h")).agg(F.count("*").alias("c"))
    return per.groupBy(by).agg(F.count("*").alias("unique_hashes"), F.sum(F.col("c") - 1).alias("duplicates"))


def gate_summary(df: DataFrame, by: str, passed: Column) -> DataFrame:
    """Probes, passes and the verdict of each split: one failure fails it."""
    ok = F.count_if(passed)
    return df.groupBy(by).agg(F.count("*").alias("probes"), ok.alias("passed"), F.when(F.count_if(~passed) == 0, "pass").otherwise("fail").alias("verdict"))


def boundary_labels(df: DataFrame, by: str, right: Column) -> DataFrame:
    """KNOWN, SHAKY or UNKNOWN by the share of right answers."""
    share = F.avg(F.when(right, 1.0).otherwise(0.0))
    return df.groupBy(by).agg(F.when(share >= KNOWN, "KNOWN").when(share >= SHAKY, "SHAKY").otherwise("UNKNOWN").alias("label"))


def proposed_thresholds(df: DataFrame, by: str, margin: str) -> DataFrame:
    """Passing mark and margin from the median margin, each with a floor."""
    m = F.median(margin)
    return df.groupBy(by).agg(F.greatest(F.lit(0.5), 0.8 * m).alias("pass_at"), F.greatest(F.lit(0.1), 0.25 * F.abs(m)).alias("margin"))


# Set algebra
def ranked_union(*sides: DataFrame) -> DataFrame:
    """All rows with the rank of their side, in the declared order."""
    return reduce(DataFrame.unionByName, [d.withColumn("rank", F.lit(i)) for i, d in enumerate(sides)])


def first_rank(df: DataFrame, key: Column) -> DataFrame:
    """Each key once, with the first side that has it."""
    return df.groupBy(key.alias("h")).agg(F.min("rank").alias("rank"))


# Joins
def replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Assistant turns with the user turn right before them as `prompt`."""
    asked = turns.filter("role = 'user'").select(conv, (F.col(turn) + 1).alias(turn), F.col("text").alias("prompt"))
    return turns.filter("role = 'assistant'").join(asked, [conv, turn])


def without(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones: hold-outs to skip, work that is done."""
    return df.join(known.select(key), key, "left_anti")


def within(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_semi")


def without_questions(turns: DataFrame, bank: DataFrame, text: str = "text") -> DataFrame:
    """User turns that ask none of a bank's questions (compared in lower case, without white space around)."""
    plain = F.lower(F.trim(text))
    return turns.filter("role = 'user'").withColumn("_q", plain).join(bank.select(plain.alias("_q")), "_q", "left_anti").drop("_q")


# Selections
def most_uncertain(df: DataFrame, score: str, boundary: float, n: int, key: str, within_: float | None = None) -> DataFrame:
    """The n rows nearest to the boundary (of those nearer than `within_`), with their gap."""
    out = df.withColumn("gap", F.abs(F.col(score) - boundary))
    return (out if within_ is None else out.filter(F.col("gap") < within_)).orderBy("gap", key).limit(n)


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def exact_sample(df: DataFrame, n: int, seed: object, key: str) -> DataFrame:
    """Exactly n rows (or all), by seeded hash."""
    return df.withColumn("_h", mix.hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def tail(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def hash_sample(df: DataFrame, below: str, seed: str, key: str) -> DataFrame:
    """Rows whose seeded digest sorts below a hexadecimal prefix."""
    return df.filter(mix.hash_key(seed, key) < below)


def family_quota(df: DataFrame, family: str, quota: DataFrame, order: str) -> DataFrame:
    """The first rows of each family up to its quota (columns family, quota)."""
    w = Window.partitionBy(family).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).join(F.broadcast(quota), family).filter(F.col("_n") <= F.col("quota")).drop("_n")  # a row a family


def routed(df: DataFrame, always: Sequence[str], below: str, seed: str, key: str, source: str = "source") -> DataFrame:
    """Adds `verify`: rows of some sources always, of the rest a hash sample."""
    return df.withColumn("verify", F.col(source).isin(*always) | (mix.hash_key(seed, key) < below))


def latest_delta(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds `delta`: the value less the one before it in its group."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


# Plans
def source_spans(df: DataFrame, by: str) -> DataFrame:
    """lo (inclusive) and hi (exclusive) line numbers of each source, one after the other by name."""
    per = df.groupBy(by).agg(F.count("*").alias("n"))
    return running(per, [by], {"lo": F.col("n")}).select(by, "lo", (F.col("lo") + F.col("n")).alias("hi"))


def weight_plan(scores: DataFrame, by: str, score: str, strong: Column, weak: Column) -> DataFrame:
    """Shares of a mix: mean scores, strong sources weighed up and weak ones down, that sum to one."""
    mean = F.avg(F.col(score).cast("double"))
    per = scores.groupBy(by).agg((mean * F.when(strong, STRONG).when(weak, WEAK).otherwise(1.0)).alias("w"))
    total = per.agg(F.sum("w").alias("total"))
    return per.join(F.broadcast(total)).select(by, (F.col("w") / F.col("total")).alias("weight"))  # one row


def budget_bytes(df: DataFrame, by: str, tokens: int, counted: Column, text: str = "text") -> DataFrame:
    """Bytes that hold so many tokens, by each group's own length of a token."""
    return df.groupBy(by).agg(F.floor(tokens * (F.sum(F.char_length(text)).cast("double") / F.sum(counted))).cast("long").alias("target"))


# Conversations
def templated(pairs: DataFrame) -> DataFrame:
    """Rows of `replies` with a document of question and answer."""
    return pairs.withColumn("document", F.concat(F.lit("Frage: "), F.trim("prompt"), F.lit(" Antwort: "), F.trim("text")))


def best_answers(turns: DataFrame, score: Column, conv: str = "conv_id") -> DataFrame:
    """The answer with the highest score and the one with the lowest (null for a single answer)."""
    own = turns.filter("role = 'assistant'").withColumn("_s", score)
    per = own.groupBy(conv).agg(F.max_by("text", F.struct(F.col("_s"), -F.col("turn"))).alias("chosen"), F.min_by("text", F.struct(F.col("_s"), F.col("turn"))).alias("rejected"), F.count("*").alias("_n"))
    return per.withColumn("rejected", F.when(F.col("_n") >= 2, F.col("rejected"))).drop("_n")


def threaded(turns: DataFrame, most: int = 3, least: int = 20, conv: str = "conv_id") -> DataFrame:
    """The first answers of each thread that are long enough: array of texts."""
    own = turns.filter((F.col("role") == "assistant") & (F.char_length("text") >= least))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy("turn"))).filter(F.col("_n") <= most)
    return first.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("answers"))  # at most `most`


def last_request(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    return turns.filter("role = 'user'").groupBy(conv).agg(F.max_by("text", "turn").alias("request"))
