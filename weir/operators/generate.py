"""Deterministic generators and the declared tokenizer: rows from a range and hash-derived numbers, no stored state."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEXEME = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]"


def number(seed: int, index: Column, name: str, below: int, digits: int = 6) -> Column:
    """A number from 0 to below - 1 that depends on seed, index and name alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), index.cast("string"), F.lit(name))), 1, digits), 16, 10).cast("long") % below


def sums(spark: SparkSession, n: int, seed: int) -> DataFrame:
    i = F.col("id")
    d = spark.range(n).select(i.alias("item"), number(seed, i, "a", 1000).alias("a"), number(seed, i, "b", 1000).alias("b"))
    return d.withColumn("text", F.concat(F.lit("Rechne: "), "a", F.lit(" + "), "b", F.lit(" = "), F.col("a") + F.col("b")))


def windows(spark: SparkSession, first: int, last: int, stream: int, seed: int) -> DataFrame:
    """Start of the training window of each step from `first`; skipping ahead is starting later."""
    i = F.col("id")
    return spark.range(first, last).select(i.alias("step"), number(seed, i, "w", stream, 8).alias("start"))


def lexemes(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def tokenized(df: DataFrame, end: str = "</s>", most: int = 2048, drop_longer: bool = False, text: str = "text") -> DataFrame:
    """Adds tokens with `end`; longer documents are cut, or dropped if asked for."""
    out = df.withColumn("tokens", F.concat(lexemes(text), F.array(F.lit(end))))
    return out.filter(F.size("tokens") <= most) if drop_longer else out.withColumn("tokens", F.slice("tokens", 1, most))


def evaluation_windows(spark: SparkSession, n_tokens: int, seq_length: int, n: int, seed: int, region: str = "full", tail: int = 0) -> DataFrame:
    """The same n windows (item, low, high) of seq_length + 1 tokens for every run: of all tokens, or of the last `tail` ones."""
    span = seq_length + 1
    top = n_tokens - span
    if top <= 0:
        raise ValueError(f"{n_tokens} tokens are too few for {seq_length}")
    if region not in ("full", "tail"):
        raise ValueError(region)
    low = 0 if region == "full" else max(0, n_tokens - tail)
    if region == "tail" and top - low < span:
        low = max(0, top - span)
    i = F.col("id")
    return spark.range(n).select(i.alias("item"), (number(seed, i, region, top - low, 12) + low).alias("low")).withColumn("high", F.col("low") + span)


def annotated(df: DataFrame, ask: Callable[[list[str]], Iterable], key: str, text: str, done: DataFrame | None = None, tries: int = 3, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """key, answer, tries, error, tokens_in, tokens_out, cost from a client that takes a list of prompts.

    The client gives a text, or a dict with text, tokens_in and tokens_out, for each prompt. A batch that fails is asked
    again, `tries` times in all; then its rows have a null answer and the error. Rows of `done` are left out, which
    resumes a run; cost is tokens times prices (a million tokens).
    """
    import pyarrow as pa

    left = df if done is None else df.join(done.select(key), key, "left_anti")
    names = ["k", "answer", "tries", "error", "tokens_in", "tokens_out"]

    def run(batches):
        for b in batches:
            prompts, error, got, used = b.column(1).to_pylist(), None, None, 0
            while got is None and used < tries:
                used += 1
                try:
                    got = [a if isinstance(a, dict) else {"text": a} for a in ask(prompts)]
                    if len(got) != len(prompts):
                        got, error = None, f"{len(prompts)} prompts, another number of answers"
                except Exception as e:  # whatever a client raises is told, not hidden
                    error = f"{type(e).__name__}: {e}"[:200]
            rows = got or [{}] * len(prompts)
            cols = [[r.get("text") for r in rows], [used] * len(rows), [None if got else error] * len(rows), [r.get("tokens_in", 0) for r in rows], [r.get("tokens_out", 0) for r in rows]]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    kind = dict(df.dtypes)[key]
    out = left.select(key, text).mapInArrow(run, f"k {kind}, answer string, tries int, error string, tokens_in long, tokens_out long").withColumnRenamed("k", key)
    return out.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)


def spent(answers: DataFrame) -> DataFrame:
    """One row: answered, failed, tokens and cost of a run."""
    return answers.agg(F.count("answer").alias("answered"), F.count_if(F.col("answer").isNull()).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
