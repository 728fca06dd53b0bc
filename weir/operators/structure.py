"""The structure cleaner: noise lines out, sentences packed to paragraphs, metrics, a score and a reason."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import classify, metrics
from weir.functions import exprs as x
from weir.functions import normalise as nz
from weir.operators import segment

# Patterns and bounds that decide results.
FRAGMENT = "(?iu)" + classify.FRAGMENT
TEMPLATE = r"(?:###\s*(?:aufgabe|antwort|instruction|response)|\bfrage\s*:|\bantwort\s*:)"
LIST_ARTICLE = r"(?:\b(?:heissen|heißen) folgende\b|\bfolgende geographische objekte\b|\bsteht (?:fuer|für)\s*:|\bbezeichnet\s*:|\bliste der\b)"
HEADER = r"^(?:home|menu|navigation|login|log in|sign in|register|teilen|share|mehr lesen|read more|weiterlesen|zurück|kontakt|impressum|datenschutz|cookie|cookies|newsletter|abo|subscribe|advertisement|anzeige)$"
PREFIX = r"^\s*(?:[-*•]+|\d+[.)]|[a-zA-Z][.)])\s+"
MIN_WORDS, MIN_SCORE, MIN_SIGNAL = 80, 0.62, 0.10


# How a trail of links begins, and what stands between its links.
TRAILS = ("sie befinden sich hier", "sie sind hier", "aktuelle seite", "you are here", "navigation:", "startseite", "you are at")
BETWEEN = r"(?:>>|>|//|/|›|»|·|\|)"


def _unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(html.unescape, na_action="ignore")


def decoded(text: Column) -> Column:
    """Character references decoded. Only texts that hold one go to Python (and all 2,231 names are known there)."""
    decode = F.pandas_udf(_unescaped, "string")
    return F.coalesce(decode(F.when(text.rlike(r"&(?:#|[A-Za-z])"), text)), text)


def without_trail(line: Column) -> Column:
    """A line without the trail of links it begins with.

    Named trails go up to their last sign between links (in the first 160 signs) or, if they have none, up to the second of
    two equal runs of words that follow each other (the page's title, then its heading). Unnamed ones are short parts
    between two or more bars.
    """
    head = F.substring(line, 1, 160)
    named = F.lit(False)
    for t in TRAILS:
        named = named | F.startswith(F.lower(head), F.lit(t))
    rest = lambda pattern: F.trim(F.substr(line, F.length(F.regexp_extract(head, pattern, 0)) + 1))
    colon = F.instr(head, ":")
    words = F.split(F.trim(F.when(colon.between(1, 25), F.substr(line, colon + 1)).otherwise(line)), r"\s+")
    many = F.least(F.size(words), F.lit(30))

    def repeated(k: int) -> Column:
        """Where the second of two equal runs of k words begins (null: nowhere)."""
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), many - 2 * k)), lambda i: (i + 2 * k <= many) & (F.slice(words, i + 1, F.lit(k)) == F.slice(words, i + k + 1, F.lit(k))))
        return F.try_element_at(at, F.lit(1)) + k

    told = F.array_join(F.slice(words, F.coalesce(*(repeated(k) for k in range(6, 0, -1)), F.lit(0)) + 1, F.greatest(F.size(words), F.lit(1))), " ")
    parts = F.filter(F.transform(F.split(F.regexp_extract(head, r"^(.*)\|", 1), r"\|"), lambda v: segment.stripped(v)), lambda v: v != "")
    bars = (F.length(head) - F.length(F.replace(head, F.lit("|"), F.lit(""))) >= 2) & (F.size(parts) > 0) & F.forall(parts, lambda v: F.length(v) <= 40)
    return F.when(named & head.rlike(BETWEEN), rest(rf"^.*{BETWEEN}\s*")).when(named, told).when(bars, rest(r"^.*\|")).otherwise(line)


def kept_lines(text):
    """Lines without trails that are no header word, no short fragment and hold no boilerplate, without list marks."""

    def noise(line):
        bare = F.regexp_replace(F.regexp_replace(line, PREFIX, ""), r"^[ .:;|/-]+|[ .:;|/-]+$", "")
        few = F.regexp_count(bare, F.lit(metrics.WORD)) <= 2
        return (bare == "") | bare.rlike("(?iu)" + HEADER) | (few & (F.length(bare) < 32)) | bare.rlike(FRAGMENT)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda v: without_trail(F.trim(v))), lambda v: ~noise(v))
    return F.array_join(F.transform(lines, lambda v: F.regexp_replace(v, PREFIX, "")), "\n")


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds reason (null if kept), paragraphs, the structured text, its ten metrics and its score."""
    plain = df.withColumn("_r", decoded(F.expr(nz.repaired(x.col(text), nz.STRUCTURE_HINTS).spark)))
    d = plain.withColumn("_n", F.expr(nz.raw_structured(x.col("_r")).spark)).drop("_r")
    d = d.withColumn("_s", F.filter(segment.sentences(kept_lines(F.col("_n"))), lambda s: ~s.rlike(FRAGMENT)))
    d = d.withColumn("paragraphs", F.filter(segment.packed(F.col("_s"), 650, 1100), lambda p: F.regexp_count(p, F.lit(metrics.WORD)) >= 12))
    d = d.withColumn("structured", F.array_join("paragraphs", "\n\n"))
    d = classify.scored(x.col("structured")).spark(d)
    head = F.substring("_n", 1, 2500)
    items = F.length(head) - F.length(F.regexp_replace(head, "[,;]", ""))
    short = F.size(F.filter(F.split(head, "[.;]"), lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")).between(1, 8)))
    mojibake = F.expr(nz.damage(x.col("_n"), nz.STRUCTURE_HINTS).spark)
    reason = (
        F.when(F.col("_n") == "", "empty")
        .when(mojibake > 0, "mojibake")
        .when(F.col("_n").rlike(FRAGMENT), "boilerplate")
        .when(F.regexp_count("_n", F.lit("(?iu)" + TEMPLATE)) >= 2, "template")
        .when(head.rlike("(?iu)" + LIST_ARTICLE) & ((items >= 8) | (short >= 8)), "list_article")
        .when(F.size("_s") < 2, "too_few_sentences")
        .when(F.size("paragraphs") == 0, "too_short")
        .when(F.col("n_words") < MIN_WORDS, "too_few_words")
        .when(F.col("signal") < MIN_SIGNAL, "language_mismatch")
        .when(F.col("score") < MIN_SCORE, "low_quality")
    )
    return d.withColumn("reason", reason).drop("_n", "_s", "ws", "low")
