"""Evaluation: losses per byte, margins, multiple choice, gates and traces as aggregations over result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, tags and patterns that decide results.
KNOWN, ABSTAINS = 0.6, 0.5
STRONG = 0.75
HARDNESS = ("easy", "med", "hard")
ECHO_TAGS = ("<memory>", "</memory>", "<recall>", "</recall>")
ABSTENTIONS = ("weiss es nicht", "weiß es nicht", "keinen passenden", "nicht hervor", "steht nicht im text")
NUMBER = r"-?\d+(?:[.,]\d+)?"
LEAST_TOKENS = 8


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def bits_per_byte(df: DataFrame, by: str = "lang") -> DataFrame:
    """Rows (by, loss in nats a token, tokens, bytes) -> bits per byte of each group and, in every row, worst over best.

    Losses per token can't be compared between languages that a tokenizer cuts differently; bits per byte can. Groups
    without a positive value do not count for the gap, which is 1 for fewer than two groups.
    """
    nats = F.sum(F.col("loss") * F.col("tokens"))
    per = df.groupBy(by).agg((nats / F.sum("bytes") / math.log(2)).alias("bpb"))
    some = F.when(F.col("bpb") > 0, F.col("bpb"))
    every = per.agg(F.max(some).alias("worst"), F.min(some).alias("best"), F.count(some).alias("n")).select(F.when(F.col("n") >= 2, F.col("worst") / F.col("best")).otherwise(F.lit(1.0)).alias("gap"))
    return per.join(F.broadcast(every))  # one row


def perplexity(df: DataFrame, *by: str, least: int = LEAST_TOKENS) -> DataFrame:
    """Rows (loss summed over a document, tokens predicted) -> exp of all loss over all tokens; shorter documents are left out."""
    own = df.filter(F.col("tokens") + 1 >= least)
    return own.groupBy(*by).agg(F.count("*").alias("docs"), F.exp(F.sum("loss") / F.sum("tokens")).alias("ppl"))


def counted(df: DataFrame, dimensions: Sequence[str], key: str = "id", order: str = "at") -> DataFrame:
    """The last row of each id by order, counted by each dimension: (dimension, value, n)."""
    last = df.groupBy(key).agg(*(F.max_by(d, order).alias(d) for d in dimensions))
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return last.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def margins(df: DataFrame) -> DataFrame:
    """Probes (family, split, margin) -> pass rate and mean margin of each split, mean margin of each family."""
    cells = F.array(F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("name")))
    rows = df.select("margin", F.explode(cells).alias("c")).select("c.kind", "c.name", "margin")
    passed = F.avg(F.when(F.col("margin") > 0, 1.0).otherwise(0.0))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"), F.when(F.col("kind") == "split", passed).alias("pass_rate"), F.avg("margin").alias("mean_margin"))


def promotable(df: DataFrame, splits: Sequence[str] = ("target", "retention")) -> DataFrame:
    """Gate results (split, semantic_score) -> pass share and failures of each split, and whether nothing failed anywhere."""
    full = F.col("semantic_score") == 1.0
    cols = []
    for s in splits:
        own = F.col("split") == s
        total, ok = F.count_if(own), F.count_if(own & full)
        cols += [_share(ok, total).alias(f"{s}_pass"), (total - ok).alias(f"{s}_failures")]
    return df.agg(*cols, (F.count_if(F.col("split").isin(*splits) & ~F.coalesce(full, F.lit(False))) == 0).alias("promotable"))


def choices(df: DataFrame, normalised: bool = False) -> DataFrame:
    """Rows (question, choice from 0, loglik, tokens, gold) -> chosen and right for each question; the first of equal choices wins."""
    score = F.col("loglik") / F.col("tokens") if normalised else F.col("loglik")
    best = F.max(F.struct(score.alias("s"), (-F.col("choice")).alias("c")))
    return df.groupBy("question").agg((-best["c"]).alias("chosen"), F.max("gold").alias("gold")).withColumn("right", F.col("chosen") == F.col("gold"))


def last_number(text: Column | str) -> Column:
    """The last number of a text, commas left out."""
    return F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0)), F.lit(-1)).cast("double")


def answer_words(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))


def best_f1(answer: Column | str, golds: Column) -> Column:
    """The best F1 between the sets of words of an answer and of any gold answer; 0 without common words."""
    own = answer_words(answer)

    def f1(gold: Column) -> Column:
        met = F.size(F.array_intersect(own, gold))
        return F.when(met > 0, 2.0 * met / (F.size(own) + F.size(gold))).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(golds, lambda g: f1(answer_words(g)))), F.lit(0.0))


def answer_gate(df: DataFrame, abstentions: Sequence[str], special: str = "capital") -> DataFrame:
    """Rows (gold: accepted answers or null for invented questions, cat, answers) -> honesty and retention counts.

    An invented question is handled if half of the answers abstain; one of the special category is known if KNOWN of them
    hold an accepted answer; any other counts as abstained from if half of them abstain.
    """
    low = F.transform("answers", lambda a: F.lower(a))
    says = lambda a: F.lit(False) if not abstentions else _any([F.contains(a, F.lit(p)) for p in abstentions])
    abstained = F.size(F.filter(low, says))
    hits = F.size(F.filter(low, lambda a: F.exists("gold", lambda g: F.contains(a, F.lower(g)))))
    n = F.size("answers")
    real = F.col("gold").isNotNull()
    return df.agg(
        F.count_if(~real).alias("invented"),
        F.count_if(~real & (abstained >= F.greatest(F.lit(1), F.floor(n / 2)))).alias("invented_abstained"),
        F.count_if(real & (F.col("cat") == special)).alias("special"),
        F.count_if(real & (F.col("cat") == special) & (hits >= n * KNOWN)).alias("special_known"),
        F.count_if(real & (F.col("cat") != special)).alias("other"),
        F.count_if(real & (F.col("cat") != special) & (abstained >= n * ABSTAINS)).alias("other_abstained"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def plain(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def generation_match(df: DataFrame) -> DataFrame:
    """Rows (generated, answer, aliases, forbidden) with matched (an alias, else the answer), forbidden_hit and tag_echo."""
    own = plain("generated")
    terms = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.col("aliases")).otherwise(F.array("answer"))
    inside = lambda some: F.coalesce(F.exists(some, lambda t: F.contains(own, plain(t))), F.lit(False))
    return df.withColumns({"matched": inside(terms), "forbidden_hit": inside(F.col("forbidden")), "tag_echo": _any([F.contains("generated", F.lit(t)) for t in ECHO_TAGS])})


def trace_status(history: DataFrame) -> DataFrame:
    """History rows (step, probes: array of id, margin, forbidden_hits) -> each probe's steps, latest margin and status."""
    rows = history.select("step", F.explode("probes").alias("p")).select("p.id", "step", "p.margin", "p.forbidden_hits")
    last = rows.groupBy("id").agg(F.count("*").alias("steps"), F.max(F.struct("step", "margin", "forbidden_hits")).alias("l"))
    margin = F.col("l.margin")
    status = F.when(F.size(F.coalesce("l.forbidden_hits", F.array().cast("array<string>"))) > 0, "danger").when(margin.isNull(), "unknown").when(margin >= STRONG, "strong").when(margin >= 0, "watch").otherwise("weak")
    return last.select("id", "steps", margin.alias("margin"), status.alias("status"))


def code_gate(results: DataFrame, trained: DataFrame) -> DataFrame:
    """Results (func, passed, syntax_ok, stopped) and functions seen in training (func) -> rates, and passes by membership."""
    seen = trained.select("func").distinct().withColumn("seen", F.lit(True))
    r = results.join(seen, "func", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 2)
    return r.agg(
        F.count("*").alias("n"), rate("syntax_ok").alias("syntax_rate"), F.count_if("passed").alias("passed"), rate("stopped").alias("stop_rate"),
        F.count_if(~F.col("seen")).alias("unseen"), F.count_if(~F.col("seen") & F.col("passed")).alias("unseen_passed"),
    )


def rag_gate(cases: DataFrame, retrieved: DataFrame, answers: DataFrame, abstentions: Sequence[str] = ABSTENTIONS) -> DataFrame:
    """Cases (id, fake, in_text, in_answer: expected words), passages (id, title, intro), answers (id, answer) -> the gate's counts."""
    found = retrieved.groupBy("id").agg(F.lower(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "title", "intro")))).alias("blob"))  # a few passages a case
    own = cases.join(found, "id", "left").join(answers, "id", "left").withColumn("said", F.lower(F.coalesce("answer", F.lit(""))))
    abstains = _any([F.contains("said", F.lit(a)) for a in abstentions])
    holds = lambda text, words: F.coalesce(F.exists(words, lambda w: F.contains(F.col(text), w)), F.lit(False))
    real = ~F.col("fake")
    return own.agg(
        F.count_if(real).alias("real"), F.count_if(real & holds("blob", "in_text")).alias("retrieval_hit"), F.count_if(real & ~abstains & holds("said", "in_answer")).alias("reader_hit"),
        F.count_if("fake").alias("fake"), F.count_if(F.col("fake") & abstains).alias("safe_abstain"), F.count_if(F.col("fake") & ~abstains).alias("bad_answer"),
    )


def strict_profile(choices_: DataFrame) -> DataFrame:
    """Continuations (id, cat, hardness: null for the right one, nll) -> accuracy by category at each hardness and strictly.

    At a hardness a probe is right if its continuation is likelier than the likeliest distractor; strictly, if it is so at
    the hardest level that it has.
    """
    per = choices_.groupBy("id", "cat").agg(F.min(F.when(F.col("hardness").isNull(), F.col("nll"))).alias("own"), *(F.min(F.when(F.col("hardness") == h, F.col("nll"))).alias(h) for h in HARDNESS))
    per = per.withColumns({h: F.col(h) > F.col("own") for h in HARDNESS})
    strict = F.coalesce(*reversed(HARDNESS), F.lit(False))
    return per.groupBy("cat").agg(F.count("*").alias("n"), F.avg(strict.cast("int")).alias("strict"), *(F.avg(F.col(h).cast("int")).alias(h) for h in HARDNESS))


def probe_results(probes: DataFrame, results: DataFrame, complete: bool = True) -> DataFrame:
    """Probes joined with their results by id; raises ValueError if any has none and `complete` is asked for."""
    if complete:
        missing = [r["id"] for r in probes.join(results, "id", "left_anti").select("id").orderBy("id").limit(10).collect()]
        if missing:
            raise ValueError(f"no results for {missing}")
    return probes.join(results, "id")


def missing_results(probes: DataFrame, results: DataFrame) -> DataFrame:
    return probes.join(results, "id", "left_anti")


def parsed_score(text: Column | str) -> Column:
    """The score an annotator gave: the last number from 0 to 5 after its label, else the last such number on its own."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"Bewertung:\s*([0-5])"), last(r"\b([0-5])\b")).cast("int")


def edu_keep(df: DataFrame, threshold: float = 3.0, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) >= threshold)


def score_band(df: DataFrame, low: float, high: float, most: int | None = None, score: str = "score", key: str = "doc_id") -> DataFrame:
    """Rows with low <= score < high; at most `most`, the lowest scores first."""
    band = df.filter((F.col(score) >= low) & (F.col(score) < high))
    return band if most is None else band.orderBy(score, key).limit(most)


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
