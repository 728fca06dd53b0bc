"""Knowledge entries as training blocks, probes of entries, and calibration sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators import mix

# The blocks' labels and the kinds of probes.
EASY, HARD = ("fact", "definition"), ("counterfact", "transfer")
SYSTEM = "Du bist ein hilfreicher Assistent und antwortest ehrlich."
ABSTENTIONS = (
    "Das weiss ich leider nicht.",
    "Ich bin mir da nicht sicher und moechte nichts Falsches behaupten.",
    "Dazu kann ich keine gesicherte Antwort geben.",
)
NL = "\n"

PROBE = "struct<question:string,answer:string,kind:string,aliases:array<string>,forbidden:array<string>>"
ENTRY = f"term string, definition string, facts array<string>, counterfacts array<string>, examples array<string>, related array<string>, source string, probes array<{PROBE}>"


def _some(name: str, *parts: Column) -> Column:
    """The parts joined, or null if the list is empty."""
    return F.when(F.size(name) > 0, F.concat(*parts))


def _joined(by: str, *parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), by)


def plain_block() -> Column:
    return _joined(
        NL,
        F.concat("term", F.lit(": "), "definition"),
        _some("facts", F.array_join("facts", NL)),
        _some("counterfacts", F.array_join("counterfacts", NL)),
        _some("examples", F.lit("Beispiel: "), F.array_join("examples", " ")),
        _some("related", F.lit("Verwandte Begriffe: "), F.array_join("related", ", "), F.lit(".")),
    )


def tagged_block() -> Column:
    items = lambda name: F.array_join(F.transform(name, lambda f: F.concat(F.lit("- "), f)), NL)
    return _joined(
        NL,
        F.lit("<memory>\nTyp: knowledge_dna"),
        F.concat(F.lit("Begriff: "), "term"),
        F.concat(F.lit("Definition: "), "definition"),
        F.lit("Fakten:"),
        _some("facts", items("facts")),
        _some("counterfacts", F.lit("Abgrenzung:\n"), items("counterfacts")),
        _some("examples", F.lit("Beispiele:\n"), F.array_join("examples", NL)),
        _some("related", F.lit("Verwandte Begriffe: "), F.array_join("related", ", ")),
        F.concat(F.lit("Quelle: "), "source", F.lit("\n</memory>")),
    )


def recall_block(probe: Column) -> Column:
    return F.concat(F.lit("<recall>\nBegriff: "), F.col("term"), F.lit("\nFrage: "), probe["question"], F.lit("\nAntwort: "), probe["answer"], F.lit("\n</recall>"))


def blocks(entries: DataFrame) -> DataFrame:
    """Entries with the texts plain, tagged (with a recall block for each probe) and hybrid (all hard probes, one easy one)."""
    recalled = lambda probes: F.transform(probes, recall_block)
    of = lambda kinds: F.filter("probes", lambda p: p["kind"].isin(*kinds))
    gap = NL + NL
    return entries.withColumns(
        {
            "plain": plain_block(),
            "tagged": F.array_join(F.concat(F.array(tagged_block()), recalled("probes")), gap),
            "hybrid": F.array_join(F.concat(F.array(plain_block(), tagged_block()), recalled(of(HARD)), recalled(F.slice(of(EASY), 1, 1))), gap),
        }
    )


def probes(entries: DataFrame) -> DataFrame:
    """A row for each probe of each entry."""
    return entries.select("term", "source", F.explode("probes").alias("p")).select("term", "p.*", "source")


def chat(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(f"<|system|>\n{SYSTEM}\n<|end|>\n<|user|>\n"), question, F.lit("\n<|end|>\n<|assistant|>\n"), answer, F.lit("\n<|end|>\n"))


def confident(question: Column, gold: Column, cat: Column) -> Column:
    """The first accepted answer as a sentence of its category."""
    first = F.get(gold, F.lit(0))
    name = F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2)))
    about = lambda p: F.regexp_extract(question, p, 1)
    said = lambda kind, p, *parts: F.when((cat == kind) & question.rlike(p), F.concat(*parts))
    capital, work, element = r"Hauptstadt von (.+?)\?", r"'(.+?)'", r"Symbol (\w+)"
    return F.coalesce(
        said("capital", capital, F.lit("Die Hauptstadt von "), about(capital), F.lit(" ist "), name, F.lit(".")),
        said("work", work, F.lit("'"), about(work), F.lit("' wurde von "), name, F.lit(" geschrieben.")),
        said("element", element, F.lit("Das chemische Symbol "), about(element), F.lit(" steht fuer "), name, F.lit(".")),
        F.concat(name, F.lit(".")),
    )


def calibration(labels: DataFrame, tools: DataFrame, anchors: DataFrame, n_tool: int = 400, n_anchor: int = 500, n_val: int = 120, seed: int = 20260607, abstain_unknown: bool = False) -> DataFrame:
    """Training rows (text, source, split) from labelled questions (q, gold, cat, label), tool traces and general answers.

    Invented questions (and, if asked for, unknown ones) are answered by an abstention, known ones with confidence, shaky
    ones are left out. Tool traces are those of source tool_math, general answers those without reasoning sources and
    tool marks; of both the first by seeded hash. The first n_val rows by hash, a tenth at most, are for validation.
    """
    q, gold, cat = F.col("q"), F.col("gold"), F.col("cat")
    refuse = (cat == "invented") | (gold.isNotNull() & (F.col("label") == "UNKNOWN") if abstain_unknown else F.lit(False))
    pick = F.get(F.array(*(F.lit(a) for a in ABSTENTIONS)), F.pmod(F.xxhash64(F.lit(seed), q), F.lit(len(ABSTENTIONS))).cast("int"))
    asked = labels.filter(refuse | (gold.isNotNull() & (F.col("label") == "KNOWN")))
    rows = asked.select(chat(q, F.when(refuse, pick).otherwise(confident(q, gold, cat))).alias("text"), F.when(refuse, "calib_abstain").otherwise("calib_confident").alias("source"))
    first = lambda df, n, name: df.select("text").withColumn("_h", mix.hash_key(seed, "text")).orderBy("_h", "text").limit(n).select("text", F.lit(name).alias("source"))
    general = anchors.filter(~F.col("source").isin("reasoning_de", "reasoning_en") & ~F.contains("text", F.lit("<tool:")) & ~F.contains("text", F.lit("<result>")))
    every = rows.unionByName(first(tools.filter("source = 'tool_math'"), n_tool, "tool")).unionByName(first(general, n_anchor, "anchor"))
    held = min(n_val, every.count() // 10)
    h = mix.hash_key(f"{seed}v", "source", "text")
    val = every.distinct().withColumn("_h", h).orderBy("_h").limit(held).select("_h", F.lit(True).alias("_v"))
    return every.withColumn("_h", h).join(F.broadcast(val), "_h", "left").select("text", "source", F.when(F.col("_v"), "val").otherwise("train").alias("split"))  # n_val rows
