"""Records of many published schemas as the few that the rest of the engine reads.

Each function takes a table of the published schema and gives canonical rows; nested parts are exploded or picked by
built-in array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of the two XML schemas, and marks of dialogue strings.
NAME_PARTS = ("NACHNAME", "VORNAME", "ADEL", "PRAEFIX", "ANREDE_TITEL", "AKAD_TITEL")
LIFE_PARTS = ("GEBURTSDATUM", "GEBURTSORT", "GEBURTSLAND", "STERBEDATUM", "GESCHLECHT", "FAMILIENSTAND", "RELIGION", "BERUF", "PARTEI_KURZ", "VITA_KURZ")
TERM_PARTS = {"wp": "WP", "von": "MDBWP_VON", "bis": "MDBWP_BIS", "wkr_nr": "WKR_NUMMER", "wkr_name": "WKR_NAME", "land": "WKR_LAND", "liste": "LISTE", "mandatsart": "MANDATSART"}
HUMAN, ASSISTANT = "Human:", "Assistant:"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _first(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def reading(df: DataFrame) -> DataFrame:
    """Reading comprehension (id, title, context, question, answers: struct with text array): the first answer, and whether there is none."""
    golds = F.coalesce(F.col("answers.text"), F.array().cast("array<string>"))
    return df.select("id", _text("title").alias("title"), _text("context").alias("context"), _text("question").alias("question"), _first(golds).alias("answer"), golds.alias("all_answers"), (F.size(golds) == 0).alias("is_impossible"))


def ranked_passages(df: DataFrame) -> DataFrame:
    """Passage ranking (query_id, query, answers, wellFormedAnswers, passages): rows with an answer, and the selected passage.

    A well-formed answer goes before a short one; without a selected passage the first one stands.
    """
    empty = F.array().cast("array<string>")
    well, short = F.coalesce("wellFormedAnswers", empty), F.coalesce("answers", empty)
    texts = F.coalesce(F.col("passages.passage_text"), empty)
    marked = F.arrays_zip(texts.alias("t"), F.coalesce(F.col("passages.is_selected"), F.array().cast("array<int>")).alias("s"))
    chosen = F.get(F.filter(marked, lambda p: (p["s"] == 1) & (F.length(p["t"]) > 0)), F.lit(0))["t"]
    answer = F.when(F.size(well) > 0, _first(well)).otherwise(_first(short))
    out = df.select("query_id", _text("query").alias("query"), answer.alias("answer"), short.alias("all_answers_short"), F.coalesce(chosen, _first(texts)).alias("selected_passage"), texts.alias("all_passages"))
    return out.filter((F.col("answer") != "") & (F.col("answer") != "No Answer Present."))


def nested_reading(df: DataFrame) -> DataFrame:
    """Articles (title, paragraphs: array of context and qas) -> a row for each question, with its answers' texts."""
    paragraphs = df.select("title", F.explode("paragraphs").alias("p"))
    questions = paragraphs.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return questions.select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"), F.transform("q.answers", lambda a: a["text"]).alias("answers"))


def _seed(source: str, kind: str, user: Column, preferred: Column, rejected: Column, category: Column) -> list[Column]:
    return [F.lit(source).alias("source"), F.lit(kind).alias("kind"), user.alias("user"), preferred.alias("preferred"), rejected.alias("rejected"), category.alias("category")]


def dialogue_pairs(df: DataFrame) -> DataFrame:
    """Preference pairs (chosen, rejected: whole dialogues) -> the last request and the two replies to it."""
    c, r = _text("chosen"), _text("rejected")
    tail = F.regexp_extract(c, rf"(?s)^.*({HUMAN}.*)$", 1)
    split = F.instr(tail, ASSISTANT)
    request = F.trim(F.replace(F.substr(tail, F.lit(1), split - 1), F.lit(HUMAN), F.lit("")))
    reply = F.regexp_replace(F.substr(tail, split + len(ASSISTANT)), r"^\s+|\s+$", "")
    other = F.when(F.contains(r, F.lit(ASSISTANT)), F.regexp_replace(F.regexp_extract(r, rf"(?s)^.*{ASSISTANT}(.*)$", 1), r"^\s+|\s+$", "")).otherwise(r)
    there = split > 0
    request = F.when(there, F.regexp_replace(request, r"^\s+|\s+$", "")).otherwise("")
    return df.select(*_seed("preference_pairs", "preference", request, F.when(there, reply).otherwise(c), F.when(there, other).otherwise(r), F.lit("helpful_or_harmless")))


def message_trees(df: DataFrame) -> DataFrame:
    """Messages of trees (role prompter or assistant, text), one row each."""
    of = lambda role: F.when(F.col("role") == role, _text("text")).otherwise("")
    return df.select(*_seed("message_trees", "chat", of("prompter"), of("assistant"), F.lit(""), F.coalesce("role", F.lit("unknown"))))


def logged_chats(df: DataFrame) -> DataFrame:
    """Conversations (conversation: array of role and content, toxic, redacted) -> a row for each user turn with the reply after it."""
    turns = F.transform("conversation", lambda t, i: F.struct(t["role"].alias("role"), t["content"].alias("content"), F.get("conversation", i + 1).alias("next")))
    rows = df.select("toxic", "redacted", F.explode(F.filter(turns, lambda t: t["role"] == "user")).alias("t"))
    category = F.when(F.col("toxic"), "jailbreak").when(F.col("redacted"), "redacted").otherwise("normal")
    reply = F.when(F.col("t.next.role") == "assistant", _text("t.next.content")).otherwise("")
    return rows.select(*_seed("logged_chats", "chat", _text("t.content"), reply, F.lit(""), category))


def harmful_requests(df: DataFrame) -> DataFrame:
    """Requests to refuse (goal or behavior, target, category, any may be null)."""
    return df.select(*_seed("harmful_requests", "harmful_request", F.coalesce("goal", "behavior", F.lit("")), F.lit(""), _text("target"), F.coalesce("category", F.lit("harmful"))))


SEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {"preference_pairs": dialogue_pairs, "message_trees": message_trees, "logged_chats": logged_chats, "harmful_requests": harmful_requests}


def grounded(df: DataFrame, schema: str, key: str) -> DataFrame:
    """Records of one of three schemas as what a prompt shows of them, long bodies cut; raw_id is the source's or made from `key`."""
    or_mark = lambda c: F.coalesce(F.col(c), F.lit("?")).alias(c)
    made = lambda c, prefix: F.coalesce(F.col(c).cast("string"), F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))).alias("raw_id")
    if schema == "plenary":
        return df.select(*map(or_mark, ("wp", "sitzung", "redner", "fraktion")), F.substring(_text("text"), 1, 6000).alias("text"), made("source_url", "plenary"))
    if schema == "caselaw":
        numbers = F.array_join(F.coalesce("fileNumbers", F.array().cast("array<string>")), ", ").alias("fileNumbers")
        return df.select(*map(or_mark, ("courtType", "documentType", "decisionDate")), numbers, or_mark("ecli"), F.substring(_text("body"), 1, 8000).alias("body"), made("documentNumber", "case"))
    if schema == "politician":
        useful = [c for c in ("nachname", "vorname", "partei_kurz", "geburtsdatum", "geburtsort", "beruf", "vita_kurz", "mandate") if c in df.columns]
        return df.select(F.to_json(F.struct(*useful)).alias("record"), made("id", "pol"))
    raise ValueError(f"unknown schema {schema}")


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    """Members of parliament from XML: id, the parts of the first name, the life data, terms (array), and a text of them."""
    term = "struct<" + ", ".join(f"{t}: string" for t in TERM_PARTS.values()) + ">"
    parts = lambda names: ", ".join(f"{n}: string" for n in names)
    schema = f"ID string, NAMEN struct<NAME: array<struct<{parts(NAME_PARTS)}>>>, BIOGRAFISCHE_ANGABEN struct<{parts(LIFE_PARTS)}>, WAHLPERIODEN struct<WAHLPERIODE: array<{term}>>"
    raw = _xml(spark, path, "MDB", schema)
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    name = F.get("NAMEN.NAME", F.lit(0))
    mandates = F.transform(F.coalesce("WAHLPERIODEN.WAHLPERIODE", F.array().cast(f"array<{term}>")), lambda t: F.struct(*(tidy(t[v]).alias(k) for k, v in TERM_PARTS.items())))
    out = raw.select(tidy(F.col("ID")).alias("id"), *(tidy(name[p]).alias(p.lower()) for p in NAME_PARTS), *(tidy(F.col(f"BIOGRAFISCHE_ANGABEN.{p}")).alias(p.lower()) for p in LIFE_PARTS), mandates.alias("mandate"))
    full = F.array_join(F.filter(F.array("anrede_titel", "akad_titel", "vorname", "adel", "praefix", "nachname"), lambda p: p != ""), " ")
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), c))
    born = F.when(F.col("geburtsdatum") != "", F.concat(F.lit("Geboren: "), "geburtsdatum", F.when(F.col("geburtsort") != "", F.concat(F.lit(" in "), "geburtsort")).otherwise("")))
    terms = F.array_sort(F.array_distinct(F.filter(F.transform("mandate", lambda t: t["wp"]), lambda w: w != "")))
    told = F.when(F.col("vita_kurz") != "", F.trim(F.regexp_replace(F.regexp_replace("vita_kurz", "<[^>]*>", " "), r"\s+", " ")))
    served = F.when(F.size(terms) > 0, F.concat(F.lit("Wahlperioden: "), F.array_join(terms, ", ")))
    parts_ = [F.concat(F.lit("Politiker: "), full), line("Partei", "partei_kurz"), born, line("Beruf", "beruf"), served, told]
    return out.withColumn("text", F.array_join(F.array_compact(F.array(*parts_)), "\n"))


def speeches(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """Speeches of plenary protocols from XML: wp, sitzung, redner, fraktion, text (paragraphs, one a line), source_url."""
    paragraph = "struct<_VALUE: string, redner: struct<name: struct<titel: string, vorname: string, nachname: string, fraktion: string>>>"
    schema = f"`_wahlperiode` string, `_sitzung-nr` string, sitzungsverlauf struct<tagesordnungspunkt: array<struct<rede: array<struct<p: array<{paragraph}>>>>>>"
    raw = _xml(spark, path, "dbtplenarprotokoll", schema)
    points = raw.select(F.col("_wahlperiode").alias("wp"), F.col("`_sitzung-nr`").alias("sitzung"), F.col("_metadata.file_path").alias("source_url"), F.explode("sitzungsverlauf.tagesordnungspunkt").alias("t"))
    talks = points.select("wp", "sitzung", "source_url", F.explode("t.rede").alias("r"))
    name = F.get(F.filter(F.transform("r.p", lambda p: p["redner"]["name"]), lambda n: n.isNotNull()), F.lit(0))
    speaker = F.when(name.isNull(), "Unbekannt").otherwise(F.array_join(F.filter(F.array(*(F.coalesce(name[c], F.lit("")) for c in ("titel", "vorname", "nachname"))), lambda v: v != ""), " "))
    lines = F.filter(F.transform("r.p", lambda p: F.trim(F.coalesce(p["_VALUE"], F.lit("")))), lambda v: v != "")
    out = talks.select(F.coalesce("wp", F.lit("?")).alias("wp"), F.coalesce("sitzung", F.lit("?")).alias("sitzung"), speaker.alias("redner"), F.coalesce(name["fraktion"], F.lit("")).alias("fraktion"), F.array_join(lines, "\n").alias("text"), "source_url")
    return out.filter(F.length("text") >= least)
