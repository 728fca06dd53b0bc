"""BM25 retrieval: postings, document lengths, top k by an aggregation over the query's postings only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.contains import WORD

K1, B = 1.2, 0.75

# Words of questions, acronyms and marks of pages that only point to others.
STOP = (
    "was ist eine ein einen der die das wer wie wo wann warum welche welcher welches mir mich du kannst ueber über sagen erklaere erkläre kurz nenne sind "
    "den dem des von im in zu und mit auf fuer für etwas mal bitte"
).split()
QUESTION_WORDS = "was wer wie wo wann warum welche welcher welches nenne schreibe erklaere erklre gib liste zeige kannst ist sind hallo hi hey moin danke ja nein ok bitte rechne".split()
ACRONYMS = "gpu cpu ram vram ai ki llm api ssd hdd os url sql usb ip dns".split()
POINTERS = (
    "steht für", "begriffsklärung", "ist der familienname", "ist der name mehrerer", "ist der name folgender", "ist der name von", "bezeichnet:", "ist eine ortsbezeichnung",
    "kann sich beziehen", "ist eine liste", "ist eine begriffsklärung", "bezeichnet mehrere",
)
POINTER_TITLES = ("Begriffsklärung", "(Familienname)")


def _capital(word: Column) -> Column:
    """An acronym in capitals, any other word with its first letter so."""
    return F.when(F.lower(word).isin(*ACRONYMS), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))))


def title_candidates(question: Column | str) -> Column:
    """Titles that a question may ask for: each of its words that is no question word, and all of them together."""
    words = F.filter(F.regexp_extract_all(question, F.lit(WORD), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP) & (F.length(w) > 1))
    each = F.transform(words, _capital)
    return F.when(F.size(words) > 1, F.concat(each, F.array(F.array_join(each, " ")))).otherwise(each)


def is_bare(text: Column | str) -> Column:
    """Whether a message is one to three words that are neither a sentence nor a question or command."""
    s = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    words = F.split(s, r"\s+")
    return (s != "") & ~s.rlike(r"[?.\n,\p{Nd}]") & (F.size(words) <= 3) & ~F.regexp_replace(F.lower(F.get(words, F.lit(0))), ":+$", "").isin(*QUESTION_WORDS)


def rewritten(text: Column | str) -> Column:
    """A bare message as a question, any other as it is."""
    own = F.col(text) if isinstance(text, str) else text
    words = F.split(F.trim(own), r"\s+")
    named = F.transform(words, lambda w, i: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).when(i == 0, _capital(w)).otherwise(w))
    return F.when(is_bare(own), F.concat(F.lit("Was ist "), F.array_join(named, " "), F.lit("?"))).otherwise(own)


def no_pointer(title: Column | str, intro: Column | str) -> Column:
    """Whether a page is more than a list of other pages of its name."""
    own = F.col(title) if isinstance(title, str) else title
    head = F.lower(F.substring(intro, 1, 130))
    bad = F.lit(False)
    for t in POINTER_TITLES:
        bad = bad | F.contains(own, F.lit(t))
    for p in POINTERS:
        bad = bad | F.contains(head, F.lit(p))
    return ~bad


def titles(pages: DataFrame) -> DataFrame:
    """The exact-title table (key in lower case, title, intro) of pages; of equal titles the first by order of title and intro."""
    return pages.groupBy(F.lower("title").alias("key")).agg(F.min(F.struct("title", "intro")).alias("p")).select("key", "p.title", "p.intro")


def aliases(pages: DataFrame, redirects: DataFrame, known: DataFrame) -> DataFrame:
    """alias (lower case) and target of redirect pages (page_id, namespace, title, is_redirect) and redirects (rd_from, namespace, target).

    Only aliases of articles whose target is a known title and another word.
    """
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    from_ = pages.filter("namespace = 0 AND is_redirect").select(F.col("page_id").alias("rd_from"), plain("title").alias("alias"))
    to = redirects.filter("namespace = 0").select("rd_from", plain("target").alias("target"))
    pairs = from_.join(to, "rd_from").groupBy("alias").agg(F.max("target").alias("target"))
    own = pairs.join(known.select(F.col("title").alias("target")), "target", "left_semi")
    return own.select(F.lower("alias").alias("alias"), "target").filter("alias <> lower(target)").distinct()


def by_title(questions: DataFrame, known: DataFrame, alias_table: DataFrame, k: int = 3, query: str = "item_id", text: str = "text") -> DataFrame:
    """(query, title, intro, rank): pages whose title, or an alias of it, a question names, in the order of its candidates."""
    asked = questions.select(query, F.posexplode(title_candidates(text)).alias("pos", "name")).withColumn("alias", F.lower("name"))
    target = asked.join(alias_table.groupBy("alias").agg(F.min("target").alias("target")), "alias", "left").select(query, "pos", F.lower(F.coalesce("target", "name")).alias("key"))
    got = target.join(known, "key").filter(no_pointer("title", "intro")).groupBy(query, "title", "intro").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(query).orderBy("pos")  # a question's candidates
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pos")


def with_fallback(questions: DataFrame, exact: DataFrame, fallback: DataFrame, query: str = "item_id") -> DataFrame:
    """Exact hits where a question has any, else those of the fallback search."""
    rest = fallback.join(exact.select(query).distinct(), query, "left_anti")
    return exact.unionByName(rest, allowMissingColumns=True).join(questions.select(query), query, "left_semi")


def terms(text: Column | str) -> Column:
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf, dl: terms of the document) and statistics (one row: n, mean)."""
    t = docs.select(key, terms(text).alias("t")).withColumn("dl", F.size("t"))
    postings = t.select(key, "dl", F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return postings, t.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))


#: Distinct terms of all queries that may be broadcast (a term and a number each).
ASKED = 500_000


def search(queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int, query: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query, key, score, rank): any of the query's distinct terms counts.

    Postings carry their document's length, so that only partial scores of asked terms are shuffled, summed map-side.
    """
    q = queries.select(query, F.explode(F.array_distinct(terms(text))).alias("term"))
    words = q.select("term").distinct()
    few = words.limit(ASKED + 1).count() <= ASKED
    asked = postings.join(F.broadcast(words) if few else words, "term", "left_semi")
    s = stats.first()  # one row
    n, mean = float(s["n"]), float(s["mean"] or 1.0)
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = q.join(F.broadcast(idf) if few else idf, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    scores = postings.join(F.broadcast(weighted) if few and q.limit(ASKED + 1).count() <= ASKED else weighted, "term").groupBy(query, key).agg(F.sum(part).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
