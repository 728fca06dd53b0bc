"""Reject policies: ordered conditions of which the first that holds names the reason; and flag lists.

A policy is a list of steps over a column `text`. `reason` is null for rows that stay. `apply` adds it, `report` counts
documents and bytes by reason (the manifest of a run), `samples` keeps the first few rejected rows of each reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import normalise as nz
from weir.functions.exprs import E, Steps

# Phrases and patterns that decide results.
BOILERPLATE = (
    "cookie policy", "privacy policy", "accept all cookies", "subscribe to our newsletter", "all rights reserved", "sign in to continue", "javascript is disabled",
    "diese website verwendet cookies", "wir verwenden cookies", "cookies akzeptieren", "alle cookies akzeptieren", "alle rechte vorbehalten", "newsletter abonnieren",
    "javascript ist deaktiviert", "bitte aktivieren sie javascript", "in den warenkorb", "zur kasse", "passwort vergessen", "anmelden oder registrieren",
)
MOJIBAKE = ("â€™", "â€œ", "â€", "Ã¼", "Ã¶", "Ã¤", "Â ")
PROTECTED = ("<|code|>", "<|endcode|>", "<filename>", "<file_sep>", "<|file|>")
LENGTHS = {"english": (200, 100_000), "german": (300, 100_000), "code": (10, 30_000)}
CHAT = r"<\|(?:system|user|assistant|end|im_start|im_end)\|>|###\s*(?:Aufgabe|Antwort):"
HTML = r"<\s*/?\s*(?:html|body|div|script|style|a|span|table|iframe|form|nav|footer)\b"
BAD = r"(cookie policy|privacy policy|accept all cookies|javascript is disabled|_end_of_the_data|user-data|<\|im_start\|>|<\|im_end\|>|sign in to continue|subscribe to our newsletter)"
WEB = r"(zwei klicks f(?:ü|u)r mehr datenschutz|teilen-button|verfassen sie die erste bewertung|erste bewertung verfassen|bewertung verfassen|newsletter abonnieren|cookie-einstellungen|alle preise inkl|gratis versand|jetzt kaufen|in den warenkorb|warenkorb|lieferzeit|weiterlesen\s+[A-ZÄÖÜ0-9]|read more|facebook,\s*google\+|twitter senden|bitte f(?:ü|u)llen sie .*formular|kein rechtsanspruch)"
COMMERCIAL = r"(about us|ueber uns|über uns|impressum|kontaktformular|agb|allgemeine geschaeftsbedingungen|allgemeine geschäftsbedingungen|datenschutzerklaerung|datenschutzerklärung|versandkosten|versand und zahlung|lieferung und zahlung|preisvergleich|rabattcode|gutschein|warenkorb|checkout|produktbeschreibung|kunden kauften auch|trusted shops|bewertungen? schreiben|erotik,\s*wohlbefinden|wellness,\s*partnerschaft|singleboerse|singlebörse)"
ADULT = r"(online casino|casino bonus|slot machine|sportwetten|porn(?:o|hub)?|xxx|sexkontakte|escort|cams? live|nackte|erotik\s+chat|onlyfans|bitcoin casino|krypto casino|no deposit bonus|free spins|jackpot|roulette|blackjack)"
OLDPRINT = r"(\bthun|\bthats(?:a|ä)ch|\bth(?:e|a)il|\bselb(?:st|ige)n?\b|\bverh(?:a|ä)ltni|\bge\s+stellt|\bbe\s+stimm|\bent\s+sch|\bver\s+fahr|\bVerzeichni(?:ß|ss)\b|\bUeber\b|\bGesetzsammlung\b|\bAmtsblatt\b|\bAbtheilung\b|\bCivilproze(?:ß|ss)\b|\bVerwaltungsgericht|[□�]|Å¿)"
HYPHEN_BREAK = r"\b[A-Za-zÄÖÜäöüß]{2,}-\s+[A-Za-zÄÖÜäöüß]{2,}\b"
SPACED_WORD = r"\b[A-Za-zÄÖÜäöüß]{2,}\s+[A-Za-zÄÖÜäöüß]{1,3}\s+[A-Za-zÄÖÜäöüß]{2,}\b"
SPEAKER = r"[A-ZÄÖÜ][A-ZÄÖÜ]{2,}(?:\s+[A-ZÄÖÜ][A-ZÄÖÜ]{2,}){0,2}"
LETTERS = "[A-Za-zÄÖÜäöüß]"
MATH = r"\\\[|\\\(|\b(problem|solution|theorem|lemma|proof|beweis)\b|[=+\-*/^]{3,}"
MIX_HTML = r"<\s*/?\s*(?:html|body|div|script|style|table|iframe|a)\b|&(?:amp|gt|lt|quot|#x?[0-9a-f]+);"
MIX_BAD = r"erotik\s+(?:chat|kontakte|shop)|erotik,\s*wohlbefinden|porn|xxx|warenkorb|checkout|rabattcode|gutschein|trusted shops|all rights reserved|cookie policy|privacy policy"
WIKI_TALK = r"\b(?:nicht signierter beitrag|ce[st]\)|wikipedia:|qs-baustein|redaktion[_ ]|diskussion:|benutzer:|--\s*[A-Za-zÄÖÜäöüß0-9_-])"
TABLE = r"\|\s*[-:]+\s*\||\{\||\|\}|^\s*\|"
INDEX = r"\b(?:kategorie:|liste der|personen nach|artikel des tages|portal:)\b|\.{3,}\s*\d{1,5}"
LISTED = r"(^|\s)(?:[-*•]|\d{1,3}[.)])\s+|[|]{2,}|\t"
GUTENBERG = r"project gutenberg|gutenberg\.org|gutenberg etext|gutenberg ebook|gutenberg-tm|electronic work|etext\s+#|ebook\s+#|distributed proofreading|produced by|prepared by volunteers|transcriber'?s note|transcriber's notes|proofreaders|start of (?:the|this) project gutenberg|end of (?:the|this) project gutenberg|full project gutenberg license|project gutenberg literary archive"
LICENSE = r"copyright|all rights reserved|terms of use|permission is granted|redistribution|public domain|creative commons|license|licence|without warranty|limited warranty|trademark|royalties|foundation|donations?|tax deductible"
FRONT_BACK = r"^(\s*)(title page|half-title|preface|foreword|introduction|publisher'?s note|editor'?s note|author'?s note|dedication|acknowledg(e)?ments|contents|table of contents|inhaltsverzeichnis|inhalt|list of illustrations|list of plates|errata|bibliography|index|appendix|glossary|notes?|footnotes?)\b"
BOOK_TOC = r"\b(contents|table of contents|inhaltsverzeichnis|inhalt|list of illustrations|list of plates)\b"
BOOK_INDEX = r"\b(index|general index|name index|subject index|register|glossary)\b"
PAGE_REF = r"(\bpage\s+\d{1,4}\b|\bp\.\s*\d{1,4}\b|\.{3,}\s*\d{1,4}\b|\[\s*page\s+\d{1,4}\s*\])"
CHAPTER_PAGE = r"\b(chapter|kapitel)\s+[ivxlcdm\d]+\b.{0,80}\b(page|seite)\b"
BOOK_MOJIBAKE = "Ã.|Â.|�|â€|ï¬"
SECRETS = {
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b",
    "generic_token": r"(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[:=]\s*['\"][^'\"\s]{12,}['\"]",
}
GENERATED = r"\b(auto[- ]?generated|generated by|do not edit|compiled from|webpackBootstrap|minified|sourceMappingURL|protobuf generated|eslint-disable)\b"
NOTEBOOK = r'"cells"\s*:\s*\[|"nbformat"\s*:'
CODE_HTML = r"</?(html|body|div|script|style|span|table)\b|&(?:nbsp|lt|gt|amp);"
LOG = r"\b(traceback \(most recent call last\)|exception in thread|stack trace|error:|warning:)\b"
TODO = r"\b(todo|fixme|hack|xxx)\b"
VENDOR = r"(?im)^<filename>(.*/)?(node_modules|vendor|dist|build|third_party|externals|site-packages)(/.*)?$"
CODE_LICENSE = r"\b(mit license|apache license|gnu general public license|copyright)\b"
T = x.col("text")


@dataclass(frozen=True)
class Policy:
    """Steps that end in a column `reason`, or `flags` for policies that name all conditions."""

    name: str
    steps: Steps


def first(*pairs: tuple[E, str]) -> E:
    return x.case(*pairs)


def quality(language: str) -> Policy:
    """General quality filter; protected markers skip all but the upper length bound."""
    least, most = LENGTHS[language]
    n = x.col("norm")
    norm = nz.code_text(T) if language == "code" else nz.clean_text(T)
    protected = None
    for p in PROTECTED:
        at = x.two("startswith({}, {})", "starts_with({}, {})", n, p)
        protected = at if protected is None else protected | at
    steps = Steps().add(norm=norm).add(toks=x.spaced(n), low=x.lower(n))
    reason = first(
        (protected & (x.length(n) > most), "too_long"),
        (x.length(n) < least, "too_short"),
        (x.length(n) > most, "too_long"),
        (x.contains_any(x.col("low"), BOILERPLATE), "boilerplate"),
        (m.url_density(x.col("toks")) > 0.20, "url_dense"),
        (m.symbol_density(n) > 0.35, "symbol_dense"),
        (m.repetition(x.col("toks")) > 0.60, "repetitive"),
        (x.contains_any(n, MOJIBAKE), "mojibake"),
    )
    return Policy(f"quality_{language}", steps.add(reason=x.case((protected & (x.length(n) <= most), E("NULL", "NULL")), otherwise=reason)))


def speaker_labels(t: E) -> E:
    """Words in capitals before a full stop that do not end a longer word."""
    return x.apart(t, LETTERS, SPEAKER, ".")


def language_ok(language: str) -> Steps:
    """ok: enough function words of the language in the first 10,000 code points. Needs `norm`."""
    steps = Steps().add(sample_words=x.found(nz.ascii_fold(x.left(x.col("norm"), 10_000)), m.WORD), umlauts=m.umlauts(x.col("norm")))
    steps = steps.add(de_hits=x.among(x.col("sample_words"), m.DE_WORDS), en_hits=x.among(x.col("sample_words"), m.EN_WORDS))
    de, en = x.col("de_hits"), x.col("en_hits")
    if language == "german":
        ok = (x.both("({} >= 6)", de) & (de >= en * 1.1)) | ((x.col("umlauts") >= 2) & (de >= en))
    elif language == "english":
        ok = (en >= 6) & (en >= de * 1.1)
    else:
        ok = x.both("true")
    return steps.add(lang_ok=x.case((x.size(x.col("sample_words")) < 30, language not in ("german", "english")), otherwise=ok))


def strict(language: str, profile: str = "prose", structure: bool = True, drops: bool = True, least: int | None = None, most: int | None = None) -> Policy:
    """The strict filter: basic checks, structural checks by profile, and the language last."""
    if least is None:
        least = {"booster": 40, "math": 80}.get(profile, {"german": 240, "english": 180, "code": 8}.get(language, 180))
    n = x.col("norm")
    head = x.left(n, 20_000)
    steps = Steps().add(norm=nz.strict_text(T)).add(fold=m.folded_words(n))
    steps = steps.add(toc=x.hits(n, m.TOC, True), biblio=x.hits(n, m.BIBLIO, True), ocr=x.hits(n, m.OCR, True), listed=m.list_score(n), names=x.hits(head, m.NAMES), years=x.hits(head, m.YEARS), speakers=speaker_labels(head), ngram=m.gram_repetition("fold", 4, 16), digit=m.digit_density(n))
    toc, listed, ngram = x.col("toc"), x.col("listed"), x.col("ngram")
    structural: list[tuple[E, str]] = [(x.has(n, CHAT, True), "chat_marker")]
    if profile == "math":
        structural += [((toc >= 2) & ~x.has(n, MATH, True), "toc_or_index"), (x.col("biblio") >= 4, "bibliography_or_metadata"), (ngram > 0.28, "repetitive_ngram")]
    elif profile == "code":
        structural += [(toc >= 2, "toc_or_index"), (ngram > 0.28, "repetitive_ngram")]
    elif profile == "prose":
        structural.append(((toc >= 2) | ((toc >= 1) & (listed >= 4)), "toc_or_index"))
        if drops:
            old = x.hits(head, OLDPRINT, True) + x.least(x.hits(head, HYPHEN_BREAK), 6) + x.least(x.two("CAST({} / 8 AS INT)", "({} // 8)", x.hits(head, SPACED_WORD)), 6)
            structural += [(x.has(n, WEB, True), "web_boilerplate"), (x.has(n, COMMERCIAL, True), "commercial_boilerplate"), (x.has(n, ADULT, True), "adult_or_gambling_spam"), (old >= 8, "old_ocr_or_fraktur")]
        structural += [
            (x.col("biblio") >= 3, "bibliography_or_metadata"),
            (x.col("ocr") >= 2, "ocr_scan_hint"),
            ((x.size(x.col("speakers")) >= 18) & (x.size(x.distinct(x.col("speakers"))) <= 12), "dialogue_script"),
            (listed >= 8, "list_or_table_heavy"),
            ((x.col("names") >= 30) | ((x.col("years") >= 10) & (x.occurrences(n, ",") >= 10)), "name_catalogue"),
            (x.col("digit") > 0.16, "digit_dense"),
            (ngram > 0.28, "repetitive_ngram"),
        ]
    steps = steps.add(structural=first(*structural) if structure else E("CAST(NULL AS STRING)", "NULL::VARCHAR"))
    steps = Steps([*steps.steps, *language_ok(language).steps])
    s = x.col("structural")
    pairs = [
        (x.length(n) < least, "too_short"),
        (x.length(n) > (80_000 if most is None else most), "too_long"),
        (x.both("({} IN ('chat_marker', 'toc_or_index', 'name_catalogue'))", s), s),
        (m.mojibake_score(n) > 0, "mojibake"),
        (x.has(n, HTML, True), "html"),
        (x.has(n, BAD, True), "boilerplate"),
        (x.hits(n, m.URL, True) > 1, "url_dense"),
        *([(m.alpha_density(n) < 0.45, "low_alpha")] if language != "code" else []),
        (m.symbol_density(n) > 0.28, "symbol_dense"),
        (m.repetition(x.col("fold"), 50) > 0.62, "repetitive"),
        (x.both("({} IS NOT NULL)", s), s),
        *([(~x.col("lang_ok"), "language_mismatch")] if profile != "booster" else []),
    ]
    return Policy(f"strict_{language}_{profile}", steps.add(reason=first(*pairs)))


def mix(max_urls: int = 0, drop_wiki: bool = True, drop_tables: bool = True, min_tokens: int = 64, tokens: str = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]") -> Policy:
    """Pretraining-mix filter with token-count gates (tokens by a declared pattern)."""
    n = x.col("norm")
    broken = x.two("({0} RLIKE '^[a-zäöüß]' AND NOT {0} RLIKE '[.!?:)\\\\]\"”]$')", "(regexp_matches({0}, '^[a-zäöüß]') AND NOT regexp_matches({0}, '[.!?:)\\]\"”]$'))", n)
    steps = Steps().add(norm=nz.doc_text(T)).add(n_tokens=x.hits(n, tokens) + 1, listed=x.has(n, LISTED), broken=broken)
    pairs = [
        (x.length(n) < 90, "too_short"),
        (x.has(n, CHAT, True), "chat_marker"),
        (x.has(n, MIX_HTML, True), "html_or_entity"),
        (x.has(n, MIX_BAD, True), "bad_marker"),
        (x.hits(n, m.URL, True) > max_urls, "url_dense"),
        *([(x.has(n, WIKI_TALK, True), "wiki_talk")] if drop_wiki else []),
        *([(x.has(n, TABLE, True) | x.has(n, INDEX, True), "table_or_index")] if drop_tables else []),
        (m.alpha_density(n) < 0.32, "low_alpha"),
        ((x.col("n_tokens") < 96) & x.col("listed"), "short_list_like"),
        ((x.col("n_tokens") < 96) & x.col("broken"), "short_broken_sentence"),
        (x.col("n_tokens") < min_tokens, "too_few_tokens"),
    ]
    return Policy("mix", steps.add(reason=first(*pairs)))


def early_mix() -> Policy:
    n = x.col("norm")
    return Policy("early_mix", Steps().add(norm=nz.doc_text(T)).add(reason=first((x.length(n) < 80, "too_short"), (x.has(n, CHAT, True), "chat_marker"), (x.has(n, MIX_HTML, True), "html_or_entity"), (x.has(n, MIX_BAD, True), "bad_marker"), (m.alpha_density(n) < 0.30, "low_alpha"))))


def candidate(least: int = 180, most: int = 30_000, words: int = 40, urls: int = 0) -> Policy:
    n = x.col("norm")
    return Policy("candidate", Steps().add(norm=nz.paragraph_text(T)).add(reason=first((x.length(n) < least, "too_short"), (x.length(n) > most, "too_long"), (x.has(n, MIX_BAD, True), "bad_marker"), (x.has(n, CHAT, True), "chat_marker"), (x.has(n, MIX_HTML, True), "html_or_entity"), (x.hits(n, m.URL, True) > urls, "url_dense"), (x.size(m.words(n)) < words, "too_few_words"), (m.alpha_density(n) < 0.32, "low_alpha"))))


def book(title: str | None = None) -> Policy:
    n = x.col("norm")
    head = x.lower(x.left(n, 2500))
    words = x.found(n, "[A-Za-z][A-Za-z'-]+")
    caps = x.found(x.left(n, 3000), "[A-Za-z][A-Za-z'-]+")
    steps = Steps().add(norm=nz.clean_text(nz.unix_lines(T))).add(low=head, ws=words, caps=caps)
    lowered = x.two("transform({}, w -> lower(w))", "list_transform({}, lambda w: lower(w))", x.col("ws"))
    big = x.two("size(filter({}, w -> length(w) >= 4 AND upper(w) = w))", "len(list_filter({}, lambda w: length(w) >= 4 AND upper(w) = w))", x.col("caps"))
    low = x.col("low")
    pairs = [
        (x.length(n) < 700, "too_short"),
        (x.has(n, BOOK_MOJIBAKE), "mojibake"),
        (x.has(n, m.URL, True), "url"),
        (x.has(n, GUTENBERG, True), "gutenberg_boilerplate"),
        (x.has(low, LICENSE) & (x.contains(low, "project gutenberg") | x.contains(low, "redistribution")), "license_block"),
        (x.has(low, LICENSE) & (x.length(n) < 2500), "license_short"),
        (x.has(x.left(n, 400), FRONT_BACK, True), "front_back_matter"),
        (x.has(low, BOOK_TOC) & (x.has(low, PAGE_REF) | x.has(low, CHAPTER_PAGE)), "table_of_contents"),
        (x.has(x.left(n, 800), BOOK_INDEX, True) & (x.has(n, PAGE_REF, True) | (_listish(n) > 0.45)), "index_glossary"),
        (x.has(x.left(n, 2000), PAGE_REF, True) & (_listish(x.left(n, 3000)) > 0.40), "page_list"),
        (x.share(big, x.size(x.col("caps"))) > 0.28, "all_caps"),
        (m.alpha_density(n) < 0.52, "low_alpha"),
        (x.size(x.col("ws")) < 120, "too_few_words"),
        (x.share(x.size(x.distinct(lowered)), x.size(x.col("ws"))) < 0.16, "repetitive"),
    ]
    return Policy("book", steps.add(reason=first(*pairs)))


def _listish(t: E) -> E:
    parts = x.two("split({}, '[.;]\\\\s+|\\\\n+')", "string_split_regex({}, '[.;]\\s+|\\n+')", t)
    short = x.two("size(filter({}, p -> p RLIKE '^\\\\s*(\\\\S+\\\\s*)$|^\\\\s*\\\\S+(\\\\s+\\\\S+){{1,6}}\\\\s*$'))", "len(list_filter({}, lambda p: regexp_matches(p, '^\\s*(\\S+\\s*)$|^\\s*\\S+(\\s+\\S+){{1,6}}\\s*$')))", parts)
    return x.share(short, x.size(parts))


def code(least: int = 80, audit: bool = False) -> Policy:
    """Flags of a code document; the audit adds a license flag and has its own bounds."""
    n_lines = x.occurrences(T, "\n") + 1
    steps = Steps().add(n_lines=n_lines, long_lines=m.long_lines(T), mean_line=m.mean_line(T))
    body = x.two("filter(split(text, '\\n'), l -> trim(l) <> '' AND NOT l RLIKE '^(<filename>|<reponame>)' AND NOT trim(l) LIKE '#%')", "list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '^(<filename>|<reponame>)') AND NOT trim(l) LIKE '#%')")
    imports = x.two("(size({0}) > 0 AND forall({0}, l -> trim(l) RLIKE '^(import |from |__all__)'))", "(len({0}) > 0 AND len(list_filter({0}, lambda l: NOT regexp_matches(trim(l), '^(import |from |__all__)'))) = 0)", body)
    many = x.two("greatest(3, CAST({} * 0.2D AS INT))", "greatest(3, CAST(floor({} * 0.2::DOUBLE) AS INT))", x.col("n_lines")) if not audit else x.two("greatest(3, CAST(ceil({} * 0.2D) AS INT))", "greatest(3, CAST(ceil({} * 0.2::DOUBLE) AS INT))", x.col("n_lines"))
    pairs = [
        (x.length(T) < least, "too_short_fragment" if audit else "too_short"),
        *([] if audit else [(imports, "import_only")]),
        (x.length(T) > (80_000 if audit else 60_000), "too_long_file" if audit else "too_long"),
        (x.contains(T, "�"), "replacement_chars"),
        (x.has(T, nz.CONTROL), "control_chars"),
        ((x.col("n_lines") <= 2) & (x.length(T) > 800), "collapsed_or_minified"),
        ((x.col("long_lines") >= many) | (x.col("mean_line") > 180), "long_line_dense"),
        (x.has(T, GENERATED, True), "generated_or_compiled"),
        (x.has(T, NOTEBOOK), "notebook_json"),
        (x.has(T, CODE_HTML, True), "html_embedded"),
        (x.has(T, LOG, True), "log_or_traceback"),
        (x.hits(T, m.URL) >= (3 if audit else 4), "url_dense"),
        *([(x.has(T, CODE_LICENSE, True) & (x.length(T) < 5000), "license_boilerplate")] if audit else []),
        (x.hits(T, TODO, True) >= 8, "todo_dense"),
        (x.has(T, VENDOR), "vendor_or_dependency_path"),
        *[(x.has(T, p), f"possible_secret_{k}") for k, p in SECRETS.items()],
    ]
    return Policy("code_audit" if audit else "code", steps.add(flags=x.flags(*pairs)))


def apply(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """`df` with the policy's reason (or flags); the helper columns are dropped."""
    out = "flags" if "flags" in policy.steps.steps[-1] else "reason"
    extra = [c for step in policy.steps.steps for c in step if c != out]
    renamed = df if text == "text" else df.withColumn("text", F.col(text))
    return policy.steps.spark(renamed).drop(*extra)


def report(df: DataFrame, policy: Policy, *by: str) -> DataFrame:
    """Documents and bytes by reason ('kept' where nothing is against them)."""
    return apply(df, policy).groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"))


def samples(df: DataFrame, policy: Policy, k: int, key: str = "doc_id", *by: str) -> DataFrame:
    """The first k rejected rows of each reason, by key."""
    w = Window.partitionBy(*by, "reason").orderBy(key)
    return apply(df, policy).filter(F.col("reason").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
