"""Classifiers and document vectors as steps of expressions. Each ends in the named column."""

from __future__ import annotations

from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import normalise as nz
from weir.functions.exprs import E, Steps
from weir.operators import policies as p

# Markers and patterns that decide results.
DE_MARKERS = " der | die | das | und | ist | nicht | sich | wird | mit | auf | den | für | eine | auch | von | im | zu ".split("|")
EN_MARKERS = " the | and | of | is | that | to | a | in | for | with | on | was | it | be | as | at | by ".split("|")
DOMAIN_MATH = r"\b(?:mathematik|problem:|loesung:|lösung:|beweis|theorem|lemma|integral|gleichung)\b|[=+\-*/^]{4,}"
DOMAIN_CODE = r"\b(?:def|class|import|return|function|const|let|var|public static|#include)\b|[{};]{4,}"
DOMAIN_QA = r"\b(?:frage:|antwort:|question:|answer:|instruction:|response:)\b"
GERMAN = r"\b(?:der|die|das|und|ist|nicht|eine|einer|mit|für|ueber|über|werden|wurde)\b|[äöüÄÖÜß]"
ENGLISH = r"\b(?:the|and|that|with|this|from|were|would|should|because|there)\b"
DOMAIN_CHAT = r"<\|(?:im_start|im_end|endoftext|user|assistant|system)\|>|_end_of_the_data|</?think>"
ADULT_CASINO = r"\b(?:onlyfans|porn|xxx|casino|jackpot|free spins|sportwetten|sexkontakte)\b"
SHOP = r"\b(?:warenkorb|checkout|rabattcode|gutschein|trusted shops|lieferzeit|versandkosten)\b"
SHORT_TOC = r"\b(?:inhaltsverzeichnis|table of contents|seite|page)\b|\.{3,}\s*\d{1,5}"
SHORT_OCR = r"Ã.|�|Å¿|\b[a-zA-ZÄÖÜäöüß](?:\s+[a-zA-ZÄÖÜäöüß]){4,}\b"
TRIAGE_URL = r"https?://|www\.|\.com\b|\.de\b|\.org\b"
TRIAGE_HTML = r"<\s*/?\s*(html|body|div|span|script|style|table|a|p|br|iframe)\b"
TRIAGE_MOJIBAKE = "Ã.|Â.|â€|�|ï¿½"
TRIAGE_BOILER = "cookie|privacy policy|javascript|newsletter|subscribe|sign in|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung"
TRIAGE_BIBLIO = r"\b(verlag|druck|druckerei|isbn|doi:|journal|vol\.|volume|chapter|herausgegeben|published by|copyright|all rights reserved|bibliothek)\b"
TRIAGE_TOC = r"\b(contents?|inhaltsverzeichnis|table of contents|page|seite)\b|(^|\s)([ivxlcdm]{1,8}|\d{1,4})\s+[.\-–—]+\s+\d{1,5}(\s|$)|(\.{3,}|…{2,})\s*\d{1,5}(\s|$)"
TRIAGE_CODE = r"\b(def|class|import|return|function|const|let|var|public static|#include)\b|[{};]{3,}"
TRIAGE_MATH = r"\\\[|\\\(|\b(theorem|lemma|proof|beweis|gleichung|integral|matrix)\b|[=+\-*/^]{3,}"
SEED_CODE = r"<\|code\|>|def \w+\(|function \w+\(|class \w+[:\(]|import \w+|```"
SEED_DATES = r"\b(19|20)\d{2}\b|\b\d{1,2}\.\s?(Jan|Feb|März|April|Mai|Juni|Juli|Aug|Sep|Okt|Nov|Dez|January|February|March|April|May|June|July|August|September|October|November|December)\b"
SEED_CITATION = r"\[\d+\]|\(\w+,?\s*\d{4}\)|et al\.|doi:|ISBN"
SEED_ORDERS_DE = r"\b(Schritt|Zuerst|Dann|Anschließend|Nun|Als erstes|Folge|Gib|Schreib|Führe aus)\b"
SEED_ORDERS_EN = r"\b(Step \d|First,|Then,|Next,|Finally,|Run|Execute|Type|Enter|Click)\b"
SEED_OPINION = r"\b(I think|I believe|in my opinion|meiner Meinung nach|ich glaube|ich denke|arguably|I'd say)\b"
SEED_NUMERIC = r"\b\d+(\.\d+)?\s?(%|km|kg|€|\$|°C|W/m)"
FRAGMENT = r"(?:_end_of_the_data|_user-data|<\|im_start\|>|<\|im_end\|>|javascript is disabled|accept all cookies|cookie policy|privacy policy|all rights reserved|subscribe to our newsletter|sign in to continue|\bnewsletter\b|advertisement|anzeige)"
SAFETY = {
    "HN-1": r"\bcsam\b|\bchild\s+pornography\b|\b(child|children|kid|kids|minor|minors|teen|teens|preteen|underage)\b[^.\n]{0,80}\b(sex|sexual|porn|nude|nudes|naked|rape|grooming)\b",
    "HN-2": r"\b(synthesi[sz]e|cook|make|produce|manufacture|brew|create|build|construct|prepare)\b[^.\n]{0,120}\b(sarin|vx|tabun|soman|nerve\s+agent|mustard\s+gas|chlorine\s+gas|phosgene|ricin|anthrax|smallpox|botulinum|nuclear\s+(bomb|weapon|device)|dirty\s+bomb|atomic\s+bomb|enriched\s+uranium|plutonium\s+core)\b",
    "HN-3": r"\b(kill|murder|assassinate|shoot|stab|bomb|attack|poison|harm|hurt)\b[^.\n]{0,40}\b(my\s+(neighbor|teacher|boss|coworker|wife|husband|partner|ex|family))\b",
    "HN-4": r"\bdox(x|xed|xing)\b|\b(find|get|give\s+me|tell\s+me|look\s+up|locate)\b[^.\n]{0,60}\b(home\s+address|personal\s+phone|private\s+phone|home\s+phone|ssn|social\s+security|credit\s+card|password)\b[^.\n]{0,80}\b(of|for|belonging\s+to)\b",
    "HN-5": r"\b(write|generate|give\s+me|provide|create)\b[^.\n]{0,40}\b(working|complete|full|ready[- ]to[- ](deploy|use|run)|production[- ]ready|deployable)\b[^.\n]{0,60}\b(ransomware|trojan|rat|keylogger|stealer|backdoor|rootkit|botnet|c2|command\s+and\s+control|exploit\s+kit|phishing\s+(kit|page))\b",
}
SOFT = r"\b(drug|drugs|cocaine|heroin|meth|mdma|lsd|psilocybin|fentanyl|hack|hacking|exploit|vulnerability|bypass|crack|pirate|piracy|weapon|gun|rifle|pistol|firearm|ammunition|self[- ]harm|suicide|overdose|abortion|euthanasia|assisted\s+suicide|holocaust|nazi|stalin|gulag|jailbreak|prompt\s+injection|ignore\s+(previous|prior)\s+(instructions|rules)|DAN\s+mode)\b"
ROUTE_MATH = r"\d[\d.,]*\s*(\*|x|×|·|/|:|\+|mal|geteilt|plus|minus|hoch|durch)\s*\d|^(rechne|berechne)|wie viel ist|wieviel ist"
ROUTE_CODE = "schreibe eine funktion|schreib eine funktion|python-funktion|funktion die|programmiere|schreibe code|schreib code"
ROUTE_WEB = r"aktuell|heute|derzeit|momentan|neueste|jüngste|dieses jahr|gerade |\b20(1[5-9]|2[0-9])\b"
ROUTE_RAG = r"^(was ist|was sind|wer ist|wer war|wer sind|wer hat|erklaer|erkläre|was bedeutet|wie funktioniert|wie viele|wo liegt|wo ist|welche|welcher|welches|definiere)\b"
COMMERCE = r"\b(warenkorb|rabatt|gutschein|checkout|kaufen|shop|preis|automarkt)\b"
CHROME = r"\b(cookie|privacy policy|datenschutz|impressum|all rights reserved)\b"
LIST_TABLE = r"(^|\s)([-*]|\d{1,3}[.)])\s+|\|\s*[-:]+\s*\||\t|\.{3,}\s*\d{1,5}"
DE_SENTENCE = r"\b(der|die|das|und|ist|nicht|frage|antwort|schritt|erklaere|erklare)\b"
GATE_NEAR = r"\bhauptstadt von deutschland\b"


def vector(t: E) -> Steps:
    """Ten document metrics, rounded as a report has them."""
    s = Steps().add(ws=m.words(t)).add(low=x.two("transform(ws, w -> lower(w))", "list_transform(ws, lambda w: lower(w))"))
    sentences = x.hits(t, r"[.!?]\s+") + 1
    paragraphs = x.two("size(filter(split({}, '\\\\n\\\\s*\\\\n'), q -> trim(q) <> ''))", "len(list_filter(string_split_regex({}, '\\n\\s*\\n'), lambda q: trim(q) <> ''))", t)
    s = s.add(chars=x.length(t), n_words=x.size(x.col("ws")), n_paragraphs=paragraphs, n_sentences=sentences)
    return s.add(alpha=x.digits(m.alpha_density(t), 4), symbol=x.digits(m.symbol_density(t), 4), digit=x.digits(m.digit_density(t), 4), rep=x.digits(m.gram_repetition("low", 4, 8), 4), signal=x.digits(m.language_signal(x.col("ws")), 4), mean_word=x.digits(m.mean_word_length(x.col("ws")), 2))


def scored(t: E) -> Steps:
    """Quality score from 0 to 1 by penalties on the rounded metrics."""
    c = x.col
    less = lambda cond, by: x.case((cond, by), otherwise=0.0)
    score = wrapd(1.0) - less(c("n_words") < 80, 0.25) - less(c("n_sentences") < 3, 0.2) - less(c("alpha") < 0.55, 0.2)
    score = score - less(c("symbol") > 0.18, x.least(wrapd(0.25), (c("symbol") - 0.18) * 1.5)) - less(c("digit") > 0.25, 0.15)
    score = score - less(c("rep") > 0.18, x.least(wrapd(0.35), c("rep"))) - less(c("signal") < 0.035, 0.18)
    score = score - less((c("mean_word") < 3.0) | (c("mean_word") > 10.5), 0.08)
    return vector(t).add(score=x.digits(x.greatest(0.0, x.least(1.0, score)), 4))


def wrapd(v: float) -> E:
    return x.wrap(v)


def url_chars(t: E) -> Steps:
    s = Steps().add(urls=x.found(t, r"https?://\S+|www\.\S+", True), toks=x.spaced(t))
    letters = x.two("size(filter(toks, w -> w RLIKE '[\\\\p{{L}}]'))", "len(list_filter(toks, lambda w: regexp_matches(w, '[\\p{{L}}]')))")
    return s.add(url_chars=x.share(x.length(x.joined(x.col("urls"), "")), x.length(t)), alpha_words=x.share(letters, x.size(x.col("toks"))))


def curator(t: E) -> Steps:
    """Nineteen heuristic scores as public papers define them (Gopher and C4 rules)."""
    c = x.col
    s = Steps().add(toks=x.spaced(t), ls=x.two("filter(split({}, '\\n'), l -> trim(l) <> '')", "list_filter(string_split({}, chr(10)), lambda l: trim(l) <> '')", t), ps=x.two("filter(split({}, '\\\\n\\\\s*\\\\n'), q -> trim(q) <> '')", "list_filter(string_split_regex({}, '\\n\\s*\\n'), lambda q: trim(q) <> '')", t))
    s = s.add(tri=x.grams("toks", 3))

    def lines_with(pattern: str) -> E:
        return x.two("size(filter(ls, l -> l RLIKE {0}))", "len(list_filter(ls, lambda l: regexp_matches(l, {0})))", x.pattern(pattern))

    def repeated(name: str) -> E:
        return x.share(x.size(c(name)) - x.size(x.distinct(c(name))), x.size(c(name)))

    def repeated_chars(name: str) -> E:
        own = x.length(x.joined(c(name), ""))
        return x.share(own - x.length(x.joined(x.distinct(c(name)), "")), own)

    longest = x.two("coalesce(array_max(transform(toks, w -> length(w))), 0)", "coalesce(list_max(list_transform(toks, lambda w: length(w))), 0)")
    alpha = x.two("size(filter(toks, w -> w RLIKE '[a-zA-ZÄÖÜäöüß]'))", "len(list_filter(toks, lambda w: regexp_matches(w, '[a-zA-ZÄÖÜäöüß]')))")
    signs = x.hits(t, r"#|\.\.\.|…")
    counts = x.two("size(tri) - size(array_distinct(tri))", "len(tri) - len(list_distinct(tri))")
    return s.add(
        word_count=x.size(c("toks")), non_alnum=x.share(m.kept(t, r"[\p{L}\p{N}]+"), x.length(t)), numbers=m.digit_density(t),
        urls=x.share(x.length(x.joined(x.found(t, r"https?://\S+|www\.\S+"), "")), x.length(t)), white=x.share(m.kept(t, r"\S+"), x.length(t)),
        bullets=x.share(lines_with(r"^\s*[-*•‣▪]"), x.size(c("ls"))), punct_lines=x.share(x.size(c("ls")) - lines_with(r"[.!?…\"')\]]\s*$"), x.size(c("ls"))),
        symbol_words=x.share(signs, x.size(c("toks"))), long_word=longest, mean_word=m.mean_word_length(c("toks")), with_alpha=x.share(alpha, x.size(c("toks"))),
        parens=x.share(m.kept(t, r"[^()\[\]]+"), x.length(t)), ellipsis=x.share(lines_with(r"(\.\.\.|…)\s*$"), x.size(c("ls"))),
        rep_lines=repeated("ls"), rep_paragraphs=repeated("ps"), rep_line_chars=repeated_chars("ls"), rep_paragraph_chars=repeated_chars("ps"),
        dup3=x.share(counts, x.size(c("tri"))), top3=x.share(_top_gram(), x.size(c("tri"))),
    )


def _top_gram() -> E:
    """How often the commonest 3-gram occurs: the longest run of equal ones in sorted order."""
    return E(
        "coalesce(aggregate(array_sort(tri), named_struct('g', '', 'n', 0, 'top', 0), (a, g) -> named_struct('g', g, 'n', IF(a.g = g, a.n + 1, 1), 'top', greatest(a.top, IF(a.g = g, a.n + 1, 1))), a -> a.top), 0)",
        "coalesce(list_max(map_values(list_aggregate(tri, 'histogram'))), 0)",
    )


def seed(t: E) -> Steps:
    return Steps().add(
        n_chars_seen=x.length(t), n_words=x.size(x.spaced(t)), has_code=x.has(t, SEED_CODE), dates=x.hits(t, SEED_DATES), citations=x.hits(t, SEED_CITATION),
        imperatives=x.hits(t, SEED_ORDERS_DE, True) + x.hits(t, SEED_ORDERS_EN, True), opinions=x.hits(t, SEED_OPINION, True), numerics=x.hits(t, SEED_NUMERIC),
        upper_share=m.upper_ratio(t), symbol_share=m.symbol_density(t),
    )


def seed_type(t: E) -> Steps:
    c = x.col
    return seed(t).add(label=x.case((c("has_code") | (c("symbol_share") > 0.15), "technical"), (c("imperatives") >= 2, "procedural"), ((c("citations") >= 2) | ((c("dates") >= 3) & (c("numerics") >= 2)), "factual"), (c("opinions") >= 1, "opinion"), ((c("dates") >= 1) & (c("n_words") > 200), "narrative"), otherwise="general"))


def looks_german(t: E) -> Steps:
    s = Steps().add(ws=x.found(nz.ascii_fold(x.left(t, 12_000)), m.WORD), um=m.umlauts(t)).add(de=x.among(x.col("ws"), m.CHAT_DE_WORDS), en=x.among(x.col("ws"), m.CHAT_EN_WORDS))
    de, en = x.col("de"), x.col("en")
    return s.add(german=x.case((x.size(x.col("ws")).eq(0), False), otherwise=((de >= 4) & (de >= en * 1.25)) | ((x.col("um") >= 2) & (de >= en))))


def marker_language(t: E) -> Steps:
    s = Steps().add(low=x.lower(x.left(t, 1000)))
    total = lambda marks: sum((x.occurrences(x.col("low"), k) for k in marks[1:]), x.occurrences(x.col("low"), marks[0]))
    return s.add(label=x.case((total(DE_MARKERS) > total(EN_MARKERS), "de"), otherwise="en"))


def code_language(t: E) -> Steps:
    return Steps().add(label=x.case(
        (x.has(t, r"(?m)^\s*def\s+\w+\(|^\s*import\s+\w+|^\s*from\s+\w+\s+import\b"), "python"),
        (x.has(t, r"\bfunction\s+\w+\(|\bconst\s+\w+\s*=|=>"), "javascript"),
        (x.has(t, r"\bfn\s+\w+\(|\blet\s+mut\b|use\s+std::"), "rust"),
        (x.has(t, r"#include\s*<|std::|int\s+main\s*\("), "cpp"),
        (x.has(t, r"\bpublic\s+class\b|\bSystem\.out\.println\b"), "java"),
        (x.has(t, r"(?s)\bSELECT\b.+\bFROM\b|\bCREATE\s+TABLE\b", True), "sql"),
        (x.has(t, r"(?m)^\s*#!/bin/(?:ba)?sh|^\s*(?:set -e|fi|done)\b"), "shell"),
        otherwise="unknown",
    ))


def domain(t: E) -> Steps:
    s = Steps().add(de=x.hits(t, GERMAN, True), en=x.hits(t, ENGLISH, True))
    flags = x.flags(
        (x.has(t, p.MIX_HTML, True, True), "html"), (x.has(t, DOMAIN_CHAT, True, True), "chat_marker"), (x.has(t, ADULT_CASINO, True, True), "adult_or_casino"), (x.has(t, SHOP, True, True), "shop_spam"),
        (x.hits(t, m.URL, True) >= 3, "url_dense"), (x.has(t, SHORT_TOC, True, True), "toc_or_index"), (x.has(t, SHORT_OCR, spelled=True), "ocr_or_mojibake"), (x.length(t) < 120, "too_short_chars"),
    )
    de, en = x.col("de"), x.col("en")
    label = x.case((x.has(t, DOMAIN_MATH, True, True), "math"), (x.has(t, DOMAIN_CODE, True, True), "code"), (x.has(t, DOMAIN_QA, True, True), "qa_or_instruction"), ((de > en * 1.25) & (de >= 2), "german_prose"), (en >= x.greatest(2, de), "english_prose"), otherwise="other")
    return s.add(label=label, flag_text=x.joined(flags, ","))


def triage(t: E) -> Steps:
    s = Steps().add(body=x.strip(t))
    b = x.col("body")
    s = s.add(ws=x.two("transform({}, w -> lower(w))", "list_transform({}, lambda w: lower(w))", m.words(b)), toc=x.hits(b, TRIAGE_TOC, True), listed=m.list_score(b))
    flags = x.flags(
        (x.length(b) < 180, "too_short"), (x.length(b) > 50_000, "very_long_doc"), (x.has(b, TRIAGE_MOJIBAKE), "mojibake"), (x.has(b, TRIAGE_HTML, True), "html"),
        (x.hits(b, TRIAGE_URL, True) >= 3, "url_dense"), (x.has(b, p.CHAT, True), "chat_or_sft_marker"), (x.has(b, TRIAGE_BOILER, True), "boilerplate"),
        ((x.col("toc") >= 2) | ((x.col("toc") >= 1) & (x.col("listed") >= 4)), "toc_or_index"), (x.hits(b, TRIAGE_BIBLIO, True) >= 3, "bibliography_or_metadata"), (x.hits(b, m.OCR, True) >= 2, "ocr_scan_hint"),
        (m.alpha_density(b) < 0.45, "low_alpha"), (m.symbol_density(b) > 0.22, "symbol_dense"), (m.digit_density(b) > 0.16, "digit_dense"),
        ((m.repetition(x.col("ws"), 30) > 0.68) | (m.gram_repetition("ws", 4, 16) > 0.28), "repetitive"), (x.col("listed") >= 8, "list_or_table_heavy"), (x.has(b, TRIAGE_CODE), "code_like"), (x.has(b, TRIAGE_MATH), "math_like"),
    )
    s = s.add(fl=flags)
    any_of = lambda names: x.two("arrays_overlap(fl, array({0}))", "list_has_any(fl, [{0}])", E(", ".join(x.quote(n) for n in names), ", ".join(x.quote(n) for n in names)))
    trash = any_of(["html", "url_dense", "chat_or_sft_marker", "boilerplate", "mojibake", "repetitive"])
    repair = any_of(["toc_or_index", "bibliography_or_metadata", "ocr_scan_hint", "list_or_table_heavy", "very_long_doc", "symbol_dense", "digit_dense", "low_alpha"])
    return s.add(label=x.case((trash, "trash"), (repair, "repair"), ((x.length(b) >= 240) & (x.size(x.col("ws")) >= 35), "keep"), otherwise="repair"), flag_text=x.joined(x.col("fl"), ","))


def short_kind(t: E) -> Steps:
    s = Steps().add(body=x.strip(t)).add(ws=m.words(x.col("body")))
    b, n = x.col("body"), x.size(x.col("ws"))
    low = x.has(b, r"^\p{Ll}")
    end = x.has(b, "[.!?:)\\]\"]$")
    hard = x.has(b, p.MIX_HTML, True) | x.has(b, DOMAIN_CHAT, True) | (x.hits(b, m.URL, True) >= 3) | x.has(b, ADULT_CASINO, True) | x.has(b, SHOP, True)
    return s.add(label=x.case((hard, "hard_noise"), (x.has(b, SHORT_OCR), "ocr_or_mojibake"), (x.has(b, p.WIKI_TALK, True), "wiki_talk"), (x.has(b, p.TABLE), "table_fragment"), (x.has(b, p.INDEX, True) | x.has(b, SHORT_TOC, True), "index_or_toc"), (x.has(b, p.LISTED), "list_like"), (n < 8, "tiny_fragment"), (low & ~end, "broken_sentence_fragment"), (low | ~end, "sentence_fragment"), (x.contains(b, ":") & (n < 28), "definition_or_label"), otherwise="compact_valid"))


def profile(source: E, t: E) -> Steps:
    low = x.lower(source)
    by_source = x.case((x.contains(low, "math/") | x.contains(low, "openmath"), "math"), (x.contains(low, "reddit") | x.contains(low, "wildchat"), "dialogue"), (x.contains(low, "qa/") | x.contains(low, "large_qa") | x.contains(low, "orca"), "qa"), (x.contains(low, "validation"), "validation"), otherwise="german_prose")
    return Steps().add(label=x.case((x.has(t, DOMAIN_MATH, True), "math"), (x.has(t, r"\b(?:dialog|nutzer|assistent):", True), "dialogue"), (x.has(t, DOMAIN_QA, True), "qa"), otherwise=by_source))


def decision(t: E) -> Steps:
    """Warnings and hard drops of the prose profile."""
    s = curator(t).add(url_hits=x.hits(t, m.URL, True), html_hits=x.hits(t, p.MIX_HTML, True), moji=x.hits(t, "Ã.|Â.|�|â€"), n_lines=x.occurrences(t, "\n") + 1)
    c = x.col
    rep = lambda bound: ((c("n_lines") >= 4) & (c("rep_lines") > bound)) | ((x.size(c("ps")) >= 4) & (c("rep_paragraphs") > bound))
    band = lambda name, hard, soft: ((c(name) <= hard) & (c(name) > soft))
    hard = x.flags((c("html_hits") >= 3, "html_or_entity"), (x.has(t, DOMAIN_CHAT, True), "chat_marker"), (c("moji") >= 2, "mojibake_or_broken_encoding"), ((c("url_chars_share") > 0.25) | (c("url_hits") >= 3), "url_dense"), (c("word_count") < 16, "too_few_words"), (c("white") > 0.45, "whitespace_extreme"), (c("long_word") > 300, "very_long_token"), (rep(0.85), "line_or_paragraph_repetition_extreme"), ((c("dup3") > 0.75) | (c("top3") > 0.65), "ngram_repetition_extreme"), (c("non_alnum") > 0.45, "non_alpha_numeric_extreme"), (c("with_alpha") < 0.55, "too_few_alpha_words"))
    warn = x.flags(
        ((c("html_hits") >= 1) & (c("html_hits") < 3), "html_or_entity_hint"), (c("moji").eq(1), "mojibake_or_broken_encoding_hint"), ((c("url_hits") >= 1) & (c("url_hits") < 3), "url_present"), ((c("word_count") >= 16) & (c("word_count") < 32), "short_doc"),
        (band("white", 0.45, 0.35), "whitespace_high"), (band("long_word", 300, 80), "long_token"), (rep(0.70) & ~rep(0.85), "line_or_paragraph_repetition"), (((c("dup3") > 0.35) | (c("top3") > 0.25)) & ~((c("dup3") > 0.75) | (c("top3") > 0.65)), "ngram_repetition"),
        (band("non_alnum", 0.45, 0.25), "non_alpha_numeric_high"), (c("numbers") > 0.30, "number_heavy"), ((c("with_alpha") >= 0.55) & (c("with_alpha") < 0.65), "low_alpha_words"), (c("bullets") > 0.80, "bullet_list"), (x.has(t, p.LISTED), "list_like_hint"), (c("punct_lines") > 0.95, "punctuation_unusual"), (c("ellipsis") > 0.30, "ellipsis_heavy"),
    )
    return s.add(url_chars_share=c("urls")).add(warn_text=x.joined(warn, ","), drop_text=x.joined(hard, ","))


def safety(t: E) -> Steps:
    pairs = [(x.has(t, pattern, True), name) for name, pattern in SAFETY.items()]
    return Steps().add(label=x.case(*pairs, (x.has(t, SOFT, True), "softable"), otherwise="normal"))


def route(t: E) -> Steps:
    q = x.col("q")
    return Steps().add(q=x.strip(x.lower(t))).add(label=x.case((x.has(q, ROUTE_MATH), "math"), (x.has(q, ROUTE_CODE), "code"), (x.has(q, ROUTE_WEB), "web"), (x.has(q, ROUTE_RAG), "rag"), otherwise="chat"))


def redacted(t: E) -> Steps:
    """Secrets replaced by their kind."""
    out = t
    for name, pattern in p.SECRETS.items():
        out = x.sub(out, pattern, f"<{name}>")
    return Steps().add(out=out)


def common(least: int, most: int, urls: int) -> list[tuple[E, str]]:
    n = x.col("norm")
    return [(x.length(n) < least, "too_short"), (x.length(n) > most, "too_long"), (x.has(n, p.MIX_BAD, True), "bad_marker"), (x.has(n, r"<\s*/?\s*(html|body|div|script|style|iframe)\b|href=|&(?:amp|gt|lt|quot);", True), "html"), (x.has(n, GATE_NEAR, True), "gate_near"), (x.hits(n, m.URL, True) > urls, "url_dense"), (m.alpha_density(n) < 0.32, "low_alpha")]


def web_prose() -> p.Policy:
    n = x.col("norm")
    pairs = [*common(700, 12_000, 0), (x.has(n, COMMERCE, True), "commerce"), (x.has(n, CHROME, True), "boilerplate"), (x.has(n, LIST_TABLE), "list_table"), (~x.has(n, DE_SENTENCE, True), "weak_de_signal")]
    return p.Policy("web_prose", Steps().add(norm=nz.paragraph_text(p.T)).add(reason=x.case(*pairs)))


def instruction() -> p.Policy:
    """The first line asks, the rest answers."""
    n, q, a = x.col("norm"), x.col("q"), x.col("a")
    s = Steps().add(norm=nz.paragraph_text(p.T)).add(q=x.sub(n, r"(?s)\n.*$"), a=x.sub(n, r"^[^\n]*\n?"))
    english = x.has(a, r"\b(the|and|with|this|that|you)\b", True) & ~x.has(a, DE_SENTENCE, True)
    pairs = [((x.length(q) < 8) | (x.length(a) < 20), "too_short"), (x.length(n) > 6000, "too_long"), (x.has(n, p.MIX_BAD, True), "bad_marker"), (x.has(n, p.MIX_HTML, True), "html"), (x.hits(n, m.URL, True) > 0, "url"), (x.has(n, GATE_NEAR, True), "gate_near"), (english, "english_answer"), (~x.has(n, DE_SENTENCE, True), "weak_de_signal"), (m.alpha_density(n) < 0.35, "low_alpha")]
    return p.Policy("instruction", s.add(reason=x.case(*pairs)))


def answer_text() -> p.Policy:
    n = x.col("norm")
    pairs = [(x.length(n) < 120, "too_short"), (x.length(n) > 8000, "too_long"), (x.has(n, p.MIX_BAD, True), "bad_marker"), (x.has(n, m.URL, True), "has_url"), (x.size(m.words(n)) < 20, "too_few_words"), (m.alpha_density(n) < 0.35, "low_alpha_density")]
    return p.Policy("answer_text", Steps().add(norm=nz.paragraph_text(p.T)).add(reason=x.case(*pairs)))
