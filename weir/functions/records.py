"""Decisions on records: licenses, metadata guards, moderation, cards, forum comments, sample quality, safe code, templates."""

from __future__ import annotations

from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import normalise as nz
from weir.functions.exprs import E, Steps

# Allow-lists, bounds and patterns that decide results.
COMMERCIAL = ("cc0", "cc0-1.0", "cc-by", "cc-by-4.0", "mit", "apache-2.0", "bsd", "public-domain")
DENIED_PARTS = ("-nd", "noderivatives", "no-derivatives")
MODERATION = ("toxicity", "severe_toxicity", "obscene", "identity_attack", "sexual_explicit", "threat", "insult")
FORUM_SPAM = r"(onlyfans|discord\.gg|telegram|whatsapp|free karma|upvote if|subscribe to|check out my|promo code|coupon code|buy now|nsfw|porn|sex chat)"
FORUM_BOT = r"\b(i am a bot|beep boop|this action was performed automatically)\b"
FORUM_JUNK = r"^\s*(?:&gt;|>|\*|-|_|\[deleted\]|\[removed\])\s*$"
SPECIAL_SPLITS = ("youtubecommons", "wikidiscussions", "onemillionposts", "thestack", "wikiquote")
YES, NO = r"^(ja|jawohl|richtig|stimmt)(\P{L}|$)", r"^(nein|nicht|falsch)(\P{L}|$)"
BANNER = "^(?:[ \\t]*(?:#[^\\n]*|\"\"\"|''')?[ \\t]*\\n){1,80}"
BANNER_WORDS = r"license|licence|copyright|all rights reserved|redistribution"
UNSAFE = ("os.system", "subprocess", "eval(", "exec(", "__import__", "open(", "socket", "shutil")
SAFE_IMPORT = r"^\s*(import|from) (math|re|json|random|itertools|functools|collections|string|datetime|statistics)\b"
PREFERENCE = r"\b(ich bevorzuge|ich mag|i prefer|i like|bitte immer|please always)\b"
PATH = r"(?:/[A-Za-z0-9_.-]+){2,}"
TEMPORARY = r"\b(heute|gerade|aktuell|today|right now|currently)\b"


def license_ok(raw: E) -> Steps:
    """verdict of a license for commercial use: denials first, then an exact or a whole-token match."""
    s = Steps().add(lic=x.sub(x.strip(x.lower(raw)), r"[ _]", "-"))
    lic = x.col("lic")
    tokens = x.two("split(lic, '-')", "string_split(lic, '-')")
    match = None
    for name in COMMERCIAL:
        parts = ", ".join(x.quote(p) for p in name.split("-"))
        own = x.two(f"size(array_except(array({parts}), {{0}})) = 0", f"len(list_filter([{parts}], lambda p: NOT list_contains({{0}}, p))) = 0", tokens)
        match = own if match is None else x.both("({} OR {})", match, own)
    return s.add(verdict=x.case((x.both("({} = '')", lic), "missing"), (x.contains_any(lic, DENIED_PARTS), "no_derivatives"), (x.contains(lic, "-nc") | x.contains(lic, "noncommercial") | x.contains(lic, "non-commercial"), "non_commercial"), (x.contains(lic, "-sa") | x.contains(lic, "share-alike") | x.contains(lic, "sharealike"), "share_alike"), (x.both("({})", match), "ok"), otherwise="not_listed"))


def metadata_guard(ocr: E, perplexity: E, least: float, most: float) -> E:
    """Null values pass."""
    return x.case((ocr < least, "low_ocr_score"), (perplexity > most, "high_perplexity"))


def forum_comment(t: E, score: E, least_score: int = 5, least: int = 120, most: int = 6000) -> Steps:
    n = x.col("body")
    s = Steps().add(body=nz.paragraph_text(t)).add(ws=x.found(n, "[A-Za-z][A-Za-z']+"), urls=x.hits(n, m.URL, True))
    many = x.size(x.col("ws"))
    return s.add(reason=x.case(
        (x.both("({} IN ('[deleted]', '[removed]', 'deleted', 'removed', ''))", x.lower(n)), "deleted_or_removed"), (x.length(n) < least, "too_short"), (x.length(n) > most, "too_long"), (score < least_score, "low_score"),
        (x.has(n, FORUM_JUNK, True), "markdown_junk"), (x.has(n, FORUM_BOT, True), "bot"), (x.has(n, FORUM_SPAM, True), "spam_or_nsfw"), (many < 12, "too_few_words"), (x.col("urls") > 1, "too_many_urls"),
        (x.col("urls").eq(1) & (many < 35), "link_dominant"), (m.alpha_density(n) < 0.45, "low_alpha_density"), (x.occurrences(n, "\n") > 12, "too_many_lines"),
    ))


def split_decision(split: E, samples: E, keep: E, ocr: E, perplexity: E) -> E:
    return x.case((samples.eq(0), "manual_check"), (ocr < 75, "hard_filter"), (keep < 0.35, "exclude"), (x.both("({} IN ('" + "', '".join(SPECIAL_SPLITS) + "'))", split), "small_or_special"), (perplexity > 1800, "hard_filter"), (keep >= 0.70, "take"), otherwise="hard_filter")


def recommendation(n: E, trash: E, repair: E, chat: E, toc_ocr: E) -> E:
    return x.case(((trash * 100.0 >= n * 25.0) | (chat > 0), "exclude_or_reclean_hard"), ((trash + repair) * 100.0 >= n * 45.0, "reclean_with_v3_filters"), (toc_ocr * 1.0 > n * 0.15, "split_and_drop_ocr_index"), otherwise="keep_with_light_filters")


def card_score(downloads: E, likes: E, permissive: E, matches: E) -> Steps:
    """0 to 100 from popularity (logarithms, capped), license and language; a label and a verdict."""
    log = lambda v: x.both("(log10({} + 1) * 4)", v)
    base = x.wrap(25.0) + x.least(18.0, log(downloads)) + x.least(12.0, log(likes)) + x.case((permissive, 18.0), otherwise=-8.0) + x.case((matches, 12.0), otherwise=-10.0)
    s = Steps().add(score=x.digits(x.greatest(0.0, x.least(100.0, base)), 1))
    v = x.col("score")
    return s.add(label=x.case((v >= 78, "strong"), (v >= 58, "usable"), (v >= 38, "risky"), otherwise="weak"))


def polarity(t: E) -> E:
    return x.case((x.has(x.strip(x.lower(t)), YES), "yes"), (x.has(x.strip(x.lower(t)), NO), "no"))


def without_banner(t: E) -> E:
    """A leading block of comments goes if it speaks of a license."""
    block = x.two("regexp_extract({}, {}, 0)", "regexp_extract({}, {})", t, x.pattern(BANNER))
    return x.case((x.has(block, "#") & x.has(block, BANNER_WORDS, True), x.sub(x.sub(t, BANNER), r"^\n+")), otherwise=t)


def safe_code(t: E) -> E:
    imports = x.two("filter(split({}, '\\n'), l -> trim(l) RLIKE '^(import|from) ')", "list_filter(string_split({}, chr(10)), lambda l: regexp_matches(trim(l), '^(import|from) '))", t)
    bad = x.two("exists({}, l -> NOT l RLIKE {})", "len(list_filter({}, lambda l: NOT regexp_matches(l, {}))) > 0", imports, x.pattern(SAFE_IMPORT))
    return x.case((x.contains_any(x.lower(t), UNSAFE), "denied"), (x.both("({})", bad), "import_not_allowed"), otherwise="ok")


def memories(t: E) -> E:
    """Kinds of memory a message holds."""
    return x.flags((x.has(t, PREFERENCE, True), "preference"), (x.has(t, PATH), "path"), (x.has(t, TEMPORARY, True), "temporary"), (x.has(t, r"\b(gpu|cuda|ssd|nvme)\b", True), "hardware"), (x.has(t, r"\b(projekt|project|repo)\b", True), "project"))


def terms_match(t: E, include: list[str], exclude: list[str]) -> E:
    low = x.lower(t)
    wanted = x.contains_any(low, include) if include else x.both("true")
    return wanted & ~x.contains_any(low, exclude) if exclude else wanted


def fenced_tabs(t: str) -> E:
    """Tabs for leading spaces inside fences only: an odd number of fence lines before a line puts it inside."""
    swap = "regexp_replace(regexp_replace(regexp_replace(l, '^ {4}', '\t'), '^(\t) {4}', '$1\t'), '^(\t\t) {4}', '$1\t')"
    duck = swap.replace("$1", "\\1").replace("'\t'", "chr(9)").replace("'\\1\t'", "'\\1' || chr(9)").replace("^(\t)", "^(\\t)").replace("^(\t\t)", "^(\\t\\t)")
    spark = swap.replace("\t", "\\t")
    return E(
        f"array_join(transform(split({t}, '\\n'), (l, i) -> IF(size(filter(slice(split({t}, '\\n'), 1, i + 1), f -> f LIKE '```%')) % 2 = 1 AND NOT l LIKE '```%', {spark}, l)), '\\n')",
        f"array_to_string(list_transform(list_zip(string_split({t}, chr(10)), range(len(string_split({t}, chr(10))))), lambda z: CASE WHEN len(list_filter(string_split({t}, chr(10))[1:z[2] + 1], lambda f: starts_with(f, '```'))) % 2 = 1 AND NOT starts_with(z[1], '```') THEN {duck.replace('(l,', '(z[1],')} ELSE z[1] END), chr(10))",
    )


def sample_signals(docs: str) -> str:
    """Per group: mean length, addresses and tags a sample, templates, and the score delta they give. Read alike by both engines."""
    return f"""SELECT source, n, round(chars, 6) AS chars, delta FROM (SELECT source, count(*) AS n, avg(length(trim(text))) AS chars,
  CASE WHEN avg(length(trim(text))) >= 650 THEN 10 WHEN avg(length(trim(text))) >= 220 THEN 5 ELSE -8 END
  - CASE WHEN count_if(contains(text, 'http')) > 0.2 * count(*) THEN 10 ELSE 0 END
  - CASE WHEN count_if(contains(text, '###')) > 0.1 * count(*) THEN 12 ELSE 0 END AS delta FROM {docs} GROUP BY source) s"""
