"""Text metrics as expressions. A text is an expression; word lists are array columns named by the caller."""

from __future__ import annotations

from weir.functions import exprs as x
from weir.functions import normalise as nz
from weir.functions.exprs import E

# Word lists and patterns that decide results.
WORD = "[A-Za-zÄÖÜäöüß]+"
DE_WORDS = "der die das und oder nicht ist sind ein eine einer einen mit fuer fur auf von zu im den dem des dass ich du sie wir kann wird werden wenn weil aber auch als wie was warum deutsch".split()
EN_WORDS = "the and or not is are a an with for to of in that this you your we can will if because please explain example answer".split()
CHAT_DE_WORDS = "der die das und oder nicht ist sind ein eine einer einen mit fuer fur auf von zu im den dem des dass ich du sie wir kann koennen konnen wird werden wenn weil aber auch als wie was warum bitte erklaere erklare beispiel loesung losung antwort deutsch nein ja dies diese dieser".split()
CHAT_EN_WORDS = "the and or not is are a an with for to of in that this you your we can will if because please explain example solution answer".split()
SIGNAL_WORDS = "der die das und oder nicht ist sind ein eine einer einen mit auf von zu im den dem des dass auch als wie wird werden fuer ueber für durch bei aus nach über".split()
TOC = r"\b(contents?|inhaltsverzeichnis|table of contents|page|seite)\b|(\.{3,}|…{2,})\s*\d{1,5}(\s|$)|(^|\s)(?:[ivxlcdm]{1,8}|\d{1,4})\s+[.\-–—]{2,}\s+\d{1,5}(\s|$)"
BIBLIO = r"\b(isbn|doi:|copyright|all rights reserved|published by|herausgegeben|verlag|druckerei|bibliothek)\b"
OCR = r"\b(?:thl|bd\.|s\.\s*\d+|a\.\s*a\.\s*o\.|vgl\.|nr\.|fig\.|tafel|abb\.|cap\.|ibid|ſ|flg\.|u\.\s*s\.\s*w\.)\b|\b[A-Za-zÄÖÜäöüß](?:\s+[A-Za-zÄÖÜäöüß]){4,}\b"
LIST_MARK = r"(^|\s)(?:[-*•]|\d{1,3}[.)])\s+"
PAGE_RANGE = r"\b\d{1,4}\s*(?:\.{2,}|…|—|-)\s*\d{1,5}\b"
NAMES = r"(?:\*|\(\*\s*\d{3,4}\)|\(\d{3,4}[–-]\d{2,4}\)|\b[A-ZÄÖÜ][a-zäöüß]+,\s+[A-ZÄÖÜ])"
YEARS = r"\(\*?\s?\d{3,4}[–-]\d{2,4}\)|\*\s?\d{3,4}"
URL = r"https?://|www\."


def words(t: E) -> E:
    return x.found(t, WORD)


def folded_words(t: E) -> E:
    return x.found(nz.ascii_fold(t), WORD)


def url_density(tokens: E) -> E:
    n = x.two("size(filter({}, w -> w RLIKE '^(https?://|www[.])'))", "len(list_filter({}, lambda w: regexp_matches(w, '^(https?://|www[.])')))", tokens)
    return x.share(n, x.size(tokens))


def kept(t: E, drop: str) -> E:
    """Number of code points left after dropping a class."""
    return x.length(E(f"regexp_replace({x.wrap(t).spark}, {x.text(x.java(drop)).spark}, '')", x.sub(t, drop).duck))


def symbol_density(t: E) -> E:
    return x.share(kept(t, r"[\p{L}\p{N}\s]+"), x.length(t))


def alpha_density(t: E) -> E:
    return x.share(kept(t, r"[^\p{L}]+"), x.length(t))


def digit_density(t: E) -> E:
    return x.share(kept(t, r"[^0-9]+"), x.length(t))


def upper_ratio(t: E) -> E:
    return x.share(kept(t, r"[^\p{Lu}]+"), x.length(t))


def repetition(tokens: E, least: int = 1) -> E:
    """1 - distinct / all; 0 for fewer than `least` tokens."""
    return x.case((x.size(tokens) >= least, x.both("(1 - {})", x.share(x.size(x.distinct(tokens)), x.size(tokens)))), otherwise=0.0)


def gram_repetition(tokens: str, n: int, floor: int) -> E:
    """1 - distinct / all n-grams of an array column; 0 below `floor` tokens."""
    g = x.grams(tokens, n)
    return x.case((x.size(x.col(tokens)) >= floor, x.both("(1 - {})", x.share(x.size(x.distinct(g)), x.size(g)))), otherwise=0.0)


def list_score(t: E) -> E:
    return x.hits(t, LIST_MARK) + x.hits(t, PAGE_RANGE) + x.occurrences(t, " | ") + x.occurrences(t, "\t")


def mojibake_score(t: E) -> E:
    return nz.damage(t, nz.STRICT_HINTS)


def language_signal(tokens: E) -> E:
    lowered = x.two("transform({}, w -> lower(w))", "list_transform({}, lambda w: lower(w))", tokens)
    return x.share(x.among(lowered, SIGNAL_WORDS), x.size(tokens))


def control_share(t: E) -> E:
    return x.share(kept(t, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]+"), x.length(t))


def line_lengths(t: E) -> E:
    return x.two("transform({}, l -> length(l))", "list_transform({}, lambda l: length(l))", x.lines(t))


def long_lines(t: E) -> E:
    return x.two("size(filter({}, l -> length(l) > 240))", "len(list_filter({}, lambda l: length(l) > 240))", x.lines(t))


def mean_line(t: E) -> E:
    """Mean length of a line: what remains without line feeds, over the lines."""
    n = x.occurrences(t, "\n") + 1
    return x.share(x.length(t) - x.occurrences(t, "\n"), n)


def most_repeated_line(t: E) -> E:
    """How often the commonest non-empty line occurs."""
    own = x.two("filter(transform({}, l -> trim(l)), l -> l <> '')", "list_filter(list_transform({}, lambda l: trim(l)), lambda l: l <> '')", x.lines(t))
    return x.two(
        "coalesce(array_max(transform(array_distinct({0}), l -> size(filter({0}, m -> m = l)))), 0)",
        "coalesce(list_max(list_transform(list_distinct({0}), lambda l: len(list_filter({0}, lambda m: m = l)))), 0)",
        own,
    )


def mean_word_length(tokens: E) -> E:
    total = x.length(x.joined(tokens, ""))
    return x.share(total, x.size(tokens))


def umlauts(t: E) -> E:
    return kept(x.lower(t), "[^äöüß]+")
