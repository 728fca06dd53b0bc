"""Text normalisation as expressions: white space, case, control characters, markup and transliteration."""

from __future__ import annotations

from weir.functions import exprs as x
from weir.functions.exprs import E

# Characters and phrases that decide results.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
HEADER = r"(?s)^.*?\*\*\*\s*start of (?:the|this) project gutenberg ebook[^*]*\*\*\*"
FOOTER = r"(?s)\*\*\*\s*end of (?:the|this) project gutenberg ebook.*$"


def clean_text(t: E) -> E:
    return x.squeeze(t)


def dedup_key_text(t: E) -> E:
    """Lower case, white space runs to one space: what exact and near duplicates are compared on."""
    return x.squeeze(x.lower(t))


def code_text(t: E) -> E:
    """Keeps line feeds; drops NUL, carriage returns to spaces, no line feeds at the end."""
    return x.sub(x.sub(x.sub(t, r"\x00"), r"\r", " "), r"\n+$")


def unix_lines(t: E) -> E:
    return x.sub(x.sub(t, r"\r\n?", "\n"), r"\x00")


# What text read through the wrong one-byte code shows, by cleaner.
STRICT_HINTS = ("\ufffd", "Ã¤", "Ã¶", "Ã¼", "Ã\u009f", "Ã¢â‚¬", "Â ")
STRUCTURE_HINTS = ("Ã¤", "Ã¶", "Ã¼", "ÃŸ", "Ã„", "Ã–", "Ãœ", "â€", "Â ", "\ufffd")
CHAT_HINTS = ("Ã", "Â", "â")
#: Signs of the Windows code that Latin-1 lacks, and the bytes that stand for them.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def damage(t: E, hints: tuple[str, ...]) -> E:
    """How many hints a text holds; replacement signs count three times more."""
    out = x.occurrences(t, "\ufffd") * 3
    for h in hints:
        out = out + x.occurrences(t, h)
    return out


def read_again(t: E) -> E:
    """A text of signs below 256 as the UTF-8 that its signs' numbers spell; null if they spell none."""
    return E(
        f"CASE WHEN {x.has(t, '^[\\x00-\\xff]*$').spark} AND is_valid_utf8(CAST(encode({t.spark}, 'ISO-8859-1') AS STRING)) THEN CAST(encode({t.spark}, 'ISO-8859-1') AS STRING) END",
        f"CASE WHEN regexp_full_match({t.duck}, '[\\x00-\\x{{ff}}]*') THEN TRY(decode(from_hex(array_to_string(list_transform(string_split({t.duck}, ''), lambda c: printf('%02X', ord(c))), '')))) END",
    )


def repaired(t: E, hints: tuple[str, ...]) -> E:
    """The least damaged of a text and its readings as doubly decoded text, through Latin-1 and the Windows code.

    Only texts that hold a hint are read again; of equal readings the first.
    """
    latin = read_again(t)
    plain = x.two("{} RLIKE {}", "regexp_matches({}, {})", t, E(x.text(f"^[^\x80-\x9f]*$").spark, x.text(r"^[^\x{80}-\x{9f}]*$").duck))
    windows = x.case((plain, read_again(x.both(f"translate({{}}, {x.quote(WINDOWS)}, {x.quote(WINDOWS_BYTES)})", t))))
    own = damage(x.col("v"), hints)
    chosen = E(
        f"array_min(transform(filter(array({t.spark}, {latin.spark}, {windows.spark}), v -> v IS NOT NULL), (v, i) -> struct({own.spark} AS d, i, v))).v",
        f"list_min(list_transform(list_filter([{t.duck}, {latin.duck}, {windows.duck}], lambda v: v IS NOT NULL), lambda v, i: {{'d': {own.duck}, 'i': i, 'v': v}})).v",
    )
    return x.case((x.contains_any(t, hints), chosen), otherwise=t)


def strict_text(t: E) -> E:
    return x.strip(x.sub(unix_lines(repaired(t, STRICT_HINTS)), r"[ \t]{2,}", " "))


def ascii_fold(t: E) -> E:
    out = x.lower(t)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = x.replace(out, a, b)
    return out


def fold_accents(t: E) -> E:
    """Lower case without the accents of Latin letters, other signs to one space."""
    plain = x.two("translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')", "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')", t)
    return x.both("trim({})", x.sub(plain, r"[^a-z0-9]+", " "))


def punct_key(t: E) -> E:
    return x.squeeze(x.sub(x.lower(t), r"[^\p{L}\p{N}_\s]"))


def doc_text(t: E) -> E:
    return x.squeeze(x.sub(unix_lines(t), r"</?think>", "", ci=True))


def paragraph_text(t: E) -> E:
    return x.strip(x.sub(x.sub(unix_lines(t), r"[ \t]{2,}", " "), r"\n{4,}", "\n\n\n"))


def message_text(t: E) -> E:
    """Lines without white space at their ends, three line feeds in a row at most."""
    return x.sub(x.strip(x.sub(unix_lines(t), r"[ \t]+(\n|$)", "$1")), r"\n{4,}", "\n\n\n")


def without_control(t: E) -> E:
    return x.sub(t, CONTROL, " ")


def html_text(t: E) -> E:
    """Scripts, styles and page chrome out, blocks to lines, other tags out, common references decoded."""
    out = t
    for tag in ("script", "style", "nav", "footer", "header"):
        out = x.sub(out, rf"(?s)<{tag}\b.*?</{tag}\s*>", " ", ci=True)
    out = x.sub(out, r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section)\b[^>]*>", "\n", ci=True)
    out = x.sub(out, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = x.replace(out, a, b)
    return x.strip(x.sub(x.sub(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def without_gutenberg(t: E) -> E:
    return x.strip(x.sub(x.sub(t, HEADER, "", ci=True), FOOTER, "", ci=True))


def forum_text(t: E) -> E:
    """Quoted lines out, links to their words, zero-width signs out."""
    out = x.sub(t, r"(?m)^[ \t]*>.*$")
    out = x.sub(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return x.squeeze(x.sub(out, "[\u200b\u200c\u200d\ufeff]"))


def excerpt(t: E, n: int) -> E:
    """The first n code points, cut at the last white space, with an ellipsis if anything is missing."""
    flat = x.squeeze(t)
    return x.case((x.length(flat) <= n, flat), otherwise=x.both("concat({}, ' […]')", x.sub(x.left(flat, n), r"\s+\S*$")))


def slug(t: E) -> E:
    return x.sub(x.lower(t), r"[^a-z0-9]+", "_")


def tab_indent(t: E) -> E:
    """Leading runs of four spaces become tabs (up to eight levels)."""
    out = t
    for _ in range(8):
        out = x.sub(out, r"(?m)^(\t*) {4}", "$1\t")
    return out


def without_list_marks(t: E) -> E:
    return x.sub(t, r"(?m)^[ \t]*(?:[-*•]+|\d+[.)]|[a-zA-Z][.)])[ \t]+")


def structured_text(t: E) -> E:
    """What `raw_structured` does after repair; character references are decoded in between where Python runs (`structure.decoded`)."""
    return raw_structured(repaired(t, STRUCTURE_HINTS))


def raw_structured(t: E) -> E:
    """Control signs, hyphenation at line ends, tags, addresses out; quotes made plain; spaces squeezed line by line."""
    out = x.sub(x.sub(x.sub(t, CONTROL, " "), r"\r\n?", "\n"), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    out = x.sub(x.sub(out, r"<[^>]{1,160}>", " "), r"https?://\S+|www\.\S+", " ", ci=True)
    out = x.sub(out, r"\S+@\S+\.\S+", " ")
    out = x.sub(x.sub(x.sub(out, "[“”„]", '"'), "[’‘`]", "'"), "\ufffd", " ")
    out = x.sub(x.sub(out, r"\n{3,}", "\n\n"), "[ \\t\u00a0]{2,}", " ")
    return x.strip(x.sub(out, r"[ \t]*\n[ \t]*", "\n"))
