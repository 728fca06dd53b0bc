"""Record gates: the reject chain of chat records, categories, code, forum and source filters, as steps over columns.

Each is written once and rendered for Spark and for the oracle. Chat records have the columns roles and contents (arrays
in the order of turns), category and source.
"""

from __future__ import annotations

from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import normalise as nz
from weir.functions.exprs import E, Steps

# Patterns, words and bounds that decide results.
CODE_HINT = (
    r"(```|def\s+\w+\s*\(|class\s+\w+|python|javascript|java\b|c\+\+|typescript|programmier|programmiere|code|funktion|algorithmus|debug|bug|iterator|rekursion|"
    r"\breturn\b|console\.log|print\s*\(|#include|public static)"
)
CHAT_HTML = r"<\s*/?\s*(?:html|body|div|script|style|table|iframe|form|a)\b"
BAD_PHRASE = r"(as an ai language model|knowledge cutoff|i cannot browse|cookie policy|privacy policy|<\|im_start\|>|<\|im_end\|>|_end_of_the_data|user-data)"
NO_INPUT = (
    r"(?s)(bitte\s+(poste|gib|sende|teile).{0,80}(text|input|frage|datei)|sobald\s+du\s+mir\s+.{0,80}(gibst|sendest|postest)|"
    r"ich\s+brauche\s+.{0,80}(mehr|informationen|input|eingabe))"
)
FIX_DE = (
    "der die das und oder nicht ist sind ein eine mit auf von zu im den dem dass ich du sie wir kann koennen wird werden wenn weil "
    "aber auch als wie was warum bitte erklaere antwort deutsch nein ja diese dieser quelle"
).split()
FIX_EN = "the and or not is are with for to of that this you your please explain answer".split()
QUESTIONS = ("ist ", "wer ", "was ", "wo ", "wann ", "welche ", "in welchem")
ORDERS = ("erklaere", "formuliere", "schreibe", "fasse", "antworte")
SFT_KEEP = ("honest_refusal", "clarify_awareness", "format_following", "rewrite", "translation", "math_reasoning", "math_word_problem")
SFT_DROP = ("code_explain", "code_refactoring", "code_debug_fix", "coding_bugfix", "coding_generation", "coding_explanation", "code_implementation", "code_general")
SFT_BAD = ("```", "python", "javascript", "typescript", "function", "class ", "def ", "import ", "stack trace", "traceback", "html", "http://", "https://")
VENDOR_PATH = r"(^|/)(node_modules|vendor|dist|build|third_party|externals|site-packages)(/|$)"
GENERATED = r"\b(auto[- ]?generated|generated by|do not edit|compiled from|webpackBootstrap|minified|sourceMappingURL|protobuf generated)\b"
SECRET = r"""\b(api[_-]?key|secret|token|password|passwd)\b\s*[:=]\s*['"][^'"\s]{12,}['"]|-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b"""
LICENSES = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense")
MODERATION = ("toxicity", "severe_toxicity", "obscene", "identity_attack", "sexual_explicit", "threat", "insult")
FENCE = "```"


def _of(role: str) -> E:
    """Contents of one role's turns."""
    return x.two(
        f"transform(filter(arrays_zip(roles, contents), t -> t.roles = '{role}'), t -> t.contents)",
        f"list_transform(list_filter(list_zip(roles, contents), lambda t: t[1] = '{role}'), lambda t: t[2])",
    )


def _each(name: str, e: E) -> E:
    """`e` of each element t of an array column."""
    return x.two(f"transform({name}, t -> {e.spark})".replace("{", "{{").replace("}", "}}"), f"list_transform({name}, lambda t: {e.duck})".replace("{", "{{").replace("}", "}}"))


def _all(name: str, e: E) -> E:
    return x.two(f"forall({name}, t -> {e.spark})", f"len(list_filter({name}, lambda t: NOT ({e.duck}))) = 0")


def roles_ok() -> E:
    """An optional system turn first, then users and assistants by turns, the last an assistant."""
    talk = x.two("array_join(transform(roles, r -> substring(r, 1, 1)), '')", "array_to_string(list_transform(roles, lambda r: r[1]), '')")
    return x.has(talk, "^s?(ua)+$")


def chat_parts() -> Steps:
    """Adds cleaned contents, users, assistants, and the joined texts said, asked and answered."""
    cleaned = _each("contents", nz.message_text(nz.repaired(x.col("t"), nz.CHAT_HINTS)))
    steps = Steps().add(cleaned=cleaned).add(contents_=x.col("cleaned"))
    by = x.two("'\\n'", "chr(10)")
    said = x.two(
        "transform(filter(arrays_zip(roles, cleaned), t -> t.roles <> 'system'), t -> t.cleaned)",
        "list_transform(list_filter(list_zip(roles, cleaned), lambda t: t[1] <> 'system'), lambda t: t[2])",
    )
    own = lambda role: E(_of(role).spark.replace("contents", "cleaned"), _of(role).duck.replace("contents", "cleaned"))
    steps = steps.add(users=own("user"), assistants=own("assistant"), turns=said)
    return steps.add(**{n: x.two("array_join({}, {})", "array_to_string({}, {})", x.col(c), by) for n, c in (("said", "turns"), ("asked", "users"), ("answered", "assistants"))})


def looks_german(t: E) -> tuple[Steps, E]:
    """Steps that count function words of the first 12,000 signs, and the gate."""
    de, en = x.col("fix_de"), x.col("fix_en")
    steps = Steps().add(fix_words=x.found(nz.ascii_fold(x.left(t, 12_000)), m.WORD), fix_umlauts=m.umlauts(t))
    steps = steps.add(fix_de=x.among(x.col("fix_words"), FIX_DE), fix_en=x.among(x.col("fix_words"), FIX_EN))
    return steps, ((de >= 3) & (de >= en)) | ((x.col("fix_umlauts") >= 1) & (de >= x.greatest(1, en)))


def response_fix() -> Steps:
    """Adds `reason` to chat records (null if kept): the first of the chain's conditions that holds."""
    said, answered = x.col("said"), x.col("answered")
    german, ok = looks_german(answered)
    parts = Steps([*chat_parts().steps, *german.steps]).add(answer_words=x.found(nz.ascii_fold(answered), m.WORD))
    n = x.length(said)
    short = (n < 48) | ~_all("users", x.length(x.col("t")) >= 8) | ~_all("assistants", x.length(x.col("t")) >= 16)
    reason = x.case(
        (~roles_ok(), "bad_role_order"),
        (x.has(x.col("asked"), CODE_HINT, True) | x.has(x.both("coalesce(category, '')"), CODE_HINT, True), "code_filtered"),
        (short, "too_short"),
        ((n > 12_000) | ~_all("assistants", x.length(x.col("t")) <= 5000), "too_long"),
        (nz.damage(said, nz.CHAT_HINTS) >= 2, "mojibake"),
        (x.has(said, CHAT_HTML, True), "html"),
        (x.has(said, BAD_PHRASE, True), "bad_phrase"),
        (x.hits(said, m.URL, True) > 1, "url_dense"),
        (x.has(answered, NO_INPUT, True), "generic_missing_input"),
        (m.repetition(x.col("answer_words"), 24) > 0.68, "repetitive"),
        (~ok, "assistant_not_german"),
        (x.has(x.sub(answered, r"\s+$"), "[-:;]$"), "truncated_assistant"),
    )
    return parts.add(reason=reason)


def prompt_category() -> Steps:
    """Adds `prompt_category` from the first user turn and the source; needs the columns of `chat_parts`."""
    first = x.two("coalesce(get(users, 0), '')", "coalesce(users[1], '')")
    steps = Steps([*chat_parts().steps]).add(first_user=nz.ascii_fold(first))
    low = x.col("first_user")
    return steps.add(prompt_category=x.case((x.contains(x.col("source"), "guard"), "hallucination_guard"), (x.contains_any(low, QUESTIONS), "qa_de"), (x.contains_any(low, ORDERS), "instruction_de"), otherwise="response_de"))


def clean_sft() -> Steps:
    """Adds `keep` to rendered chats (text, category): an allowed category, no code or links, an answer of 40 to 850 signs in nine lines."""
    t = x.col("text")
    tail = r"(?s)<\|assistant\|>\n((?:[^<]|<[^|]|<\|[^e])*)\n<\|end\|>\n?$"
    answer = x.case((x.has(t, tail), x.strip(x.two("regexp_extract({}, {}, 1)", "regexp_extract({}, {}, 1)", t, x.pattern(tail)))), otherwise=t)
    allowed = x.among(x.two("array(category)", "[category]"), SFT_KEEP) > 0
    fine = (x.length(x.col("answer")) >= 40) & (x.length(x.col("answer")) <= 850) & (x.occurrences(x.col("answer"), "\n") <= 8)
    return Steps().add(answer=answer).add(keep=allowed & ~x.contains_any(x.lower(t), SFT_BAD) & fine)


def code_file(min_stars: int = 5, least: int = 100, most: int = 20_000) -> Steps:
    """Adds `reason` and `wrapped` (the code between marks) to files (content, lang, stars)."""
    c = x.both("coalesce(content, '')")
    reason = x.case((x.both("coalesce(stars, 0)") < min_stars, "low_stars"), (x.length(c) < least, "too_short"), (x.length(c) > most, "too_long"))
    wrapped = x.two(r"concat('<|code|>[', lang, ']\n', {}, '\n<|endcode|>')", "concat('<|code|>[', lang, ']', chr(10), {}, chr(10), '<|endcode|>')", x.both("replace({}, {}, {})", c, x.two(r"'\r\n'", "chr(13) || chr(10)"), x.two(r"'\n'", "chr(10)")))
    return Steps().add(reason=reason, wrapped=wrapped)


def code_record(least: int = 200, most: int = 60_000, licenses: tuple[str, ...] = LICENSES) -> Steps:
    """Adds `reasons` (all that hold) to files (content, path, license, autogenerated, copies, line_max, line_mean)."""
    c = x.both("coalesce(content, '')")
    name = x.lower(x.both("coalesce(license, 'unknown')"))
    flags = x.flags(
        (~(x.among(x.two("array({})", "[{}]", name), licenses) > 0), "license_not_allowed"),
        (x.length(c) < least, "too_short"),
        (x.length(c) > most, "too_long"),
        (x.both("coalesce(autogenerated, false)"), "autogenerated_field"),
        (x.both("coalesce(copies, 0)") > 5, "too_many_copies"),
        (x.both("coalesce(line_max, 0)") > 300, "long_line_field"),
        (x.both("coalesce(line_mean, 0)") > 140, "high_mean_line_length"),
        (x.has(x.both("coalesce(path, '')"), VENDOR_PATH, True), "vendor_path"),
        (x.hits(c, GENERATED, True) > 0, "generated_or_compiled"),
        (x.hits(c, SECRET, True) > 0, "possible_secret"),
    )
    return Steps().add(reasons=flags)


def preference(min_score: int = 5, least: int = 80, require_code: bool = True) -> Steps:
    """Adds `reason` to answered questions (question and answer as HTML, score of the accepted answer)."""
    fenced = lambda c: nz.html_text(x.sub(x.sub(x.both(f"coalesce({c}, '')"), r"<pre[^>]*>\s*<code[^>]*>", FENCE, ci=True), r"</code>\s*</pre>", FENCE, ci=True))
    steps = Steps().add(problem=fenced("question"), accepted=fenced("answer"))
    p, a = x.col("problem"), x.col("accepted")
    code = x.contains(p, FENCE) | x.contains(a, FENCE)
    pairs = [(x.both("coalesce(score, 0)") < min_score, "low_score"), (x.length(p) < least, "short_problem"), (x.length(a) < least, "short_accepted")]
    return steps.add(reason=x.case(*pairs, *([(~code, "no_code")] if require_code else [])))


def detox_ok(threshold: float) -> E:
    """Whether a conversation (toxic, redacted, moderation: array of score structs) is neither marked nor scored above."""
    spark = " OR ".join(f"coalesce(t.{k}, 0) > {threshold}D" for k in MODERATION)
    duck = " OR ".join(f"coalesce(t.{k}, 0) > {threshold}::DOUBLE" for k in MODERATION)
    clean = x.two(f"NOT exists(coalesce(moderation, array()), t -> {spark})", f"len(list_filter(coalesce(moderation, []), lambda t: {duck})) = 0")
    return ~x.both("(coalesce(toxic, false) OR coalesce(redacted, false))") & clean


# Filters of corpora by the metadata they come with. Each adds `reason` (null if kept) and `out`, the cleaned text.


def _source(*pairs: tuple[E, str], text: E | None = None) -> Steps:
    return Steps().add(reason=x.case(*pairs), out=nz.clean_text(text if text is not None else x.both("coalesce(text, '')")))


N = x.length(x.both("coalesce(text, '')"))


def scored_web(min_score: float = 3.0, least: int = 200, most: int = 100_000) -> Steps:
    return _source((x.both("coalesce(score, 0)") < min_score, "low_education_score"), (N < least, "too_short"), (N > most, "too_long"))


def encyclopedia(least: int = 200, words: tuple[str, ...] = ("disambiguation", "begriffsklärung"), starts: tuple[str, ...] = ("list of", "liste ")) -> Steps:
    title = x.lower(x.both("coalesce(title, '')"))
    listed = x.contains_any(title, words)
    for s in starts:
        listed = listed | x.two("startswith({}, {})", "starts_with({}, {})", title, s)
    return _source((listed, "disambiguation_or_list"), (N < max(least, 500), "too_short"))


def wanted_sources(wanted: tuple[str, ...] = ("wiki", "book", "arxiv", "stack", "pes2o"), least: int = 200, most: int = 100_000) -> Steps:
    source = x.lower(x.both("coalesce(source, '')"))
    return _source(((x.length(source) > 0) & ~x.contains_any(source, wanted), "source_not_wanted"), (N < least, "too_short"), (N > most, "too_long"))


def problem_pairs() -> Steps:
    p, s = x.strip(x.both("coalesce(problem, '')")), x.strip(x.both("coalesce(solution, '')"))
    return _source(((x.length(p).eq(0)) | (x.length(s).eq(0)), "empty_fields"), text=x.both("concat('Problem: ', {}, ' Solution: ', {})", p, s))


def licensed_commons(excluded: tuple[str, ...], max_perplexity: float = 600.0, cultural_share: float = 0.3, seed: int = 42, least: int = 200, most: int = 100_000) -> Steps:
    """Cultural subsets are thinned by the hash of their ids, alike for any order of rows."""
    subset = x.lower(x.both("coalesce(subset, '')"))
    one = lambda some: x.among(x.two("array({})", "[{}]", subset), some) > 0
    unit = x.two(f"(CAST(conv(substring(md5(concat('{seed}:', CAST(doc_id AS STRING))), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D)", f"(('0x' || substring(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE)")
    pairs = [(one(excluded), "excluded_subset"), (x.both("coalesce(perplexity, 1000)") > max_perplexity, "high_perplexity"), (one(("cultural", "gutenberg", "dta")) & (unit > cultural_share), "cultural_subsampled")]
    return _source(*pairs, (N < least, "too_short"), text=x.left(x.both("coalesce(text, '')"), most))


def warned_web(least: int = 200, most: int = 100_000) -> Steps:
    return _source((x.two("size(coalesce(warnings, array())) > 0", "len(coalesce(warnings, [])) > 0"), "quality_warnings"), (N < max(least, 400), "too_short"), text=x.left(x.both("coalesce(text, '')"), most))


def plain_web(least: int = 200, most: int = 100_000) -> Steps:
    return _source((N.eq(0), "empty"), (N < least, "too_short"), (N > most, "too_long"))
