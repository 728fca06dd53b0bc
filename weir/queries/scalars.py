"""Normalisers (N), metrics (X), classifiers (C) and reject policies (F) over whole tables."""

from __future__ import annotations

from weir.functions import classify as c
from weir.functions import exprs as x
from weir.functions import metrics as m
from weir.functions import normalise as nz
from weir.functions.exprs import Steps
from weir.operators import policies as p
from weir.queries.registry import grouped, steps

T, H = x.col("text"), x.col("html")

NORMALISERS = {
    "n01_clean_text": nz.clean_text(T),
    "n02_dedup_key": nz.dedup_key_text(T),
    "n03_code_text": nz.code_text(T),
    "n04_strict_text": nz.strict_text(T),
    "n05_structured_text": nz.structured_text(T),
    "n07_ascii_fold": nz.ascii_fold(T),
    "n08_fold_accents": nz.fold_accents(T),
    "n09_punct_key": nz.punct_key(T),
    "n10_doc_text": nz.doc_text(T),
    "n11_paragraph_text": nz.paragraph_text(T),
    "n12_message_text": nz.message_text(T),
    "n13_without_control": nz.without_control(T),
    "n15_without_gutenberg": nz.without_gutenberg(T),
    "n16_forum_text": nz.forum_text(T),
    "n18_tab_indent": nz.tab_indent(T),
    "n20_without_list_marks": nz.without_list_marks(T),
    "n21_excerpt": nz.excerpt(T, 200),
    "n22_slug": nz.slug(x.col("source")),
}
for name, e in NORMALISERS.items():
    steps(name, "documents", Steps().add(out=e), "doc_id; length(out) AS n_out; md5(out) AS out_md5")
steps("n14_html_text", "pages", Steps().add(out=nz.html_text(H)), "page_id; length(out) AS n_out; md5(out) AS out_md5")
steps("n06_mojibake_score", "documents", Steps().add(score=m.mojibake_score(T)), "doc_id; CAST(score AS BIGINT) AS score")

WS, TOK, FW = x.col("ws"), x.col("toks"), x.col("fold")
BASE = Steps().add(ws=m.words(T), toks=x.spaced(T), fold=m.folded_words(T))
FOUR = "round({}, 4) AS {}"
METRICS = {
    "x01_url_density": m.url_density(TOK),
    "x02_symbol_density": m.symbol_density(T),
    "x02b_alpha_density": m.alpha_density(T),
    "x03_digit_density": m.digit_density(T),
    "x04_token_repetition": m.repetition(TOK),
    "x04b_word_repetition": m.repetition(FW, 50),
    "x05_gram_repetition": m.gram_repetition("fold", 4, 16),
    "x05b_trigram_repetition": m.gram_repetition("fold", 3, 3),
    "x06_list_score": m.list_score(T),
    "x07_language_signal": m.language_signal(WS),
    "x10_control_share": m.control_share(T),
    "x11_mean_line": m.mean_line(T),
    "x11b_long_lines": m.long_lines(T),
    "x12_most_repeated_line": m.most_repeated_line(T),
    "x15_upper_ratio": m.upper_ratio(T),
    "x15b_listish_score": p._listish(T),
}
for name, e in METRICS.items():
    steps(name, "documents", BASE.add(v=e), "doc_id; round(CAST(v AS DOUBLE), 6) AS value")

steps("x08_document_vector", "documents", c.vector(T), "doc_id; chars; n_words; n_paragraphs; n_sentences; alpha; symbol; digit; rep; signal; mean_word")
steps("x09_quality_score", "documents", c.scored(T), "doc_id; score")
steps("x13_url_chars_alpha_words", "documents", c.url_chars(T), "doc_id; round(url_chars, 6) AS url_chars; round(alpha_words, 6) AS alpha_words")
steps("x14_curator_scores", "documents", c.curator(T), "doc_id; word_count; round(non_alnum, 6) AS non_alnum; round(numbers, 6) AS numbers; round(urls, 6) AS urls; "
    "round(white, 6) AS white; round(bullets, 6) AS bullets; round(punct_lines, 6) AS punct_lines; round(symbol_words, 6) AS symbol_words; long_word; round(mean_word, 6) "
    "AS mean_word; round(with_alpha, 6) AS with_alpha; round(parens, 6) AS parens; round(ellipsis, 6) AS ellipsis; round(rep_lines, 6) AS rep_lines; "
    "round(rep_paragraphs, 6) AS rep_paragraphs; round(rep_line_chars, 6) AS rep_line_chars; round(rep_paragraph_chars, 6) AS rep_paragraph_chars; round(dup3, 6) AS "
    "dup3; round(top3, 6) AS top3")
steps("x16_oldprint_score", "documents", Steps().add(head=x.left(T, 20_000)).add(hits=x.hits(x.col("head"), p.OLDPRINT, True), breaks=x.least(x.hits(x.col("head"), p.HYPHEN_BREAK), 6)), "doc_id; "
    "CAST(hits + breaks AS BIGINT) AS score")
steps("x17_pattern_hits", "documents", Steps().add(toc=x.hits(T, m.TOC, True), biblio=x.hits(T, m.BIBLIO, True), ocr=x.hits(T, m.OCR, True), names=x.hits(T, m.NAMES), speakers=x.size(p.speaker_labels(T)), years=x.hits(T, m.YEARS)), "doc_id; "
    "toc; biblio; ocr; names; speakers; years")
steps("x18_seed_signals", "documents", c.seed(T), "doc_id; n_chars_seen; n_words; has_code; dates; citations; imperatives; opinions; numerics; round(upper_share, 6) AS "
    "upper_share; round(symbol_share, 6) AS symbol_share")

LABELS = {
    "c01_language_gate_de": (Steps([*Steps().add(norm=T).steps, *p.language_ok("german").steps]), "lang_ok"),
    "c01b_language_gate_en": (Steps([*Steps().add(norm=T).steps, *p.language_ok("english").steps]), "lang_ok"),
    "c02_looks_german": (c.looks_german(T), "german"),
    "c03_marker_language": (c.marker_language(T), "label"),
    "c04_code_language": (c.code_language(T), "label"),
    "c05_domain": (c.domain(T), "label"),
    "c06_triage": (c.triage(T), "label"),
    "c07_short_kind": (c.short_kind(T), "label"),
    "c08_seed_type": (c.seed_type(T), "label"),
    "c09_source_profile": (c.profile(x.col("source"), T), "label"),
    "c11_safety_bin": (c.safety(T), "label"),
    "c17_route": (c.route(T), "label"),
}
for name, (plan, out) in LABELS.items():
    steps(name, "documents", plan, f"doc_id; {out}")
steps("c05b_domain_flags", "documents", c.domain(T), "doc_id; flag_text")
steps("c06b_triage_flags", "documents", c.triage(T), "doc_id; flag_text")
steps("c10_profile_decision", "documents", c.decision(T), "doc_id; warn_text; drop_text")
steps("c18_secrets", "documents", Steps().add(**{k: x.has(T, v) for k, v in p.SECRETS.items()}), "doc_id; aws_access_key; private_key; github_token; generic_token")
steps("c18b_redacted", "documents", c.redacted(T), "doc_id; length(out) AS n_out; md5(out) AS out_md5")

POLICIES = {
    "f01_quality_en": p.quality("english"),
    "f01b_quality_de": p.quality("german"),
    "f01c_quality_code": p.quality("code"),
    "f02_strict_en": p.strict("english"),
    "f02b_strict_de": p.strict("german"),
    "f03_strict_math": p.strict("english", "math"),
    "f03b_strict_code": p.strict("code", "code"),
    "f03c_strict_booster": p.strict("german", "booster"),
    "f05_mix": p.mix(),
    "f06_early_mix": p.early_mix(),
    "f08_candidate": p.candidate(),
    "f10_book": p.book(),
    "f09_instruction": c.instruction(),
    "f15_answer_text": c.answer_text(),
    "f07_web_prose": c.web_prose(),
}
for name, policy in POLICIES.items():
    grouped(name, "documents", policy.steps, "source, coalesce(reason, 'kept') AS reason", "count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars")
steps("f11_code_flags", "documents", Steps([*p.code().steps.steps, {"flag_text": x.joined(x.col("flags"), ",")}]), "doc_id; flag_text")
steps("f11b_code_audit", "documents", Steps([*p.code(audit=True).steps.steps, {"flag_text": x.joined(x.col("flags"), ",")}]), "doc_id; flag_text")
