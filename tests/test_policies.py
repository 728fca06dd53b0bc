"""Scenarios of the reject policies on hand-made rows: one text, one expected reason."""

import pytest
from pyspark.sql import functions as F

from weir.operators import policies, structure
from weir.plans.curation import Run, Source

PROSE_DE = "Die Stadt liegt an einem Fluss und hat viele alte Brücken. Wir sind mit dem Zug gefahren und haben den Tag in den Gassen verbracht. Das Wetter war gut, und die Menschen waren freundlich. Am Abend haben wir auf dem Markt gegessen, und es war nicht teuer. Ich kann die Reise empfehlen, weil man viel sehen kann und auch Ruhe findet. "
PROSE_EN = "The town lies on a river and has many old bridges that people cross on foot. We went there by train and spent a whole day in the narrow streets. It was a warm morning, and the houses along the water looked bright in the sun. You can walk for hours and still find a quiet place to rest, which is what we did. "


@pytest.fixture(scope="module")
def judge(spark):
    def run(policy, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return [r.reason for r in policies.apply(df, policy).orderBy("doc_id").collect()]

    return run


def test_quality_chain(judge):
    long = PROSE_EN
    got = judge(policies.quality("english"), long, "short", long + " accept all cookies", "http://a.b " * 60, "%&/ " * 80, "word " * 100, long + " fÃ¼r", "<|code|>[python]", "x " * 60_000)
    assert got == [None, "too_short", "boilerplate", "url_dense", "symbol_dense", "repetitive", "mojibake", None, "too_long"]


def test_strict_order_and_profiles(judge):
    de = policies.strict("german")
    assert judge(de, PROSE_DE, "kurz", PROSE_DE + " <|user|> hallo", PROSE_EN, PROSE_DE + " <div>", PROSE_DE + " in den warenkorb", PROSE_DE + " http://a "
        "http://b") == [None, "too_short", "chat_marker", "language_mismatch", "html", "web_boilerplate", "url_dense"]
    index = "Inhaltsverzeichnis Seite Kapitel " + " ".join(f"Teil {i} ..... {i * 7}" for i in range(1, 30))
    assert judge(de, index + PROSE_DE) == ["toc_or_index"]
    names = " ".join(f"Anna, Maier{i} (1850–1901)" for i in range(40))
    assert judge(de, PROSE_DE + names) == ["name_catalogue"]
    play = " ".join(f"{n}. Komm herein." for n in ["FAUST", "WAGNER"] * 12)
    assert judge(de, PROSE_DE + play) == ["dialogue_script"]
    assert judge(policies.strict("english", "math"), "Problem: What is 3 + 4? Solution: the sum of 3 and 4 is 7, and that is the answer to the problem for you. We can "
        "check it with a proof that is short and easy to see because 7 minus 4 is 3.") == [None]
    assert judge(policies.strict("german", "booster"), "Rechne: 12 + 30 = 42. Das Ergebnis ist 42.") == [None]


def test_strict_repetition(judge):
    assert judge(policies.strict("english"), "the same words and again " * 40) == ["repetitive"]


def test_mix_gates(judge):
    got = judge(policies.mix(), PROSE_DE * 2, "kurz", PROSE_DE + " <|im_end|>", PROSE_DE + " &amp; ", PROSE_DE + " gutschein", PROSE_DE + " www.x.de", PROSE_DE + " diskussion:", "1 "
        "2 3 4 5 6 7 8 9 0 " * 10)
    assert got == [None, "too_short", "chat_marker", "html_or_entity", "bad_marker", "url_dense", "wiki_talk", "low_alpha"]


def test_book_chain(judge):
    body = " ".join(f"{PROSE_EN} chapterword{i}" for i in range(4)).replace(",", "")
    got = judge(policies.book(), body, "short", body + " produced by volunteers", "Preface " + body, body + " http://x")
    assert got == [None, "too_short", "gutenberg_boilerplate", "front_back_matter", "url"]


def test_code_flags(spark):
    code = "import os\nimport sys\n"
    texts = [code * 5, "def f():\n    return 1\n" * 10, "x = 'AKIA" + "A" * 16 + "'\n" + "y = 1\n" * 20, "<filename>a/node_modules/b.js\n" + "let a = 1\n" * 20, '{"cells": [ ' + "x" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.flags) for r in policies.apply(df, policies.code()).collect()}
    assert got[0] == {"import_only"} and got[1] == set()
    assert got[2] == {"possible_secret_aws_access_key"} and got[3] == {"vendor_or_dependency_path"}
    assert {"collapsed_or_minified", "long_line_dense", "notebook_json"} <= got[4]


def test_structure_cleaner(spark):
    page = "Home\nMenu\n" + "\n".join([PROSE_DE] * 3)
    texts = [page, "", PROSE_DE + " accept all cookies", "Frage: a Antwort: b " + PROSE_DE, "Nur ein Satz, der lang genug ist hier.", PROSE_EN * 3, "Das heißt �� Ã¼ber"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in structure.clean(df).collect()}
    assert [got[i].reason for i in range(6)] == [None, "empty", "boilerplate", "template", "too_few_sentences", "language_mismatch"]
    assert got[0].paragraphs and "Home" not in got[0].structured and 0.62 <= got[0].score <= 1
    assert got[6].reason == "mojibake"


def test_damaged_texts_are_repaired_not_rejected(spark, judge):
    broken = PROSE_DE.encode().decode("latin1")
    assert judge(policies.strict("german"), broken, PROSE_DE + " Das ist \ufffd.") == [None, "mojibake"]
    got = structure.clean(spark.createDataFrame([(1, (PROSE_DE + " Größe – mit "
        "“Anführung”. ").encode().decode("cp1252", "replace").replace("\ufffd", "") * 3), (2, PROSE_DE.replace("gut", "&quot;gut&quot; &amp; "
        "sch&ouml;n") * 3), (3, "<p>" + broken * 3 + "</p>")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert '"gut" & schön' in got[1].structured and got[1].reason is None
    assert got[2].reason is None and "Brücken" in got[2].structured and "<p>" not in got[2].structured


def test_trails_are_cut(spark):
    lines = {
        "Home | A | B | Echter Text hier": "Echter Text hier",
        "Sie befinden sich hier: Startseite > X > Echter Text": "Echter Text",
        "Sie sind hier: Physik Entropie Isothermer Prozess Isothermer Prozess Zustand bleibt": "Isothermer Prozess Zustand bleibt",
        "a | b": "a | b",
        "x" * 50 + " | y | z": "x" * 50 + " | y | z",
        "You are here no trail and nothing twice": "You are here no trail and nothing twice",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in lines], "l string").select("l", structure.without_trail(F.col("l")).alias("o"))
    assert {r.l: r.o for r in df.collect()} == lines


def test_speaker_labels_begin_words(spark):
    df = spark.createDataFrame([("HAMLET. To be. aHAMLET. KING LEAR. xÄHAM. NURSE.ROMEO.",)], "text string")
    assert df.selectExpr(policies.speaker_labels(policies.T).spark + " AS s").first().s == ["HAMLET", "KING LEAR", "NURSE", "ROMEO"]


def test_report_and_samples(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else PROSE_EN, f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    rows = {r.reason: (r.docs, r.bytes) for r in policies.report(df, policies.quality("english")).collect()}
    assert rows == {"kept": (15, 15 * len(PROSE_EN)), "too_short": (15, 15)}
    assert [r.doc_id for r in policies.samples(df, policies.quality("english"), 3).orderBy("doc_id").collect()] == [1, 3, 5]


def test_run_is_idempotent_and_splits_disjointly(spark):
    df = spark.createDataFrame([(i, f"{PROSE_DE} Nummer {i % 20} und mehr.", f"s{i % 2}") for i in range(60)], "doc_id long, text string, source string")
    run = Run([Source("s0", "german"), Source("s1", "german", target_bytes=2000)])
    out = run.execute(df)
    assert out.count() == len({r.text for r in out.collect()})
    again = run.execute(out.drop("bucket", "split"))
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in out.collect())
    assert sum(r.docs for r in run.report(df).collect()) == 60
    with pytest.raises(ValueError):
        Run([]).judged(df)
