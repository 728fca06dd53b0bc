"""Record schemas, gates, knowledge, plans, writers and evaluation on hand-made rows."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import evaluate, gates, generate, knowledge, plan, retrieve, segment, signals
from weir.sources import readers, remote, schemas, sinks
from weir.streaming import controller

DE = "Das ist eine Antwort, und sie ist nicht zu kurz, weil wir es so wollen."


def chats(spark, *rows):
    return spark.createDataFrame([(i, [r for r, _ in t], [c for _, c in t], cat, src) for i, (t, cat, src) in enumerate(rows)], "i int, roles array<string>, contents "
        "array<string>, category string, source string")


def test_response_fix_chain(spark):
    ask = ("user", "Was ist ein Fluss und woher kommt er?")
    talk = lambda *turns, cat="talk": (list(turns), cat, "mix")
    rows = {
        None: talk(("system", "s"), ask, ("assistant", DE)),
        "bad_role_order": talk(("assistant", DE), ask),
        "code_filtered": talk(("user", "Schreibe python code bitte"), ("assistant", DE)),
        "too_short": talk(("user", "Was?"), ("assistant", DE)),
        "too_long": talk(ask, ("assistant", DE * 100)),
        "html": talk(ask, ("assistant", DE + " <div>")),
        "bad_phrase": talk(ask, ("assistant", DE + " knowledge cutoff")),
        "url_dense": talk(ask, ("assistant", DE + " http://a www.b")),
        "generic_missing_input": talk(ask, ("assistant", "Bitte sende mir zuerst deinen Text. " + DE)),
        "repetitive": talk(ask, ("assistant", "das ist nicht gut " * 12)),
        "assistant_not_german": talk(ask, ("assistant", "This is the answer that you asked for, and it is not short at all.")),
        "truncated_assistant": talk(ask, ("assistant", DE + " Dazu gehört:")),
        "mojibake": talk(ask, ("assistant", DE + " Â Ã 日本")),
    }
    got = [r.reason for r in gates.response_fix().spark(chats(spark, *rows.values())).orderBy("i").collect()]
    assert got == list(rows)
    repaired = gates.response_fix().spark(chats(spark, talk(ask, ("assistant", (DE + " Größe.").encode().decode("latin1"))))).first()
    assert repaired.reason is None and repaired.answered.endswith("Größe.")
    cats = gates.prompt_category().spark(chats(spark, ([("user", "x")], "c", "guard_2"), ([("user", "Erkläre mir das")], "c", "a"), ([("user", "Wer ist "
        "da?")], "c", "a"), ([("user", "Hm")], "c", "a"), ([], "c", "a")))
    assert [r.prompt_category for r in cats.orderBy("i").collect()] == ["hallucination_guard", "instruction_de", "qa_de", "response_de", "response_de"]


def test_members_and_speeches_from_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        "<DOCUMENT><MDB><ID> 11 </ID><NAMEN><NAME><NACHNAME>Muster</NACHNAME><VORNAME>Eva</VORNAME><AKAD_TITEL>Dr.</AKAD_TITEL></NAME><NAME><NACHNAME>Alt</NACHNAME></NAME></NAMEN>"
        "<BIOGRAFISCHE_ANGABEN><GEBURTSDATUM>1.2.1960</GEBURTSDATUM><GEBURTSORT>Ulm</GEBURTSORT><BERUF>Ärztin</BERUF><PARTEI_KURZ>X</PARTEI_KURZ><VITA_KURZ>Kurz "
            "&lt;b&gt;und&lt;/b&gt; gut</VITA_KURZ></BIOGRAFISCHE_ANGABEN>"
        "<WAHLPERIODEN><WAHLPERIODE><WP>19</WP><WKR_NAME>Ulm</WKR_NAME></WAHLPERIODE><WAHLPERIODE><WP>18</WP></WAHLPERIODE></WAHLPERIODEN></MDB><MDB><ID>12</ID></MDB></DOCUMENT>",
        encoding="utf-8",
    )
    got = {r.id: r for r in schemas.members(spark, str(tmp_path / "m.xml")).collect()}
    assert got["11"].nachname == "Muster" and [m.wp for m in got["11"].mandate] == ["19", "18"] and got["11"].mandate[0].wkr_name == "Ulm"
    assert got["11"].text == "Politiker: Dr. Eva Muster\nPartei: X\nGeboren: 1.2.1960 in Ulm\nBeruf: Ärztin\nWahlperioden: 18, 19\nKurz und gut"
    assert got["12"].mandate == [] and got["12"].text.startswith("Politiker:")
    long = "Meine Damen und Herren, " * 4
    (tmp_path / "p.xml").write_text(
        f"<dbtplenarprotokoll wahlperiode='20' "
            f"sitzung-nr='7'><sitzungsverlauf><tagesordnungspunkt><rede><p><redner><name><vorname>Eva</vorname><nachname>Muster</nachname><fraktion>X</fraktion></name></redner></p><p>{long}</p><p>Ende.</p></rede><rede><p>kurz</p></rede></tagesordnungspunkt></sitzungsverlauf></dbtplenarprotokoll>",
        encoding="utf-8",
    )
    (talk,) = schemas.speeches(spark, str(tmp_path / "p.xml")).collect()
    assert (talk.wp, talk.sitzung, talk.redner, talk.fraktion, talk.text) == ("20", "7", "Eva Muster", "X", f"{long.strip()}\nEnde.")


def test_schemas(spark):
    pairs = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nHuman: c?\n\nAssistant: good", "\n\nHuman: c?\n\nAssistant: bad"), ("no marks", None)], "chosen string, rejected string")
    assert [(r.user, r.preferred, r.rejected) for r in schemas.dialogue_pairs(pairs).collect()] == [("c?", "good", "bad"), ("", "no marks", "")]
    nested = spark.createDataFrame([("T", [{"context": "C", "qas": [{"id": "1", "question": "Q", "answers": [{"text": "A"}]}, {"id": "2", "question": "R", "answers": []}]}])], "title "
        "string, paragraphs array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>")
    assert [(r.id, r.answers) for r in schemas.nested_reading(nested).collect()] == [("1", ["A"]), ("2", [])]
    trees = spark.createDataFrame([("prompter", "hi"), ("assistant", "ho"), (None, None)], "role string, text string")
    assert [(r.user, r.preferred, r.category) for r in schemas.message_trees(trees).collect()] == [("hi", "", "prompter"), ("", "ho", "assistant"), ("", "", "unknown")]
    bad = spark.createDataFrame([(None, "b", "t", None)], "goal string, behavior string, target string, category string")
    assert schemas.harmful_requests(bad).first().asDict() == {"source": "harmful_requests", "kind": "harmful_request", "user": "b", "preferred": "", "rejected": "t", "category": "harmful"}
    case = spark.createDataFrame([(7, "AG", None, "2020", ["1/2", "3/4"], None, "x" * 9000, None)], "k int, courtType string, documentType string, decisionDate string, "
        "fileNumbers array<string>, ecli string, body string, documentNumber string")
    got = schemas.grounded(case, "caselaw", "k").first()
    assert (got.documentType, got.fileNumbers, len(got.body), got.raw_id) == ("?", "1/2, 3/4", 8000, "case_7")
    person = spark.createDataFrame([("9", "Muster", "zu viel")], "id string, nachname string, other string")
    assert json.loads(schemas.grounded(person, "politician", "id").first().record) == {"nachname": "Muster"}
    with pytest.raises(ValueError):
        schemas.grounded(person, "unknown", "id")


def test_folders_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.lines(spark.createDataFrame([("a",)], "text string"), path)
    broken = spark.createDataFrame([("b",)], "text string").select(F.raise_error(F.col("text")).cast("string").alias("text"))
    with pytest.raises(Exception, match="b"):
        sinks.lines(broken, path)
    assert [r.value for r in spark.read.text(path).collect()] == ["a"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.lines(spark.createDataFrame([("c",)], "text string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["c"]


def test_splits_bins_and_manifests(spark, tmp_path):
    one, two = (spark.createDataFrame([(t,) for t in ts], "text string") for ts in (["a\nb", " "], ["ä"]))
    assert sinks.concatenated([one, two], str(tmp_path / "all")) == {"output_file": str(tmp_path / "all"), "docs": 2, "bytes": 7}
    docs = spark.createDataFrame([(2, [7]), (0, [5, 6]), (1, [])], "doc long, tokens array<int>")
    assert sinks.token_pair(docs, str(tmp_path / "t"), end=9) == {"docs": 2, "tokens": 5}
    assert np.fromfile(tmp_path / "t.bin", "<u4").tolist() == [5, 6, 9, 7, 9] and np.fromfile(tmp_path / "t.idx", "<i8").tolist() == [0, 3, 3, 2]
    back = readers.token_bins(spark, str(tmp_path / "t.bin"), str(tmp_path / "t.idx"))
    assert {r.doc: r.tokens for r in back.collect()} == {0: [5, 6, 9], 1: [7, 9]}
    at = str(tmp_path / "run")
    sinks.start_run(spark, at, {"lr": 0.1, "path": tmp_path}, {"seed": 1}, note="x")
    got = sinks.end_run(spark, at, "done", {"step": 10})
    assert got["status"] == "finished" and got["config"] == {"lr": 0.1, "path": str(tmp_path)} and got["note"] == "x" and got["final_state"] == {"step": 10}
    assert sinks.end_run(spark, str(tmp_path / "other"), "lost", {})["exit_reason"] == "lost"


def test_scans(spark, tmp_path):
    (tmp_path / "c.txt").write_text("def f(x): return 1\nfn main() {}\nplain words\n")
    assert sorted(r.lang for r in readers.plain_lines(spark, str(tmp_path / "c.txt")).collect()) == ["python", "rust", "unknown"]
    rows = spark.createDataFrame([(i * 7,) for i in range(20)], "k long")
    want = spark.createDataFrame([(1,), (3,), (99,)], "line_no long")
    assert sorted((r.k, r.line_no) for r in readers.numbered(rows, ["k"], want).collect()) == [(0, 1), (14, 3)]
    good, bad = tmp_path / "a.json.gz", tmp_path / "b.json.gz"
    good.write_bytes(gzip.compress(b'{"text": "x"}\n'))
    bad.write_bytes(gzip.compress(b'{"text": "y"}\n' * 500)[:30])
    paths = [str(good), str(bad), str(tmp_path / "c.json.gz")]
    assert {(r.path.rsplit("/", 1)[1], r.why) for r in remote.lost_shards(spark, paths[:2]).collect()} == {("b.json.gz", "damaged")}


def test_plans(spark):
    planned = spark.createDataFrame([("de", "a", 10, 2.0), ("de", "b", 10, 2.0), ("en", "c", 1, 1.0)], "language string, name string, target_tokens long, bytes_per_token double")
    files = spark.createDataFrame([("a", 3, 20), ("b", 1, 5)], "name string, lines long, bytes long")
    assert {r.name: (r.status, r.bytes) for r in plan.budgets(planned, files, strict=False).collect()} == {"a": ("ok", 20), "b": ("short", 5), "c": ("missing", 0)}
    with pytest.raises(ValueError, match="b: short, c: missing"):
        plan.budgets(planned, files)
    assert plan.rank_window(0, 100, 1, 3, 10) == (33, 66) and plan.rank_window(5, 9, 0, 1, 100) == (5, 9)
    with pytest.raises(ValueError):
        plan.rank_window(0, 30, 0, 3, 10)
    with pytest.raises(ValueError):
        plan.available(planned, files, ["name"], skip_missing=False)
    slices = spark.createDataFrame([("x", 0, 20)], "name string, start long, end long")
    with pytest.raises(Exception, match="too small"):
        plan.rank_windows(slices, 4, 10).collect()
    with pytest.raises(ValueError, match="no rows"):
        plan.by_preset(spark.createDataFrame([("t", "s")], "text string, source string"), [plan.Preset("other", "german")])
    with pytest.raises(ValueError):
        generate.evaluation_windows(spark, 10, 20, 1, 0)
    tail = generate.evaluation_windows(spark, 1000, 9, 50, 3, "tail", 100).collect()
    assert all(900 <= r.low and r.high == r.low + 10 <= 1000 for r in tail)


def test_knowledge_blocks_and_calibration(spark):
    entry = ("Alb", "ein Gebirge", ["Es ist hoch."], [], [], ["Berg"], "atlas", [("Was?", "Berg", "fact", [], []), ("Was "
        "noch?", "Fels", "definition", [], []), ("Meer?", "Nein", "counterfact", [], [])])
    e = knowledge.blocks(spark.createDataFrame([entry], knowledge.ENTRY)).first()
    assert e.plain == "Alb: ein Gebirge\nEs ist hoch.\nVerwandte Begriffe: Berg."
    assert e.tagged.startswith("<memory>\nTyp: knowledge_dna\nBegriff: Alb\nDefinition: ein Gebirge\nFakten:\n- Es ist hoch.\nVerwandte Begriffe: Berg\nQuelle: "
        "atlas\n</memory>\n\n<recall>\nBegriff: Alb\nFrage: Was?")
    assert e.hybrid.count("<recall>") == 2 and "Meer?" in e.hybrid and "Was noch?" not in e.hybrid
    labels = spark.createDataFrame([("Was ist die Hauptstadt von Peru?", ["lima"], "capital", "KNOWN"), ("Wer ist X?", None, "invented", "UNKNOWN"), ("Was ist "
        "Y?", ["y"], "other", "SHAKY"), ("Wer schrieb 'Faust'?", ["goethe"], "work", "KNOWN")], "q string, gold array<string>, cat string, label string")
    none = spark.createDataFrame([], "text string, source string")
    anchors = spark.createDataFrame([("gut", "qa"), ("denk", "reasoning_de"), ("<tool:x>", "qa")], "text string, source string")
    rows = knowledge.calibration(labels, none, anchors).collect()
    assert sorted(r.source for r in rows) == ["anchor", "calib_abstain", "calib_confident", "calib_confident"]
    said = " ".join(r.text for r in rows)
    assert "Die Hauptstadt von Peru ist Lima." in said and "'Faust' wurde von Goethe geschrieben." in said and {r.split for r in rows} == {"train"}


def test_annotation_tries_again_and_counts(spark, tmp_path):
    calls = tmp_path / "calls"

    def ask(prompts):
        with open(calls, "a") as f:
            f.write("x")
        if calls.stat().st_size == 1:
            raise RuntimeError("busy")
        return [{"text": p.upper(), "tokens_in": 10, "tokens_out": 5} for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, text string").coalesce(1)
    got = generate.annotated(df, ask, "k", "text", done=df.filter("k = 2"), price_in=1.0, price_out=2.0).collect()
    assert [(r.k, r.answer, r.tries, r.error, r.cost) for r in got] == [(1, "A", 2, None, 20 / 1e6)]

    def never(prompts):
        raise RuntimeError("down")

    lost = generate.annotated(df, never, "k", "text", tries=2)
    assert [(r.answer, r.tries, r.error) for r in lost.collect()] == [(None, 2, "RuntimeError: down")] * 2
    assert generate.spent(lost).first().failed == 2


def test_evaluation(spark):
    probes, results = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x")], "id long, answer string")
    with pytest.raises(ValueError, match="2"):
        evaluate.probe_results(probes, results)
    one = spark.createDataFrame([("de", 2.0, 10, 40)], "lang string, loss double, tokens long, bytes long")
    assert evaluate.bits_per_byte(one).first().gap == 1.0
    df = spark.createDataFrame([("Bewertung: 3 ... Bewertung: 5",), ("etwa 4 von 9",), ("12 34",), (None,)], "t string")
    assert [r.s for r in df.select(evaluate.parsed_score("t").alias("s")).collect()] == [5, 4, None, None]
    asked = spark.createDataFrame([("beste gpu",), ("katze",), ("wer da",), ("Ein ganzer Satz ist lang",), ("a, b",), ("",)], "t string")
    assert [r.q for r in asked.select(retrieve.rewritten("t").alias("q")).collect()] == ["Was ist Beste GPU?", "Was ist Katze?", "wer da", "Ein ganzer Satz ist lang", "a, b", ""]
    turns = spark.createDataFrame([("op_1: hi there bob: yo empty: ",), ("no marks",)], "t string").select(segment.author_turns("t").alias("a")).collect()
    assert [(t.author, t.text) for t in turns[0].a] == [("op_1", "hi there"), ("bob", "yo")] and turns[1].a == []


def test_alert_stream_matches_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, i % 3, float(v)) for i, v in enumerate(r.uniform(0, 100, 120))]
    df = spark.createDataFrame(rows, "event_id long, run long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = controller.alert_stream(stream, "run", "value", 80, 3, 1.9).writeStream.format("memory").queryName("alerts_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {x.event_id: (x.streak, x.alert) for x in signals.alerts(df, "run", "event_id", "value", 80, 3, 1.9).collect()}
    assert {x.event_id: (x.streak, x.alert) for x in spark.table("alerts_out").collect()} == want
