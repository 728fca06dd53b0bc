"""Sources, sinks and streams on temporary files."""

import gzip
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from weir.operators import policies
from weir.sources import readers, sinks
from weir.streaming import controller


def test_line_and_json_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\r\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "x", "n": 1}\nnot json\n\n{"text": "y"}\n')
    assert sorted(r.text for r in readers.lines(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two"]
    good, bad = readers.jsonl(spark, str(tmp_path / "b.jsonl.gz"), "text string, n int")
    assert sorted((r.text, r.n) for r in good.collect()) == [("x", 1), ("y", None)] and bad.count() == 1
    assert readers.detect(spark, str(tmp_path / "b.jsonl.gz")).count() == 2


def test_document_readers(spark, tmp_path):
    (tmp_path / "c.txt").write_text("<|code|>[python]\na = 1\n<|endcode|>\n<|code|>[Rust]\nfn x")
    assert sorted((r.lang, r.text) for r in readers.code_documents(spark, str(tmp_path / "c.txt")).collect()) == [("python", "a = 1"), ("rust", "fn x")]
    (tmp_path / "r.txt").write_text("<reponame>me/x\nprint(1)\n<reponame>me/y\nprint(2)")
    assert sorted((r.repo, r.code.strip()) for r in readers.repositories(spark, str(tmp_path / "r.txt")).collect()) == [("me/x", "print(1)"), ("me/y", "print(2)")]
    (tmp_path / "d.txt").write_text("a\nb\n\nc")
    assert [(r.block, r.text) for r in readers.blocks(spark, str(tmp_path / "d.txt")).orderBy("block").collect()] == [(0, "a b"), (1, "c")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.xml", "<p>" + "word " * 80 + "</p>")
        z.writestr("b.txt", "short")
    assert [r.name for r in readers.archives(spark, str(tmp_path / "z.zip")).collect()] == ["a.xml"]
    (tmp_path / "m.xml").write_text("<root><MDB><ID>1</ID><NAME>A</NAME></MDB><MDB><ID>2</ID><NAME>B</NAME></MDB></root>")
    assert {(r.ID, r.NAME) for r in readers.xml(spark, str(tmp_path / "m.xml"), "MDB", "ID long, NAME string").collect()} == {(1, "A"), (2, "B")}


def test_manifest_validation(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("abc")
    good = hashlib.sha256(b"abc").hexdigest()
    m = spark.createDataFrame([("x/a.txt", 3, good), ("b.txt", 1, good)], "path string, size_bytes long, sha256 string")
    assert {r.path: r.problem for r in readers.checked(spark, str(tmp_path / "a.txt"), m).collect()} == {"a.txt": None, "b.txt": "missing"}
    wrong = spark.createDataFrame([("a.txt", 3, "0")], "path string, size_bytes long, sha256 string")
    assert readers.checked(spark, str(tmp_path / "a.txt"), wrong).first().problem == "hash"


def test_token_bins(spark, tmp_path):
    np.array([5, 6, 2, 7, 2], "<u4").tofile(tmp_path / "t.bin")
    np.array([[0, 3], [3, 2]], "<i8").tofile(tmp_path / "t.idx")
    docs = readers.token_bins(spark, str(tmp_path / "t.bin"), str(tmp_path / "t.idx"))
    assert {r.doc: r.tokens for r in docs.collect()} == {0: [5, 6, 2], 1: [7, 2]}
    sinks.token_bins(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).orderBy("k").collect()
    assert [(r.offset, r.n) for r in back] == [(0, 3), (3, 2)] and b"".join(bytes(r.ids) for r in back) == np.array([5, 6, 2, 7, 2], "<u4").tobytes()


def test_sinks_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\nb", "de"), (2, "c", "en")], "doc_id long, text string, lang string")
    sinks.lines(d, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a b", "c"]
    sinks.jsonl(d, str(tmp_path / "j"), gzip=True, by="lang")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    m = sinks.manifest(policies.apply(d, policies.quality("english")))
    assert m == {"docs_in": 2, "docs_written": 0, "bytes_written": 0, "dropped": {"too_short": 2}}
    sinks.write_manifest(m, d, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == m
    assert "| too_short | 2 |" in sinks.manifest_markdown(m)


def test_log_points_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("step=10 loss=2.5 lr=1e-3\nnoise\nstep: 20 loss: 2.0\n")
    want = {(10, "loss", 2.5), (10, "lr", 0.001), (20, "loss", 2.0)}
    assert {tuple(r) for r in readers.log_points(spark.read.text(str(tmp_path / "logs"))).collect()} == want
    q = readers.log_points(spark.readStream.text(str(tmp_path / "logs"))).writeStream.format("memory").queryName("points").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("points").collect()} == want


def events(spark):
    return spark.createDataFrame([(i, i % 3, float((i * 37) % 100)) for i in range(90)], "event_id long, user_id long, value double")


def test_controller_batch_and_stream_agree(spark, tmp_path):
    e = events(spark)
    want = {}
    for user in range(3):
        state = (0, 0, [])
        for i in range(user, 90, 3):
            state, what = controller.advance(state, float((i * 37) % 100))
            want[i] = (state[0], what)
    assert {r.event_id: (r.stage, r.decision) for r in controller.staged(e, "user_id", ["event_id"], "value").collect()} == want
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = controller.stream(s, "user_id", "value").writeStream.format("memory").queryName("stages").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.event_id: (r.stage, r.decision) for r in spark.table("stages").collect()} == want


def test_windows_and_bounded_dedup(spark, tmp_path):
    e = spark.createDataFrame([(i, "a", float(i)) for i in range(48)], "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(86_400 + F.col("event_id") * 1800))
    e = e.unionByName(e.limit(5))
    e.coalesce(1).write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "w"))
    q = controller.deduplicated(s, "event_id").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 48
    q = controller.windows(s).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("hours").agg(F.sum("n"), F.count("*")).first()
    assert got[1] >= 20 and got[0] == 2 * got[1] + 5


def test_paged_source_resumes(spark, monkeypatch):
    import os
    from pathlib import Path

    from weir.sources import remote

    root = str(Path(__file__).resolve().parents[1])
    monkeypatch.setenv("PYTHONPATH", f"{root}:{os.environ.get('PYTHONPATH', '')}")
    df = remote.paged(spark, "tests.fake_service:page", 4, "id long, text string", done=[1])
    assert sorted((r.page, r.id) for r in df.collect()) == [(p, p * 10 + i) for p in (0, 2, 3) for i in range(3)]


def test_blobs_and_shards(spark, tmp_path):
    from weir.sources import remote

    m = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", False, False)], "blob_id string, is_vendor boolean, is_generated boolean")
    got = remote.blobs(m, lambda k: None if k == "c" else f"text {k}".encode())
    assert [(r.blob_id, r.text) for r in got.collect()] == [("a", "text a")]
    (tmp_path / "s1.json").write_text('{"text": "x"}\n')
    assert remote.shards(spark, [str(tmp_path / "s1.json")], "text string").count() == 1


def test_resumable_append(spark, tmp_path):
    from weir.sources import remote

    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        s = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
        remote.append_resumable(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 90
