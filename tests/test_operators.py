"""Operators on small tables, with invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.operators import contains, dedup, execute, mix, retrieve, scoring, segment, signals


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_first_wins_and_cross_dataset(spark):
    d = docs(spark, ["A b", "a  B", "c", "a b", "d"])
    assert sorted(r.doc_id for r in dedup.first_by(d, dedup.text_key("text"), ["doc_id"]).collect()) == [0, 2, 4]
    ref = docs(spark, ["c" * 300, "a b"])
    fresh = docs(spark, ["C" * 300, "a b", "new"])
    assert sorted(r.doc_id for r in dedup.against(fresh, ref).collect()) == [1, 2]  # short references are not indexed
    got = {r.doc_id: r.matched for r in dedup.attributed(fresh, ref.withColumn("rank", F.col("doc_id")), "rank").collect()}
    assert got == {0: 0, 1: 1, 2: None}


def test_first_wins_keeps_the_first_row_without_a_key(spark):
    d = docs(spark, ["a b", None, "A b", None, "c"])
    for key in (dedup.text_key("text"), dedup.prefix_key("text"), dedup.code_key("text")):
        assert {1} == {r.doc_id for r in dedup.first_by(d, key, ["doc_id"]).collect() if r.text is None}
    assert sorted(r.doc_id for r in dedup.first_by(d, dedup.text_key("text"), ["doc_id"]).collect()) == [0, 1, 4]


def test_stratified_sample_has_rows_without_language(spark, tmp_path):
    from weir.queries import mixing

    spark.createDataFrame([(i, None if i % 2 else "en") for i in range(400)], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.lang for r in mixing.t05(spark, str(tmp_path)).collect()]
    assert 40 < got.count(None) < 120 and 5 < got.count("en") < 45


def test_caps_and_last_write(spark):
    d = spark.createDataFrame([(i, "k" if i < 7 else "l") for i in range(9)], "id long, k string")
    assert sorted(r.id for r in dedup.capped(d, F.col("k"), 3, ["id"]).collect()) == [0, 1, 2, 7, 8]
    w = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k long, t long, v string")
    assert {(r.k, r.v) for r in dedup.last_write(w, ["k"], ["t"]).collect()} == {(1, "c"), (2, "z")}


def test_running_sums_of_any_order(spark):
    """One group with all rows, one far outlier, texts as order, ties and nulls."""
    rows = [(i if i else 10**15, f"k{i % 37:03d}", "a" if i % 50 else None, i % 7) for i in range(500)]
    df = spark.createDataFrame([*rows, (None, None, "a", 3)], "n long, t string, g string, v int")
    for order, by in ((["n"], []), (["n"], ["g"]), (["t", "n"], ["g"]), (["t", "n"], [])):
        out = contains.running(df, order, {"s": F.col("v"), "r": F.lit(1)}, by, totals=True, quantiles=4, cells=8).collect()
        low = lambda x: (x is not None, x)
        sums = {}
        for r in sorted(out, key=lambda r: [low(r[c]) for c in order]):
            s, n = sums.get(tuple(r[c] for c in by), (0, 0))
            assert (r.s, r.r) == (s, n), (order, by, r)
            sums[tuple(r[c] for c in by)] = (s + r.v, n + 1)
        assert all((r.s_total, r.r_total) == sums[tuple(r[c] for c in by)] for r in out) and len(out) == 501
    assert contains.running(df.limit(0), ["n"], {"s": F.col("v")}).count() == 0


def test_near_against_is_exact(spark):
    r = np.random.default_rng(4)
    base = [f"w{x}" for x in r.integers(0, 500, 60)]
    texts = []
    for k in range(30):
        t = list(base)
        for _ in range(k // 4):
            t[int(r.integers(60))] = f"n{r.integers(10**6)}"
        texts.append(" ".join(t))
    a, b = docs(spark, texts[::2]), docs(spark, texts[1::2])

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(i, j) for i, x in enumerate(texts[::2]) for j, y in enumerate(texts[1::2]) if len(sets(x) & sets(y)) >= 0.85 * len(sets(x) | sets(y))}
    found = {(r.a, r.b) for r in dedup.near_against(a, b).collect()}
    of = [{r.id: r.cid for r in dedup.set_classes(d).collect()} for d in (a, b)]
    assert {(i, j) for i in of[0] for j in of[1] if (of[0][i], of[1][j]) in found} == want
    assert len(found) < len(want) and all(of[0][i] == i and of[1][j] == j for i, j in found)


def test_containment_joins(spark):
    d = docs(spark, ["xx the quick brown fox jumps over it yy", "The Quick\nbrown fox jumps over it", "prefixthe quick brown fox jumps over itsuffix", "none", "x "
        "Yabcdefghijklmnopqrstuv z", "a leftmostpart rightmostparts"])
    items = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "short"), (3, "unrelated sentence of some "
        "length"), (4, "abcdefghijklmnopqrstu"), (5, "leftmostpart rightmostpart")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in contains.contained(d, items).collect()) == [(1, 0), (1, 1), (1, 2), (4, 4), (5, 5)]
    assert sorted((r.item_id, r.doc_id) for r in contains.anchored(d, items.filter("item_id < 4")).collect()) == [(1, 0), (1, 1), (1, 2)]


def test_prefix_sums_and_intervals(spark):
    d = spark.createDataFrame([(i * 3, i % 5 + 1) for i in range(500)], "k long, n long")
    got = {r.k: r.before for r in contains.prefix_sums(d, "k", "n", "before").collect()}
    total = 0
    for i in range(500):
        assert got[i * 3] == total
        total += i % 5 + 1
    spans = contains.spans(d, "k", "n")
    points = spark.createDataFrame([(p,) for p in (0, 1, 700, total - 1, total)], "p long")
    hit = {r.p: r.k for r in contains.interval_join(points, "p", spans, "lo", "hi", width=8).collect()}
    assert set(hit) == {0, 1, 700, total - 1} and hit[0] == 0 and hit[1] == 3


def test_budgets(spark):
    d = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["aaaa", "bbbb", "cccc"])], "i long, s string, text string")
    size = F.octet_length("text") + 1
    keep = lambda n, **k: [r.i for r in mix.budget(d, n, ["s"], ["i"], size, **k).orderBy("i").collect()]
    assert keep(10) == [0, 1] and keep(1) == [0] and keep(1, at_least_one=False) == []


def test_splits_are_stable(spark):
    d = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.b for r in d.select(mix.bucket(F.col("k")).alias("b")).collect()][0] == 250
    many = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in mix.bernoulli(many, 0.3, 1, "doc_id").collect()}
    assert a == {r.doc_id for r in mix.bernoulli(many.repartition(7), 0.3, 1, "doc_id").collect()} and 500 < len(a) < 700
    r = mix.reservoir(many.withColumn("g", F.col("doc_id") % 3), 10, ["g"], 5, "doc_id")
    assert r.groupBy("g").count().filter("count <> 10").count() == 0


def test_segments(spark):
    d = spark.createDataFrame([(1, "One sentence that is long enough. Two is also long enough here! no. " * 12)], "i long, text string")
    p = d.select(segment.paragraphs("text").alias("p")).first().p
    assert all(len(x) <= 1100 for x in p) and " ".join(p).count("One sentence") == 12
    code = "junk\n<|code|>[Python]\na = 1\n<|endcode|>\n<|code|>[rust]\nfn x\nlast"
    got = spark.createDataFrame([(code,)], "t string").select(segment.code_documents("t").alias("c")).first().c
    assert [(x.lang, x.text) for x in got] == [("python", "a = 1"), ("rust", "fn x\nlast")]
    b = spark.createDataFrame([("a\nb\n\n\nc\n \nd",)], "t string").select(segment.blocks("t").alias("b")).first().b
    assert b == ["a b", "c", "d"]


def test_chat_round_trip_and_order(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (2, 0, "assistant", "A"), (3, 0, "user", "U"), (3, 1, "user", "U"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes")]
    c = segment.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    ok = {r.conv_id: r.ok for r in c.select("conv_id", segment.order_ok("messages").alias("ok")).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: True}
    text = {r.conv_id: r.t for r in c.select("conv_id", segment.rendered("messages").alias("t")).collect()}
    assert text[4] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"
    mask = c.filter("conv_id = 1").select(segment.answer_mask("messages").alias("m")).first().m
    assert [text[1][x.start : x.end] for x in mask] == ["S", "U", "A"] and [x.learn for x in mask] == [False, False, True]


def test_ridge_matches_numpy(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(200, 5)), r.normal(size=200)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(200)], "i long, v array<double>, y double")
    one = np.concatenate([x, np.ones((200, 1))], axis=1)
    keep = np.diag([2.0] * 5 + [0.0])
    assert np.allclose(scoring.ridge(df, "v", "y", 2.0), np.linalg.solve(one.T @ one + keep, one.T @ y))
    assert df.select(scoring.unit("v").alias("u")).filter("abs(aggregate(u, 0D, (a, b) -> a + b * b) - 1) > 1e-9").count() == 0


def test_bm25_ranks_the_matching_document(spark):
    d = docs(spark, ["the red fox", "the blue whale swims", "red red red paint", "nothing"])
    q = spark.createDataFrame([(1, "blue whale"), (2, "red")], "item_id long, text string")
    p, n = retrieve.index(d)
    top = {(r.item_id, r["rank"]): r.doc_id for r in retrieve.search(q, p, n, 2).collect()}
    assert top[(1, 1)] == 1 and top[(2, 1)] == 2 and top[(2, 2)] == 0


def test_signals(spark):
    v = [1.0, 2.0, 60.0, 70.0, 80.0, 1.0, 90.0]
    s = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)], "run string, step long, value double")
    streak = [r.streak for r in signals.runs(s, "run", "step", F.col("value") > 50).orderBy("step").collect()]
    assert streak == [0, 0, 1, 2, 3, 0, 1]
    alerts = [r.alert for r in signals.alerts(s, "run", "step", "value", 50, 3, 2.0).orderBy("step").collect()]
    assert alerts[4] == "STOP" and alerts[6] == "WARN"
    assert signals.slope(s, "run", "step", "value").first().slope == pytest.approx(np.polyfit(range(7), v, 1)[0])
    e = v[0]
    for x in v[1:]:
        e = 0.3 * x + 0.7 * e
    assert s.groupBy("run").agg(F.collect_list("value").alias("v")).select(signals.ema(F.col("v")).alias("e")).first().e == pytest.approx(e)


def test_python_scalars(spark):
    assert execute.folded("Éclair Straße!") == "eclair strasse"
    assert execute.parses("x = 1") and not execute.parses("x =")
    for code, want in (("2 * (3 + 4) ** 2", "98"), ("```python\nprint(sqrt(16), max(2, 3))\n7 // 2\n```", "4 3\n3"), ("round(2 * pi, 3)", "6.283"), ("sum([1, 2, 3]) % "
        "4", "2"), ("factorial(5) - -1", "121")):
        assert execute.calculated(code) == want
    for code in ("__import__('os')", "1/0", "x = 1", "", "2 ** 5000", "factorial(9999)", "'a' * 3", "pow(2, 99999)", "open('x')", "abs(x=1)", "True + 1"):
        assert execute.calculated(code) is None, code
    df = spark.createDataFrame([("Ärger & Café", "1+1", "x = (", "python"), (None, None, None, None), ("", "y", "<filename>a.py\nx = "
        "1", "python"), ("", "", "Text\n```py\nz = 2\n```", "de")], "t string, a string, c string, l string")
    code = execute.python_part(F.col("c"), F.col("l"))
    got = df.select(execute.fold(F.col("t")).alias("f"), execute.evaluate(F.col("a")).alias("v"), code.alias("c"), execute.python_ok(code).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("arger cafe", "2", "x = (", False), (None, None, None, None), ("", None, "x = 1", True), ("", None, "z = 2\n", True)]


def test_programs_run_against_tests(spark):
    tests = '[{"args": [2, 3], "expected": 5}]'
    rows = [(1, "def add(a, b):\n    return a + b", "add", tests), (2, "def add(a, b):\n    return a - b", "add", tests), (3, "def add(a, b):\n    while True: "
        "pass", "add", tests), (4, "import os\ndef add(a, b): return 5", "add", tests), (5, "def other(): pass", "add", tests), (6, None, None, None), (7, "def f(x):\n   "
        " return x == [True, None]", "f", '[{"args": [[true, null]], "expected": true}]')]
    got = execute.verified(spark.createDataFrame(rows, "id long, code string, entrypoint string, tests string"), seconds=2).collect()
    assert {r.id: r.outcome for r in got} == {1: "pass", 2: "mismatch", 3: "timeout", 4: "refused", 5: "error", 6: "refused", 7: "pass"}
