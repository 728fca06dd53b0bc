import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose, rows
from weir.llm import exact_dedup, near_dedup
from weir.llm.components import components
from weir.session import Scratch


def brute_exact(pairs):
    out = {}
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-(len(t) if t else 0), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_matches_brute_force(spark, odd):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd, Scratch(spark, "t")).collect()}
    assert got == brute_exact([(r.doc_id, r.text) for r in odd.collect()])


def test_exact_keeps_one_and_all_columns(spark, odd):
    kept = exact_dedup.keep_first(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Rows under one id with other texts, wholly equal rows, and rows without an id."""
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    near = a + " more"
    data = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, near), (4, prose(24, 50)), (None, prose(25, 50)), (None, prose(26, 50)), (None, b), (5, "  " + c), (6, ""), (6, None)]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in data], "doc_id long, text string, lang string, source string"), data


def test_exact_goes_by_row(spark, shared_ids):
    df, data = shared_ids
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first(df, Scratch(spark, "t")).collect()), key=str)
    want = [data[0], data[2], data[5], data[6], data[7], data[8], data[10]]
    assert [x for x in kept if x[1]] == sorted(want, key=str) and [x[0] for x in kept if not x[1]] == [6]


def test_near_goes_by_row(spark, shared_ids):
    df, data = shared_ids
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df, Scratch(spark, "t")).collect()), key=str)
    assert kept == sorted([data[0], data[2], data[3], data[6], data[7], data[8], data[11], data[12]], key=str)
    rows_ = near_dedup.near_classes(df, Scratch(spark, "t")).collect()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows_}
    assert got[4, 57] == (1, False) and got[4, 46] == (4, True) and got[None, 46] == (None, True) and got[None, 56] == (2, False) and got[5, 56] == (3, False)
    assert len(rows_) == len(data)


def test_near_finds_links_at_the_threshold(spark):
    """Pairs between 0.80 and 0.82, in sets of 60 to 400 shingles: all of them are found."""
    r = np.random.default_rng(8)
    pairs, want = [], 0
    for k in range(400):
        n = int(r.integers(60, 400))
        words = [f"w{int(x)}" for x in r.integers(0, 10**9, n + 3)]
        edits = n // 9 - int(r.integers(0, 2))  # words at the end: each replaced word takes one shingle away
        other = words[: len(words) - edits] + [f"v{int(x)}" for x in r.integers(0, 10**9, edits)]
        a, b = shingles(" ".join(words), 4), shingles(" ".join(other), 4)
        want += 0.8 <= len(a & b) / len(a | b) < 0.82
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {i: shingles(t, 4) for i, t in pairs}
    linked = {i for i in sets if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])}
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    got = {x.doc_id for x in near_dedup.near_classes(df, Scratch(spark, "t"), k=4).collect() if x.doc_id != x.component_id}
    assert got == linked and want >= 100


def test_near_cells_hold_no_bucket(spark):
    """A bucket of many small families beside a hub: members are dealt over cells, hub members once for each block of outsiders."""
    met = spark.createDataFrame([(7, i, 0, 2600) for i in range(2600)], "key long, cid long, band byte, c long")
    comp = spark.createDataFrame([(i, 0) for i in range(1500)], "node long, comp long")
    rest = near_dedup._open_buckets(met, comp, Scratch(spark, "t"))
    assert rest.agg(F.min("c"), F.min("o"), F.count_if("row")).first() == (2600, 1100, 1100)
    sketches = spark.range(2600).select(F.col("id").alias("cid"), F.lit(9).alias("n"), F.lit(b"x").alias("regs"), F.lit(b"y").alias("bins"))
    cells = near_dedup._cells(rest, sketches)
    per = cells.groupBy("key", "i", "j").agg(F.count("*").alias("n")).collect()
    assert len(per) == 5 * 11 and max(x.n for x in per) < 2.4 * near_dedup.BLOCK
    assert cells.filter("cid < 1500").groupBy("cid").count().agg(F.max("count")).first()[0] == 5


def test_exact_empty_table(spark, empty):
    assert exact_dedup.exact_dedup(empty, Scratch(spark, "t")).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(pairs, k):
    sets = {i: shingles(t, k) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_matches_brute_force_on_odd_rows(spark, odd, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(odd, Scratch(spark, "t"), k=k).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in odd.collect()], k)


def test_near_family_of_drifting_copies(spark):
    """A family whose members are near the original, some too far from the center, some linked by a chain only."""
    r = np.random.default_rng(0)
    base = prose(9, 160).split()
    pairs = []
    for i in range(60):
        w = list(base)
        for _ in range(int(r.integers(0, 12))):
            w[int(r.integers(len(w)))] = f"edit{int(r.integers(10**6))}"
        pairs.append((100 + i, " ".join(w)))
    w = list(base)
    for i in range(12):  # each differs from the one before by two words
        for _ in range(2):
            w[int(r.integers(len(w)))] = f"drift{int(r.integers(10**6))}"
        pairs.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    got = {x.doc_id: x.component_id for x in near_dedup.near_classes(df, Scratch(spark, "t"), k=4).collect()}
    assert got == {i: c for i, (_, c) in brute_near(pairs, 4).items()}


def test_near_empty_table(spark, empty):
    assert near_dedup.near_classes(empty, Scratch(spark, "t")).count() == 0


def test_keep_one_keeps_clean_documents(spark, odd):
    kept = {r.doc_id for r in near_dedup.keep_one(odd, Scratch(spark, "t")).collect()}
    assert {1, 4, 5, 6, 9, 11, 12, 13, 14} <= kept and not kept & {3, 15}


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:800], b]))
    sk = lambda v: near_dedup.registers(v, np.array([0, len(v)]))
    assert (np.maximum(sk(x), sk(y)) == sk(np.union1d(x, y))).all()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    est = near_dedup.similarity(sk(x), sk(y), np.array([len(x)], float), np.array([len(y)], float))[0]
    assert abs(est - true) < 0.12


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, j) for j in range(101, 130)] + [(500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.comp for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{j: 100 for j in range(100, 130)}, 500: 500, 501: 500}
    assert components(df.filter(F.lit(False)), Scratch(spark, "t")).count() == 0
