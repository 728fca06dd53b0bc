import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_dedup import brute_exact, brute_near
from tests.llm.test_text import brute_contamination
from weir.llm import langid, packing
from weir.session import Scratch


def test_stages_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
        if name == "exact_dedup":
            keep = {i for i, x in brute_exact(left).items() if x[2]}
        elif name == "near_dedup":
            keep = {i for i, (_, c) in brute_near(left, 5).items() if i == c}
        elif name == "decontamination":
            keep = {i for i, x in brute_contamination(left, items).items() if not x[4]}
        else:
            keep = {i for i, t in left if t}
        left = [(i, t) for i, t in left if i in keep]
        assert sorted(r.doc_id for r in step.collect()) == sorted(i for i, _ in left), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, step, sf)
    found = pieces.toPandas()
    assert set(found.doc_id) == {i for i, _ in left}
    lib = Tokenizer.from_str(packing.vocabulary())
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for i, t in left}
    for i, own in found.sort_values("start").groupby("doc_id"):  # each id lies in exactly one piece, in order
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() == len(ids[i]) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own.ids_crc32.tolist()
    for _, own in found.sort_values("offset").groupby("sequence_id"):  # sequences are gapless and not too long
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= packing.SIZE


def test_language_stage_matches_plain_fusion(spark):
    """The documents that stay are those with letters whose fused probability, by plain arithmetic, is high enough."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()] + [(10_001, "12 34 !!", "en", "s", 8), (10_002, None, "de", "s", 0), (10_003, "e", None, "s", 1)]
    more = spark.createDataFrame(rows, docs.schema)
    langs, model = langid.learn(more)
    lik = {r.doc_id: (np.array(r.lik), r.letters) for r in langid.text_likelihood(more.withColumnRenamed("text", "_text"), langs, model, ["doc_id"]).collect()}
    host = {r[0]: r[3] for r in rows}
    hot = {i: np.eye(len(langs))[int(x.argmax())] * (n > 0) for i, (x, n) in lik.items()}
    by_host = {h: sum(hot[i] for i in host if host[i] == h) for h in set(host.values())}
    total = sum(hot.values())
    stay = set()
    for i, (x, letters) in lik.items():
        rest, own = total - hot[i], by_host[host[i]] - hot[i]
        q = (1 - langid.FLOOR) * (rest + 1) / (rest.sum() + len(langs)) + langid.FLOOR / len(langs)
        post = x + np.log((own + langid.KAPPA * q) / (own.sum() + langid.KAPPA))
        p = np.exp(post - post.max())
        if letters and (p / p.sum()).max() >= langid.ACCEPT:
            stay.add(i)
    kept = {r.doc_id for r in langid.keep_identified(more, Scratch(spark, "t")).collect()}
    assert kept == stay and not kept & {10_001, 10_002}


def test_ten_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
