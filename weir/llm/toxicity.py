"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the 3- to 5-byte n-grams of its lower-cased words with their borders; each n-gram's hash bucket has
an embedding, a text is the mean of its n-grams' embeddings, and a softmax over two classes follows. Embeddings and
softmax are learned together, with a decay, from a bounded sample of labelled texts (MOST documents with the smallest id
hashes, a share ONES of them toxic where there are enough, texts of CHARS code points at most, reweighted to the classes'
shares), with a quarter of it held back to choose the number of epochs. The mean is drawn towards zero by PRIOR n-grams
that say nothing. Unseen misspellings share most n-grams with what was seen. Since the model is linear after the mean,
scoring needs only each bucket's margin, which is what travels to the executors (BUCKETS floats).

Labels are taken only from documents whose crc32(id as text) mod FOLDS is not HELD; a score depends on the text alone.

Defined cases: a null or empty text has no n-grams and gets the share of the toxic class; with fewer than LEAST labelled
texts, or one class only, every score is that share (0 without labels); null labels and ids teach nothing, an id that is
labelled twice has the larger label, and of several texts under one id the one with the smallest hash is learned from;
equal texts have equal scores; a score of exactly CUT is predicted 1; a null id is not held out; every text is scored
whole, a very long one in memory of about 100 times its bytes; an empty table gives an empty result; repeated rows, also
under one id, get a row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import ngrams
from weir.session import table

LENGTHS, BUCKETS, DIM = (3, 4, 5), 1 << 18, 16
MOST, CHARS, FOLDS, HELD, CUT = 6000, 8192, 4, 2, 0.3
#: Share of toxic ones in the sample, where there are enough.
ONES = 0.25
#: Fewer labelled texts than these teach nothing but the share.
LEAST = 8
#: A text counts as if it had so many more n-grams that say nothing, which keeps very short ones near the share.
PRIOR = 200
#: Share of itself that an embedding loses at each step, so that n-grams that say nothing stay near zero.
DECAY = 0.02


def remainder(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def bags(texts: list[str], least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share of the text's n-grams), one row for each distinct bucket of a text that `least` texts have."""
    df = np.zeros(BUCKETS, np.int32)
    for at, some in ngrams.chunks(texts):
        text, bucket = ngrams.document_grams(*ngrams.as_flat(some), LENGTHS, BUCKETS)
        df += np.bincount(np.unique(text * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS).astype(np.int32)
    t, b, s = [], [], []
    for at, some in ngrams.chunks(texts):
        text, bucket = ngrams.document_grams(*ngrams.as_flat(some), LENGTHS, BUCKETS)
        both, count = np.unique(text * BUCKETS + bucket, return_counts=True)
        text, bucket = both // BUCKETS, both % BUCKETS
        part = count / (np.bincount(text, weights=count, minlength=len(some))[text] + PRIOR)
        keep = df[bucket] >= least
        t.append((text[keep] + at).astype(np.int32))
        b.append(bucket[keep].astype(np.int32))
        s.append(part[keep].astype(np.float32))
    none = [np.zeros(0, np.int32)]
    return np.concatenate(t or none), np.concatenate(b or none), np.concatenate(s or [np.zeros(0, np.float32)])


def fit(texts: list[str], y: np.ndarray, share: float, epochs: int = 30, rate: float = 0.15, seed: int = 5) -> tuple[np.ndarray, float]:
    """Margin of each bucket and the bias: the log-odds of a text are the mean margin of its n-grams plus the bias."""
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    margin = np.zeros(BUCKETS, np.float32)
    if len(y) < LEAST or len(set(y.tolist())) < 2:
        return margin, base if len(y) else -30.0
    text, bucket, part = bags(texts)
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    col = place[bucket]
    del bucket
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, base], np.float32)
    weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    held = np.arange(len(texts)) % 4 == 3
    groups = rng.integers(0, 8, len(texts))
    groups[held] = -1
    order = np.argsort(groups[text], kind="stable")  # groups lie one after the other, so that batches are views
    text, col, part = text[order], col[order], part[order]
    edge = np.searchsorted(groups[text], np.arange(9))
    own = [(np.flatnonzero(groups == g), text[a:b], col[a:b], part[a:b]) for g, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
    dev = slice(0, int(edge[0]))
    del order
    params = [emb, soft, bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    best = (np.inf, margin, base)
    for _ in range(epochs):
        for docs, t, c, s in own:
            if not len(docs):
                continue
            d = soft[:, 1] - soft[:, 0]
            score = np.bincount(t, weights=s * (emb @ d)[c], minlength=len(texts))[docs] + bias[1] - bias[0]
            delta = (1 / (1 + np.exp(-score)) - y[docs]) * weight[docs] / len(docs)
            full = np.zeros(len(texts))
            full[docs] = delta
            pull = np.bincount(c, weights=s * full[t], minlength=len(used)).astype(np.float32)  # of each bucket's mean
            hidden = pull @ emb
            grads = [pull[:, None] * d[None, :], np.stack([-hidden, hidden], axis=1), np.array([-delta.sum(), delta.sum()], np.float32)]
            step += 1
            for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            emb *= 1 - DECAY
        own_margin = emb @ (soft[:, 1] - soft[:, 0])
        offset = float(bias[1] - bias[0])
        z = np.bincount(text[dev], weights=part[dev] * own_margin[col[dev]], minlength=len(texts))[held] + offset
        loss = float(np.average(np.logaddexp(0, np.where(y[held] == 1, -z, z)), weights=weight[held]))
        if loss < best[0]:
            margin = np.zeros(BUCKETS, np.float32)
            margin[used] = own_margin
            best = (loss, margin, offset)
    return best[1], best[2]


def score(docs: DataFrame, margin: np.ndarray, offset: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score of every document."""

    def of(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total, count = ngrams.weight_sums(raw, bounds, LENGTHS, margin)
        return 1 / (1 + np.exp(-np.clip(total[:, 0] / (count + PRIOR) + offset, -30, 30)))

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return slim.mapInArrow(lambda batches: ngrams.scored(batches, of, ["doc_id"]), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    learn = labels.filter(remainder(key, FOLDS) != HELD)
    texts, y = ngrams.sample(docs, learn, label, most, key, text, CHARS, ONES)
    share = learn.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    margin, offset = fit(texts, y, share or 0.0)
    out = score(docs, margin, offset, key, text)
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
