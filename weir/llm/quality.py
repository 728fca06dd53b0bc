"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated odds.

Random indexing: every word (and every word shape, its pattern of letter case, digits and signs) has a sparse random
index vector of +1 and -1, made from its hash; a word's vector is the sum of the index vectors of its neighbours and of
their shapes over the whole corpus. Words and shapes share WORDS + SHAPES hashed rows, so the vectors are one table of
fixed size, gathered by a grouped sum over all documents, and rare words still have their shape's vector. A document is
pooled: the means of its words' vectors and of its words' index vectors, their lengths (repetition shows there) and
counts. A network of HIDDEN units gives log-odds. An eighth of the examples is held back to choose the epoch, another one
to fit the temperature that calibrates them.

The network learns from at most MOST labelled documents of up to EXAMPLE_CHARS (32,768) code points, those with the smallest
id hashes, of ids whose crc32 (as text) mod FOLDS is not HELD; the vectors come from all documents' texts and from no
label. A score depends on the text alone, and every text is scored whole.

Defined cases: a null or empty text is pooled as zeros and scored all the same; with fewer than LEAST labelled texts, or
one class only, every score is the share of class 1 (0.5 without labels); null labels and ids teach nothing, an id that
is labelled twice has the larger label, and of several texts under one id the one with the smallest hash is learned
from; equal texts have equal scores; a score of exactly CUT is predicted 1; a null id is not held out; a very long text
takes memory of about 200 times its bytes; an empty table gives an empty result; repeated rows, also under one id, get a
row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import ngrams
from weir.llm import text as tx
from weir.llm.toxicity import LEAST, remainder
from weir.session import table

WORDS, SHAPES, DIM, NONZERO, HIDDEN = 1 << 13, 1 << 11, 24, 3, 24
ROWS = WORDS + SHAPES
MOST, FOLDS, HELD, CUT = 6000, 5, 0, 0.3

_KIND = np.full(256, 5, np.uint8)  # of a byte: lower, upper, digit, beyond ASCII, stop marks, other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[33, 44, 46, 58, 59, 63]] = 4


def word_rows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its text, its row, its shape's row, and its length in bytes. A shape is the word's byte kinds without repeats."""
    start, end, owner = tx.words(raw, bounds)
    word = (tx.word_hashes(raw, start, end) % np.uint64(WORDS)).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    kind = _KIND[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    step = np.where(change, kind.astype(np.int64) + 1, 0)
    # Order matters little more than what occurs: each kind's runs, capped at 3, and the last byte's kind.
    code = np.zeros(len(start), np.int64)
    for k in range(6):
        runs = np.concatenate([[0], np.cumsum(step == k + 1)])
        code = code * 4 + np.minimum(runs[end] - runs[start], 3)
    code = code * 6 + kind[end - 1] if len(start) else code
    shape = WORDS + (tx.mix(code.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    return owner, word, shape, (end - start).astype(np.float64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


PLACE, SIGN = _index_vectors()
DENSE = np.zeros((ROWS, DIM), np.float32)
for _k in range(NONZERO):
    np.add.at(DENSE, (np.arange(ROWS), PLACE[:, _k]), SIGN[:, _k])


def context_sums(raw: np.ndarray, bounds: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours and their shapes to the word's and its shape's rows."""
    owner, word, shape, _ = word_rows(raw, bounds)
    near = owner[1:] == owner[:-1]
    left, right = np.flatnonzero(near), np.flatnonzero(near) + 1
    for a, b in ((left, right), (right, left)):
        for own in (word, shape):
            for other in (word, shape):
                row, of = own[a] * DIM, other[b]
                for k in range(NONZERO):
                    total += np.bincount(row + PLACE[of, k], weights=SIGN[of, k], minlength=ROWS * DIM)


def vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(ROWS, DIM): unit word and shape vectors from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM)
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                context_sums(*tx.flat(part.column("_text")), total)
        wide = total.reshape(ROWS, DIM)
        seen = np.flatnonzero(wide.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(wide[seen, j]) for j in range(DIM))], names=["row", *(f"c{j}" for j in range(DIM))])

    sums = docs.select(F.col(text).alias("_text")).mapInArrow(run, "row long, " + ", ".join(f"c{j} double" for j in range(DIM)))
    rows = sums.groupBy("row").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(DIM))).toPandas()  # at most ROWS rows
    out = np.zeros((ROWS, DIM))
    out[rows["row"].to_numpy(np.int64)] = rows[[f"c{j}" for j in range(DIM)]].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(raw: np.ndarray, bounds: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Features of each text."""
    owner, word, shape, length = word_rows(raw, bounds)
    edge = np.searchsorted(owner, np.arange(len(bounds)))
    n = np.diff(edge).astype(float)[:, None]

    def mean(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, values.shape[1]))
        full = edge[1:] > edge[:-1]
        if full.any():
            out[full] = np.add.reduceat(values, edge[:-1][full], axis=0, dtype=np.float64)
        return out / np.maximum(n, 1)

    blocks = [mean(vec[word]), mean(vec[shape]), mean(DENSE[word]), mean(DENSE[shape])]
    norms = [np.linalg.norm(b, axis=1, keepdims=True) for b in blocks]
    same = np.zeros(len(word), np.float32)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    long = mean(np.stack([length, length**2, same], axis=1))
    return np.concatenate([*blocks, *norms, np.log1p(n), np.log1p(long[:, :1]), np.log1p(long[:, 1:2]), long[:, 2:]], axis=1)


class Network:
    """tanh layer, then log-odds over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, epochs: int = 150, rate: float = 0.01, seed: int = 3):
        self.flat = None
        if len(y) < LEAST or len(set(y.tolist())) < 2:
            self.flat = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if len(y) else 0.0
            return
        rng = np.random.default_rng(seed)
        fold = np.arange(len(x)) % 8  # the documents are in the order of their ids, not of anything a score depends on
        held, heated = fold == 3, fold == 7
        self.mean, self.std = x[~(held | heated)].mean(axis=0), x[~(held | heated)].std(axis=0) + 1e-3
        z = np.clip((x - self.mean) / self.std, -8, 8)
        weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        m1, m2, step, best = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0, (np.inf, None)
        train = np.flatnonzero(~(held | heated))
        for _ in range(epochs):
            rng.shuffle(train)
            for at in range(0, len(train), 256):
                i = train[at : at + 256]
                h = np.tanh(z[i] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - y[i]) * weight[i] / len(i)
                back = d[:, None] * self.p[2][None, :] * (1 - h * h)
                grads = [z[i].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                step += 1
                for p, g, a, b in zip(self.p, grads, m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            loss = self._loss(z[held], y[held], weight[held], 1.0)
            if loss < best[0]:
                best = (loss, [p.copy() for p in self.p])
        self.p = best[1]
        heats = np.geomspace(0.25, 8, 41)
        self.heat = float(heats[np.argmin([self._loss(z[heated], y[heated], weight[heated], t) for t in heats])])

    def _odds(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def _loss(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, heat: float) -> float:
        o = self._odds(z) / heat
        return float(np.average(np.logaddexp(0, np.where(y == 1, -o, o)), weights=weight))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            odds = np.full(len(x), self.flat)
        else:
            odds = self._odds(np.clip((x - self.mean) / self.std, -8, 8)) / self.heat
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def features(texts: list[str], vec: np.ndarray) -> np.ndarray:
    if not texts:
        return np.zeros((0, 1))
    return np.concatenate([pooled(*ngrams.as_flat(some), vec) for _, some in ngrams.chunks(texts)])


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    learn = labels.filter(remainder(key, FOLDS) != HELD)
    vec = vectors(docs, text)
    texts, y = ngrams.sample(docs, learn, label, most, key, text)
    share = learn.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    net = Network(features(texts, vec), y, share if share is not None else 0.5)

    def of(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return net(pooled(raw, bounds, vec))

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    out = slim.mapInArrow(lambda batches: ngrams.scored(batches, of, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
