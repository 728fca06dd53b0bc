"""Near-duplicate components by SetSketch: exponentially spaced truncated minima, banded, estimated jointly, verified.

A document's set holds its distinct k-word shingles. Register i of a set is floor(1 + log_b(a / E)), with E the least of
the set's exponential hash values under the i-th hash function; with b near 1 two registers agree about as often as the
sets' similarity says, and registers of a union are the larger ones, so sketches merge. ROWS registers at a time are
hashed as bands; documents meet in a band's bucket. From each pair that meets, the similarity's likelihood given the
counts of smaller, equal and larger registers and both sizes is maximised; pairs far below the threshold go, the rest
are verified on full sets.

Copies with equal sets form a class first; only class representatives are banded. A bucket's members are first compared
with its center, the member that meets most others in all its buckets, which in a family of copies is nearest to the
original; that is one pair a member and joins most families. Only buckets whose members then lie in several components
are looked at again. There the members outside of the bucket's largest component (its hub) have their sketches compared
with those of all members, in cells of about BLOCK of the former and BLOCK of the latter, so that no task holds a large
bucket and a member of the hub is sent once for every BLOCK members outside of it. Each member outside is first linked with
its likeliest partner where that is verified; then every remaining pair of different components that agrees often enough
is verified. Sketches also hold the minima of BINS bins of the set (8 bits each), whose agreement tells pairs just below
the threshold from links more sharply than the registers do. No pair that meets in a bucket goes unexamined. The chance
that a pair of similarity s meets in no band is (1 - s^ROWS)^BANDS, 7e-6 at 0.8; that sampling error puts one exactly at the
threshold out is about 1e-5.

A key that many rows share (a bucket, a class, a component, the center of a star) is joined with a broadcast side while
that is small, else by a merge join, whose hot partitions Spark splits; it is never grouped other than by partial sums.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a text of fewer than
k words has its whole sequence as one shingle; a very long text is hashed whole, in memory of about 60 times its bytes;
rows are nodes by their own text, whatever others share their id: rows repeated under one id with the same set share
their result, those with other sets have their own; a null id is greater than none, so component_id is null only if a
component has no other id, and `kept` marks the rows that bear their component's id; of a component the row with the least
id and then the least hash of all columns is kept by `keep_one`, one only if rows repeat; an empty table gives an empty
result; extra columns are ignored. A similarity below 0.8 is refused, since the bands are laid out for more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.llm.base import MARK, NO_ID, empty, mark, quoted, small, without
from weir.llm.components import components
from weir.session import Scratch, table

ROWS, BANDS = 5, 30
M = ROWS * BANDS
BASE, RATE = 1.001, 64.0
#: Standard deviations by which a pair's estimate may fall below the threshold and still be verified.
SLACK = 4.2
BLOCK = 256
#: Bins of a set whose least values sharpen the comparison in blocks.
BINS = 1024

_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(0, 2**64, M, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, M, dtype=np.uint64)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _sets(batch: pa.RecordBatch, k: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    raw, bounds = tx.flat(batch.column(text))
    start, end, owner = tx.words(raw, bounds)
    return tx.shingles(tx.word_hashes(raw, start, end), owner, len(bounds) - 1, k)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, M) uint16; of an empty set all 0."""
    out = np.zeros((len(bounds) - 1, M), np.uint16)
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(M):
            least = tx.segment(np.minimum, values * _MUL[i] + _ADD[i], bounds, np.uint64(2**64 - 1))
            u = ((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            e = -np.log1p(-u)
            out[:, i] = np.clip(np.floor(1 + np.log(RATE / e) / np.log(BASE)), 0, 65535)
    out[bounds[1:] == bounds[:-1]] = 0
    return out


def bin_minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BINS) uint8: 0 for an empty bin, else 1 to 255 from the bin's least value."""
    n = len(bounds) - 1
    least = np.full(n * BINS, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    with np.errstate(over="ignore"):
        np.minimum.at(least, owner * BINS + (values & np.uint64(BINS - 1)).astype(np.int64), values >> np.uint64(10))
        mark = (tx.mix(least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    mark[least == np.uint64(2**64 - 1)] = 0
    return mark.reshape(n, BINS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64."""
    with np.errstate(over="ignore"):
        x = (regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _BAND
        return tx.mix(x.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity that makes the counts of smaller, equal and larger registers likeliest, given both sizes.

    With u = na / (na + nb) and v = nb / (na + nb), a register of a is the larger with probability p(u - v J) and of b
    with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b); the rest of the probability goes to equality.
    """
    up, down = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - up - down
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    most = np.minimum(1.0, np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        pu, pv = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(pu, 1e-12)) + down * np.log(np.maximum(pv, 1e-12)) + same * np.log(np.maximum(1 - pu - pv, 1e-12))

    lo, hi = np.zeros(len(a)), most.copy()
    for _ in range(40):  # the likelihood has one peak
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = value(x) < value(y)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def _fixed(x: np.ndarray, width: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x.tobytes())])


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """docs: _id, mark, _text. _id, mark, set size n, two sums that identify the set, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                value, bounds = _sets(part, k, "_text")
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    d1 = tx.segment(np.add, tx.mix(value ^ np.uint64(0x5851F42D4C957F2D)), bounds, np.uint64(0))
                    d2 = tx.segment(np.add, tx.mix(value ^ np.uint64(0x14057B7EF767814F)), bounds, np.uint64(0))
                regs = registers(value, bounds).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", *MARK)), tx.array(n.astype(np.int64)), tx.array(d1.view(np.int64)), tx.array(d2.view(np.int64)), _fixed(regs, 2 * M)],
                    names=["_id", *MARK, "n", "d1", "d2", "regs"],
                )

    return docs.mapInArrow(run, f"_id long, {MARK[0]} long, {MARK[1]} long, n long, d1 long, d2 long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("regs")))
            cid = np.repeat(tx.numbers(batch.column("cid")), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int8), len(keys))
            yield pa.RecordBatch.from_arrays([tx.array(keys.ravel()), tx.array(cid), tx.array(band)], names=["key", "cid", "band"])
            tx.trim()


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = threshold - SLACK * (threshold * (1 - threshold) / M) ** 0.5
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column("ra")), _matrix(batch.column("rb"))
                na, nb = (tx.numbers(batch.column(c)).astype(float) for c in ("na", "nb"))
                near = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (similarity(a, b, na, nb) >= low)
                yield batch.select(["u", "v", "na", "nb"]).filter(tx.array(near))
                tx.trim()

    return run


def _bin_sketches(texts: DataFrame, k: int) -> DataFrame:
    """texts: cid, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("cid"), _fixed(bin_minima(*_sets(part, k, "_text")), BINS)], names=["cid", "bins"])

    return texts.mapInArrow(run, "cid long, bins binary").dropDuplicates(["cid"])


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """texts: cid, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                value, bounds = _sets(part, k, "_text")
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.ListArray.from_arrays(tx.array(bounds.astype(np.int32)), tx.array(value.view(np.int64)))], names=["cid", "s"])

    return texts.mapInArrow(run, "cid long, s array<long>")


class _Verifier:
    """Pairs (u, v) of classes -> those with the threshold or more, on full sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, held: DataFrame, scratch: Scratch, k: int, percent: int):
        self.docs, self.reps, self.held, self.scratch, self.k, self.percent = docs, reps, held, scratch, k, percent

    def texts(self, nodes: DataFrame) -> DataFrame:
        """cid and _text of the classes `nodes` (cid), from the row that stands for each (repeated rows: several)."""
        wanted = self.scratch.put(self.reps.join(small(nodes), "cid").select("cid", *MARK), "wanted")
        return self.docs.join(small(wanted), MARK).select("cid", "_text")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        r = self.reps
        first = r.select(F.col("cid").alias("u"), F.col("n").alias("na"), F.col("regs").alias("ra")).join(small(pairs), "u")
        both = first.join(r.select(F.col("cid").alias("v"), F.col("n").alias("nb"), F.col("regs").alias("rb")).transform(small, of=self.held), "v")
        likely = self.scratch.put(both.select("u", "v", "na", "nb", "ra", "rb").mapInArrow(_likely(self.percent / 100), "u long, v long, na long, nb long"), "likely")
        ids = self.scratch.put(likely.select(F.col("u").alias("cid")).unionByName(likely.select(F.col("v").alias("cid"))).distinct(), "ids")
        sets = self.scratch.put(_full_sets(self.texts(ids), self.k).dropDuplicates(["cid"]), "sets")
        of = lambda c: small(sets.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")), of=sets)
        got = likely.join(of("u"), "u").join(of("v"), "v")
        met = F.size(F.array_intersect("su", "sv")).cast("long")
        out = self.scratch.put(got.select("u", "v", (F.lit(100) * met).alias("x"), (F.lit(self.percent) * (F.col("na") + F.col("nb") - met)).alias("y")).filter("x >= y").select("u", "v"), "links")
        self.scratch.drop(likely, ids, sets)
        return out


def _blocks(threshold: float, best: bool):
    """Rows sorted by (key, i, j) -> pairs of an outsider and a member of another component whose sketches agree often enough.

    A cell (i, j) of a bucket holds some of its members outside of the hub (`row`) and some of all members. best: of each
    outsider only the pair that agrees most often in the cell. Else a pair is examined in the first band it meets in only.
    The minima of bins are a sample without replacement of the union, nearly all of it for small sets, and their
    agreement varies the less.
    """
    least = int(threshold * M - SLACK * (M * threshold * (1 - threshold)) ** 0.5)

    def pairs(row: np.ndarray, cid: np.ndarray, comp: np.ndarray, band: int, n: np.ndarray, regs: np.ndarray, bins: np.ndarray) -> list[np.ndarray]:
        outside, every = np.flatnonzero(row), np.flatnonzero(~row)
        if not len(outside) or not len(every):
            return []
        is_out = np.isin(cid[every], cid[outside])  # two outsiders of one cell meet once
        low = (regs & 0xFF).astype(np.uint8)
        out = []
        for at in range(0, len(outside), 64):
            here = outside[at : at + 64]
            agree = np.concatenate([(low[here][:, None, :] == low[every[a : a + 512]][None, :, :]).sum(axis=2, dtype=np.int16) for a in range(0, len(every), 512)], axis=1)
            ok = (agree >= least) & (comp[here][:, None] != comp[every][None, :])
            if best:
                y = np.where(ok, agree, -1).argmax(axis=1)
                x = np.flatnonzero(ok[np.arange(len(here)), y])
                y = y[x]
            else:
                ok &= ~is_out[None, :] | (cid[here][:, None] < cid[every][None, :])
                x, y = np.nonzero(ok)
            for a in range(0, len(x), 1024):
                p, q = here[x[a : a + 1024]], every[y[a : a + 1024]]
                if not best:
                    first = (regs[p] == regs[q]).reshape(len(p), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    p, q = p[first], q[first]
                some = np.count_nonzero(bins[p] | bins[q], axis=1)
                same = np.count_nonzero((bins[p] == bins[q]) & (bins[p] > 0), axis=1)
                left = np.maximum(1 - some * (1 + threshold) / (n[p] + n[q]), 0.05)
                near = same >= threshold * some - SLACK * np.sqrt(1.5 * left * some * threshold * (1 - threshold))
                out.append(np.stack([cid[p[near]], cid[q[near]]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark_ = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                held.clear()
                col = lambda c: tx.numbers(t.column(c))
                regs, bins = _matrix(t.column("regs")), np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
                found = pairs(col("row"), col("cid"), col("comp"), int(col("band")[0]), col("n"), regs, bins)
                if found:
                    uv = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([tx.array(uv[0]), tx.array(uv[1])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, j = (tx.numbers(batch.column(c)) for c in ("key", "i", "j"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
                if mark_ != (k[a], i[a], j[a]):
                    yield from flush()
                    mark_ = (k[a], i[a], j[a])
                held.append(batch.slice(a, b - a))
        yield from flush()
        tx.trim()

    return run


def _classes(sk: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: n, d1, d2, cid, mark of the row that stands for them, regs; and the written table they read.

    cid is that row's id or, where several classes have it, a hash of the set's sums.
    """
    held = scratch.put(sk.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(_last_null(F.struct(*MARK))).alias("rep"), F.first("regs").alias("regs")).select("n", "d1", "d2", "rep.mark.*", "regs"), "classes")
    shared = held.groupBy(MARK[0]).agg(F.count("*").alias("c")).filter((F.col("c") > 1) | (F.col(MARK[0]) == NO_ID)).select(MARK[0], F.lit(True).alias("shared"))
    shared = scratch.put(shared, "shared")
    if empty(shared):
        return held.withColumn("cid", F.col(MARK[0])), held
    return held.join(small(shared), MARK[0], "left").withColumn("cid", F.when(F.col("shared"), F.xxhash64("n", "d1", "d2")).otherwise(F.col(MARK[0]))).drop("shared"), held


def _open_buckets(met: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets that lie in several components: key, band, cid, comp, row (outside of the hub), c and o (members, outsiders)."""
    named = met.filter("c > 2").join(small(comp.withColumnRenamed("node", "cid"), of=comp), "cid", "left").select("key", "c", "band", "cid", F.coalesce("comp", "cid").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("m"))
    hubs = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("hub"), F.sum("m").alias("c"), F.count("*").alias("many")).filter("many > 1")
    hubs = scratch.put(hubs.select("key", F.col("hub.comp").alias("hub"), "c", (F.col("c") - F.col("hub.m")).alias("o")), "hubs")
    return named.drop("c").join(small(hubs), "key").withColumn("row", F.col("comp") != F.col("hub")).drop("hub")


def _cells(rest: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members dealt over the cells of their buckets, with their sketches: everyone as a column, outsiders also as rows."""
    many = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("cid"), many(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), many(c) - 1))
    dealt = rest.join(small(sketches), "cid")
    kept = ["key", "band", "cid", "comp", "n", "regs", "bins"]
    columns = dealt.select(*kept, F.lit(False).alias("row"), own("c").alias("j"), every("o").alias("i"))
    rows = dealt.filter("row").select(*kept, F.lit(True).alias("row"), own("o").alias("i"), every("c").alias("j"))
    return columns.unionByName(rows).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def judged(docs: DataFrame, scratch: Scratch, k: int, percent: int, key: str, text: str) -> DataFrame:
    """One row for each document: _id, mark, n, the class's id and mark (low_), and the component's (best_; null without links)."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    docs = docs.select(F.col(quoted(key)).cast("long").alias("_id"), *mark(docs, key), F.col(quoted(text)).alias("_text"))
    sk = scratch.put(sketch(docs, k), "sketch")
    reps, held = _classes(sk, scratch)
    bands = scratch.put(reps.select("cid", "regs").mapInArrow(_bands, "key long, cid long, band byte"), "bands")
    counts = scratch.put(bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    met = scratch.put(bands.join(small(counts), "key"), "met")
    scratch.drop(bands, counts)
    score = scratch.put(met.groupBy("cid").agg(F.sum("c").alias("score")), "score")
    center = F.max(F.struct("score", (-F.col("cid")).alias("m"))).alias("best")
    centers = scratch.put(met.join(small(score), "cid").groupBy("key").agg(center).select("key", (-F.col("best.m")).alias("center")), "centers")
    verify = _Verifier(docs, reps, held, scratch, k, percent)
    starred = met.join(small(centers), "key").filter("cid <> center")
    tested = scratch.put(starred.select(F.least("cid", "center").alias("u"), F.greatest("cid", "center").alias("v")).distinct(), "tested")
    scratch.drop(score, centers)
    links = verify(tested)
    made, linked = [held, tested], [links]
    comp = scratch.put(components(links, scratch), "comp")
    sketches = None
    for best in (True, False):  # buckets that do not yet lie in one component
        rest = scratch.put(_open_buckets(met, comp, scratch), "rest")
        if empty(rest):
            break
        if best:  # what is open later is open now
            nodes = scratch.put(rest.select("cid").distinct(), "nodes")
            bins = scratch.put(_bin_sketches(verify.texts(nodes), k), "bins")
            sketches = scratch.put(reps.join(small(nodes), "cid").select("cid", "n", "regs").join(small(bins), "cid"), "sketches")
            scratch.drop(bins, nodes)
        fresh = _cells(rest, sketches).mapInArrow(_blocks(percent / 100, best), "u long, v long").distinct()
        for old in made[1:]:  # what was tested before
            fresh = fresh.join(small(old), ["u", "v"], "left_anti")
        fresh = scratch.put(fresh, "fresh")
        more = None if empty(fresh) else verify(fresh)
        made.append(fresh)
        if more is not None and not empty(more):
            linked.append(more)
            links = links.unionByName(more)
            old, comp = comp, scratch.put(components(links, scratch), "comp")
            scratch.drop(old)
        scratch.drop(rest)
    scratch.drop(met, sketches)
    member = reps.select("cid", F.struct(*MARK).alias("own")).join(small(comp.withColumnRenamed("node", "cid"), of=comp), "cid")
    first = scratch.put(member.groupBy("comp").agg(F.min(_last_null(F.col("own"))).alias("best")), "first")
    named = reps.select("n", "d1", "d2", "cid", F.struct(*MARK).alias("low")).join(small(comp.withColumnRenamed("node", "cid").join(small(first), "comp").select("cid", "best"), of=comp), "cid", "left")
    named = scratch.put(named.select("n", "d1", "d2", "low", F.col("best.mark").alias("best")), "named")
    scratch.drop(*made, *linked, comp, first)
    return sk.select("_id", *MARK, "n", "d1", "d2").join(small(named), ["n", "d1", "d2"], "left").drop("d1", "d2")


def _last_null(own: Column) -> Column:
    """A mark in the order of ids, those without an id last."""
    return F.struct((own[MARK[0]] == NO_ID).alias("none"), own.alias("mark"))


def _number(node: Column, id_: Column) -> Column:
    """The id of a mark, that of the row itself without one; null for the mark of a null id."""
    got = node[MARK[0]]
    return F.when(node.isNull(), id_).when(got != NO_ID, got)


def near_classes(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept, class_id (smallest id with an equal set)."""
    found = judged(docs, scratch, k, percent, key, text)
    class_id = _number(F.col("low"), F.col("_id"))
    component = _number(F.coalesce("best", "low"), F.col("_id"))
    return found.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), class_id.alias("class_id"))


def keep_one(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each near-duplicate component."""
    found = judged(docs, scratch, k, percent, key, text).filter("low IS NOT NULL")
    own = scratch.put(found.select(*MARK, (F.struct(*MARK) == F.coalesce("best", "low")).alias("stays")), "verdicts")
    dropped = scratch.put(own.filter("NOT stays").select(*MARK).distinct(), "dropped")
    twins = scratch.put(own.filter("stays").groupBy(*MARK).agg(F.count("*").alias("c")).filter("c > 1").select(*MARK), "twins")
    return without(docs, dropped, key, twins)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), Scratch(spark, "near"), k=4).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
         ELSE list_transform(range(1, len(l) - 2), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * p.c >= 80 * (x.c + y.c - p.c)),
r AS (SELECT DISTINCT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.v, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = d.doc_id
"""
