"""Personal data by a semi-Markov conditional random field over whole spans, beside fixed base patterns.

The base patterns find e-mail and IP addresses, card and telephone numbers; what they find always stays. Around every
digit, at sign or spelled-out at sign the text is cut into runs of letters, digits and white space and single signs. The
random field scores candidate segments of up to LONGEST such tokens, and the whole address around an at sign however many
tokens it has, by features of the whole span (its shape, number of digits, the words before, what borders it) and a label
transition; dynamic programming over these segments chooses boundaries and types together. A segment is a candidate only
for kinds that it can be: an e-mail address has an at sign, written or spelled out; an IP address four groups of digits
of at most 255 joined by dots (plain, spaced or in brackets); a card number 14 to 19 digits that pass Luhn's check; a
telephone number 7 to 15 digits; the latter three have no letters. Spans it adds overlap no base span.

It is learned in numpy by conditional likelihood (forward and backward sums over all segmentations, SOME stretches at a
time) from base spans, at most SPANS of a document and EXAMPLES in all, in at most MOST documents of up to MOST_CHARS code
points (of documents that hold something like a base span those with the least hash in MOST classes of hashes), from
rewritten forms of these spans (other separators, spelled-out signs, no plus) and from numbers that are none of these:
dates, amounts, versions, counters, book numbers, coordinates, measured values.

Defined cases: a null text is empty and has no spans; offsets are code points, ends exclusive; equal starts are ordered
as the kinds are listed; segmentations of equal score: the one found first, shorter segments first; without any base span
in the table nothing is added; every text is searched whole, in time in proportion to its length, and a stretch of
numbers without other words between takes about 300 bytes of memory for each of its tokens; an empty table gives an empty
result; repeated rows, also under one id, get a row each; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.session import table

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# From the first digit of a run on and without giving digits back, so that runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LONGEST, FEATURES, MOST, EPOCHS = 16, 1 << 13, 300, 12
SPANS, EXAMPLES, MOST_CHARS, SOME = 4, 1200, 32_768, 32
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[\s\S]")
SPACE = re.compile(r"\s")
DOTTED = re.compile(r"[0-9]+(?:(?:\.| \. |\[\.\]|\(\.\))[0-9]+){3}")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number without sign is at most 255, however many zeros it begins with."""
    rest = digits.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and kind."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and LOCAL.match(text, start - 1):
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                end = m.end()
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str, margin: int = 24, gap: int = 24) -> list[tuple[int, int]]:
    """Stretches of text around triggers: the margin on both sides and on from there to white space, so no word is cut."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= gap:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    wide = []
    for a, b in out:
        a, b = max(0, a - margin), min(len(text), b + margin)
        floor = wide[-1][1] if wide else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        b = m.start() if (m := SPACE.search(text, b)) else len(text)
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
        else:
            wide.append((a, b))
    return wide


def _bucket(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % FEATURES


def possible(signs: str, digits: str, letters: int, spelled: bool, run: str, groups: list[str]) -> list[int]:
    """Labels (1 and on, as KINDS) that a segment can have."""
    out = [1] if "@" in signs or spelled and ("(" in signs or "[" in signs) else []
    if not letters and "@" not in signs:
        if len(groups) == 4 and DOTTED.fullmatch(run) and all(map(octet, groups)):
            out.append(2)
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(3)
        if 7 <= len(digits) <= 15:
            out.append(4)
    return out


Segment = tuple[int, list[int], list[int]]


class Lattice:
    """Tokens of a stretch, features of each as outside of any entity, and the candidate segments that start at each."""

    def __init__(self, text: str, at: int = 0):
        self.tokens = [(m[0], m.start() + at, m.end() + at) for m in TOKEN.finditer(text)]
        self.n = len(self.tokens)
        self.words = [t.lower() for t, _, _ in self.tokens]
        self.kinds = [f"d{min(len(t), 6)}" if t[0].isdigit() and t.isascii() else " " if t.isspace() else "a" if t.isalpha() else t for t, _, _ in self.tokens]
        self.last = ["^"] * (self.n + 1)  # word before each token
        for i, w in enumerate(self.words):
            self.last[i + 1] = w if w.isalpha() else self.last[i]
        self.addresses: dict[int, list[int]] = {}
        for i, j in self._addresses():
            self.addresses.setdefault(i, []).append(j)

    def outside(self, i: int) -> list[int]:
        return [_bucket("o", self.kinds[i]), _bucket("o2", self.kinds[i - 1] if i else "^", self.kinds[i])]

    def segments(self, i: int) -> list[Segment]:
        """(end, features, possible labels) of the candidates that start at token i, shorter ones first."""
        kinds, words, out = self.kinds, self.words, []
        if kinds[i] == " " or kinds[i] in ".-)]/,;:":
            return out
        digits, signs, letters, blanks, groups, spelled = "", "", 0, 0, [], False
        for j in range(i, min(self.n, i + LONGEST)):
            k = kinds[j]
            if k[0] == "d":
                digits += words[j]
                groups.append(words[j])
            elif k == "a":
                letters += 1
                spelled |= words[j] == "at"
            elif k == " ":
                blanks += 1
                if "\n" in words[j]:
                    break
            else:
                signs += k
            if len(digits) > 19:
                break
            if k == " " or k in ".-([/,;:+":
                continue
            labels = possible(signs, digits, letters, spelled, "".join(words[i : j + 1]) if len(groups) == 4 else "", groups)
            if labels:
                out.append((j + 1, self._features(i, j + 1, digits, signs, letters, blanks, groups, spelled), labels))
        there = {j for j, _, _ in out}
        for j in self.addresses.get(i, ()):
            if j not in there:
                run = list(zip(kinds[i:j], words[i:j], strict=True))
                groups = [w for k, w in run if k[0] == "d"]
                signs = "".join(k for k, _ in run if k[0] not in "da ")
                letters, blanks = sum(k == "a" for k, _ in run), sum(k == " " for k, _ in run)
                out.append((j, self._features(i, j, "".join(groups), signs, letters, blanks, groups, "at" in words[i:j]), [1]))
        return out

    def _addresses(self) -> list[tuple[int, int]]:
        """First and end tokens of the whole local part and host around each at sign, written or spelled out."""
        kinds, words, out = self.kinds, self.words, []
        for p, k in enumerate(kinds):
            if k == "@":
                i, j = p, p + 1
            elif k in ("(", "[") and words[p + 1 : p + 3] in (["at", ")"], ["at", "]"]):
                i, j = p, p + 3
                i -= i > 0 and kinds[i - 1] == " " and "\n" not in words[i - 1]
                j += j < self.n and kinds[j] == " " and "\n" not in words[j]
            else:
                continue
            left, right = i, j
            while i > 0 and (kinds[i - 1][0] in "da" or kinds[i - 1] in "._%+-"):
                i -= 1
            while j < self.n and (kinds[j][0] in "da" or kinds[j] in ".-"):
                j += 1
            while i < left and kinds[i] in ".-":
                i += 1
            while j > right and kinds[j - 1] in ".-":
                j -= 1
            if i < left and j > right:
                out.append((i, j))
        return out

    def _features(self, i: int, j: int, digits: str, signs: str, letters: int, blanks: int, groups: list[str], spelled: bool) -> list[int]:
        run = self.kinds[i:j]
        flat = "".join("d" if k[0] == "d" else k for k in run)
        before = self.kinds[i - 1] if i else "^"
        after = self.kinds[j] if j < self.n else "$"
        return [
            _bucket("s", "".join(run)),
            _bucket("c", flat),
            _bucket("n", len(digits)),
            _bucket("g", "".join(sorted(set(signs)))),
            _bucket("l", min(letters, 5), min(blanks, 5), len(digits) > 0),
            _bucket("a", before[0], after[0]),
            _bucket("k", len(groups), all(map(octet, groups)), letters > 0),
            _bucket("u", len(digits) >= 13 and luhn(digits), letters > 0, min(len(digits), 20)),
            _bucket("w", self.last[i]),
            _bucket("b", run[0][0], run[-1][0], spelled, len(digits) > 0),
            _bucket("h", signs[:1], signs.count("."), signs.count("@")),
            _bucket("z", [len(g) for g in groups[:6]]),
        ]


NEVER = -1e30
WIDTH = len(KINDS) + 1


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis=axis) + np.log(np.exp(x - m).sum(axis=axis))


def _merged(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums of the rows of equal `at` (sorted), and their `at`."""
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    m = np.maximum.reduceat(x, cut, axis=0)
    many = np.diff(np.concatenate([cut, [len(at)]]))
    return m + np.log(np.add.reduceat(np.exp(x - np.repeat(m, many, axis=0)), cut, axis=0)), at[cut]


class Batch:
    """Segments of several lattices as arrays; a lattice of n tokens has n + 1 positions."""

    def __init__(self, data: list[tuple[Lattice, dict[tuple[int, int], int]]]):
        rows, feats, masks, golds = [], [], [], []
        wide = 12
        self.first, self.final, at = [], [], 0
        self.steps = np.zeros((WIDTH, WIDTH))
        for b, (lat, gold) in enumerate(data):
            inside = {k for i, j in gold for k in range(i, j)}
            for i in range(lat.n):
                for j, f, labels in [(i + 1, lat.outside(i), [0]), *lat.segments(i)]:
                    rows.append((at + i, at + j, i, j, b))
                    feats.append(f + [FEATURES] * (wide - len(f)))
                    masks.append([0.0 if y in labels else NEVER for y in range(WIDTH)])
                    y = 0 if labels == [0] and i not in inside else gold.get((i, j), -1) if labels != [0] else -1
                    golds.append([float(k == y) for k in range(WIDTH)])
            here, prev = 0, 0
            while here < lat.n:
                to, y = next(((j, y) for (i, j), y in gold.items() if i == here), (here + 1, 0))
                self.steps[prev, y] += 1
                here, prev = to, y
            self.first.append(at)
            self.final.append(at + lat.n)
            at += lat.n + 1
        self.positions = at
        cols = np.array(rows, np.int64).reshape(-1, 5)
        order = np.lexsort((cols[:, 1], cols[:, 3]))
        self.start, self.end, self.i, self.j, self.b = cols[order].T
        self.feats, self.mask, self.gold = np.array(feats)[order], np.array(masks)[order], np.array(golds)[order]
        self.by_end = np.split(np.arange(len(order)), np.flatnonzero(self.j[1:] != self.j[:-1]) + 1)
        back = np.lexsort((self.start, -self.i))
        self.by_start = np.split(back, np.flatnonzero(self.i[back][1:] != self.i[back][:-1]) + 1)


class Field:
    """Labels 0 (outside, one token a segment) and 1.. (KINDS)."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES + 1, WIDTH))  # the last row stands for no feature
        self.t = np.zeros((WIDTH, WIDTH))
        self.fitted = False

    def sums(self, x: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of segments, forward and backward log sums by position and label, log Z of each lattice.

        The label is that of the segment that ends (forward) or of the one before that starts (backward) there.
        """
        score = self.w[x.feats].sum(axis=1) + x.mask
        fwd = np.full((x.positions, WIDTH), NEVER)
        fwd[x.first, 0] = 0
        for k in x.by_end:
            got, at = _merged(_lse(fwd[x.start[k]][:, :, None] + self.t, 1) + score[k], x.end[k])
            fwd[at] = got
        bwd = np.full((x.positions, WIDTH), NEVER)
        bwd[x.final] = 0
        for k in x.by_start:
            got, at = _merged(_lse(self.t + (score[k] + bwd[x.end[k]])[:, None, :], 2), x.start[k])
            bwd[at] = got
        return score, fwd, bwd, _lse(fwd[x.final], 1)

    def gradient(self, x: Batch) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the gold segmentations by features and transitions, and the log-likelihood."""
        score, fwd, bwd, z = self.sums(x)
        after = score + bwd[x.end] - z[x.b][:, None]
        pair = np.exp(np.minimum(fwd[x.start][:, :, None] + self.t + after[:, None, :], 0))
        miss = x.gold - pair.sum(axis=1)
        dw = np.zeros_like(self.w)
        np.add.at(dw, x.feats, miss[:, None, :])
        dw[FEATURES] = 0
        own = float((np.where(x.gold > 0, score, 0)).sum() + (x.steps * self.t).sum() - z.sum())
        return dw, x.steps - pair.sum(axis=0), own

    def fit(self, data: list[tuple[Lattice, dict[tuple[int, int], int]]], epochs: int = EPOCHS, rate: float = 0.3) -> None:
        """data: a lattice and the labels of its entity segments (by first and end token)."""
        batches = [Batch(data[at : at + SOME]) for at in range(0, len(data), SOME)]
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for _ in range(epochs):
            for x in batches:
                dw, dt, _ = self.gradient(x)
                dw -= 1e-3 * self.w
                gw += dw * dw
                gt += dt * dt
                self.w += rate * dw / np.sqrt(gw + 0.1)
                self.t += 0.2 * rate * dt / np.sqrt(gt + 0.1)
        self.fitted = True

    def best(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """The likeliest segmentation's entity segments: first token, end token, label."""
        top = np.full((lat.n + 1, WIDTH), NEVER)
        top[0, 0] = 0
        start, prev = np.zeros((lat.n + 1, WIDTH), np.int32), np.zeros((lat.n + 1, WIDTH), np.int8)
        for i in range(lat.n):
            into = top[i][:, None] + self.t
            before = into.argmax(axis=0)
            into = into[before, range(WIDTH)]
            for j, f, labels in [(i + 1, lat.outside(i), [0]), *lat.segments(i)]:
                s = self.w[f].sum(axis=0)
                for y in labels:
                    if into[y] + s[y] > top[j, y]:
                        top[j, y], start[j, y], prev[j, y] = into[y] + s[y], i, before[y]
        out, e, y = [], lat.n, int(top[lat.n].argmax())
        while e > 0:
            i, before = int(start[e, y]), int(prev[e, y])
            if y:
                out.append((i, e, y))
            e, y = i, before
        return out[::-1]


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    out: list[Span] = []
    if not field.fitted:
        return out
    held: list[list[int]] = []  # stretches that base spans cover
    for a, b, _ in sorted(base):
        if held and a <= held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    ends = [b for _, b in held]
    for a, b in regions(text):
        lat = Lattice(text[a:b], a)
        for i, j, y in field.best(lat):
            start, end = lat.tokens[i][1], lat.tokens[j - 1][2]
            k = bisect.bisect_right(ends, start)
            if k == len(held) or held[k][0] >= end:
                out.append((start, end, KINDS[y - 1]))
    return out


def _rewritten(kind: str, span: str, rng: np.random.Generator) -> str:
    """Another way to write the span that the base patterns miss."""
    digits = "".join(DIGIT.findall(span))
    k = int(rng.integers(3))
    if kind == "email":
        local, _, host = span.partition("@")
        local = local.split(".")[0] if rng.integers(2) else local
        return (f"{local} (at) {host}", f"{local} [at] {host}", f"{local}(at){host}")[k]
    if kind == "ip":
        return span.replace(".", (" . ", "[.]", "(.)")[k])
    if kind == "card":
        return (".", "/", "_")[k].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    return (f"({area}) {rest}-{end}", f"{area}-{rest}-{end}", f"{area}.{rest}.{end}")[k]


def _nothing(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    r = lambda a, b: int(rng.integers(a, b))
    forms = (
        lambda: f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}",
        lambda: f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d} {r(0, 24):02d}:{r(0, 60):02d}:{r(0, 60):02d}",
        lambda: f"{r(1, 30):02d}.{r(1, 13):02d}.{r(1900, 2100)}",
        lambda: f"{r(1, 99)},{r(100, 999)},{r(100, 999)}.{r(10, 99)}",
        lambda: f"{r(0, 2**62):x}",
        lambda: f"{r(10**6, 10 ** r(7, 16))}",
        lambda: f"{r(1, 30)}.{r(1, 13)}.{r(1900, 2100)} {r(10, 24)}:{r(10, 60)}:{r(10, 60)}",
        lambda: f"v{r(1, 9)}.{r(0, 99)}.{r(0, 999)}-{r(1000, 9999)}",
        lambda: f"{r(1, 9)}.{r(0, 99)}.{r(300, 999)}.{r(1000, 9999)}",
        lambda: f"97{r(8, 10)}-{r(0, 10)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 10)}",
        lambda: f"{r(0, 90)}.{r(10**5, 10**6)}, {r(0, 180)}.{r(10**5, 10**6)}",
        lambda: f"{r(1800, 2000)}-{r(2000, 2100)}, {r(100, 999)} pages",
        lambda: f"{r(10, 99)}/{r(1000, 9999)}/{r(10**4, 10**5)}",
        lambda: f"{r(1000, 9999)} {r(1000, 9999)} {r(1000, 9999)} {r(100, 999)}",
        lambda: " ".join(str(r(1, 999)) for _ in range(r(4, 7))),
        lambda: ", ".join(str(r(1, 9999)) for _ in range(r(3, 6))),
        lambda: f"{r(10**13, 10**14)}",
        lambda: f"0.{r(10**6, 10**12)}",
        lambda: f"#{r(10**6, 10**9)}-{r(10, 99)}",
    )
    return forms[r(0, len(forms))]()


def train(texts: list[str], seed: int = 9) -> Field:
    rng, data, field = np.random.default_rng(seed), [], Field()

    def add(left: str, span: str, right: str, label: int) -> None:
        lat = Lattice(left + span + right)
        first = next((i for i, t in enumerate(lat.tokens) if t[1] == len(left)), None)
        last = next((i + 1 for i, t in enumerate(lat.tokens) if t[2] == len(left) + len(span)), None)
        if not label:
            data.append((lat, {}))
        elif first is not None and last is not None and any(j == last and label in labels for j, _, labels in lat.segments(first)):
            data.append((lat, {(first, last): label}))

    for text in texts:
        for start, end, kind in base_spans(text)[:SPANS]:
            left, right = text[max(0, start - 24) : start], text[end : end + 24]
            if TRIGGER.search(left) or TRIGGER.search(right):
                continue
            label = KINDS.index(kind) + 1
            add(left, text[start:end], right, label)
            add(left, _rewritten(kind, text[start:end], rng), right, label)
            add(left, _nothing(rng), right, 0)
            add(left, _nothing(rng), right, 0)
    if data:
        field.fit([data[i] for i in rng.permutation(len(data))[:EXAMPLES]])
    return field


def sample(docs: DataFrame, most: int = MOST, key: str = "doc_id", text: str = "text") -> list[str]:
    """At most `most` texts with an at sign, a plus or a long number, in one pass: the least hash in each of `most` classes."""
    some = docs.filter((F.char_length(text) <= MOST_CHARS) & F.col(text).rlike(r"@[A-Za-z0-9-]+\.|\+[0-9][ ().0-9-]{8}|[0-9]{14}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))
    hashed = some.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))
    rows = hashed.groupBy(F.pmod("h", F.lit(most)).alias("class")).agg(F.min(F.struct("h", "t")).alias("m")).select("class", "m.t").collect()  # at most `most` rows
    return [r[1] for r in sorted(rows)]


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, base and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_text"):
                raw, bounds = tx.flat(part.column("_text"))
                hot = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64) | (raw == 40) | (raw == 91))])
                some = np.flatnonzero(hot[bounds[1:]] > hot[bounds[:-1]])
                base, every = [""] * part.num_rows, [""] * part.num_rows
                for i, value in zip(some.tolist(), part.column("_text").take(pa.array(some)).to_pylist(), strict=True):
                    own = base_spans(value)
                    both = sorted(own + added_spans(value, own, field), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    base[i], every[i] = _digest(own), _digest(both)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base), pa.array(every)], names=["doc_id", "base", "spans"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, "doc_id long, base string, spans string")


def redact(text: str, field: Field) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    own = base_spans(text)
    out, at = [], 0
    for a, b, k in sorted(own + added_spans(text, own, field)):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find(docs, train(sample(docs)))
    many = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *many, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def base_digest(text: str) -> str:
    return hashlib.sha256(_digest(base_spans(text)).encode()).hexdigest()
