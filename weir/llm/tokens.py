"""Ids of whole texts by the tokenizers library, which encodes each distinct piece of text once.

Where a text has no doubled, leading or trailing white space, a byte-level BPE never joins what a single space or line
feed separates (the space goes with the word after it), and a BPE that drops white space never joins two words. So such
texts are cut there, the library encodes distinct pieces only, and a table from 64-bit hashes of pieces to id runs gives
the rest; all other texts go to the library whole. Where the tokenizer's own pattern parts letters, digits and other signs,
pieces are cut there as well, so that a word is encoded once whatever stands around it; runs of letters, which no other
step of the tokenizer changes but lower-casing, go straight to its merges. The table is emptied when it holds MOST pieces, which bounds its
memory to about 60 MB; it grows beyond that for a slice of texts with more new pieces, in proportion to their length. (Two different pieces would have to share a 64-bit hash within one table for an id to be wrong.)
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weir.llm import text as tx

MOST = 1_000_000
_BYTE_SEP = np.zeros(256, bool)
_BYTE_SEP[[0x20, 0x0A]] = True
_ODD = np.zeros(256, bool)  # white space and the like, which send a text to the library whole
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_WIDE = "[\x85\xa0  -     　]"
_WIDE_NEXT = re.compile(f"{_WIDE}[ \\n]|[ \\n]{_WIDE}")
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF, letters but for two
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.zeros(256, np.uint8)  # 0: white space, or beyond ASCII
_LETTER, _DIGIT, _SIGN, _QUOTE = 1, 2, 3, 4
_KIND[:0x80] = _SIGN
_KIND[tx.SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE
#: Kinds of two neighbours (8 * first + second) between which _PATTERN parts always; an apostrophe may go with the letters after it.
_PARTS = np.zeros(64, bool)
_PARTS[[8 * a + b for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if (a != b or a == _DIGIT) and not (a == _QUOTE and b == _LETTER) and not (a >= _SIGN and b >= _SIGN)]] = True
#: Code points that byte-level tokenizers write for bytes, but for the space.
_VISIBLE = np.arange(256, dtype="<u2")
_VISIBLE[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 324)
_VISIBLE[0x20] = 0x20
_WIDE_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def load(path: str) -> str:
    """The file's content, which travels to executors with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class _Table:
    """64-bit keys (not 0) to numbers 0, 1, ... in order of insertion; open addressing, whole arrays at a time, at most half full."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.values, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        last = len(self.keys) - 1
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys & np.uint64(last)).astype(np.int64)
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (held != 0)
            left, slot = left[go], (slot[go] + 1) & last
        return out

    def add(self, keys: np.ndarray) -> None:
        """New, distinct keys."""
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            full = self.keys != 0
            old, values = self.keys[full], self.values[full]
            slots = 1 << int(2 * self.n - 1).bit_length()
            self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._put(old, values)
        self._put(keys, number)

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        last = len(self.keys) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]
            won = np.zeros(len(keys), bool)
            won[free] = self.keys[slot[free]] == keys[free]
            self.values[slot[won]] = number[won]
            keys, number, slot = keys[~won], number[~won], (slot[~won] + 1) & last


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy half as large again that holds n."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """mode: 'byte' (a space belongs to the word after it) or 'word' (white space is dropped, letter case as well)."""

    def __init__(self, spec: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.mode = Tokenizer.from_str(spec), mode
        self.between = "\n" if mode == "byte" else " \x01 "
        self.mark = self._raw([self.between])[0][0]
        self.merges = self._merges() if mode == "word" else None
        self._clear()

    def _merges(self):
        """A tokenizer with the same model, for words of lower-case letters; none if the spec does other things to them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        normal, before = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        split, level = before if len(before) == 2 else ({}, {})
        known = normal.get("normalizers") == _NORMAL and split.get("type") == "Split" and split["pattern"] == {"Regex": _PATTERN} and split["behavior"] == "Removed" and split["invert"]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not (known and suffix and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]):
            return None
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = CharDelimiterSplit(" ")
        return out

    def _clear(self) -> None:
        self.table, self.held = _Table(), 0
        self.starts, self.lens, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces (none holds what stands between them), many to a call, and each piece's start and number of ids."""
        ends, runs, held = [], [], 0
        pieces = [p.decode("utf-8", "replace") for p in pieces]
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            run = np.array(self._raw([self.between.join([*some, ""])])[0], np.uint32)
            if (run == self.mark).sum() != len(some):
                run = np.array([x for ids in self._raw(some) for x in [*ids, self.mark]], np.uint32)
            ends.append(np.flatnonzero(run == self.mark) + held)
            runs.append(run)
            held += len(run)
        ends = np.concatenate(ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
        return np.concatenate(runs), starts, ends - starts

    def _lettered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of letters only, without the steps that leave these as they are."""
        runs = []
        try:
            for at in range(0, len(words), 256):
                text = b" ".join(words[at : at + 256]).decode("utf-8").lower()
                seen = text if text.isascii() else _VISIBLE[np.frombuffer(text.encode("utf-8"), np.uint8)].tobytes().decode("utf-16-le")
                runs += [np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast([seen], add_special_tokens=False)]
        except UnicodeDecodeError:
            return self._marked(words)
        run = np.concatenate(runs)
        ends = np.flatnonzero(self.last[run]) + 1
        if len(ends) != len(words) or ends[-1] != len(run):  # a letter without an id
            return self._marked(words)
        starts = np.concatenate([[0], ends[:-1]])
        return run, starts, ends - starts

    def _learn(self, keys: np.ndarray, run: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        """Keep the ids of new pieces."""
        n, held = self.table.n, self.held + len(run)
        self.starts = _room(self.starts, n + len(keys))
        self.lens = _room(self.lens, n + len(keys))
        self.pool = _room(self.pool, held)
        self.starts[n : n + len(keys)], self.lens[n : n + len(keys)] = starts + self.held, lens
        self.pool[self.held : held] = run
        self.held = held
        self.table.add(keys)

    def _cut(self, raw: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words cut further where _PATTERN parts: starts, ends and text numbers of pieces, and the places of bytes that are no letters."""
        kind = _KIND[raw]
        at = np.flatnonzero(raw[:-1] == _LATIN)
        after = raw[at + 1]
        at = at[(after >> 6 == 2) & (after != 0x97) & (after != 0xB7)]
        kind[at] = kind[at + 1] = _LETTER
        first, final = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        first[1:] = _PARTS[kind[:-1] << 3 | kind[1:]]
        final[:-1] = first[1:]
        first[start] = final[end - 1] = True
        start = np.flatnonzero(first)
        return start, np.flatnonzero(final) + 1, np.searchsorted(bounds, start, "right") - 1, np.flatnonzero(kind != _LETTER)

    def _whole(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the texts that must go to the library whole."""
        data, bad = raw.tobytes(), np.zeros(len(bounds) - 1, bool)

        def mark(places: np.ndarray) -> None:
            bad[np.searchsorted(bounds, places, "right") - 1] = True

        if b"<|" in data:
            mark(np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)))
        if self.mode == "word":
            if b"\x01" in data:
                mark(np.flatnonzero(raw == 1))
            return np.flatnonzero(bad)
        mark(np.flatnonzero(_ODD[raw]))
        sep = _BYTE_SEP[raw]
        mark(np.flatnonzero(sep[:-1] & sep[1:]))
        full = bounds[1:] > bounds[:-1]
        bad[full] |= sep[bounds[:-1][full]] | sep[bounds[1:][full] - 1]
        if any(x in data for x in _WIDE_BYTES):
            for i in np.flatnonzero(~bad):
                own = data[bounds[i] : bounds[i + 1]]
                if any(x in own for x in _WIDE_BYTES) and _WIDE_NEXT.search(own.decode("utf-8", "replace")):
                    bad[i] = True
        return np.flatnonzero(bad)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in a row and the texts' bounds in them."""
        if self.table.n > MOST:
            self._clear()
        raw, bounds = tx.flat(column)
        n = len(bounds) - 1
        whole = self._whole(raw, bounds) if len(raw) else np.zeros(0, np.int64)
        start, end, owner = tx.words(raw, bounds, _BYTE_SEP if self.mode == "byte" else tx.SPACE)
        if self.merges and len(start):
            start, end, owner, other = self._cut(raw, bounds, start, end)
        key = tx.word_hashes(raw, start, end, fold=self.mode == "word") if len(start) else np.zeros(0, np.uint64)
        if len(whole):
            easy = np.ones(n, bool)
            easy[whole] = False
            keep = easy[owner]
            start, end, owner, key = start[keep], end[keep], owner[keep], key[keep]
        line = np.zeros(len(start), bool)
        if self.mode == "byte":
            follows = start > bounds[owner]
            before = raw[np.maximum(start - 1, 0)]
            spaced = follows & (before == 0x20)
            line = follows & (before == 0x0A)
            with np.errstate(over="ignore"):
                key = np.where(spaced, tx.mix(key + np.uint64(0xA5A5)), key)
            start = start - spaced
        key[key == 0] = 1
        code = self.table.find(key)
        if (missing := code < 0).any():
            new, first = np.unique(key[missing], return_index=True)
            at = np.flatnonzero(missing)[first]
            data, one, two = raw.tobytes(), start[at], end[at]
            letters = np.searchsorted(other, one) == np.searchsorted(other, two) if self.merges else np.zeros(len(at), bool)
            for own, encode in ((letters, self._lettered), (~letters, self._marked)):
                if own.any():
                    self._learn(new[own], *encode([data[a:b] for a, b in zip(one[own].tolist(), two[own].tolist(), strict=True)]))
            code[missing] = self.table.find(key[missing])
        lens = self.lens[code].astype(np.int64)
        size = lens + line  # a line feed before a word is an id of its own
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        where = np.repeat(self.starts[code] - stop + lens, size) + np.arange(total)
        if line.any():
            feeds = (stop - size)[line]
            where[feeds] = 0
            flat = self.pool[where]
            flat[feeds] = self.mark
        else:
            flat = self.pool[where] if total else np.zeros(0, np.uint32)
        count = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
        if not len(whole):
            return flat, np.concatenate([[0], np.cumsum(count)])
        texts = [t or "" for t in column.take(tx.array(whole)).to_pylist()]
        own = {int(i): np.array(ids, np.uint32) for i, t in zip(whole, texts, strict=True) for ids in self._raw([t])}
        edge = np.concatenate([[0], np.cumsum(count)])
        runs = [own[i] if i in own else flat[edge[i] : edge[i + 1]] for i in range(n)]
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])


_encoders: dict[tuple[int, int, str], Encoder] = {}


def encoder(spec: str, mode: str) -> Encoder:
    """One for each Python worker."""
    key = (len(spec), zlib.crc32(spec.encode()), mode)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, mode)
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], spec: str, mode: str, end: int, text: str = "_text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, their texts' ids in a row with `end` after each text, and the texts' bounds in them."""
    for batch in batches:
        encode = encoder(spec, mode)
        for part in tx.parts(batch, text):
            ids, bounds = encode(part.column(text))
            out = np.insert(ids, bounds[1:], np.uint32(end))
            yield part, out, bounds + np.arange(len(bounds))


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
