"""Main text of pages by deducing the template of each host from equivalence classes of tokens.

A page is a run of tags and texts. Elements that are closed on the page are its tokens, an opening and a closing one, told
apart by their role: the path of elements above them, each with its class, id and role and numbered among its like. Inline
elements, void ones and those left open are no tokens.

1. Classes. Tokens of a host that share an occurrence vector (the pages they stand on) form an equivalence class. Vectors
   are compared by their size and two sums of page hashes, so classes come from one grouped aggregation, whatever a
   host's size. Only tokens on at least half of the host's pages count, at most twice the tokens of an average page.
2. Order and nesting. A second pass reads each class's tokens in page order; a class whose order differs on more than a
   twentieth of its pages is not valid. An opening token and its closing one span an element, so spans of valid classes
   nest, and the nested classes are the host's template.
3. Slots lie between consecutive template tokens. For each slot the same pass counts its different contents: `fresh` is
   the text of those, `total` that of all pages. The main element is the one whose own slots and whose leaves' slots hold
   the most fresh text: menus, adverts and notices are shorter or repeat. It is widened to the element around it if all
   that this adds is more of the same kind that varies as much, or headings; and to an article (else main) element.
4. Extraction takes the slots inside the main element, but not those of its inner elements that most pages repeat, nor of
   its leaves whose contents are a small repertoire (FEW pages or more a content, by length). Repetition is looked at on
   hosts of ENOUGH different pages or more, a repertoire on FEW times as many: fewer tell nothing.

Elements that are named as something else than text (navigation, forms, asides, footers and the like, `OUT_TAGS`, and
`COMMENTS`, since what readers write varies as the text does) are left out there; no other name decides. Only on pages
without the host's main element, and on hosts with one page, there is no variation to go by: there the article (else
main) element counts, else what neither tags, roles nor class words (`OUT_WORDS`) name as something else.

What remains is decoded, with white space turned into one space, block by block. Elements of unknown name are blocks.
Templates (a few dozen numbers a host) are broadcast while they are small, else joined by host.

Defined cases: a null or empty page has an empty text; a null address is a host of its own; elements left open end with
the element around them, closing tags without an opening one are skipped; equally fresh elements: the first by its number;
copies of a page count as one different page; a very long page is read in one task and takes memory in proportion; an
empty table gives an empty result; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import text as tx
from weir.llm.base import small
from weir.session import Scratch, table

# Names of elements and attributes with their roles.
RAW = "script|style|noscript|template|textarea|svg|iframe|select"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo ms mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr mrow mfrac msup msub".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Ended by the next of their kind where their closing tag is left out.
OPEN = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
HIDDEN = frozenset(["head", "title"])
OUT_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
COMMENTS = frozenset("comments comment-list commentlist comments-area disqus_thread".split())
IN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Class words that name an element where nothing but names can tell.
OUT_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search share sharing social comment comments commentlist disqus replies reply respond pagination pager toolbar skip".split())

ALIKE, FEW, ENOUGH = 0.85, 4, 4
NAMED, HEADING = 1, 2

PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")


class Node(NamedTuple):
    """An element: number of its role, of the element around it, of its kind (role without its own count), and its names."""

    id: int
    up: int
    kind: int
    name: str
    attrs: dict


#: What a page consists of: an element begins (Node), an element ends (int, its number), a text, or None where a block ends.
Event = Node | int | str | None
ROOT = 0


def pieces(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is open, close or text. Comments, raw elements and declarations are left out."""
    for m in PIECE.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], {}
        elif m["name"]:
            attrs = {}
            if m["attrs"] and not m["close"]:
                attrs = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in ATTR.findall(m["attrs"])}
            yield ("close" if m["close"] else "open"), m["name"].lower(), attrs


_numbers: dict[tuple, int] = {}


def number(*parts: object) -> int:
    """A positive 62-bit number of the parts."""
    if parts not in _numbers:
        if len(_numbers) > 50_000:
            _numbers.clear()
        _numbers[parts] = (int.from_bytes(hashlib.md5(repr(parts).encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "big") >> 2) + 1
    return _numbers[parts]


def events(page: str) -> list[Event]:
    """The page's elements, texts and block ends, in order. What is hidden (`HIDDEN`) is left out."""
    run = list(pieces(page))
    closes: dict[int, int] = {}  # of opening tags that are elements: the place of the closing one
    stack: list[int] = []
    depth: Counter = Counter()
    for i, (kind, name, _) in enumerate(run):
        if kind == "text" or name in INLINE or name in VOID:
            continue
        if kind == "open":
            stack.append(i)
            depth[name] += 1
        elif depth[name]:
            while True:
                at = stack.pop()
                depth[run[at][1]] -= 1
                if run[at][1] == name:
                    closes[at] = i
                    break
    closes |= {i: len(run) for i in stack if run[i][1] not in OPEN}
    out: list[Event] = []
    above: list[tuple[int, int]] = []  # number and place of the end of the elements around
    counts: Counter = Counter()
    hidden = -1
    for i, (kind, name, attrs) in enumerate([*run, ("end", "", {})]):
        while above and above[-1][1] <= i:
            out.append(above.pop()[0])
        if i <= hidden:
            continue
        if kind == "text":
            out.append(name)
        elif name not in INLINE:
            out.append(None)
            if kind == "open" and i in closes:
                if name in HIDDEN:
                    hidden = closes[i]
                    continue
                own = DIGITS.sub("0", " ".join(attrs.get(k, "") for k in ("class", "id", "role")).strip())
                up = above[-1][0] if above else ROOT
                like = number(up, name, own)
                counts[like] += 1
                node = Node(number(like, counts[like]), up, like, name, attrs)
                out.append(node)
                above.append((node.id, closes[i]))
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "big", signed=True)


def _rows(cols: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "host" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)


def _naming(name: str) -> int:
    return NAMED if name in IN_TAGS else HEADING if name in HEADINGS else 0


def classes(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages: host, _html. For each host: total (pages), different (pages), tokens (id, up, kind, class, and whether it is an article or main element)."""
    names = ["host", "id", "up", "kind", "named", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_html"):
                cols: list[list] = [[] for _ in names]
                for h, p in zip(part.column("host").to_pylist(), part.column("_html").to_pylist(), strict=True):
                    mark = digest(p or "")
                    nodes = [(ROOT, -1, mark, 0)] + [(e.id, e.up, e.kind, _naming(e.name)) for e in events(p or "") if isinstance(e, Node)]
                    for col, values in zip(cols, ([h] * len(nodes), *zip(*nodes, strict=True), [mark] * len(nodes)), strict=True):
                        col.extend(values)
                yield _rows(cols, names)

    seen = pages.select("host", "_html").mapInArrow(run, "host string, id long, up long, kind long, named long, mark long")
    # Hashes of 20 bits, so that sums over any host stay in range; two of them and the size tell occurrence vectors apart.
    x, y = (F.sum(F.pmod(F.shiftright("mark", by), F.lit(1 << 20))) for by in (0, 24))
    per = scratch.put(seen.groupBy("host", "id", "up", "kind", "named").agg(F.count("*").alias("pages"), x.alias("x"), y.alias("y")), "vectors")
    total = per.filter("id = 0").groupBy("host").agg(F.sum("pages").alias("total"), F.count("*").alias("different"))
    wide = per.filter("id <> 0").join(total, "host").filter("2 * pages >= total")
    token = F.struct("id", "up", "kind", "named", F.xxhash64("pages", "x", "y").alias("class"))
    return wide.groupBy("host", "total", "different").agg(F.collect_list(token).alias("tokens"))  # twice an average page's at most


def contents(pages: DataFrame) -> DataFrame:
    """pages: host, _html, ids and class of the host's tokens. For each host the counts of its slots and class orders.

    A slot has the number of the token before it, a closing one's complement; `is_order` rows have the number of a class.
    n: pages, top: those of the commonest content, total and fresh: text of all pages and of different contents.
    """
    names = ["host", "is_order", "slot", "content", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, "_html"):
                cols: list[list] = [[] for _ in names]
                for h, p, ids, own in zip(*(part.column(c).to_pylist() for c in ("host", "_html", "ids", "own")), strict=True):
                    of, texts, orders, slot = dict(zip(ids, own, strict=True)), defaultdict(list), defaultdict(list), ROOT
                    for e in events(p or ""):
                        if isinstance(e, str):
                            if not e.isspace():
                                texts[slot].append(e)
                        elif e is not None:
                            token = e.id if isinstance(e, Node) else ~e
                            known = of.get(token if token >= 0 else ~token)
                            if known is not None:
                                slot = token
                                orders[known].append(token)
                    for s, parts in texts.items():
                        t = " ".join(html.unescape(" ".join(parts)).split())
                        for col, value in zip(cols, (h, 0, s, digest(t), len(t)), strict=True):
                            col.append(value)
                    for c, order in orders.items():
                        for col, value in zip(cols, (h, 1, c, digest(repr(order)), 0), strict=True):
                            col.append(value)
                yield _rows(cols, names)

    seen = pages.select("host", "_html", "ids", "own").mapInArrow(run, "host string, is_order long, slot long, content long, chars long")
    one = seen.groupBy("host", "is_order", "slot", "content").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    return one.groupBy("host", "is_order", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("chars")).alias("total"), F.sum("chars").alias("fresh"))


class Mass:
    """Text of a part of the template, of all pages and of different contents."""

    def __init__(self) -> None:
        self.total = self.fresh = 0

    def add(self, total: int, fresh: int) -> None:
        self.total += total
        self.fresh += fresh

    def share(self) -> float:
        return self.fresh / self.total if self.total else 1.0


def decide(total: int, different: int, tokens: list[dict], slots: list[dict]) -> tuple[int, list[int], list[int]] | None:
    """The main element, the template's tokens inside of it and the slots there that are left out; None if there is none."""
    if different < 2:
        return None
    bad = {s["slot"] for s in slots if s["is_order"] and 20 * s["top"] < 19 * s["n"]}
    node = {t["id"]: t for t in tokens if t["class"] not in bad}
    up_of = {t["id"]: t["up"] for t in tokens}

    def valid(i: int) -> int:
        while i not in node and i != ROOT:
            i = up_of.get(i, ROOT)
        return i

    up = {i: valid(t["up"]) for i, t in node.items()}
    kids: dict[int, list[int]] = defaultdict(list)
    for i in sorted(node):
        kids[up[i]].append(i)
    own: dict[int, Mass] = defaultdict(Mass)
    owner: dict[int, int] = {}
    for s in slots:
        if not s["is_order"]:
            t = s["slot"]
            owner[t] = valid(t) if t >= 0 else valid(up_of.get(~t, ROOT))
            own[owner[t]].add(s["total"], s["fresh"])

    def leaf(i: int) -> bool:
        return not kids.get(i)

    def groups(i: int) -> dict[int, Mass]:
        """Masses of an element's parts: its own slots, its leaves by kind, each inner element with all it holds."""
        out: dict[int, Mass] = defaultdict(Mass)
        out[ROOT].add(own[i].total, own[i].fresh)
        for k in kids.get(i, ()):
            rest = [k]
            while rest:
                j = rest.pop()
                out[node[k]["kind"] if leaf(k) else k].add(own[j].total, own[j].fresh)
                rest += kids.get(j, ())
        return out

    def content(i: int) -> int:
        return own[i].fresh + sum(own[k].fresh for k in kids.get(i, ()) if leaf(k))

    some = [i for i in sorted(node) if not leaf(i) or up[i] == ROOT]
    if not some:
        return None
    main = max(some, key=content)
    if not content(main):
        return None
    best = Mass()
    best.add(own[main].total + sum(own[k].total for k in kids.get(main, ()) if leaf(k)), content(main))
    around, wider, grows, named = up[main], main, True, node[main]["named"] == NAMED

    def alike(i: int, part: int, m: Mass) -> bool:
        """Whether a part of element i goes with what is in `wider`: more of the same kind that varies as much, or headings."""
        if not m.total or part == wider:
            return True
        if part in node and node[part]["kind"] == node[wider]["kind"] or part == node[wider]["kind"]:
            return m.share() >= ALIKE * best.share()
        rest = [part] if part in node else [k for k in kids[i] if node[k]["kind"] == part]
        while rest:
            j = rest.pop()
            if own[j].total and node[j]["named"] != HEADING:
                return False
            rest += kids.get(j, ())
        return part != ROOT

    while around != ROOT:
        parts = groups(around)
        if grows and all(alike(around, k, m) for k, m in parts.items()):
            main = around if any(m.total for k, m in parts.items() if k != wider) else main
        elif node[around]["named"] == NAMED and not named:
            main, grows, named = around, True, True
        else:
            grows = False
        wider, around = around, up[around]
    inside, rest = [], [main]
    while rest:
        j = rest.pop()
        inside.append(j)
        rest += kids.get(j, ())
    held = set(inside)
    few = {k for k, m in groups(main).items() if m.total and m.fresh * FEW <= m.total * best.share() and k != ROOT} if different >= ENOUGH * FEW else set()
    drop = []
    for s in slots:
        if not s["is_order"] and owner[s["slot"]] in held:
            at = owner[s["slot"]]
            direct = at == main or leaf(at) and up[at] == main
            if (at != main and node[at]["kind"] in few and up[at] == main and leaf(at)) or (not direct and different >= ENOUGH and 2 * s["top"] > total):
                drop.append(s["slot"])
    return main, sorted(inside), sorted(drop)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages: host, _html. host, main (element), inside (tokens), left (slots); of hosts that have a main element."""
    known = scratch.put(classes(pages, scratch).filter("different >= 2"), "classes")
    ids = known.select("host", F.transform("tokens", lambda t: t["id"]).alias("ids"), F.transform("tokens", lambda t: t["class"]).alias("own"))
    slots = scratch.put(contents(pages.join(small(ids), "host")), "slots")
    slot = F.struct("is_order", "slot", "n", "top", "total", "fresh")
    both = known.join(slots.groupBy("host").agg(F.collect_list(slot).alias("slots")), "host")  # a few for each token
    marked = scratch.put(both, "deduced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, total, different, tokens, slots_ in zip(*(batch.column(c).to_pylist() for c in ("host", "total", "different", "tokens", "slots")), strict=True):
                got = decide(total, different, tokens, slots_)
                if got:
                    found.append((h, *got))
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "main", "inside", "left"])

    return scratch.put(marked.mapInArrow(run, "host string, main long, inside array<long>, left array<long>"), "templates")


def _out(node: Node) -> bool:
    """Whether an element's name says that it is no text of the article it stands in."""
    a = node.attrs
    return node.name in OUT_TAGS or a.get("role", "") in OUT_ROLES or a.get("id", "") in COMMENTS or any(w in COMMENTS for w in a.get("class", "").split())


def _named_out(node: Node) -> bool:
    return _out(node) or node.name == "header" or any(w in OUT_WORDS for k in ("class", "id") for w in WORD.split(node.attrs.get(k, "")))


def _joined(run: list[Event]) -> str:
    """Texts of the run, blocks joined by one space."""
    blocks: list[str] = []
    block: list[str] = []
    for e in [*run, None]:
        if isinstance(e, str):
            block.append(html.unescape(e))
        elif block:
            words = "".join(block).split()
            if words:
                blocks.append(" ".join(words))
            block.clear()
    return " ".join(blocks)


def by_template(run: list[Event], main: int, inside: frozenset[int], left: frozenset[int]) -> list[Event] | None:
    """What the slots inside the main element hold; None if the page has no such element."""
    if not any(isinstance(e, Node) and e.id == main for e in run):
        return None
    out: list[Event] = []
    slot, within, skip = ROOT, False, 0
    for e in run:
        if isinstance(e, str) or e is None:
            if within and not skip and (e is None or slot not in left):
                out.append(e)
            continue
        is_open = isinstance(e, Node)
        i = e.id if is_open else e
        if within:
            if skip:
                skip = 0 if not is_open and i == skip else skip
            elif is_open and i != main and _out(e):
                skip = i
        if i == main:
            within = is_open
        if i in inside:
            slot = i if is_open else ~i
    return out


def by_names(run: list[Event]) -> list[Event]:
    """What names do not leave out: inside the article (else main) elements of a page, else on all of it."""
    hearts = {name: [e.id for e in run if isinstance(e, Node) and e.name == name] for name in ("article", "main")}
    heart = set(hearts["article"] or hearts["main"])
    out: list[Event] = []
    within: list[int] = []
    skip = 0
    for e in run:
        if isinstance(e, str) or e is None:
            if not skip and (within or not heart):
                out.append(e)
        elif isinstance(e, Node):
            if e.id in heart:
                within.append(e.id)
            elif not skip and (_out(e) if within else e.name not in ("html", "body", *IN_TAGS) and _named_out(e)) and not (heart and not within):
                skip = e.id
        elif e == skip:
            skip = 0
        elif within and e == within[-1]:
            within.pop()
    return out


def extract(page: str, template: tuple[int, frozenset[int], frozenset[int]] | None) -> str:
    """Main text of a page; template: main element, tokens inside of it and slots left out."""
    run = events(page)
    found = by_template(run, *template) if template else None
    return _joined(by_names(run) if found is None else found)


def main_text(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(page).alias("_html"), host(F.col(url)).alias("host"))
    known = templates(rows.select("host", "_html"), scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, tuple] = {}
        for batch in batches:
            for part in tx.parts(batch, "_html"):
                texts = []
                for p, main, inside, left in zip(*(part.column(c).to_pylist() for c in ("_html", "main", "inside", "left")), strict=True):
                    template = None
                    if main is not None:
                        own = (main, tuple(inside), tuple(left))
                        if own not in sets:
                            if len(sets) > 1000:
                                sets.clear()
                            sets[own] = (main, frozenset(inside), frozenset(left))
                        template = sets[own]
                    texts.append(extract(p or "", template))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(small(known), "host", "left").select("_id", "_url", "_html", "main", "inside", "left")
    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), Scratch(spark, "html"))


#: Holds for pages whose only other parts are those taken out first; blocks are line breaks, paragraphs and headings.
SQL = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?s)<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*', ' ', 'g'),
      '<br */?>|</?p>|</?h[1-6]>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM pages)
"""
