"""HTML extraction by union-free wrappers inferred for each host.

A page is a stream of tags and text slots. Runs that repeat beside each other become repeated groups, and the pages of
a host are aligned one after the other: where the aligned streams agree they are merged, and what only one has becomes
optional. The result, a union-free regular expression of tags, `#` (a text slot), `(...)+` and `(...)?`, is the
host's wrapper. Every page is read along it, and the texts that the pages have in each of its slots are counted: a text
that the pages share is the template's. That, and where a slot stands (in an element named an article, or in a menu, a
form and so on), tells what is kept.

Aligning is a merge, so it works in any grouping (the slots of a wrapper are the same for any): equal streams are
counted once, a host's streams are merged in salted parts and the parts' wrappers with each other. No page is left
out, and no task holds a host's pages.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.plans.joins import small
from framewell.session import materialise

#: Streams of one host that a task aligns about, and merged parts that the next step aligns.
PART, MERGED = 512, 16
#: Inside so many elements that have items of their own only those that change where text stands have one, and so many
#: of these: what is aligned and stored is no deeper.
DEEP, PLACES = 150, 100
#: Bits of the table that an alignment keeps; longer runs are halved first.
TABLE_BITS = 1 << 28
#: Characters of all wrappers together that are broadcast at most; more are joined by host.
BROADCAST_CHARS = 32_000_000
#: Share of the pages with a slot on which one text makes it the template's.
OFTEN = 0.5
#: Different pages that must bear a text at least before it is taken for the template's.
LEAST_PAGES = 3

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|template|svg|math)\b(?P<rawattrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NO_CDATA = re.compile(_TOKEN.pattern.replace(r"|<!\[CDATA\[.*?\]\]>", ""), re.S | re.I)
_NO_MARK = re.compile(_NO_CDATA.pattern.replace("|<[!?][^>]*>", ""), re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag in the second place ends an open element of the first.
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
ENDS["a"] = frozenset("a")
#: Which open elements a start tag can end.
ENDED_BY = {tag: [t for t, by in ENDS.items() if tag in by] for tag in frozenset().union(*ENDS.values())}
#: What an element must not be looked for beyond.
FENCES = frozenset("article aside body div footer form header main nav section table td th ul ol dl".split())
#: Tags and words of class, id or role whose content is not the article.
OUTSIDE_TAGS = frozenset("aside button dialog footer form head input label menu nav select".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget "
    "related recommended share sharing social comment comments discussion disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription paywall footer footnav masthead toolbar pagination pager login signin signup search skip legal disclaimer copyright complementary contentinfo".split()
)
#: Of those, words in which no article is looked for.
NEVER_WORDS = frozenset("comment comments discussion disqus respond reply replies related recommended aside complementary".split())
#: Sets of words that name an article's element.
ARTICLE_WORDS = [{"article"}, {"article", "body"}, {"article", "content"}, {"post", "content"}, {"entry", "content"}]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _tokens(html: str):
    """Matches of _TOKEN; after the last `]]>` no CDATA section is looked for, and after the last `>` no declaration, each
    of which would be sought to the end."""
    last, end, at = html.rfind("]]>"), html.rfind(">"), 0
    if "<![CDATA[" in html or html.find("<!", end + 1) >= 0 or html.find("<?", end + 1) >= 0:
        while at < len(html):
            m = (_TOKEN if at < last else _NO_CDATA if at < end else _NO_MARK).match(html, at)
            yield m
            at = m.end()
    else:
        yield from _TOKEN.finditer(html)


def events(html: str):
    """("open", label), ("close", label), ("text", raw) in page order, with every element closed. A label is the tag
    and the words of its class, id and role; inline elements without any, and links apart, are left to the text."""
    stack: list[tuple[str, str | None, int]] = []  # tag, the label that was told (None if none was), where text in it stands
    open_: Counter[str] = Counter()  # tags on the stack
    deep = 0  # labels that were told

    def close_to(k):
        nonlocal deep
        while len(stack) > k:
            tag, label, _ = stack.pop()
            open_[tag] -= 1
            if label is not None:
                deep -= 1
                yield "close", label

    for m in _tokens(html):
        text, tag = m["text"], m["tag"]
        if text is not None:
            yield "text", text
        elif m["raw"] is not None or tag is None:
            yield "break", ""
        else:
            tag = tag.lower()
            if m["end"]:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or (tag in INLINE and stack[k][0] in FENCES)), -1) if open_[tag] else -1
                if tag not in INLINE:
                    yield "break", ""
                if k >= 0 and stack[k][0] == tag:
                    yield from close_to(k)
                continue
            for k in range(len(stack) - 1, -1, -1) if any(open_[t] for t in ENDED_BY.get(tag, ())) else ():
                if tag in ENDS.get(stack[k][0], ()):
                    yield from close_to(k)
                    break
                if stack[k][0] in FENCES and stack[k][0] not in ("td", "th"):
                    break
            words = " ".join(sorted({w for a in _ATTR.finditer(m["attrs"]) for w in _WORD.findall(_CAMEL.sub(" ", a[2] or a[3] or a[4] or "").lower())})) if m["attrs"] else ""
            if tag in VOID:
                if tag == "br":
                    yield "text", " "
                elif tag not in INLINE:
                    yield "break", ""
                continue
            outer = stack[-1][2] if stack else 1
            told = tag not in INLINE or tag == "a" or bool(words and not OUTSIDE_WORDS.isdisjoint(words.split()))
            place = _place(tag, {*words.split()}, outer) if told else outer
            told = told and (deep < DEEP or place != outer and deep < DEEP + PLACES)
            if tag not in INLINE:
                yield "break", ""
            label = f"{tag} {words}".strip() if told else None
            if told:
                deep += 1
                yield "open", label
            stack.append((tag, label, place))
            open_[tag] += 1
    yield from close_to(0)


# A wrapper is a tuple of items: ("#", signs), ("e", signs, label, items) or ("g", signs, items) for a group of several.
# signs: "+" for one that repeats, "?" for one that may be missing, in this order.


def _key(item: tuple) -> tuple:
    """What must agree for items to be merged: an element's label, a group's run of these."""
    return ("g", *map(_key, item[2])) if item[0] == "g" else (item[0], *item[2:3])


def _keys(items) -> list[tuple]:
    return [*map(_key, items)]


def _signed(item: tuple, signs: str) -> tuple:
    return (item[0], "".join(c for c in "+?" if c in item[1] or c in signs), *item[2:])


def _merge(a: tuple, b: tuple) -> tuple:
    """Two items of one key as one."""
    if a[0] == "e" and a[3] != b[3]:
        a = (*a[:3], align(a[3], b[3]))
    elif a[0] == "g" and a[2] != b[2]:
        a = (*a[:2], tuple(map(_merge, a[2], b[2])))
    return _signed(a, b[1])


def _rows(ka: list, kb: list) -> list[int]:
    """For each prefix of ka the longest common runs with all prefixes of kb: bit j is 0 where the run grows by kb[j]."""
    whole, at = (1 << len(kb)) - 1, {}
    for j, k in enumerate(kb):
        at[k] = at.get(k, 0) | 1 << j
    rows = [whole]
    for k in ka:
        v = rows[-1]
        u = v & at.get(k, 0)
        rows.append(((v + u) | (v - u)) & whole)
    return rows


def _lengths(ka: list, kb: list) -> np.ndarray:
    """Length of the longest common run of ka with each prefix of kb."""
    last, n = (1 << len(kb)) - 1, len(kb)
    at: dict = {}
    for j, k in enumerate(kb):
        at[k] = at.get(k, 0) | 1 << j
    for k in ka:
        u = last & at.get(k, 0)
        last = ((last + u) | (last - u)) & ((1 << n) - 1)
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _common(ka: list, kb: list) -> list[tuple[int, int]]:
    """Places of a longest common run of keys, at any length; memory is bounded by halving ka until a table fits."""
    a, z = 0, 0
    while a < min(len(ka), len(kb)) and ka[a] == kb[a]:
        a += 1
    while z < min(len(ka), len(kb)) - a and ka[-1 - z] == kb[-1 - z]:
        z += 1
    n, m = len(ka) - a - z, len(kb) - a - z
    out = [(k, k) for k in range(a)]
    if n and m:
        mine, its = ka[a : a + n], kb[a : a + m]
        if n > 1 and n * m > TABLE_BITS:
            half = n // 2
            cut = int((_lengths(mine[:half], its) + _lengths(mine[half:][::-1], its[::-1])[::-1]).argmax())
            inner = _common(mine[:half], its[:cut]) + [(i + half, j + cut) for i, j in _common(mine[half:], its[cut:])]
        else:
            rows, i, j, inner = _rows(mine, its), n, m, []
            while i and j:
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                    continue
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                    inner.append((i, j))
            inner.reverse()
        out += [(i + a, j + a) for i, j in inner]
    return out + [(len(ka) - k, len(kb) - k) for k in range(z, 0, -1)]


def align(a: tuple, b: tuple) -> tuple:
    """One run of items for two: a common run is merged, what only one has becomes optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*_common(_keys(a), _keys(b)), (len(a), len(b))]:
        out += [_signed(k, "?") for k in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def fold(items, longest: int = 3) -> tuple:
    """Runs of items that repeat beside each other become repeated groups."""
    items = list(items)
    for size in range(1, longest + 1):
        out: list[tuple] = []
        for item in items:
            out.append(item)
            while True:
                if size == 1 and len(out) > 1 and _key(out[-1]) == _key(out[-2]):
                    out[-2:] = [_signed(_merge(out[-2], out[-1]), "+")]
                elif size > 1 and len(out) > size and out[-size - 1][0] == "g" and [*_key(out[-size - 1])[1:]] == _keys(out[-size:]):
                    group = out[-size - 1]
                    out[-size - 1 :] = [("g", _signed(group, "+")[1], tuple(map(_merge, group[2], out[-size:])))]
                elif size > 1 and len(out) >= 2 * size and _keys(out[-2 * size : -size]) == _keys(out[-size:]):
                    out[-2 * size :] = [("g", "+", tuple(map(_merge, out[-2 * size : -size], out[-size:])))]
                else:
                    break
        items = out
    return tuple(items)


def shape(html: str) -> tuple:
    """A page's own stream, its repeated groups folded."""
    stack: list[tuple[str, list]] = [("", [])]
    for kind, what in events(html):
        here = stack[-1][1]
        if kind == "open":
            stack.append((what, []))
        elif kind == "close":
            label, inside = stack.pop()
            stack[-1][1].append(("e", "", label, fold(inside)))
        elif kind == "text" and not what.isspace() and (not here or here[-1][0] != "#"):
            here.append(("#", ""))
    return fold(stack[0][1])


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def dumps(items: tuple) -> str:
    return json.dumps(items, separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> tuple:
    return _tuples(json.loads(text))


def _place(tag: str, words: set[str], outer: int) -> int:
    """2 in the article, 1 elsewhere, 0 in what is never article, -1 in what an article may still stand in."""
    outside = not OUTSIDE_WORDS.isdisjoint(words)
    if (tag in ("article", "main") or words in ARTICLE_WORDS or "main" in words) and not outside:
        return 2 if outer else 0
    if outer == 0 or tag in OUTSIDE_TAGS or not NEVER_WORDS.isdisjoint(words):
        return 0
    if tag in ("body", "html", "article", "main"):
        return 2 if tag == "main" else 0 if tag == "article" else 1
    if outside or (outer != 2 and (tag == "header" or "header" in words)):
        return -1
    return outer


class Node:
    """A wrapper's element or text slot: its number, where its text stands, whether it is a link, and its items in order."""

    __slots__ = ("at", "extra", "fixed", "items", "link", "number", "own", "place", "spans")

    def __init__(self, place: int, link: bool, number: int = -1) -> None:
        self.place, self.link, self.number = place, link, number
        self.items, self.spans, self.at, self.extra = [], [], {}, {}
        self.fixed, self.own = {}, False

    def inside(self, label: str, number: int = -1) -> Node:
        tag, *words = label.split()
        return Node(self.place if label == "#" else _place(tag, {*words}, self.place), self.link or tag == "a", number)

    def step(self, label: str, last: int) -> tuple[Node, int]:
        """The item that a label ("#" for text) falls into after the item `last`, and its place: the next one inside the
        repeat that `last` stands in, that repeat once more, a later one, or the first. What the wrapper lacks is unnumbered."""
        at = self.at.get(label)
        if at is None:
            if label not in self.extra:
                self.extra[label] = self.inside(label)
            return self.extra[label], last
        start, end = self.spans[last] if last >= 0 else (0, 0)
        k = bisect_right(at, last)
        if k == len(at) or at[k] >= end:
            again = bisect_left(at, start)
            if again < len(at) and at[again] < end:
                k = again
        place = at[k] if k < len(at) else at[0]
        return self.items[place], place


def compiled(items: tuple, facts: dict | None = None) -> Node:
    """The wrapper as a tree of numbered items, with what is known of its text slots' texts (`slot_facts`)."""
    root, slots = Node(1, False), []

    def put(node: Node, items: tuple, span: tuple[int, int] | None) -> None:
        for item in items:
            place = len(node.items)
            if item[0] == "g":
                put(node, item[2], (place, place + _width(item)) if "+" in item[1] else span)
                continue
            label = "#" if item[0] == "#" else item[2]
            inner = node.inside(label, len(slots))
            slots.append(inner)
            node.items.append(inner)
            node.spans.append(span or ((place, place + 1) if "+" in item[1] else (place, place)))
            node.at.setdefault(label, []).append(place)
            if item[0] == "e":
                put(inner, item[3], None)

    put(root, items, None)
    for slot, text, share in (facts or {}).get("fixed", ()):
        slots[slot].fixed[text] = share
    for slot in (facts or {}).get("own", ()):
        slots[slot].own = True
    return root


def _width(item: tuple) -> int:
    return sum(map(_width, item[2])) if item[0] == "g" else 1


def blocks_of(html: str, wrapper: Node):
    """(block, its text slot, whether it is mostly links), in page order, of a page read along its wrapper."""
    path, last, run, out = [wrapper], [-1], [], []

    def flush() -> None:
        if run:
            # what an inline element keeps out of the article is left out of its block
            kept = [x for x in run if x[2].place > 0] or run
            block = " ".join(html_lib.unescape("".join(t for t, _, _ in kept)).split())
            if block:
                linked = sum(len(t) for t, link, _ in kept if link)
                out.append((block, kept[0][2], 2 * linked > sum(len(t) for t, _, _ in kept)))
            run.clear()

    for kind, what in events(html):
        if kind == "text":
            here = path[-1]
            slot = next((x[2] for x in run if (x[2].place > 0) == (here.place > 0)), None)
            if slot is None:
                if what.isspace():
                    continue
                slot, last[-1] = here.step("#", last[-1])
            run.append((what, here.link, slot))
        elif kind == "break":
            flush()
        else:
            if what.split(" ", 1)[0] not in INLINE:
                flush()
            if kind == "open":
                node, last[-1] = path[-1].step(what, last[-1])
                path.append(node)
                last.append(-1)
            else:
                path.pop()
                last.pop()
    flush()
    return out


def text_hash(block: str) -> int:
    return xxhash.xxh64_intdigest(block.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(html: str, wrapper: Node) -> str:
    """The article's text of a page that follows the wrapper: blocks in page order, joined by one blank.

    A text that its slot bears on at least half of the pages is the template's, but nothing inside an element that is
    named an article is: articles may be alike on all pages of a host, as mirrors and reprints are. A page without any text in an article keeps its other text
    outside menus and the like, but for blocks that are mostly links; one without that keeps what stands in slots whose
    texts are the pages' own, whatever they are named.
    """
    blocks: dict[int, list] = {0: [], 1: [], 2: []}
    for block, slot, linked in blocks_of(html, wrapper):
        share = slot.fixed.get(text_hash(block), 0) if slot.fixed else 0
        if slot.place == 2 or share < OFTEN and (slot.place > 0 or slot.own):
            blocks[max(0, slot.place)].append((block, linked))
    if blocks[2]:
        return " ".join(b for b, _ in blocks[2])
    return " ".join(b for b, linked in blocks[1] if not linked) or " ".join(b for b, linked in blocks[0] if not linked)


def _merged(keys: list[str], column: str = "shape"):
    """mapInArrow work over rows sorted by keys: one row a key, its streams aligned in turn."""

    def run(batches):
        now, held = None, None
        names = [*keys, column]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if now is not None:
                        for c, x in zip(out, (*now, dumps(held)), strict=True):
                            c.append(x)
                    now, held = key, loads(text)
                else:
                    held = align(held, loads(text))
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(k).type) for k, c in enumerate(out)], names=names)
        if now is not None:
            kinds = [pa.string() if isinstance(x, str) else pa.int32() for x in now]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, dumps(held)), [*kinds, pa.string()], strict=True)], names=names)

    return run


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, shape): each host's wrapper, from all its pages. A null or odd url has host ''; a null page is empty."""

    def shapes(batches):
        for b in batches:
            seen: dict[tuple[str, str], None] = {}
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault((host_of(url), dumps(shape(page or ""))))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.string())], names=["host", "shape"])

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    told = materialise(rows.mapInArrow(shapes, "host string, shape string").distinct(), "shapes")
    sizes = materialise(told.groupBy(F.col("host").alias("_host")).agg(F.ceil(F.count("*") / PART).alias("parts")).filter("parts > 1"), "sizes")
    salt = F.pmod(F.xxhash64("shape"), F.coalesce("parts", F.lit(1))).cast("int")
    parts = told.join(small(sizes), F.col("host") == F.col("_host"), "left").select("host", salt.alias("salt"), "shape")
    most = sizes.agg(F.max("parts")).first()[0] or 1
    while True:  # parts of a host, then parts of these, until one is left
        parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").mapInArrow(_merged(["host", "salt"]), "host string, salt int, shape string")
        if most <= 1:
            return parts.select("host", "shape")
        parts = materialise(parts, "parts").select("host", F.expr(f"salt div {MERGED}").cast("int").alias("salt"), "shape")
        most = -(-most // MERGED)


def slot_facts(pages: DataFrame, reading) -> DataFrame:
    """(host, facts): what the different pages of a host have in their wrapper's slots, as JSON for `compiled`.

    fixed has (slot, text's hash, share of pages) for texts on LEAST_PAGES or more and OFTEN of the slot's pages; own has the slots most of whose pages' texts no other page
    has. A host without such a slot on half of its pages tells no template from article, and has no facts. Counted are
    slots, texts and pages; copies of a page count once.
    """

    def told(page: str, wrapper: Node):
        found = {(slot.number, text_hash(block)) for block, slot, _ in blocks_of(page, wrapper) if slot.number >= 0}
        return [(-1, None), *((k, None) for k in {k for k, _ in found}), *found]

    def places(batches):
        for b, nodes in reading(batches):
            out = [[], [], [], []]
            for url, page, node in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), nodes, strict=True):
                host, digest = host_of(url), text_hash(page or "")
                for slot, text in told(page or "", node):
                    for c, x in zip(out, (host, slot, text, digest), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["host", "slot", "text", "page"])

    seen = pages.mapInArrow(places, "host string, slot int, text long, page long").distinct()
    counted = materialise(seen.groupBy("host", "slot", "text").agg(F.count("*").alias("n")), "slots")
    hosts = counted.filter("slot = -1").select("host", F.col("n").alias("of_host"))
    slots = counted.filter("slot >= 0").groupBy("host", "slot").agg(
        F.sum(F.when(F.col("text").isNull(), F.col("n"))).alias("of_slot"), F.count(F.when(F.col("text").isNotNull() & (F.col("n") == 1), 1)).alias("single"))
    slots = slots.join(hosts, "host").withColumn("own", (F.col("of_slot") >= LEAST_PAGES) & (2 * F.col("single") >= F.col("of_slot")))
    contrast = slots.groupBy("host").agg(F.max(F.col("own") & (2 * F.col("of_slot") >= F.col("of_host"))).alias("tells"), F.collect_list(F.when(F.col("own"), F.col("slot"))).alias("own")).filter("tells")
    often = counted.filter((F.col("slot") >= 0) & F.col("text").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(slots.select("host", "slot", "of_slot", "of_host"), ["host", "slot"])
    often = often.filter(F.col("n") >= OFTEN * F.col("of_slot"))
    fixed = often.groupBy("host").agg(F.collect_list(F.struct("slot", "text", (F.col("n") / F.col("of_slot")).alias("share"))).alias("fixed"))
    facts = contrast.select("host", "own").join(fixed, "host", "left")
    listed = F.transform("fixed", lambda x: F.concat(F.lit("["), x["slot"], F.lit(","), x["text"], F.lit(","), F.round(x["share"], 6), F.lit("]")))
    return facts.select("host", F.concat(F.lit('{"own":'), F.to_json("own"), F.lit(',"fixed":['), F.coalesce(F.array_join(listed, ","), F.lit("")), F.lit("]}")).alias("facts"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars. Null pages have empty text; null ids and repeated rows keep their rows."""
    learned = materialise(wrappers(pages, url_col, html_col), "wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names, kind = ["page_id", "url", "text", "n_chars"], pages.schema[id_col].dataType.simpleString()

    def along(learned: DataFrame):
        """(rows with what their reader needs, the reader): batches and the wrapper of each of their rows."""

        def reading(batches, wrapper_of):
            known: dict[str, Node] = {}
            for b in batches:
                nodes, urls = [], b.column(1).to_pylist()
                for k, url in enumerate(urls):
                    host = host_of(url)
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        items, facts = wrapper_of(host, b, k)
                        known[host] = compiled(loads(items), facts and json.loads(facts))
                    nodes.append(known[host])
                yield b, nodes

        size = learned.agg(F.sum(F.length("shape") + F.length(F.coalesce("facts", F.lit(""))))).first()[0] or 0
        if size <= BROADCAST_CHARS:
            table = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["shape"], r["facts"]) for r in learned.toLocalIterator()})
            return rows, lambda batches: reading(batches, lambda host, *_: table.value[host])

        def hosts(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

        with_host = rows.mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
        joined = with_host.join(learned, "host").select("page_id", "url", "html", "shape", "facts")
        return joined, lambda batches: reading(batches, lambda _, b, k: (b.column(3)[k].as_py(), b.column(4)[k].as_py()))

    with_wrapper, reading = along(learned.withColumn("facts", F.lit(None).cast("string")))
    facts = slot_facts(with_wrapper, reading)
    with_facts, told = along(materialise(learned.join(facts, "host", "left"), "facts"))

    def read(batches):
        for b, nodes in told(batches):
            text = [extract(page or "", node) for page, node in zip(b.column(2).to_pylist(), nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=names)

    return with_facts.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
