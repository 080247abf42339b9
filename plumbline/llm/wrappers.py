"""Main text of web pages by wrappers, inferred per host as union-free regular expressions.

A page is a stream of tags and texts. Pages of one host come from one template, so their streams are aligned,
one page after the other, with the expression found so far. Where both agree nothing changes. Where texts
differ, the place becomes a text slot. Where tags differ, equal neighbours are first taken together as a
repeated group (of one element, or of up to ``PERIOD`` that follow each other again and again); what then
has no partner becomes optional. The expression is never a union of alternatives. It is kept as a tree, since
every group lies within one element.

In a host's expression the article is the element that holds most of the running text; text that stays
the same in all pages around changing text is the template's own. Every page is then matched with its host's
expression, and the text of its article is read out, block by block. What the expression doesn't hold is
judged by the page alone, so that no page goes without.

A host may have several layouts. A page by itself points to the element that it would take as its article; a
layout is all pages that hold the same of the elements that any page of the host points to. Each layout has an expression and
an article of its own, inferred from all its pages: parts of them are aligned by themselves, and the
expressions of the parts are merged in a tree. What stands unchanged at one place is counted over all layouts of the host.
"""

from __future__ import annotations

import pickle
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, small_batches, stored, table
from plumbline.runtime import ship

#: Pages that are aligned one after the other, and expressions that are merged so; neither limits a host.
PART = 200
MERGED = 8
#: Hashes of pages that a task remembers at once, to drop copies before the shuffle; those it misses are dropped later.
SEEN = 1_000_000
#: Longest sequence of siblings that is seen as one repeated group.
PERIOD = 3
#: A text is the template's own if it stands unchanged in at least so many different pages and is no longer.
SAME_PAGES = 4
SAME_CHARS = 200
#: Share of the running text that an element must hold for its siblings to be left out; those with headings or paragraphs never are.
HOLDS = 0.8
#: Elements deeper than this are read as text of the element that holds them.
DEPTH = 100

# Element names of HTML, and words in class, id and role that mark what is not the article.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_SKIPPED = "script|style|noscript|template|textarea|iframe|svg|math|select|object|title|canvas|audio|video|button|applet|frameset|datalist"
_NOT_ARTICLE = set("nav footer aside form menu dialog head fieldset search".split())
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPES = set("ul ol dl table article section main div body html td th aside nav footer header form blockquote".split())
_NOISE = set(
    """ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs byline captcha comment comments commentlist complementary consent contentinfo cookie
    cookies copyright dialog discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted
    promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola tags teaser toolbar widget
    widgets alert""".split()
)
_COMMENTS = set("comment comments commentlist discussion disqus replies reply respond".split())
_LISTS = set("p li td blockquote pre ul ol dl table".split())
_HEADING = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_SAYS = _HEADING | set("p blockquote pre".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_SKIPPED})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """kids: Elements, and runs of text between them as (text, characters in links)."""

    __slots__ = ("tag", "key", "kids", "noise", "kind", "doubtful")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.noise, self.kind, self.doubtful = tag, [], tag in _NOT_ARTICLE, "", False
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes else {}
        classes = found.get("class", "")
        self.key = f"{tag}.{' '.join(re.sub('[0-9]+', '', classes).split())}" if classes else tag
        if found.get("role", "").lower() == "main":
            self.kind = "main"
        if found.get("itemprop", "").lower() == "articlebody":
            self.kind = "article"
        if tag in ("article", "main"):
            self.kind = self.kind or tag
        if tag not in ("html", "body", "main", "article") or "comment" in classes.lower():
            marks = f"{classes} {found.get('id', '')} {found.get('role', '')}".split()
            words = {w.lower() for m in marks if not re.match("(has|no|with|without)-", m) for w in _WORDS.findall(m)} & _NOISE
            # a name that only has such a word in it may be that of a frame around the article
            self.doubtful = bool(words) and not (self.noise or words & _COMMENTS or {m.lower() for m in marks} & _NOISE)
            self.noise = self.noise or bool(words)
        if found.get("aria-hidden", "").lower() == "true":
            self.noise = True


def _clear(root: Element) -> None:
    """Elements whose name only suggests that they are not the article, but that hold most of the page's running text, may be it."""
    held: dict[int, int] = {}

    def weigh(e: Element) -> int:
        held[id(e)] = total = sum(_running(k) if isinstance(k, tuple) else weigh(k) for k in e.kids)
        return total

    def clear(e: Element) -> None:
        for k in e.kids:
            if isinstance(k, Element) and 2 * held[id(k)] > total:
                if k.doubtful:
                    k.noise = False
                clear(k)

    total = weigh(root)
    clear(root)


def parse(html: str) -> Element:
    """The tree of a page's block elements. Ends that are left out are taken where HTML ends an element by itself."""
    root = Element("html")
    stack, text, links, in_link, doubtful = [root], [], 0, False, False
    at = 0

    def close_run():
        nonlocal links
        if text:
            run = " ".join(unescape("".join(text)).split())
            text.clear()
            if run:
                stack[-1].kids.append((run, min(links, len(run))))
        links = 0

    def add(piece: str):
        nonlocal links
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece.strip())

    def close_to(depth: int):
        close_run()
        del stack[depth:]

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag in _INLINE or tag == "br":
            if tag == "a":
                in_link = not m[2]
            elif tag == "br":
                text.append(" ")
            continue
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            else:
                close_run()  # an end without a start still ends a block
            in_link = False
            continue
        if tag == "html":
            continue
        ends = _ENDS_LIKE.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ends:
                close_to(depth)
                if tag not in _ENDS_LIKE:
                    break
            elif stack[depth].tag in _SCOPES:
                break
        close_run()
        if tag in _VOID or len(stack) > DEPTH:
            continue
        element = Element(tag, m[4])
        doubtful |= element.doubtful
        stack[-1].kids.append(element)
        stack.append(element)
    add(html[at:])
    close_run()
    if doubtful:
        _clear(root)
    return root


def _key(kid) -> str:
    return "#" if isinstance(kid, tuple) else kid.key


def _groups(kids: list) -> list[tuple[tuple[str, ...], list[list]]]:
    """Siblings as groups: (keys, occurrences). Equal neighbours are one group, and so are sequences that repeat."""
    keys = [_key(k) for k in kids]
    out, i, n = [], 0, len(kids)
    while i < n:
        best = (1, 1)
        for period in range(1, PERIOD + 1):
            times = 1
            while keys[i + times * period : i + (times + 1) * period] == keys[i : i + period] and i + (times + 1) * period <= n:
                times += 1
            if times > 1 and period * times > best[0] * best[1]:
                best = (period, times)
        period, times = best
        out.append((tuple(keys[i : i + period]), [kids[i + t * period : i + (t + 1) * period] for t in range(times)]))
        i += period * times
    return out


def _align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of two lists of keys, as pairs of places; None where one has no partner."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


class Group:
    """A part of an expression: slots one after the other, as a whole optional or repeated."""

    __slots__ = ("keys", "slots", "optional", "repeated")

    def __init__(self, keys):
        self.keys, self.slots, self.optional, self.repeated = keys, [None] * len(keys), False, False


class Pattern:
    """An element of an expression: its groups of children. ``chars`` counts running text, ``main`` marks the article."""

    __slots__ = ("key", "tag", "noise", "kind", "groups", "chars", "main")

    def __init__(self, element: Element):
        self.key, self.tag, self.noise, self.kind = element.key, element.tag, element.noise, element.kind
        self.groups, self.chars, self.main = None, 0, False


class Slot:
    """A text place: its one text, or None once texts differ; and the pages it was seen in."""

    __slots__ = ("text", "pages", "chars")

    def __init__(self, text):
        self.text, self.pages, self.chars = text, 0, 0


def extend(pattern: Pattern, element: Element) -> None:
    """Align an element with its pattern and widen the pattern to hold it too."""
    found = _groups(element.kids)
    if pattern.groups is None:
        known, pairs = [], [(None, j) for j in range(len(found))]
        first = True
    else:
        known, first = pattern.groups, False
        pairs = _align([g.keys for g in known], [k for k, _ in found])
    out = []
    for i, j in pairs:
        if j is None:
            known[i].optional = True
            out.append(known[i])
            continue
        keys, times = found[j]
        if i is None:
            group = Group(keys)
            group.optional = not first
        else:
            group = known[i]
        group.repeated |= len(times) > 1
        for kids in times:
            for s, kid in enumerate(kids):
                slot = group.slots[s]
                if isinstance(kid, tuple):
                    if slot is None:
                        slot = group.slots[s] = Slot(kid[0])
                    if slot.text != kid[0]:
                        slot.text = None
                    slot.pages += 1
                    slot.chars += _running(kid)
                else:
                    if slot is None:
                        slot = group.slots[s] = Pattern(kid)
                    extend(slot, kid)
        out.append(group)
    pattern.groups = out


def merge(a: Pattern, b: Pattern) -> None:
    """Widen a pattern to hold all that another one of the same key holds."""
    if a.groups is None or b.groups is None:
        a.groups = a.groups if b.groups is None else b.groups
        return
    out = []
    for i, j in _align([g.keys for g in a.groups], [g.keys for g in b.groups]):
        if i is None or j is None:
            group = a.groups[i] if j is None else b.groups[j]
            group.optional = True
        else:
            group, other = a.groups[i], b.groups[j]
            group.optional |= other.optional
            group.repeated |= other.repeated
            for mine, its in zip(group.slots, other.slots):
                if isinstance(mine, Slot):
                    mine.text = mine.text if mine.text == its.text else None
                    mine.pages += its.pages
                    mine.chars += its.chars
                else:
                    merge(mine, its)
        out.append(group)
    a.groups = out


def _running(run: tuple[str, int]) -> int:
    """Characters of a run that are not in links; few words alone are no running text."""
    text, links = run
    return len(text) - links if 2 * links < len(text) else 0


def _weigh(node) -> list[tuple[int, object]]:
    """Set or give the running text of a node; its element children with theirs."""
    total, kids = 0, []
    if isinstance(node, Element):
        pieces = node.kids
    else:
        pieces = [s for g in node.groups or [] for s in g.slots if s is not None]
    for k in pieces:
        if isinstance(k, tuple):
            total += _running(k)
        elif isinstance(k, Slot):
            total += k.chars
        elif not k.noise:
            w = _weight(k)
            total += w
            kids.append((w, k))
    return total, kids


def _weight(node) -> int:
    return _weigh(node)[0]


def _inside(node, path: str = ""):
    """(path of keys, element) of all elements in a node that may be of the article."""
    pieces = node.kids if isinstance(node, Element) else [s for g in node.groups or [] for s in g.slots]
    for k in pieces:
        if isinstance(k, (Element, Pattern)) and not k.noise:
            here = f"{path}/{k.key}"
            yield here, k
            yield from _inside(k, here)


def _says(node) -> bool:
    """Whether a node is a heading or paragraph of running text; in an expression, of text that is not the same in its pages."""
    if node.tag not in _SAYS:
        return False
    pieces = node.kids if isinstance(node, Element) else [s for g in node.groups or [] for s in g.slots]
    return any(_running(k) if isinstance(k, tuple) else isinstance(k, Slot) and k.chars and k.text is None for k in pieces)


def choose(root):
    """The element of the article: the weightiest article, else main, else the deepest that holds most running text and has no
    heading or paragraph beside it."""
    marked: dict[str, list] = {"article": [], "main": []}
    for _, k in _inside(root):
        if k.kind in marked:
            marked[k.kind].append(k)
    for kind in ("article", "main"):
        weights = [_weight(k) for k in marked[kind]]
        if weights and max(weights):
            best = marked[kind][weights.index(max(weights))]
            if kind == "article" or not marked["article"]:
                return best
    node = root
    while True:
        total, kids = _weigh(node)
        weight, heaviest = max(kids, key=lambda x: x[0], default=(0, None))
        if heaviest is None or weight < HOLDS * total or heaviest.tag in _LISTS or any(_says(k) for _, k in kids if k is not heaviest):
            return node
        node = heaviest


def infer(pages: list[str]) -> Pattern:
    """The expression of a host's pages. Pages that say the same count once."""
    trees, seen = [], set()
    for html in pages:
        tree = parse(html)
        said = hash(str(list(_texts(tree))))
        if said not in seen:
            seen.add(said)
            trees.append(tree)
    root = Pattern(Element("html"))
    for tree in trees:
        extend(root, tree)
    choose(root).main = True
    return root


def _long(*parts: str) -> int:
    """A hash that is the same on all workers, as a signed long."""
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest("\0".join(parts).encode("utf-8", "replace"))
    return n - (1 << 64) if n >> 63 else n


def outline(tree: Element) -> tuple[int, int, list[str]]:
    """Hashes of a page's skeleton and of the whole tree, and the paths that make the skeleton: those of all elements that can be an article."""
    paths = sorted({"", *(path for path, k in _inside(tree) if k.kind or k.tag not in _LISTS)})
    return _long(*paths), _long(*_stream(tree)), paths


def _stream(element: Element):
    for k in element.kids:
        if isinstance(k, tuple):
            yield k[0]
            yield str(k[1])
        else:
            yield f"<{k.key} {k.kind} {k.noise}>"
            yield from _stream(k)
            yield "</>"


def _points(tree: Element) -> str:
    """Path of the element that the page by itself takes as its article."""
    best = choose(tree)
    return next((path for path, k in _inside(tree) if k is best), "")


def _fixed(pattern: Pattern, path: str = "", repeated: bool = False):
    """(hash of path and text, pages) of the texts that stand unchanged."""
    for g in pattern.groups or []:
        for s in g.slots:
            if isinstance(s, Pattern):
                if not s.noise:
                    yield from _fixed(s, f"{path}/{s.key}", repeated or g.repeated)
            elif s is not None and s.text is not None and len(s.text) <= SAME_CHARS and not (repeated or g.repeated):
                yield _long(path, s.text), s.pages


def _texts(element: Element):
    for k in element.kids:
        if isinstance(k, tuple):
            yield k[0]
        else:
            yield from _texts(k)


def _match(element: Element, pattern: Pattern | None):
    """(kid, slot of the pattern that it matches or None, whether the slot's group is repeated)."""
    if pattern is None or not pattern.groups:
        return [(k, None, False) for k in element.kids]
    found, out = _groups(element.kids), []
    for i, j in _align([g.keys for g in pattern.groups], [k for k, _ in found]):
        if j is None:
            continue
        for kids in found[j][1]:
            for s, kid in enumerate(kids):
                group = pattern.groups[i] if i is not None else None
                out.append((kid, group.slots[s] if group else None, bool(group and group.repeated)))
    return out


def _read(element: Element, pattern: Pattern | None, out: list[str], path: str = "", fixed: frozenset = frozenset(), repeats: bool = False, inside: bool = False) -> None:
    inside = inside or element.kind == "article"  # what an article element holds is its text, whoever else has it
    for kid, slot, repeated in _match(element, pattern):
        if isinstance(kid, tuple):
            own = not inside and isinstance(slot, Slot) and slot.text == kid[0] and slot.pages >= SAME_PAGES and len(kid[0]) <= SAME_CHARS and not repeated
            if not own and not inside and fixed and not (repeats or repeated) and isinstance(slot, Slot) and slot.text == kid[0] and len(kid[0]) <= SAME_CHARS:
                own = _long(path, kid[0]) in fixed
            if not own:
                out.append(kid[0])
        elif kid.tag == "header":
            _headings(kid, out)
        elif not kid.noise:
            _read(kid, slot if isinstance(slot, Pattern) else None, out, f"{path}/{kid.key}", fixed, repeats or repeated, inside)


def _headings(element: Element, out: list[str]) -> None:
    for k in element.kids:
        if isinstance(k, Element) and not k.noise:
            if k.tag in _HEADING:
                out.extend(_texts(k))
            else:
                _headings(k, out)


def _find(element: Element, pattern: Pattern | None, out: list, path: str = "") -> None:
    for kid, slot, _ in _match(element, pattern):
        if isinstance(kid, Element) and isinstance(slot, Pattern) and not kid.noise:
            if slot.main:
                out.append((kid, slot, f"{path}/{kid.key}"))
            else:
                _find(kid, slot, out, f"{path}/{kid.key}")


def extract(html: str | None, pattern: Pattern | None = None, fixed: frozenset = frozenset()) -> str:
    """The main text of a page: blocks in page order, joined by two line ends. ``fixed`` are texts that the other
    layouts of its host have at the same place."""
    root = parse(html or "")
    places: list = []
    if pattern is not None:
        places = [(root, pattern, "")] if pattern.main else []
        if not places:
            _find(root, pattern, places)
    out: list[str] = []
    for element, part, path in places:
        _read(element, part, out, path, fixed)
    if not out:
        _read(choose(root), None, out)
    return "\n\n".join(out)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.try_parse_url(pages["url"], F.lit("HOST")), F.lit("")))
    return pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), host.alias("host"))


def _outlines(batches):
    for b in batches:
        rows = []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tree = parse(html)
            skeleton, whole, paths = outline(tree)
            rows.append((host, skeleton, whole, _long(*_texts(tree)), [_long(p) for p in paths], _long(_points(tree))))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "skeleton", "tree", "said", "paths", "points"])


def _with_skeleton(once: bool):
    """Adds skeleton and tree; with ``once`` copies that a task has seen are left out already."""

    def run(batches):
        seen: set = set()
        for b in batches:
            found = [(None, None) if html is None else outline(parse(html))[:2] for html in b.column("html").to_pylist()]
            skeletons, trees = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            out = pa.RecordBatch.from_arrays([*b.columns, skeletons, trees], [*b.schema.names, "skeleton", "tree"])
            if once:
                new = []
                for key in zip(b.column("host").to_pylist(), trees.to_pylist()):
                    new.append(key not in seen)
                    seen.add(key)
                out = out.filter(pa.array(new, pa.bool_()))
                if len(seen) > SEEN:
                    seen.clear()
            yield out

    return run


def _skeletons(hosted: DataFrame, once: bool = False) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hosted.schema.fields)
    return batched(hosted, _with_skeleton(once), f"{fields}, skeleton long, tree long")


def layouts(outlines: DataFrame) -> DataFrame:
    """host, skeleton, layout: pages of a layout hold the same of the elements that any page of the host points to."""
    per = stored(outlines.groupBy("host", "skeleton").agg(F.first("paths").alias("paths")), "skeletons")
    pointed = stored(outlines.select("host", F.col("points").alias("path")).distinct(), "pointed")
    held = per.select("host", "skeleton", F.explode("paths").alias("path")).join(pointed, ["host", "path"])
    held = held.groupBy("host", "skeleton").agg(F.array_sort(F.collect_set("path")).alias("held"))
    return held.select("host", "skeleton", F.xxhash64("held").alias("layout"))


_PARTS = "host string, layout long, part long, wrapper binary"


def _infer_parts(batches):
    """Rows come by host, layout, part and tree; copies count once."""
    key, root, last = None, None, None
    schema = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("part", pa.int64()), ("wrapper", pa.binary())])

    def done():
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, pickle.dumps(root))))], schema)

    for b in batches:
        for *here, tree, html in zip(*(c.to_pylist() for c in b.columns)):
            if here != key:
                if key is not None:
                    yield done()
                key, root, last = here, Pattern(Element("html")), None
            if tree != last:
                extend(root, parse(html))
            last = tree
    if key is not None:
        yield done()


def _merge_parts(t: pa.Table) -> pa.Table:
    t = t.sort_by("part")
    first, *others = (pickle.loads(x) for x in t["wrapper"].to_pylist())
    for other in others:
        merge(first, other)
    return pa.table([*(t[c].slice(0, 1) for c in ("host", "layout")), pa.array([t["part"][0].as_py() // MERGED]), pa.array([pickle.dumps(first)])], ["host", "layout", "part", "wrapper"])


def _finish(batches):
    for b in batches:
        wrappers, texts, counts = [], [], []
        for x in b.column(2).to_pylist():
            root = pickle.loads(x)
            choose(root).main = True
            most: dict[int, int] = {}
            for text, pages in _fixed(root):
                most[text] = max(pages, most.get(text, 0))
            wrappers.append(pickle.dumps(root))
            texts.append(list(most))
            counts.append(list(most.values()))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wrappers, pa.binary()), pa.array(texts, longs), pa.array(counts, longs)], ["host", "layout", "wrapper", "texts", "counts"])


def wrappers(pages: DataFrame, part: int = PART) -> DataFrame:
    """host, skeleton, wrapper (pickled), fixed from all rows of (host, html). Pages of a host that say the same count once."""
    small_batches(pages.sparkSession)
    ship(pages.sparkSession)
    rows = pages.where("html IS NOT NULL").select("host", "html")
    outlines = batched(rows, _outlines, "host string, skeleton long, tree long, said long, paths array<long>, points long")
    outlines = outlines.groupBy("host", "tree").agg(*[F.first(c).alias(c) for c in ("skeleton", "said", "paths", "points")])
    outlines = stored(outlines, "outlines")
    of = stored(layouts(outlines), "layouts")
    # of a layout's pages with the same texts in unlike trees, one tree stands for all
    placed = stored(outlines.select("host", "skeleton", "tree", "said").join(of, ["host", "skeleton"]), "placed")
    says = stored(placed.groupBy("host", "layout", "said").agg(F.min("tree").alias("kept"), F.count("*").alias("n")), "says")
    others = placed.join(says.where("n > 1"), ["host", "layout", "said"]).where("tree <> kept").select("host", "tree")
    others = stored(others, "others")
    counted = placed.join(others, ["host", "tree"], "left_anti")
    sizes = counted.groupBy("host", "layout").agg(F.ceil(F.count("*") / F.lit(part)).alias("parts"))
    sizes = stored(of.join(sizes, ["host", "layout"]), "sizes")
    most = sizes.agg(F.max("parts")).first()[0] or 1
    once = _skeletons(rows, True).join(others, ["host", "tree"], "left_anti").join(sizes, ["host", "skeleton"])
    dealt = once.select("host", "layout", F.expr("pmod(tree, parts)").alias("part"), "tree", "html")
    # the copies that are left lie side by side
    dealt = dealt.repartition("host", "layout", "part").sortWithinPartitions("host", "layout", "part", "tree")
    found = stored(batched(dealt, _infer_parts, _PARTS), "parts")
    while most > 1:
        most = -(-most // MERGED)
        found = stored(found.groupBy("host", "layout", F.expr(f"part div {MERGED}")).applyInArrow(_merge_parts, _PARTS), "parts")
    whole = stored(batched(found.select("host", "layout", "wrapper"), _finish, "host string, layout long, wrapper binary, texts array<long>, counts array<long>"), "expressions")
    fixed = whole.select("host", F.explode(F.arrays_zip("texts", "counts")).alias("t")).groupBy("host", F.col("t.texts").alias("text")).agg(F.sum("t.counts").alias("n"))
    fixed = stored(fixed.where(F.col("n") >= SAME_PAGES).groupBy("host").agg(F.array_sort(F.collect_list("text")).alias("fixed")), "fixed")
    return of.join(whole.select("host", "layout", "wrapper"), ["host", "layout"]).join(fixed, "host", "left").select("host", "skeleton", "wrapper", "fixed")


def _extract_all(batches):
    known: dict[bytes, Pattern] = {}
    for b in batches:
        texts = []
        for html, wrapper, fixed in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            if wrapper is not None and wrapper not in known:
                if len(known) > 200:
                    known.clear()
                known[wrapper] = pickle.loads(wrapper)
            texts.append(extract(html, known.get(wrapper), frozenset(fixed or ())))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, part: int = PART) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Nulls: a null html is empty and gives an empty text; a null or unreadable url has the host "". A null page_id is
    kept. Repeated rows come back as often. An empty table gives no rows. Other columns are not read.
    """
    hosted = _hosted(pages)
    found = stored(wrappers(hosted, part), "wrappers")
    rows = _skeletons(hosted).drop("tree")
    joined = rows.join(found, ["host", "skeleton"], "left").select(rows["page_id"].cast("long").alias("page_id"), "url", "html", "wrapper", "fixed")
    return batched(joined, _extract_all, "page_id long, url string, text string, n_chars long")


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
