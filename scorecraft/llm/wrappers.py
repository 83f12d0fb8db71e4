"""Operator 12: main text of web pages by wrappers inferred from the pages of a host.

A page is read as a balanced stream of tags and texts (a tolerant parser closes
what pages leave open).  A wrapper is a union-free regular expression over such
streams: an element with its content, a text that is equal on all pages, a text
slot, an optional part ``(...)?`` or a repeated group ``(...)+``.  Two wrappers are
aligned child by child along a longest common subsequence of their tags:

* texts that differ become a slot;
* what only one side has becomes optional;
* a run of like parts, of one element or several in turn, becomes a repeated
  group, and a run on one side is aligned with a group on the other.

Aligning is how wrappers grow, page by page, and how partial wrappers are merged:
each task aligns the pages of its partition host by host, then wrappers of one
host are merged in rounds of at most ``MERGED`` a group, so a host with most of the
pages is no hot group.  Pages meet their host's wrapper in a join that the engine
splits where a host is hot.

In a wrapper the main region is chosen once for the host: the elements ``article``,
else ``main``, else all of the body but the texts that are equal on all pages.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments (by element, role or class) are no part of it.  A page's text is what
stands in the region, slot or not: an article that two pages share stays.

Defined cases: null and empty html give an empty text, html without tags is text;
pages without a host count as one host; a page alone on its host is its own
wrapper; equal rows give equal rows; pages of any length are read whole; other
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored
from scorecraft.llm.url_rules import host_path

#: Partial wrappers of a host that one task merges in a round.
MERGED = 64
#: Elements nest so deep; deeper ones stand beside their content.
DEEPEST = 128
#: Texts up to this length stand in a wrapper as they are, longer ones by their digest.
SPELLED = 80
#: Elements without content; elements whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe")
#: Elements that never hold main text, and those that don't outside of an article.
NEVER = frozenset("script style noscript template head title nav aside form button select option textarea input iframe svg canvas object dialog menu xmp noembed noframes video audio".split())
FRAME = frozenset("header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes, ids and roles that tell such parts.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside related recommended share sharing social newsletter subscribe signup login search cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus respond replies pagination pager toolbar widget form complementary contentinfo dialog".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these closes an open one of those (up to the element that holds both).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
HOLDS = frozenset("html body article main section div aside nav header footer form table tbody thead tfoot tr td th ul ol li dl dd blockquote figure button object".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: A tag with a quote that nothing closes.
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
_SIGN = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_WORD = re.compile(r"[a-z]+|[0-9]+")


class Node:
    """An element of a page, or of a wrapper: tag, class words, content; or a text."""

    __slots__ = ("tag", "mark", "children", "text", "optional", "repeated")

    def __init__(self, tag: str, mark: str = "", text: str | None = None):
        self.tag, self.mark, self.text = tag, mark, text
        self.children: list[Node] = []
        self.optional = self.repeated = False

    @property
    def key(self) -> str:
        """What must be equal to align two nodes; groups and texts have keys of their own."""
        return self.tag + "." + self.mark


TEXT, GROUP = "#text", "#group"


def parse(html: str) -> Node:
    """A page as a balanced tree under ``#page``; character references decoded."""
    page = Node("#page")
    open_: list[Node] = [page]
    flat: list[str] = []  # elements too deep to nest: their content goes to the one around
    at, n = 0, len(html)

    def say(raw: str) -> None:
        if raw:
            open_[-1].children.append(Node(TEXT, text=unescape(raw)))

    def close(tags, within) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in tags:
                del open_[i:]
                return close(tags, within)
            if open_[i].tag in within:
                return None
        return None

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        m = _TOKEN.match(html, lt) or _OPEN.match(html, lt)
        if m is None:  # a lone sign is text
            nxt = html.find("<", lt + 1)
            say(html[at:nxt if nxt >= 0 else n])
            at = nxt if nxt >= 0 else n
            continue
        say(html[at:lt])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if flat and name in flat:
                flat.remove(name)
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == name:
                    del open_[i:]
                    break
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        elif name in BLOCKS:
            close({"p"}, HOLDS)
        node = Node(name, _mark(m[3]) if m[3] else "")
        open_[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(r"</" + name + r"(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.children.append(Node(TEXT, text=html[at:end.start() if end else n]))
            at = end.end() if end else n
            continue
        if len(open_) <= DEEPEST:
            open_.append(node)
        else:
            flat.append(name)
    return page


def _mark(attributes: str) -> str:
    """The words of class, id and role that tell a part's use; no others, so that pages align."""
    found = set()
    for m in _SIGN.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role" and value.strip().lower() == "main":
            found.add("main")
        for part in value.lower().split():
            words = _WORD.findall(part)
            found.update(w for w in words if w in SIGNS)
    return " ".join(sorted(found))


def wrapper(page: Node) -> Node:
    """A page as the wrapper of itself, runs folded into groups."""
    if page.tag == TEXT:
        return Node(TEXT, text=told(page.text))
    made = Node(page.tag, page.mark)
    made.children = _fold([wrapper(c) for c in _solid(page.children)])
    return made


def told(text: str) -> str:
    """What a wrapper keeps of a text, to tell whether another is equal."""
    return text if len(text) <= SPELLED else "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _plain(text: str) -> str:
    """White space (all that Unicode calls so) as one space, none at the ends."""
    return " ".join(text.split())


def _solid(children: list[Node]) -> list[Node]:
    """Children without blank texts, neighbouring texts as one."""
    out: list[Node] = []
    for c in children:
        if c.tag == TEXT:
            text = _plain(c.text)
            if not text:
                continue
            if out and out[-1].tag == TEXT:
                out[-1] = Node(TEXT, text=out[-1].text + " " + text)
                continue
            c = Node(TEXT, text=text)
        out.append(c)
    return out


def _fold(parts: list[Node]) -> list[Node]:
    """Runs of like parts, and of up to four parts in turn, become repeated groups."""
    for period in (1, 2, 3, 4):
        out: list[Node] = []
        i = 0
        while i < len(parts):
            run = [p.key for p in parts[i:i + period]]
            n = 1
            while len(run) == period and [p.key for p in parts[i + n * period:i + (n + 1) * period]] == run:
                n += 1
            plain = all(p.tag != GROUP for p in parts[i:i + period]) and (period == 1 or len(set(run)) > 1)
            if n > 1 and plain and run[0] != TEXT + ".":
                body = parts[i:i + period]
                for k in range(1, n):
                    body = [align(a, b) for a, b in zip(body, parts[i + k * period:i + (k + 1) * period])]
                out.append(_group(body))
                i += n * period
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def _group(body: list[Node]) -> Node:
    g = Node(GROUP, " ".join(sorted({p.key for p in body})))
    g.children, g.repeated = body, True
    return g


def align(a: Node, b: Node) -> Node:
    """The least union-free expression found that holds both: same key on both sides."""
    if a.tag == TEXT:
        made = Node(TEXT, text=a.text if a.text == b.text else None)
    else:
        made = Node(a.tag, a.mark)
        made.children = _aligned(a.children, b.children)
    made.optional, made.repeated = a.optional or b.optional, a.repeated or b.repeated
    return made


def _aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Two contents as one: common parts aligned, runs taken into groups, the rest optional."""
    if [x.key for x in a] == [y.key for y in b]:
        return [align(x, y) for x, y in zip(a, b)]
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = [x.key for x in a], [y.key for y in b]
    # longest common subsequence, equal ends taken off first
    lead = 0
    while lead < min(len(a), len(b)) and ka[lead] == kb[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    ma, mb = range(lead, len(a) - tail), range(lead, len(b) - tail)
    best = [[0] * (len(mb) + 1) for _ in range(len(ma) + 1)]
    for i in range(len(ma) - 1, -1, -1):
        for j in range(len(mb) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[ma[i]] == kb[mb[j]] else max(best[i + 1][j], best[i][j + 1])
    out = [align(x, y) for x, y in zip(a[:lead], b[:lead])]
    i = j = 0
    while i < len(ma) or j < len(mb):
        if i < len(ma) and j < len(mb) and ka[ma[i]] == kb[mb[j]]:
            out.append(align(a[ma[i]], b[mb[j]]))
            i, j = i + 1, j + 1
        elif j >= len(mb) or (i < len(ma) and best[i + 1][j] >= best[i][j + 1]):
            out.append(_maybe(a[ma[i]]))
            i += 1
        else:
            out.append(_maybe(b[mb[j]]))
            j += 1
    return _fold(out + [align(x, y) for x, y in zip(a[len(a) - tail:], b[len(b) - tail:])])


def _grouped(parts: list[Node], other: list[Node]) -> list[Node]:
    """``parts`` with the runs that a group of ``other`` can hold as a group of the same body."""
    for g in other:
        if g.tag != GROUP:
            continue
        order = [p.key for p in g.children]
        out: list[Node] = []
        for p in parts:
            body = p.children if p.tag == GROUP else [p]
            if p.key == g.key or not all(q.key in order for q in body):
                out.append(p)
                continue
            if not (out and out[-1].key == g.key):
                empty = Node(GROUP, g.mark)
                empty.children, empty.repeated = [_maybe(x) for x in g.children] if len(order) > 1 else g.children, True
                out.append(empty)
            into = {q.key: q for q in body}
            some = _maybe if len(order) > 1 else lambda x: x
            out[-1].children = [some(align(x, into[x.key])) if x.key in into else x for x in out[-1].children]
        parts = out
    return parts


def _maybe(node: Node) -> Node:
    made = Node(node.tag, node.mark, node.text)
    made.children, made.optional, made.repeated = node.children, True, node.repeated
    return made


def spelled(w: Node) -> str:
    """A wrapper as a regular expression, for people to read."""
    inner = "".join(spelled(c) for c in w.children)
    if w.tag == TEXT:
        out = "SLOT" if w.text is None else json.dumps(w.text, ensure_ascii=False)
    elif w.tag == GROUP:
        out = inner
    else:
        mark = f" {w.mark}" if w.mark else ""
        out = f"<{w.tag}{mark}>" + (inner + f"</{w.tag}>" if w.tag not in VOID else "")
    if w.repeated:
        out = f"({out})+"
    return f"({out})?" if w.optional else out


def dump(w: Node) -> list:
    return [w.tag, w.mark, w.text, int(w.optional) + 2 * int(w.repeated), [dump(c) for c in w.children]]


def load(x: list) -> Node:
    w = Node(x[0], x[1], x[2])
    w.optional, w.repeated = bool(x[3] & 1), bool(x[3] & 2)
    w.children = [load(c) for c in x[4]]
    return w


class Region:
    """Which parts of a host's pages are main text, as its wrapper tells."""

    def __init__(self, w: Node, differ: bool):
        """``differ``: is the wrapper of pages that aren't all the same?"""
        self.wrapper = _told_optional(w, False)
        self.root = next((t for t in ("article", "main") if self._has(w, t)), None)
        self.constant = differ and self.root is None  # texts equal on all pages are the host's

    def _has(self, w: Node, tag: str) -> bool:
        return not _apart(w, False) and (_is(w, tag) or any(self._has(c, tag) for c in w.children))

    def text(self, page: Node) -> str:
        """The page's main text, block by block."""
        self.blocks: list[list[str]] = [[]]
        self.within = self.root if self.root and self._has(page, self.root) else None
        self._walk(page, [self.wrapper], self.within is None, False)
        lines = (_plain("".join(b)) for b in self.blocks)
        return "\n".join(line for line in lines if line)

    def _walk(self, node: Node, at: list[Node], inside: bool, article: bool) -> None:
        """``at``: the wrapper's nodes that the node is matched with."""
        for child in node.children:
            if child.tag == TEXT:
                if inside and not (self.constant and self._fixed(child, at)):
                    self.blocks[-1].append(child.text)
                continue
            if _apart(child, article):
                if article and child.tag in FRAME:
                    self._headings(child, at)
                self._cut(child)
                continue
            block = child.tag in BLOCKS
            within = inside or _is(child, self.within)
            if block:
                self.blocks.append([])
            elif child.tag == "br":
                self.blocks[-1].append(" ")
            self._walk(child, [m for w in at for m in _content(w) if m.key == child.key], within, article or child.tag == "article")
            if block:
                self.blocks.append([])

    def _headings(self, node: Node, at: list[Node]) -> None:
        """Headings of an article may stand in a header of its own."""
        for child in node.children:
            if child.tag in HEADINGS:
                self.blocks.append([])
                self._walk(child, at, True, True)
                self.blocks.append([])
            elif child.tag != TEXT and not _apart(child, False):
                self._headings(child, at)

    def _cut(self, node: Node) -> None:
        if node.tag in BLOCKS:
            self.blocks.append([])

    @staticmethod
    def _fixed(text: Node, at: list[Node]) -> bool:
        """Does the wrapper have just this text here?"""
        plain = told(_plain(text.text))
        return any(m.tag == TEXT and m.text == plain and not m.optional for w in at for m in _content(w))


def _told_optional(w: Node, optional: bool) -> Node:
    """``w`` with all that stands in optional parts told to be optional."""
    made = Node(w.tag, w.mark, w.text)
    made.optional, made.repeated = w.optional or optional, w.repeated
    made.children = [_told_optional(c, made.optional) for c in w.children]
    return made


def _content(w: Node) -> Iterator[Node]:
    """A wrapper's parts, those of groups included."""
    for c in w.children:
        if c.tag == GROUP:
            yield from _content(c)
        else:
            yield c


def _is(node: Node, tag: str | None) -> bool:
    return node.tag == tag or (tag == "main" and "main" in node.mark.split())


def _apart(node: Node, article: bool) -> bool:
    """Is the part none of the main text? An article's own frame is told by its tag alone."""
    if node.tag in NEVER or node.tag in FRAME:
        return True
    return bool(node.mark) and node.tag not in ("html", "body", "#page", GROUP) and any(m != "main" for m in node.mark.split())


def _merge(have: dict, host: str, pages: int, w: Node, page: str) -> None:
    """``page``: digest of the only page among them, empty if they differ."""
    old = have.get(host)
    have[host] = (pages, w, page) if old is None else (old[0] + pages, align(old[1], w), page if page == old[2] else "")


PARTIAL = "host string, part long, pages long, page string, wrapper string"


def infer(pages: DataFrame) -> DataFrame:
    """host, pages, differ (aren't they all the same?), wrapper (see ``dump``) of all pages with columns host and html."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, tuple[int, Node, str]] = {}
        held = 0
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                _merge(have, host, 1, wrapper(parse(html or "")), told((html or "").ljust(SPELLED + 1)))
                held += 1
            if held >= 20_000:  # wrappers of so many pages are told and begun anew
                yield out(have)
                have, held = {}, 0
        if have:
            yield out(have)

    def out(have: dict) -> pa.RecordBatch:
        pages_, made, page = zip(*have.values())
        return pa.RecordBatch.from_arrays([
            pa.array(list(have), pa.string()), pa.array([0] * len(have), pa.int64()), pa.array(pages_, pa.int64()), pa.array(page, pa.string()),
            pa.array([json.dumps(dump(w)) for w in made], pa.string())], names=["host", "part", "pages", "page", "wrapper"])

    def merge(t: pa.Table) -> pa.Table:
        have: dict[str, tuple[int, Node, str]] = {}
        for r in t.to_pylist():
            _merge(have, r["host"], r["pages"], load(json.loads(r["wrapper"])), r["page"])
        return pa.Table.from_batches([out(have)])

    made = stored(pages.select("host", "html").mapInArrow(local, PARTIAL).withColumn("part", F.monotonically_increasing_id()), "wrappers")
    while True:
        most = made.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return made.select("host", "pages", (F.col("page") == "").alias("differ"), "wrapper")
        # a host's partial wrappers meet in groups of about MERGED, then those groups' wrappers do
        groups = F.lit(max(-(-most // MERGED), 1))
        made = made.withColumn("part", F.pmod(F.xxhash64("host", "part"), groups))
        made = stored(made.groupBy("host", "part").applyInArrow(merge, PARTIAL).withColumn("part", F.monotonically_increasing_id()), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and text of every page."""
    host, _ = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    wrappers = infer(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions: dict[str, Region] = {}
        for batch in batches:
            texts = []
            for host_, html, differ, w in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "differ", "wrapper"))):
                if host_ not in regions:
                    if len(regions) >= 2000:
                        regions.clear()
                    regions[host_] = Region(load(json.loads(w)), differ)
                texts.append(regions[host_].text(parse(html or "")))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string())], names=["__id", "__url", "text"])

    schema = rows.select("__id", "__url", F.lit("").alias("text")).schema
    read_ = rows.join(wrappers, "host").select("__id", "__url", "html", "host", "differ", "wrapper").mapInArrow(read, schema)
    return read_.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text")
