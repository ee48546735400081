"""Main text of web pages by wrapper induction.

Pages of a host are parsed into trees in which siblings of one signature (tag and
class) are one repeated node, and aligned by simple tree matching into one
template per host: first inside every task, then by merging the tasks' templates,
whose nodes are bounded however many pages a host has.  Every node of a template counts its
pages, its text and link text.  A slot is the path of signatures to a node; the pages
that have a text in a slot are counted exactly, over all pages of the host, pages of
one core once: the longest texts that hold half of a page.
Constant texts become template; varying slots become content.  Where content is, the template
says: from its root down, the part that holds most of the text that is no link and not constant.
Elements that say that they are a menu, an advert, a form or the like are left out.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .url_filter import host_path

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg xmp noembed noframes object canvas".split())
#: elements that are never content
DEAD = frozenset("head title nav footer aside form menu dialog button select option datalist optgroup fieldset legend label input".split()) | RAW
DEAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: words that name what is no content wherever they stand in a name
STRONG_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored sidebar sidenav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr newsletter subscribe comment comments commentlist disqus related recommended recommendations share sharing pagination".split())
#: words that do in names of them and plain words alone, and of containers only: a paragraph may well be about a search
WEAK_WORDS = frozenset("promo promotion nav menu header notice notices alert banner popup modal overlay subscription social reply replies respond discussion login signup search pager widget toolbar skip hidden copyright".split())
#: words that say nothing of their own beside those; a name with any other word, as in entry-header or comment-policy-history, is not of these kinds
PLAIN_WORDS = frozenset("site page global main left right top bottom box boxes list item items block area wrapper wrap container content section inner outer bar slot unit units link links button buttons form icons icon posts post thread text tray row col column group nav article articles story stories reader readers user users body tools tool has no with count new all".split())
#: what text itself is in; other blocks are containers
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr ul ol dl table tbody thead tfoot hgroup address center summary figure".split())
#: headings that belong to the content beside them
HEADINGS = frozenset(("h1", "h2"))
#: levels of a tree; what is nested deeper counts as on the last
DEEPEST = 150
#: children of one tag, told apart by their classes, that a node of a template has; more are one child
FANOUT = 24
MAIN = frozenset(("article", "main"))
#: an opened element closes open ones of its group up to the next container
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_TOLD = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))


@dataclass(frozen=True)
class Params:
    least_pages: int = 4  # of a host, all of other cores, before a text can be constant
    constant_share: float = 0.9  # of these pages that have a constant text
    link_share: float = 0.6  # of a slot's text that is links, from which on it is a menu
    core_share: float = 0.5  # of a page's characters that its core holds; constant texts of the main element that hold more are no template
    content_share: float = 0.7  # of a node's text that one part has to hold to be where the content is
    main_weight: int = 3  # what text inside article or main counts for then
    least_share: float = 0.2  # of a page's text that the template's content has to hold, else the page goes by its own tree
    broadcast_bytes: int = 32 << 20  # templates up to which they are broadcast; a join by host beyond
    salts: int = 16


@lru_cache(maxsize=65_536)
def _says_dead(name: str, textual: bool) -> bool:
    """Whether a class or id names a menu, an advert or the like."""
    own = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    if not all(w in STRONG_WORDS or w in WEAK_WORDS or w in PLAIN_WORDS or len(w) == 1 for w in own) or own[:1] in (["has"], ["no"], ["with"]):
        return False
    return any(w in STRONG_WORDS or w in WEAK_WORDS and not textual for w in own)


class Tags:
    """The tags of a page from its begin to its end: (begin, end, name, closing, empty, attributes) of each; comments and the like have no name.

    Nothing is read twice: a quote, comment or element that is not closed is known to be so by
    where the last of its kind ends.  A quote that is not closed ends at the next ``>``.
    """

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self._last = {q: html.rfind(q) for q in "\"'>"}

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, bool, dict[str, str]]]:
        html, n = self.html, len(self.html)
        while (begin := html.find("<", self.at)) >= 0:
            after = html[begin + 1 : begin + 2]
            closing = after == "/"
            name = _TAG_NAME.match(html, begin + 1 + closing)
            if name is None:
                if after in ("!", "?") or closing:
                    mark, skip = ("-->", 4) if html.startswith("<!--", begin) else ("]]>", 9) if html.startswith("<![CDATA[", begin) else (">", 1)
                    end = html.find(mark, begin + skip)
                    self.at = n if end < 0 else end + len(mark)
                    yield begin, self.at, "", False, False, {}
                elif after == "":
                    return
                else:
                    self.at = begin + 1
                    yield begin, begin, "", False, False, {}  # a character of the text
                continue
            told: dict[str, str] = {}
            at, empty = name.end(), False
            while at < n and html[at] != ">":
                gap = _SPACE.match(html, at)
                if gap.end() > at:
                    empty = html[gap.end() - 1] == "/"
                    at = gap.end()
                    continue
                word = _ATTR_NAME.match(html, at)
                at, empty = word.end(), False
                equals = _EQUALS.match(html, at)
                value = ""
                if equals:
                    at = equals.end()
                    quote = html[at : at + 1]
                    if quote in ("\"", "'") and self._last[quote] > at:
                        end = html.find(quote, at + 1)
                        value, at = html[at + 1 : end], end + 1
                    else:
                        bare = _BARE.match(html, at)
                        value, at = bare[0], bare.end()
                key = word[0].lower()
                if key in _TOLD:
                    told.setdefault(key, value)
            self.at = min(n, at + 1)
            yield begin, self.at, name[0].lower(), closing, empty, told

    def skip(self, name: str) -> int:
        """Passes over what is in an element up to its end tag; where its text ends."""
        end = re.compile(rf"</{re.escape(name)}(?=[\s>/])", re.I).search(self.html, self.at)
        at = len(self.html) if end is None else self.html.find(">", end.start())
        self.at = len(self.html) if at < 0 else min(len(self.html), at + (end is not None))
        return self.at


class Page:
    """A parsed page: ``nodes`` of (parent, signature, dead, main, textual), ``blocks`` of (node, text, link characters)."""

    __slots__ = ("blocks", "children", "depth", "nodes")

    def __init__(self, html: str):
        self.nodes: list[tuple[int, str, bool, bool, bool]] = [(-1, "", False, False, False)]
        self.children: list[dict[str, int]] = [{}]
        self.depth = [0]
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # tag, node
        outer = [0]  # where blocks are on the stack
        open_ = [Counter()]  # inline elements of each of them
        blocks_open: Counter[str] = Counter()
        held: list[str] = []
        links = linked = at = 0

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[outer[-1]][1], text, links))
                held.clear()
            links = 0

        def said(text: str) -> None:
            nonlocal links
            if not self.nodes[stack[-1][1]][2]:
                text = unescape(text)
                held.append(text)
                if linked:
                    links += len(text)

        def close(depth: int) -> None:
            nonlocal linked
            while len(stack) > depth:
                block = outer[-1] == len(stack) - 1
                if block:
                    flush()
                    outer.pop()
                    open_.pop()
                tag = stack.pop()[0]
                linked -= tag == "a"
                (blocks_open if block else open_[-1])[tag] -= 1

        tags = Tags(html)
        for begin, end, tag, closing, empty, told in tags:
            if begin > at:
                said(html[at:begin])
            at = max(at, end)
            if not tag:
                continue
            block = tag in BLOCKS
            if closing:
                if not block:
                    if open_[-1][tag] > 0:
                        close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
                elif tag == "p":
                    if stack[outer[-1]][0] == "p":
                        close(outer[-1])
                elif blocks_open[tag] > 0:
                    close(next(d for d in reversed(outer) if stack[d][0] == tag))
            elif tag in ("br", "wbr"):
                if tag == "br":
                    said(" ")
            elif tag in RAW:
                if not empty or tag in ("script", "style"):
                    at = tags.skip(tag)
            else:
                if block:
                    while outer[-1] and (stack[outer[-1]][0] == "p" or stack[outer[-1]][0] in CLOSES.get(tag, ())):
                        close(outer[-1])
                        if tag not in CLOSES:
                            break
                    flush()
                node = self._node(stack[-1][1], tag, told)
                if tag not in VOID and not (empty and not block):
                    stack.append((tag, node))
                    linked += tag == "a"
                    if block:
                        outer.append(len(stack) - 1)
                        open_.append(Counter())
                    (blocks_open if block else open_[-1])[tag] += 1
        if at < len(html):
            said(html[at:])
        close(1)
        flush()

    def _node(self, parent: int, tag: str, told: dict[str, str]) -> int:
        key = tag
        dead, main, textual = tag in DEAD, tag in MAIN, tag in TEXTUAL or tag not in BLOCKS
        if told:
            dead = dead or tag not in ("html", "body") and ("hidden" in told or told.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(told.get("style", "")) is not None)
            role = told.get("role", "").lower()
            dead, main = dead or role in DEAD_ROLES, main or role == "main"
            if "class" in told:  # ids are mostly of one page
                key += "." + re.sub(r"\d+", "0", " ".join(told["class"].split()))
            names = f"{told.get('class', '')} {told.get('id', '')}".split()
            dead = dead or tag not in ("html", "body", "main") and any(_says_dead(n, textual) for n in names)
        above = self.nodes[parent]
        if tag == "header" and not above[3]:
            dead = True
        dead, main = dead or above[2], main or above[3]
        key += "!" * dead
        while self.depth[parent] >= DEEPEST:
            parent = self.nodes[parent][0]
        found = self.children[parent].get(key)
        if found is None:
            found = self.children[parent][key] = len(self.nodes)
            self.nodes.append((parent, key, dead, main, textual))
            self.children.append({})
            self.depth.append(self.depth[parent] + 1)
        return found

    def core(self, share: float) -> int:
        """A hash of the longest texts that hold ``share`` of the page's characters: pages that differ beside them are copies."""
        texts = sorted({t for _, t, _ in self.blocks}, key=lambda t: (-len(t), t))
        left, kept = share * sum(map(len, texts)), []
        for t in texts:
            kept.append(t)
            left -= len(t)
            if left <= 0:
                break
        return xxhash.xxh3_64_intdigest("\n".join(sorted(kept))) >> 1

    def shape(self) -> tuple:
        return tuple((p, s) for p, s, *_ in self.nodes)

    def placed_texts(self) -> list[int]:
        """A hash of slot and text for each block."""
        slots = [0] * len(self.nodes)
        for k, (parent, key, *_) in enumerate(self.nodes[1:], 1):
            slots[k] = xxhash.xxh3_64_intdigest(key, slots[parent])
        return [xxhash.xxh3_64_intdigest(text, slots[node]) >> 1 for node, text, _ in self.blocks]


class Template:
    """Aligned tree of a host.  A node: [signature, main, children, pages, characters, link characters, textual]."""

    def __init__(self, tree: list | None = None, pages: int = 0):
        self.tree, self.pages = tree or ["", False, [], 0, 0, 0, False], pages
        self._places: dict[tuple, list[list | None]] = {}
        self._inside: set[int] | None = None

    def align(self, page: Page, grow: bool) -> list[list | None]:
        """The template's node of each node of the page; None where simple tree matching finds none and it may not grow."""
        shape = page.shape()
        found = self._places.get(shape)
        if found is None:
            if len(self._places) > 4096:
                self._places.clear()
            tree = _tree(page, 0)
            found = [None] * len(page.nodes)
            _align(self.tree, tree, grow, lambda mine, theirs: found.__setitem__(theirs[7], mine))
            self._places[shape] = found
        return found

    def add(self, page: Page) -> None:
        self.pages += 1
        self._inside = None
        places = self.align(page, True)
        for node, text, links in page.blocks:
            mine = places[node]
            mine[4] += len(text)
            mine[5] += links
        for node in {n for n, _, _ in page.blocks}:
            places[node][3] += 1

    def merge(self, other: Template) -> None:
        self.pages += other.pages
        self._places.clear()
        self._inside = None

        def both(mine: list, theirs: list) -> None:
            for k in (3, 4, 5):
                mine[k] += theirs[k]

        _align(self.tree, other.tree, True, both)

    def content(self, params: Params) -> tuple[list, list[list]]:
        """The node that holds the content, and those above it.

        From the root down into the container with ``content_share`` of the text that is no menu's, text inside main
        elements counting for more; an article or main element is taken whole, and others with it.
        """
        mass: dict[int, int] = {}

        def weigh(node: list) -> int:
            own = 0 if node[5] >= params.link_share * max(1, node[4]) or node[0].endswith("!") else (node[4] - node[5]) * (params.main_weight if node[1] else 1)
            mass[id(node)] = own + sum(weigh(c) for c in node[2])
            return mass[id(node)]

        weigh(self.tree)
        node, above = self.tree, []
        while not node[1] and (best := max((c for c in node[2] if not c[6]), key=lambda c: mass[id(c)], default=None)) is not None and mass[id(best)] >= params.content_share * max(1, mass[id(node)]):
            above.append(node)
            node = best
        return node, above

    def inside(self, params: Params) -> set[int]:
        """The nodes of the content, and of the headings beside the way to it."""
        if self._inside is None:
            node, above = self.content(params)
            mains = _below(self.tree, True) if node[1] else set()
            self._inside = _below(node).union(mains, *(_below(c) for n in above for c in n[2] if _tag(c[0]) in HEADINGS))
        return self._inside

    def dump(self) -> str:
        return json.dumps([self.pages, self.tree], ensure_ascii=False, separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Template:
        pages, tree = json.loads(text)
        return Template(tree, pages)


def _tree(page: Page, node: int) -> list:
    _, key, _, main, textual = page.nodes[node]
    return [key, main, [_tree(page, c) for c in page.children[node].values()], 0, 0, 0, textual, node]


def _matching(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the size of the largest top-down, order-keeping match of two trees."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _table(a[2], b[2], memo)[-1][-1] + 1
    return memo[key]


def _table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        row = [0]
        for j, y in enumerate(ys):
            row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + _matching(x, y, memo)))
        rows.append(row)
    return rows


def _tag(key: str) -> str:
    return key.rstrip("!").split(".", 1)[0]


def _align(mine: list, theirs: list, grow: bool, met, memo: dict | None = None) -> None:
    """Calls met(node of mine, node of theirs) for all that match; with grow, what doesn't match is put into mine."""
    memo = {} if memo is None else memo
    met(mine, theirs)
    xs, ys = mine[2], theirs[2]
    table = _table(xs, ys, memo)
    i, j, pairs = len(xs), len(ys), []
    while i and j:
        w = _matching(xs[i - 1], ys[j - 1], memo)
        if w and table[i][j] == table[i - 1][j - 1] + w:
            pairs.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i -= 1
    of = {id(y): x for x, y in pairs}
    last = 0
    for y in ys:
        x = of.get(id(y))
        if x is None and grow:
            # one node a signature among siblings, also where the order differs
            x = next((c for c in mine[2] if c[0] == y[0]), None)
            if x is None:
                key = y[0]
                if sum(_tag(c[0]) == _tag(key) for c in mine[2]) >= FANOUT:
                    key = _tag(key) + ".*" + "!" * key.endswith("!")
                    x = next((c for c in mine[2] if c[0] == key), None)
            if x is None:
                x = [key, y[1], [], 0, 0, 0, y[6]]
                mine[2].insert(last, x)
        elif x is None:
            key = _tag(y[0]) + ".*" + "!" * y[0].endswith("!")
            x = next((c for c in mine[2] if c[0] == key), None)
        if x is not None:
            last = next(k for k, c in enumerate(mine[2]) if c is x) + 1
            _align(x, y, grow, met, memo)


def page_text(page: Page, template: Template, params: Params, constant: frozenset[int] = frozenset()) -> str:
    """The text of a page; constant: the placed texts that the page's host has everywhere.

    A host of few pages has no template to go by: the page's own tree takes its place, and so it
    does where the template's content holds next to nothing of what the page has.
    """
    placed = page.placed_texts() if constant else [0] * len(page.blocks)

    def own() -> Template:
        t = Template()
        t.add(page)
        return t

    def kept_by(t: Template) -> list[tuple[bool, bool, str]]:
        """(in the content, constant, text) of what is no menu."""
        places, inside = t.align(page, False), t.inside(params)
        out = []
        for (node, text, links), at in zip(page.blocks, placed, strict=True):
            _, _, dead, main, _ = page.nodes[node]
            slot = places[node]
            menu = links >= params.link_share * len(text) if slot is None else slot[5] >= params.link_share * max(1, slot[4])
            if not dead and (main or not menu):
                out.append((slot is not None and id(slot) in inside, at in constant, text))
        return out

    found = kept_by(template if template.pages >= params.least_pages else own())
    size = lambda rows: sum(len(t) for *_, t in rows)
    if size([r for r in found if r[0] and not r[1]]) < params.least_share * size([r for r in found if not r[1]]):
        found = kept_by(own())
    content = [r for r in found if r[0]]
    # a text that is on all pages is no template where it is most of the article
    if size([r for r in content if r[1]]) > params.core_share * size(content) and any(page.nodes[n][3] for n, _, _ in page.blocks):
        return "\n".join(t for *_, t in content)
    return "\n".join(t for _, c, t in content if not c)


def _below(node: list, main: bool = False) -> set[int]:
    """A node and all below it; or those of them in article or main elements."""
    return {id(node)}.union(*(_below(c, main) for c in node[2])) if node[1] or not main else set().union(*(_below(c, main) for c in node[2]))


def _induce():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: dict[str, Template] = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(templates)), pa.array([t.dump() for t in templates.values()])], ["host", "template"])

        for b in batches:
            for k in range(len(b)):
                html = b.column(1)[k].as_py()
                if html:
                    templates.setdefault(b.column(0)[k].as_py(), Template()).add(Page(html))
            if len(templates) > 2000:
                yield made()
                templates.clear()
        if templates:
            yield made()

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    whole = Template()
    for text in sorted(rows["template"]):
        whole.merge(Template.load(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [whole.dump()]})


def induce(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, template) of pages(host, html): one row per host with any html.

    Rows of null or empty html add nothing, repeated rows count each, an empty table gives none.
    """
    each = pages.select("host", "html").mapInArrow(_induce(), "host string, template string")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(params.salts)))
    schema = "host string, template string"
    some = salted.groupBy("host", "salt").applyInPandas(_merge, schema)
    return cut(some.groupBy("host").applyInPandas(_merge, schema))


def _placed(core_share: float):
    """(host, content, items) of every page: a hash of its core; its distinct placed texts, and -1 for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, contents, items = [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if html := html.as_py():
                    page = Page(html)
                    hosts.append(host)
                    contents.append(page.core(core_share))
                    items.append([-1, *dict.fromkeys(page.placed_texts())])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["host", "content", "items"])

    return run


def constants(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, constant array<long>) of pages(host, html): the placed texts of each host that has any on enough of its pages.

    All pages are counted, and those of one core once, so that copies of one page, near copies too,
    have no constant texts; how pages are dealt to tasks makes no difference.  Null and empty html add
    nothing, repeated rows nothing new; an empty table gives no rows.
    """
    each = pages.select("host", "html").mapInArrow(_placed(params.core_share), "host string, content long, items array<long>")
    each = each.groupBy("host", "content").agg(F.min("items").alias("items"))
    counts = each.select("host", F.explode("items").alias("item")).groupBy("host", "item").agg(F.count("*").alias("c"))
    # a constant text has this many at least: the rest, nearly all, needs no join
    counts = cut(counts.where((F.col("item") == -1) | (F.col("c") >= params.constant_share * params.least_pages)))
    whole = counts.where((F.col("item") == -1) & (F.col("c") >= params.least_pages)).select("host", F.col("c").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt"))
    often = counts.where("item <> -1").withColumn("salt", F.pmod("item", F.lit(params.salts)).cast("int"))
    often = often.join(whole, ["host", "salt"]).where(F.col("c") >= F.col("n") * params.constant_share)
    return often.groupBy("host").agg(F.collect_list("item").alias("constant"))


def _extract(params: Params, given: dict[str, tuple[str, list[int]]] | None):
    """given: all templates and constant texts, or None where each row carries its own."""
    loaded: dict[str, tuple[Template, frozenset[int]]] = {}

    def of_host(host: str, own: tuple[str | None, list[int] | None]) -> tuple[Template, frozenset[int]]:
        if host not in loaded:
            if len(loaded) > 500:
                loaded.clear()
            text, constant = own if given is None else given.value.get(host, (None, None))
            loaded[host] = Template.load(text) if text else Template(), frozenset(constant or ())
        return loaded[host]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for k in range(len(b)):
                host, html = b.column(2)[k].as_py(), b.column(3)[k].as_py()
                own = (b.column(4)[k].as_py(), b.column(5)[k].as_py()) if given is None and host not in loaded else (None, None)
                template, constant = of_host(host, own)
                texts.append(page_text(Page(html), template, params, constant) if html else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Blocks of the main text in page order, joined by a line feed; white space in a
    block is one space, character references are decoded.  Null or empty html: empty
    text.  What is nested more than ``DEEPEST`` levels deep counts as on the last of them.  A null url, or one without ``://``, belongs to the host ''.  A host of fewer
    than ``least_pages`` pages has no template to go by, and of fewer different cores no constant texts.  Copies
    of an article keep it.  Repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    A page takes time by its length, however broken.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", host_path()[0].alias("host"), F.col("html").cast("string").alias("html"))
    templates = cut(induce(rows, params).join(constants(rows, params), "host", "left"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    size = templates.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host") + 8 * F.coalesce(F.array_size("constant"), F.lit(0))), F.lit(0))).first()[0]
    if size <= params.broadcast_bytes:
        given = spark.sparkContext.broadcast({r.host: (r.template, r.constant) for r in templates.collect()})
        return rows.mapInArrow(_extract(params, given), schema)
    return rows.join(templates, "host", "left").select("page_id", "url", "host", "html", "template", "constant").mapInArrow(_extract(params, None), schema)
