"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags), each with its root-to-leaf path of block-level tags; open p, li and
table parts are closed as HTML says. Blocks under tags or names of furniture (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are out. Over the others, text length and punctuation are added up by
path and divided by the path's number of blocks; both ratios are smoothed along the page's paths, fused by multiplication,
and paths of at least SHARE of the greatest fused ratio hold content. The content node is the lowest common ancestor of all
their blocks, of every article, any h1 and the heading before them, or the nearest article or main around it; all blocks below it are
the main text, short ones too.

A class, id or role names furniture if a whole word of it does, or a compound whose last part does (site-footer, but not
widget-body or share-price) or says no more than a box (PARTS: comment-list, nav-item). Of elements within a line, only
spans go by their names, and only by whole words. Where nothing is left, names are no evidence and tags alone decide.

A page is read once from left to right, so time is linear in it: what has no end (a quote, a comment) is looked for once, open
tags are found by name, and paths are numbered. A quoted value that never ends takes its tag to the next ">".

Null or empty html, or none but furniture: empty text, n_chars 0. Repeated rows, null ids: a result row each.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARE = 0.15
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select option button object canvas audio video".split())
UNSEEN = frozenset("script style title noscript template".split())
BLOCK = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog search fieldset".split())
#: Words of class, id and role that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side aside complementary rail menu menus nav navi navbar navigation breadcrumb breadcrumbs toolbar footer foot header masthead contentinfo comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login search widget widgets pagination pager".split()
)
#: Parts of compound names that say nothing of what a box holds.
PARTS = frozenset("area bar block box button buttons container content el form header footer group holder icon icons inner item items left link links list outer panel placeholder post posts region right section slot thread title top unit wrap wrapper zone".split())
RELATION = frozenset("has no not with without".split())
KEPT = frozenset("html body main article".split())
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_NAME = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_PUNCT = re.compile(r"[.,;:!?…。，！？]")


def _named(attrs: str, tag: str) -> bool:
    """Whether a class, id or role names furniture."""
    if tag in KEPT or (tag not in BLOCK and tag != "span"):
        return False
    names = NAMES - {"header", "masthead", "banner"} if tag in HEADINGS else NAMES
    for m in _NAME.finditer(attrs):
        for word in (m[2] or m[3] or m[4] or "").split():
            parts = [x.lower() for x in _PART.findall(word)]
            if parts and parts[0] in RELATION:  # has-sidebar is no sidebar
                continue
            if tag not in BLOCK:
                parts = parts if len(parts) == 1 else []
            if parts and (parts[-1] in names or (parts[-1] in PARTS and not names.isdisjoint(parts))):
                return True
    return False


class _Finder:
    """page.find, but what was not found is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.gone.add(what)
        return got

    def tag_end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose attributes begin at `at`; the page's end if there is none."""
        page, stop = self.page, self(">", at)
        while stop >= 0:
            equals = page.find("=", at, stop)
            if equals < 0:
                return stop
            at = equals + 1
            while at < stop and page[at].isspace():
                at += 1
            if page[at] in "\"'":
                end = self(page[at], at + 1)
                if end >= 0:
                    at = end + 1
                    if at > stop:
                        stop = self(">", at)
        return len(page)


class Tree:
    """Block-level elements as numbers in page order, and the blocks of text."""

    def __init__(self, page: str, by_name: bool = True):
        self.parent, self.tag, self.last = [-1], [""], [0]  # last: the greatest number within
        self.paths: dict[tuple[int, str], int] = {}
        self.path_tags, self.path_up = [""], [-1]
        self.path = [0]
        self.blocks: list[tuple[int, str]] = []  # (element, text)
        self._read(page, by_name)

    def _path(self, up: int, tag: str) -> int:
        got = self.paths.setdefault((up, tag), len(self.path_tags))
        if got == len(self.path_tags):
            self.path_tags.append(tag)
            self.path_up.append(up)
        return got

    def _read(self, page: str, by_name: bool) -> None:
        stack: list[tuple[str, bool, int]] = []  # tag, furniture, innermost block-level element
        where: dict[str, list[int]] = {}  # places in the stack by tag
        buf: list[str] = []
        find = _Finder(page)

        def flush() -> None:
            if buf:
                text = " ".join(entities.unescape("".join(buf)).split())
                buf.clear()
                if text:
                    self.blocks.append((stack[-1][2] if stack else 0, text))

        def add(text: str) -> None:
            if not (stack and stack[-1][1]):
                buf.append(text)

        def close(tags, stop) -> None:
            i = max((where[t][-1] for t in tags if where.get(t)), default=-1)
            if i < 0 or any(where.get(t) and where[t][-1] > i for t in stop):
                return
            if any(x[0] in BLOCK for x in stack[i:]):
                flush()
            while len(stack) > i:
                tag, _, node = stack.pop()
                where[tag].pop()
                if tag in BLOCK:
                    self.last[node] = len(self.tag) - 1

        at, end = 0, len(page)
        while at < end:
            start = find("<", at)
            if start < 0:
                add(page[at:])
                break
            if start > at:
                add(page[at:start])
            if page.startswith("<!--", start):
                stop = find("-->", start + 4)
                at = stop + 3 if stop >= 0 else end
                continue
            if page.startswith("<![CDATA[", start):
                stop = find("]]>", start)
                at = stop + 3 if stop >= 0 else end
                continue
            if page.startswith(("<!", "<?"), start):
                stop = find(">", start)
                at = stop + 1 if stop >= 0 else end
                continue
            m = _OPEN.match(page, start)
            if not m:
                add("<")
                at = start + 1
                continue
            stop = find.tag_end(m.end())
            attrs, at = page[m.end() : stop], stop + 1
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    flush()
                close({tag}, frozenset() if tag in BLOCK else BLOCK)
                continue
            if tag in RAW:
                closing = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at) if find("</", at) >= 0 else None
                at = closing.end() if closing else end
                if tag not in UNSEEN:
                    add(" ")
                continue
            if tag in VOID:
                if tag in BLOCK:
                    flush()
                elif tag == "br":
                    add(" ")
                continue
            if tag == "body":
                close({"head"}, frozenset())
            if tag in BLOCK:
                flush()
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            node = stack[-1][2] if stack else 0
            hidden = bool(stack and stack[-1][1]) or tag in FURNITURE or (by_name and _named(attrs, tag))
            if tag in BLOCK:
                self.parent.append(node)
                self.tag.append(tag)
                self.last.append(0)
                self.path.append(self._path(self.path[node], tag))
                node = len(self.tag) - 1
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, hidden, node))
        flush()
        for _, _, node in stack:
            self.last[node] = len(self.tag) - 1
        self.last[0] = len(self.tag) - 1

    def within(self, tags: frozenset[str]) -> list[bool]:
        """Of each path, whether one of the tags is on it."""
        out: list[bool] = []
        for tag, up in zip(self.path_tags, self.path_up):
            out.append(tag in tags or (up >= 0 and out[up]))
        return out

    def common(self, nodes: list[int]) -> int:
        """The deepest element above (or at) all nodes: that of the first and the last, as numbers go in page order."""
        node, far = min(nodes), max(nodes)
        while self.last[node] < far:
            node = self.parent[node]
        return node


def blocks(page: str) -> list[str]:
    """Texts of the blocks that are not furniture, in page order."""
    return [text for _, text in Tree(page).blocks]


def _root(tree: Tree, content: set[int]) -> int:
    """The deepest element above all content, articles and headings of it, or the article or main around that; 0: the whole page."""
    first = next(i for i, (node, _) in enumerate(tree.blocks) if tree.path[node] in content)
    before = next((i for i in range(first, -1, -1) if tree.tag[tree.blocks[i][0]] in HEADINGS), None)
    article = tree.within(frozenset({"article"}))
    held = [node for i, (node, _) in enumerate(tree.blocks) if tree.path[node] in content or i == before or tree.tag[node] == "h1" or article[tree.path[node]]]
    at = tree.common([node if tree.tag[node] in KEPT or not node else tree.parent[node] for node in held])  # a block's own element is a leaf
    node = at
    while node and tree.tag[node] not in ("article", "main"):
        node = tree.parent[node]
    return node or at


def main_text(page: str | None) -> str:
    tree = Tree(page or "")
    if not tree.blocks:
        tree = Tree(page or "", by_name=False)
    if not tree.blocks:
        return ""
    length: dict[int, int] = {}
    points: dict[int, int] = {}
    count: dict[int, int] = {}
    for node, text in tree.blocks:
        path = tree.path[node]
        length[path] = length.get(path, 0) + len(text)
        points[path] = points.get(path, 0) + len(_PUNCT.findall(text))
        count[path] = count.get(path, 0) + 1
    paths = list(length)
    ratio = [[x[p] / count[p] for p in paths] for x in (length, points)]
    smooth = [[(r[max(0, i - 1)] + 2 * r[i] + r[min(len(r) - 1, i + 1)]) / 4 for i in range(len(r))] for r in ratio]
    inside = tree.within(frozenset({"article", "main"}))
    fused = {p: a * (1 + b) * (4 if inside[p] else 1) for p, a, b in zip(paths, *smooth)}
    most = max(fused.values())
    chosen = _root(tree, {p for p in paths if fused[p] >= SHARE * most})
    return "\n".join(text for node, text in tree.blocks if chosen <= node <= tree.last[chosen])


def _extract(batches):
    for b in batches:
        text = [main_text(x) for x in b.column("__html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["__id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    common.small_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("__html"))
    return src.mapInArrow(_extract, f"__id {dict(src.dtypes)['__id']}, url string, text string, n_chars long").withColumnRenamed("__id", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars over all pages."""
    return extract(common.table(spark, sf_dir, "pages"))
