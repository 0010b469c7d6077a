"""Op 6, HTML extraction: blocks of a page are labelled content or boilerplate by a minimum cut.

1. A scanner goes through the markup once and keeps a small tree: elements with their parents, and blocks (runs of
   text between block-level tags) with the element that holds them. It survives unclosed, crossed and truncated tags.
2. A classifier gives each block log-odds of being content from its words, links and punctuation and from the names of
   the elements around it. Costs -log p become the capacities of the edges from the source (content) and to the sink.
   Menus, footers, forms, adverts, comments and the like cost HARD.
3. Neighbouring blocks, and next blocks under one parent or grandparent, are joined by smoothness edges whose capacity
   falls with the steps between them in the tree. The blocks on the source's side of the minimum cut are the content.

White space (Unicode's) inside a block becomes one space; a line break element counts as white space. Nothing is ever
capped: a page with more blocks has a larger graph, in which edges only join what is near.

Defined results: a null or empty page has the text '' and no blocks; equal pages have equal texts; repeated rows have a row
each; an empty table has an empty result; costs that tie go to content; a very long page is one page like others; other columns are carried only where asked for.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Cost of content for what is boilerplate by its place; above any sum of smoothness edges at a block.
HARD = 100_000
SCALE = 100
NEAR = 1.2  # capacity between blocks under one parent
FAR = 6  # steps in the tree beyond which there is no edge

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Names of HTML.
RAW = frozenset("script style template textarea title iframe svg select".split())
#: Of these all that follows belongs to them if they are never closed; of the others only the tag is left out then.
OPEN_END = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of these names, up to the nearest one of the scope.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
SCOPE = frozenset("ul ol dl table body html article section div nav aside footer header main form select td th".split())
#: A start tag of a block ends an open paragraph.
NO_PARAGRAPH = BLOCK - frozenset(("body", "html", "head"))

PLACES = frozenset("nav footer aside form button dialog menu fieldset head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id by which an element is boilerplate.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion sidebar sidebars widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead footer foot comment comments commentlist commenter respond reply replies disqus cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar search copyright legal disclaimer alert".split()
)
COMMENT = frozenset("comment comments commentlist respond reply replies disqus".split())
POST = frozenset("post entry story".split())
GOOD = frozenset("content article post entry main story text body".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)]*(?:\s|$)")
_LEGAL = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.I)


class Page:
    """Elements and blocks of a page."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.flag: list[int] = [0]  # boilerplate: 1 unless the article lies within, 4 unless it or an h1 does, 2 always; 3 a good name; 5 doubtful
        self.cleared: list[bool] = [False]  # the article lies within
        self.titled: list[bool] = [False]  # an h1 lies within
        self.inside: list[bool] = [False]  # it is an article, or lies within one
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._scan(source)

    def _open(self, tag: str, rest: str, up: int) -> int:
        at = len(self.tags)
        self.tags.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.cleared.append(False)
        self.titled.append(False)
        flag, main = 1 if tag in PLACES else 0, tag in ("article", "main")
        if rest and not rest.isspace():
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
            role = a.get("role", "").lower()
            main |= role in ("main", "article")
            names = {x.lower() for x in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")} if "class" in a or "id" in a else set()
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", ""):
                flag = 2
            elif names & COMMENT and tag not in ("body", "html"):
                flag = 0 if main and names & POST else 1 if names & POST else 2
            elif role in ROLES:
                flag = 1
            elif not flag and names & WORDS and not main and tag not in ("body", "html", *HEADINGS):
                # inside the article, a class that is a good name of its own leaves it to the cut
                flag = 5 if self.inside[up] and not GOOD.isdisjoint(a.get("class", "").lower().split()) else 4
            elif not flag and names & GOOD:
                flag = 3
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        if tag == "header" and not self.inside[up]:
            flag = 1
        self.flag.append(flag)
        x = up if tag == "h1" else 0
        while x > 0 and not self.titled[x]:
            self.titled[x], x = True, self.parent[x]
        if main and flag != 2:
            while up > 0 and not self.cleared[up]:  # what holds the article is no menu, whatever its name
                self.cleared[up], up = True, self.parent[up]
        return at

    def _scan(self, source: str) -> None:
        at, text, linked, link = 0, [], 0, 0
        open_: dict[str, int] = {}
        tags, parent = self.tags, self.parent

        def end_block() -> None:
            nonlocal linked
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if words:
                    self.blocks.append((at, words, linked))
            linked = 0

        def close(until: int) -> None:
            """Closes all elements from the innermost up to ``until``."""
            nonlocal at, link
            while True:
                x = at
                open_[tags[x]] -= 1
                link -= tags[x] == "a"
                at = parent[x]
                if x == until:
                    return

        place, find = 0, _TOKEN.match
        while place < len(source):
            m = find(source, place)
            place = m.end()
            if m[4] is not None:
                text.append(m[4])
                if link:
                    linked += len(m[4].strip())
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK or tag == "br":
                    end_block() if tag != "br" else text.append(" ")
                if open_.get(tag):
                    x = at
                    while tags[x] != tag:
                        x = parent[x]
                    # an inline element ends no block around it
                    if tag not in BLOCK:
                        y = at
                        while y != x and tags[y] not in BLOCK:
                            y = parent[y]
                        if y != x:
                            continue
                    close(x)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, place)
                    place = stop.end() if stop else len(source) if tag in OPEN_END else place
                text.append(" " if tag in ("select", "textarea", "iframe") else "")
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag == "body" and open_.get("head"):
                end_block()
                x = at
                while tags[x] != "head":
                    x = parent[x]
                close(x)
            if tag in BLOCK:
                end_block()
                if tag in NO_PARAGRAPH and open_.get("p"):
                    x = at
                    while tags[x] != "p" and tags[x] not in SCOPE and x:
                        x = parent[x]
                    if tags[x] == "p":
                        close(x)
                if tag in ENDS:
                    names, x, last = ENDS[tag].split(), at, 0
                    while x and (tags[x] not in SCOPE or tags[x] in names):
                        last = x if tags[x] in names else last
                        x = parent[x]
                    if last:
                        close(last)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            at = self._open(tag, m[3], at)
            open_[tag] = open_.get(tag, 0) + 1
            link += tag == "a"
        end_block()

    # ---- classifier ------------------------------------------------------------------------------

    def odds(self) -> list[float | None]:
        """Log-odds of content of each block; None for what is boilerplate by its place."""
        n = len(self.tags)
        hard, main, good, doubt = [False] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p, f = self.parent[i], self.flag[i]
            hard[i] = hard[p] or f == 2 or f in (1, 4) and not self.cleared[i] and not (f == 4 and self.titled[i])
            main[i] = not hard[i] and (main[p] or self.tags[i] in ("article", "main"))
            good[i] = good[p] or f == 3
            doubt[i] = doubt[p] or f == 5
        out: list[float | None] = []
        for at, text, linked in self.blocks:
            if hard[at]:
                out.append(None)
                continue
            words, share = text.count(" ") + 1, min(1.0, linked / len(text))
            s = -1.5 + min(words, 40) / 12 + 0.8 * bool(_SENTENCE.search(text)) + 0.8 * good[at]
            s += 3.0 if main[at] else 0.0
            s -= 1.5 if doubt[at] else 0.0
            s -= (2.0 if main[at] else 4.0) * share
            x = at
            while x and self.tags[x] not in BLOCK:
                x = self.parent[x]
            tag = self.tags[x]
            s += 1.0 if tag == "h1" else 0.5 if tag in HEADINGS else 0.3 if tag in ("p", "pre", "blockquote") else 0.0
            s -= 1.5 if tag == "li" and share > 0.8 else 0.0
            s -= 2.5 if words < 30 and not main[at] and _LEGAL.search(text) else 0.0
            out.append(s)
        return out

    # ---- graph -----------------------------------------------------------------------------------

    def _steps(self, a: int, b: int) -> int:
        """Steps between two elements in the tree, or more than FAR."""
        n = 0
        while a != b and n <= FAR:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n

    def edges(self) -> list[tuple[int, int, int]]:
        """(block, later block, capacity)."""
        out, last = [], {}
        for i, (at, _, _) in enumerate(self.blocks):
            joined = set()
            if i:
                d = self._steps(self.blocks[i - 1][0], at)
                if d <= FAR:
                    out.append((i - 1, i, round(SCALE * NEAR * math.exp(-d / 4))))
                    joined.add(i - 1)
            up = at
            for k in range(2):
                up = self.parent[up] if up else 0
                j = last.get((k, up))
                if j is not None and j not in joined and up:
                    out.append((j, i, round(SCALE * NEAR / (2 + 2 * k))))
                    joined.add(j)
                last[k, up] = i
        return out

    def labels(self) -> list[bool]:
        """Whether each block is content."""
        source, sink = [], []
        for s in self.odds():
            if s is None:
                source.append(0)
                sink.append(HARD)
            else:
                source.append(round(SCALE * (max(s, 0.0) + math.log1p(math.exp(-abs(s))))))
                sink.append(round(SCALE * (max(-s, 0.0) + math.log1p(math.exp(-abs(s))))))
        return minimum_cut(source, sink, self.edges())

    def text(self) -> str:
        return "\n\n".join([b[1] for b, keep in zip(self.blocks, self.labels(), strict=True) if keep])


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes on the source's side of a minimum cut (the largest such side), by Dinic's blocking flows.

    ``source`` and ``sink``: capacities of each node's terminal edges. ``edges``: (node, node, capacity both ways).
    """
    n = len(source)
    left = [a - b for a, b in zip(source, sink, strict=True)]  # what the two-edge path through each node leaves
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:
        if c > 0:
            near[a].append(len(to))
            to.append(b)
            room.append(c)
            near[b].append(len(to))
            to.append(a)
            room.append(c)
    while True:
        # levels from all nodes that still have flow to give
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            a = queue.popleft()
            if left[a] < 0:
                reached = True
                continue
            for e in near[a]:
                b = to[e]
                if room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if not reached:
            break
        next_ = [0] * n
        for start in range(n):
            while left[start] > 0 and level[start] == 0:
                path, a = [], start
                while left[a] >= 0 or not path:
                    while next_[a] < len(near[a]):
                        e = near[a][next_[a]]
                        if room[e] and level[to[e]] == level[a] + 1:
                            break
                        next_[a] += 1
                    else:
                        if not path:
                            break
                        level[a] = -2  # a dead end
                        a = to[path.pop() ^ 1]
                        next_[a] += 1
                        continue
                    path.append(e)
                    a = to[e]
                if not path:
                    break
                flow = min(left[start], -left[a], *[room[e] for e in path])
                left[start] -= flow
                left[a] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
    # boilerplate is what can still reach the sink
    queue = deque(i for i in range(n) if left[i] < 0)
    content = [x >= 0 for x in left]
    while queue:
        b = queue.popleft()
        for e in near[b]:
            if room[e ^ 1] and content[to[e]]:
                content[to[e]] = False
                queue.append(to[e])
    return content


def extract(source: str | None) -> str:
    return Page(source).text() if source else ""


def main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text, n_blocks and n_content (blocks of the page, and of its content) of every row."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                text, n, kept = [], [], []
                for value in part.column(0):
                    page = Page(value.as_py() or "")
                    some = [b[1] for b, ok in zip(page.blocks, page.labels(), strict=True) if ok]
                    text.append("\n\n".join(some))
                    n.append(len(page.blocks))
                    kept.append(len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars", "n_blocks", "n_content"])

    source = pages[html_column].alias("_html")
    return pages.select(source, *[pages[c] for c in keep]).mapInArrow(run, f"{kinds}, text string, n_chars long, n_blocks long, n_content long")


def op6_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
