"""Main text of HTML pages by composite text density.

Every node of the page's tree has its characters, link characters, tags and link tags. The
composite density is characters a tag, set against links as

    C/T * log_B(C/LC * T/LT),  B = ln(C/(C-LC) * LC + LC_body/C_body * C + e),

with 1 for every count of 0 (and plain C/T on a page without links). A block's sum is that of the
densities of the blocks in it and of its own text, elements within lines included. The block with the
largest sum is the core of the page; the least density on the path from it to the body is the
threshold; every block as dense as that contributes the subtree of largest sum within it. The region
of the core is the widest element around it, below the body, that is at least WIDEN times as dense:
there, paragraphs, headings and the like that are mostly no links contribute too, however short.

Furniture neither counts in sums nor contributes. Certain by element or role: navigation, page headers
and footers, sidebars, dialogs, controls and what isn't text. By name: forms, and elements with a class or id made
up wholly of words for furniture (`comment-list`, not `related-work`); these are looked past where
they only wrap the article, that is, hold an article, a main element or a first heading, or are a
form with over half of the page's text. Where the body itself is the core, blocks that are mostly
links and less dense than it don't contribute.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by an empty line. Line breaks are white space.

Defined results: null or empty html gives the empty text; damaged markup is read as browsers do in
the main (open paragraphs, cells and items end where the next begins; stray end tags don't count);
equally large sums go to the first node; repeated rows are kept; empty tables give no rows; other
columns are not looked at. Memory: one batch of pages; the tree is walked without recursion.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from veriloom.llm.common import arrow_map, arrow_schema, small_batches

# Elements by their role in HTML, and words of class, id and role that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CERTAIN = frozenset("script style noscript template textarea title iframe noembed noframes xmp head nav footer aside button select option input svg canvas object audio video dialog menu search".split())
ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar dialog alertdialog alert".split())
FURNITURE = frozenset("nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar aside footer complementary contentinfo search form login signup subscribe subscription newsletter cookie cookies consent gdpr notice notices alert banner popup modal overlay ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion comment comments disqus respond replies reply share sharing social related recommended toolbar pagination pager widget skip".split())
PAGE_ONLY = frozenset(("header", "masthead"))
# What such words come with in names of furniture.
BESIDE = frozenset("list box block container wrapper wrap area section inner outer item items bar unit slot top bottom left right page site user users reader readers post article thread links buttons icons main global primary secondary".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
# An opening tag ends what is open of its kind up to the element that holds such things.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: What an open paragraph isn't closed through.
HOLDERS = ("td", "th", "caption", "button", "object", "template")

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")

#: Least share of the core's density that an element around it has as its region.
WIDEN = 0.5
TEXT, NAMED, SURE = 0, 1, 2


class Page:
    """Nodes in page order, each after its parent. texts: (node, text, run), one run for what no block's start or end parts."""

    def __init__(self, source: str):
        self.tag, self.parent, self.role, self.inside = ["html"], [-1], [TEXT], [False]
        self.texts: list[tuple[int, str, int]] = []
        self._read(source)
        self._count()

    def _role(self, tag: str, attributes: str, inside: bool) -> int:
        """SURE: furniture by element or role; NAMED: by class or id."""
        if tag in CERTAIN or (tag == "header" and not inside):
            return SURE
        if attributes and _HIDDEN.search(attributes):
            return SURE
        found = NAMED if tag == "form" else TEXT
        for m in _NAMED.finditer(attributes):
            for name in html.unescape(m[2] or m[3] or m[4] or "").split():
                words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
                if m[1].lower() == "role":
                    if words & ROLES or (not inside and "banner" in words):
                        return SURE
                elif words & FURNITURE and words <= FURNITURE | BESIDE or not inside and words and words <= PAGE_ONLY | BESIDE and words & PAGE_ONLY:
                    found = NAMED
        return TEXT if tag in ("body", "html", "article", "main") and not inside else found

    def _read(self, source: str) -> None:
        open_, run, at = [0], 0, 0
        depths: dict[str, list[int]] = {}  # of the open nodes of each tag
        blocks: list[int] = []  # depths of the open blocks

        def close(depth: int) -> None:
            nonlocal run
            while len(open_) > depth:
                tag = self.tag[open_.pop()]
                depths[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                    run += 1

        def deepest(tags) -> int:
            return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        while at < len(source):
            m = _MARKUP.search(source, at)
            if raw := source[at : m.start() if m else len(source)]:
                self.texts.append((open_[-1], html.unescape(raw), run))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, attributes = m[2].lower(), m[3]
            if m[1]:
                depth = deepest((tag,))
                if depth and (tag in BLOCK or not blocks or blocks[-1] < depth):
                    close(depth)
                continue
            if tag in BLOCK and (p := deepest(("p",))) > deepest(HOLDERS):
                close(p)
            if tag in ENDS and (own := deepest(ENDS[tag][0])) > deepest(ENDS[tag][1]):
                close(min(d for t in ENDS[tag][0] if depths.get(t) and (d := depths[t][-1]) > deepest(ENDS[tag][1])) if tag == "tr" else own)
            if tag in ("html", "body") and (tag == "html" or depths.get("body")):
                continue
            node, up = len(self.tag), open_[-1]
            self.tag.append(tag)
            self.parent.append(up)
            self.inside.append(self.inside[up] or tag in ("article", "main"))
            self.role.append(self._role(tag, attributes, self.inside[up]))
            run += tag in BLOCK
            if tag == "br":
                self.texts.append((up, " ", run))
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
                depths.setdefault(tag, []).append(len(open_))
                if tag in BLOCK:
                    blocks.append(len(open_))
                open_.append(node)

    def _count(self) -> None:
        """Composite densities of each node and of its own text; elements that hold no block belong to the text of their block."""
        n = len(self.tag)
        linked, self.block = [False] * n, [t in BLOCK for t in self.tag]
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        own = [[0, 0, 0, 0] for _ in range(n)]  # characters, tags, link characters, link tags
        for i, t, _ in self.texts:
            k = len(" ".join(t.split()))
            own[i][0] += k
            own[i][2] += k * linked[i]
        whole = [list(x) for x in own]
        for i in range(n - 1, 0, -1):
            up, link = self.parent[i], self.tag[i] == "a"
            self.block[up] = self.block[up] or self.block[i]
            for counts in (whole,) if self.block[i] else (whole, own):
                for k, more in enumerate((0, 1, 0, link)):
                    counts[up][k] += counts[i][k] + more
        self.body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = whole[self.body][2] / (whole[self.body][0] or 1)
        self.density = [composite(*x, share) for x in whole]
        self.text_density = [composite(*x, share) for x in own]
        self.said = [x[0] - x[2] for x in own]
        self.linked = [2 * x[2] >= x[0] for x in whole]

    def furniture(self) -> list[bool]:
        """Nodes in furniture."""
        n, role = len(self.tag), self.role
        if NAMED in role:
            holds, said = [False] * n, [0] * n  # of each subtree: the article; characters outside links and sure furniture
            for i in range(n - 1, 0, -1):
                if role[i] != SURE:
                    up = self.parent[i]
                    holds[up] = holds[up] or holds[i] or (role[i] == TEXT and self.tag[i] in ("article", "main", "h1"))
                    said[i] += self.said[i] * self.block[i]
                    said[up] += said[i]
            role = [TEXT if r == NAMED and (holds[i] or (self.tag[i] == "form" and 2 * said[i] > said[self.body])) else r for i, r in enumerate(role)]
        gone = [r != TEXT for r in role]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        return gone

    def sums(self, gone: list[bool]) -> list[float]:
        """Of each block the densities of its own text and of the blocks in it that count."""
        total = [d * b for d, b in zip(self.text_density, self.block, strict=True)]
        for i in range(len(total) - 1, 0, -1):
            if self.block[i] and not gone[i]:
                total[self.parent[i]] += self.density[i]
        return total

    def content(self) -> list[bool]:
        """Which nodes lie in a contributing subtree."""
        n, density, gone = len(self.tag), self.density, self.furniture()
        total = self.sums(gone)
        best = list(range(n))  # of each subtree, the block of the largest sum that is no furniture
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not gone[i] and total[best[i]] >= total[best[up]] and total[best[i]] > total[up]:
                best[up] = best[i]
        start = self.body
        core = path = region = best[start]
        threshold = density[core]
        while path != start and path > 0:
            path = self.parent[path]
            threshold = min(threshold, density[path])
        while region not in (start, 0) and self.parent[region] not in (start, 0) and density[self.parent[region]] >= WIDEN * density[core]:
            region = self.parent[region]
        chosen, within = [False] * n, [False] * n
        chosen[core] = within[region] = True
        for i in range(start, n):
            within[i] = within[i] or (i > 0 and within[self.parent[i]])
            if self.block[i] and not gone[i] and density[i] and density[i] >= threshold:
                chosen[best[i]] = True
            if within[i] and self.tag[i] in PROSE and not self.linked[i]:
                chosen[i] = True
        for i in range(1, n):
            lists = core == start and self.block[i] and self.linked[i] and density[i] < threshold
            chosen[i] = (chosen[i] or chosen[self.parent[i]]) and not gone[i] and not lists
        return chosen

    def text(self) -> str:
        chosen, runs = self.content(), {}
        for i, t, run in self.texts:
            if chosen[i]:
                runs.setdefault(run, []).append(t)
        blocks = (" ".join("".join(r).split()) for r in runs.values())
        return "\n\n".join(x for x in blocks if x)


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """The composite density of c characters, lc of them in links, with t tags, lt of them links; share: link characters of the page's."""
    if not c:
        return 0.0
    t = t or 1
    if not share:
        return c / t
    base = math.log(c / (c - lc or 1) * lc + share * c + math.e)
    return c / t * max(0.0, math.log(c / (lc or 1) * t / (lt or 1))) / math.log(base)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its code points, a row a page."""
    small_batches(pages.sparkSession)

    def rows(batch):
        ids, urls, sources = (c.to_pylist() for c in batch.columns)
        texts = [main_text(s) for s in sources]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select("page_id", "url", "html"), rows, arrow_schema(EXTRACTED), EXTRACTED)
