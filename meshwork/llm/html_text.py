"""Main text of HTML pages by composite text density (Sun, Song and Liao, 2011).

Each element that makes a block is a node of the page's tree; inline markup belongs to the block around it, and links are counted. A node's
density is its characters per tag, raised where few of them are in links and judged by the page's own share of link text. A
node's sum is that of its children's densities and of its own text; the subtree of the greatest sum is the text.

* Furniture goes first: elements that never hold the text (menus, headers, footers, sidebars, forms, scripts), and those whose class, id or
  role names such a thing, an advert, a notice or comments. A name doesn't hide an element that holds an ``article`` or ``main``.
* Where a page marks its text by ``article``, else ``main``, the greatest sum chooses among those, and the one that holds
  it is taken whole, with its short blocks. Elsewhere, the least density on the way from the chosen node to the body is the
  threshold: nodes of at least that density give the subtree of the greatest sum below them, too.

Pages are judged one by one, by a scan, a pass up and a pass down the tree, each linear in its size.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.llm.columns import fresh
from meshwork.session import table

#: A comment, a declaration, an end tag or a start tag with its attributes.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</([a-z][^\s/>]*)[^>]*>|<([a-z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""", re.I | re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without an end tag, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())
#: Elements inside a block; all others make blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and names that are never part of the text.
FURNITURE = frozenset("head script style title noscript template iframe noframes nav header footer aside form button select option textarea input dialog menu object embed svg canvas audio video".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe subscription paywall"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer copyright comment comments respond disqus replies share sharing social related recommended widget search toolbar".split()
)
#: First words of a name that tells what its element goes along with, not what it is.
RELATED = frozenset("has have with no without".split())
#: Elements that close an open element of the same kind, up to the bounds given.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
LANDMARKS = ("article", "main")


def names_furniture(attributes: str) -> bool:
    """Whether a class, id or role is the name of a thing beside the text."""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORD.findall(name)]
            if words and words[0] not in RELATED and not NAMED.isdisjoint(words):
                return True
    return False


class Page:
    """The tree of blocks of one page: parallel lists by node, parents first, and runs of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.named, self.links = [-1], ["body"], [False], [0]
        self.runs: list[tuple[int, list[tuple[str, bool]]]] = []
        self.at, self.open, self.skip, self.linked, self.fresh = 0, [], 0, 0, True
        self.n_open: Counter[str] = Counter()
        self.scan(source)
        n = len(self.parent)
        holds = [t in LANDMARKS for t in self.tag]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        self.out = [False] * n
        for i in range(1, n):
            own = self.tag[i] in FURNITURE or self.named[i] and (not holds[i] or self.tag[i] == "article") and self.tag[i] not in ("html", "body", "main")
            self.out[i] = own or self.out[self.parent[i]]

    def scan(self, source: str) -> None:
        end, at = source.rfind(">") + 1, 0
        while at < end and (m := TAG.search(source, at, end)):
            self.text(source[at : m.start()])
            at = m.end()
            if m[1]:
                self.close(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else len(source)
                else:
                    self.start(tag, m[3])
        self.text(source[at:])

    def text(self, piece: str) -> None:
        if piece and not self.skip:
            if self.fresh:
                self.runs.append((self.at, []))
                self.fresh = False
            self.runs[-1][1].append((piece, self.linked > 0))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        if tag == "a":
            self.close("a")
        if tag not in INLINE:
            if self.n_open["p"]:
                self.close("p")
            closed, bounds = CLOSES.get(tag, ((), ()))
            if any(self.n_open[t] for t in closed):
                inner = next(d for d in range(len(self.open) - 1, -1, -1) if self.open[d][0] in closed or self.open[d][0] in bounds)
                if self.open[inner][0] in closed:
                    self.drop_to(inner)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            self.fresh = self.fresh or tag not in INLINE
            return
        named = bool(attributes) and names_furniture(attributes)
        if tag in INLINE:
            hidden = named or tag in FURNITURE
            self.open.append((tag, -1, hidden))
            self.n_open[tag] += 1
            self.skip += hidden
            if tag == "a":
                self.linked += 1
                self.links[self.at] += 1
            return
        self.open.append((tag, self.at, False))
        self.n_open[tag] += 1
        self.parent.append(self.at)
        self.tag.append(tag)
        self.named.append(named)
        self.links.append(0)
        self.at, self.fresh = len(self.parent) - 1, True

    def close(self, tag: str) -> None:
        """End the last open element of this name; inline elements end only within their block."""
        for depth in range(len(self.open) - 1, -1, -1) if self.n_open[tag] else ():
            if self.open[depth][0] == tag:
                self.drop_to(depth)
                return
            if tag in INLINE and self.open[depth][1] >= 0:
                return
        if tag == "p":
            self.fresh = True

    def drop_to(self, depth: int) -> None:
        for tag, before, hidden in reversed(self.open[depth:]):
            self.n_open[tag] -= 1
            self.skip -= hidden
            self.linked -= tag == "a"
            if before >= 0:
                self.at, self.fresh = before, True
        del self.open[depth:]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and sum of each node; those of furniture are zero."""
        n = len(self.parent)
        chars, linked, own = [0] * n, [0] * n, [0] * n
        page_chars = page_linked = 0
        for at, pieces in self.runs:
            size = sum(len(p) - p.count(" ") for p, _ in pieces)
            inside = sum(len(p) - p.count(" ") for p, a in pieces if a)
            page_chars, page_linked = page_chars + size, page_linked + inside
            if not self.out[at]:
                own[at] += size
                chars[at] += size
                linked[at] += inside
        tags, links = list(self.links), list(self.links)
        density, total = [0.0] * n, [0.0] * n
        kids = [False] * n
        for i in range(n - 1, -1, -1):
            if self.out[i]:
                continue
            c, t, lc, lt = chars[i], max(tags[i], 1), max(linked[i], 1), max(links[i], 1)
            if c:
                base = math.log(c / max(c - linked[i], 1) * lc + page_linked / max(page_chars, 1) * c + math.e)
                density[i] = max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base))
            total[i] = total[i] + own[i] / max(self.links[i], 1) if kids[i] else density[i]
            if i:
                up = self.parent[i]
                kids[up] = True
                chars[up] += c
                linked[up] += linked[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                total[up] += density[i]
        return density, total

    def chosen(self) -> list[bool]:
        """Which nodes hold the text."""
        n = len(self.parent)
        density, total = self.densities()
        best = list(range(n))  # node of the greatest sum in each subtree, the outer one among equals
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.out[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
                best[up] = best[i]
        take = [False] * n
        for landmark in LANDMARKS:
            marked = [i for i in range(n) if self.tag[i] == landmark and not self.out[i]]
            if marked:
                top = max(marked, key=lambda i: (total[best[i]], -i))
                take[top] = True
                break
        else:
            low, i = math.inf, best[0]
            while i >= 0:
                low, i = min(low, density[i]), self.parent[i]
            take[best[0]] = True
            for i in range(n):
                if not self.out[i] and density[i] >= low and density[i] > 0 and self.tag[i] not in ("html", "body"):
                    take[best[i]] = True
        for i in range(1, n):
            take[i] = (take[i] or take[self.parent[i]]) and not self.out[i]
        return take


def extract(source: str | None) -> str:
    """The page's main text, a block a line; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    take = page.chosen()
    blocks = (" ".join(html.unescape("".join(p for p, _ in pieces)).split()) for at, pieces in page.runs if take[at])
    return "\n".join(b for b in blocks if b)


def _texts(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(b.column(at)[i].as_py()) for i in range(b.num_rows)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), sizes], [*names, "_text", "_size"])

    return run


def main_text(pages: DataFrame, source: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``source``, with the main text and its code points; new names get underscores where ``pages`` has such columns.

    A null or empty page has an empty text, as has one of furniture alone. Repeated rows give repeated results, ties between nodes go to
    the outer, then the earlier one, an empty table gives an empty result, and very long pages take time in proportion.
    """
    kept = [c for c in pages.columns if c != source]
    new = fresh(pages.select(*(F.col(f"`{c}`") for c in kept)), text, n_chars)
    fields = [pages.schema[c] for c in kept]
    inner = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{source}`").cast("string").alias("_source"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("_source", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("_size", T.LongType())])
    found = inner.mapInArrow(_texts(len(kept)), schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("_text").alias(new[0]), F.col("_size").alias(new[1]))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars)."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
