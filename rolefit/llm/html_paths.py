"""HTML extraction by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path, and blocks
(text between block tags).  Scripts, styles and the like are no text.  Over all
other nodes:

1. text length and punctuation are added up per tag path, and divided by the
   path's number of nodes (text ratio, punctuation ratio),
2. in page order, each ratio is smoothed over neighbouring nodes with a Gaussian,
   and the smoothed values are averaged per path again,
3. the two are fused (product).  Parts that markup declares to be no article
   (navigation, footers, asides, forms, advert, notice, share and comment
   containers) are paths of their own, whose fused value is multiplied by a small
   factor; a declaration does not hold on a page where such parts together have
   most of the text and punctuation outside links (a form around the page, a
   site builder's widgets; an advert only if there is no article or main part),
   and an ambiguous name (legal, notice, widget, ...) not for prose inside the
   article,
4. the paths are divided into strong and weak ones where the fused values
   fall apart: the threshold has the greatest variance between the two classes of
   nodes (of the logarithms, weighted by text).

The element that holds most of the strong text (the article or main part around
it, if there is one) is the content with its headings and short items, except
declared parts and paths of mostly links; elsewhere strong paths alone are.
Blocks keep page order.  Paths are numbered in a trie of tags, so that memory is
linear in the page however deep it is.

Defined cases: a null page is empty and gives an empty text; a page without
markup is one block; unclosed and stray tags are closed or ignored; if all parts
are declared no article, those with most text stay, and a page of links is empty;
repeated rows return a row each; an empty table
returns no row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and container names of the HTML standard and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small
span strike strong sub sup time tt u var wbr""".split())
SKIPPED = frozenset("head script style noscript template title iframe object svg math canvas audio video map".split())
DECLARED = frozenset("nav footer aside form button select option textarea label fieldset menu dialog".split())
DECLARED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
DECLARED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|legal|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|sidenav|social|sponsor\w*|"
    r"subscribe|toolbar|widgets?)(?:$|[\s_-])", re.IGNORECASE)
#: Names that article parts bear as well.
AMBIGUOUS = frozenset("legal menu notice notices related share sharing social widget widgets".split())
#: Declarations that an article or main part beside them does not confirm.
LOOSE = AMBIGUOUS | {"<form>", "<fieldset>"}
#: Elements of running text: an ambiguous name on one of them does not make it a container.
PROSE = frozenset("p blockquote pre li td dd h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left closes an open tag on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: An implied end does not reach beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(frozen=True)
class PathRule:
    """Width of the smoothing (in nodes), factor of the fused value of declared parts, share of the strong text that the
    content element holds, share of the strongest path that its neighbours reach if that element is the page's
    body, most link text, and least text of a block (characters) that makes a part with an ambiguous name prose."""

    sigma: float = 1.0
    factor: float = 0.001
    core: float = 0.6
    share: float = 0.02
    links: float = 0.6
    prose: int = 60


class Mark(NamedTuple):
    """What declares an element to be no article (its tag, role or name), and whether it is article text if it is prose."""

    what: str
    prose: bool


class Node(NamedTuple):
    """A text node: its element, the number of its tag path, and what :class:`Open` says of the innermost open tag."""

    element: int
    path: int
    text: str
    block: int
    linked: bool
    marks: frozenset[Mark]
    part: int
    article: bool


class Page(NamedTuple):
    """Text nodes in page order, and of every element its tag and its parent (element 0 is the page itself)."""

    nodes: list[Node]
    tag: list[str]
    parent: list[int]


class Open(NamedTuple):
    """An open tag: whether it is no text, its element and path, whether a link encloses it, what declares it no article."""

    name: str
    skipped: bool
    element: int
    path: int
    linked: bool
    marks: frozenset[Mark]
    part: int  # number of the innermost element that is declared no article, 0 if there is none
    article: bool  # inside an article or main part


def _hidden(name: str, attrs: str) -> bool:
    if name in SKIPPED:
        return True
    if not attrs.strip() or name in ("html", "body", "main", "article"):
        return False
    return any(key.lower() == "hidden" or key.lower() == "aria-hidden" and (a or b or c).lower() == "true"
               for key, a, b, c in ATTRIBUTE.findall(attrs))


def _marks(name: str, attrs: str, inside_article: bool) -> set[Mark]:
    """What declares an element to be no article."""
    out = set()
    if name in DECLARED or name == "header" and not inside_article:
        out.add(Mark(f"<{name}>", False))
    if not attrs.strip() or name in ("html", "body", "main", "article"):
        return out
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and DECLARED_NAMES.search(value):
            names = (x for x in re.split(r"[\s_-]+", value) if DECLARED_NAMES.fullmatch(x))
            out.update(Mark(x, x in AMBIGUOUS and (inside_article or name in PROSE)) for x in names)
        if key == "role" and value in DECLARED_ROLES:
            out.add(Mark(f"role {value}", False))
    return out


def parsed(page: str) -> Page:
    """Text nodes and elements of a page, without scripts and the like."""
    out: list[Node] = []
    tag, parent = [""], [-1]
    paths: dict[tuple[int, str], int] = {}  # the trie: path and tag -> path
    stack = [Open("", False, 0, 0, False, frozenset(), 0, False)]
    block, at, size, parts = 0, 0, len(page), 0

    def add(raw: str) -> None:
        top = stack[-1]
        if raw and not top.skipped:
            text = html.unescape(raw) if "&" in raw else raw
            out.append(Node(top.element, top.path, text, block, top.linked, top.marks, top.part, top.article))

    def close(to: int) -> None:
        nonlocal block
        if any(x.name not in INLINE for x in stack[to:]):
            block += 1
        del stack[to:]

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            add(page[at: m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        inline = name in INLINE
        if m["end"]:
            match = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
            if match is not None:
                close(match)
            elif not inline:
                block += 1
            continue
        if not inline:
            block += 1
            closes, scope = CLOSES.get(name, ()), SCOPES.get(name, ())
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item its sibling
                of = stack[i].name
                if of == "p" or of in closes:
                    close(i)
                    break
                if of in scope or of not in INLINE:
                    break
        if name in VOID:
            if name == "br":
                add(" ")
            continue
        top = stack[-1]
        skipped = top.skipped or _hidden(name, m["attrs"])
        marks = set() if skipped else _marks(name, m["attrs"], top.article)
        parts += bool(marks)
        tag.append(name)
        parent.append(top.element)
        stack.append(Open(name, skipped, len(tag) - 1, paths.setdefault((top.path, name), len(paths) + 1), top.linked or name == "a",
                          top.marks | marks if marks else top.marks, parts if marks else top.part,
                          top.article or name in ("article", "main")))
        if name in RAW:  # its content is no markup
            end = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            stop = end.start() if end else size
            add(page[at:stop])
            at = stop
    add(page[at:])
    return Page(out, tag, parent)


def declared_out(nodes: list[Node]) -> frozenset[Mark]:
    """The declarations that hold on this page: those whose parts together do not have most of its text and punctuation.

    Text of links does not count.  Beside an article or main part only the loose ones can fall.  If nothing would be
    left, the declarations of the heaviest parts fall one after the other."""
    seen: dict[tuple[frozenset[Mark], bool], np.ndarray] = {}
    for n in nodes:
        text = n.text.strip()
        if text and not n.linked:
            key = n.marks, n.article
            seen[key] = seen.get(key, 0) + np.array([len(text), len(PUNCTUATION.findall(text))])
    out = {m for n in nodes for m in n.marks}
    if not seen:
        return frozenset(out)
    total = sum(seen.values())
    mass = {m: sum((w for (marks, _), w in seen.items() if m in marks), np.zeros(2)) for m in out}
    most = {m for m in out if 2 * mass[m][0] > total[0] and 2 * mass[m][1] >= total[1]}
    out -= {m for m in most if m.what in LOOSE}
    if not any(article and not marks & out for marks, article in seen):
        out -= most
    while all(marks & out for marks, _ in seen):
        out.discard(max(out, key=lambda m: (*mass[m], m)))
    return frozenset(out)


def declared(nodes: list[Node], rule: PathRule) -> np.ndarray:
    """Which nodes lie in parts that are declared no article, by declarations that hold."""
    if not any(n.marks for n in nodes):
        return np.zeros(len(nodes), bool)
    out = declared_out(nodes)
    blocks: dict[int, dict[int, int]] = {}  # text outside links of each part's blocks
    whole: dict[int, int] = {}
    for n in nodes:
        if n.marks & out and all(m.prose for m in n.marks & out):
            size = len(n.text.strip())
            whole[n.part] = whole.get(n.part, 0) + size
            of = blocks.setdefault(n.part, {})
            of[n.block] = of.get(n.block, 0) + (0 if n.linked else size)
    prose = {k for k, of in blocks.items() if 0 < whole[k] <= 2 * sum(x for x in of.values() if x >= rule.prose)}
    return np.array([bool(n.marks & out) and not (n.part in prose and all(m.prose for m in n.marks & out)) for n in nodes])


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    norm = np.convolve(np.ones(len(x)), kernel, mode="full")[reach: reach + len(x)]
    return np.convolve(x, kernel, mode="full")[reach: reach + len(x)] / norm


def fused_ratios(path: np.ndarray, length: np.ndarray, points: np.ndarray, sigma: float) -> np.ndarray:
    """The fused ratio of each path: text and punctuation a node, smoothed over the nodes in page order."""
    filled = length > 0
    count = np.maximum(np.bincount(path, weights=filled), 1)
    ratios = (np.bincount(path, weights=length) / count, (np.bincount(path, weights=points) + 1) / count)
    per = path[filled]
    if not len(per):
        return np.zeros(len(count))
    smooth = [np.bincount(per, weights=_smooth(r[per], sigma), minlength=len(count)) / count for r in ratios]
    return smooth[0] * smooth[1]


def threshold(values: np.ndarray, weights: np.ndarray) -> float:
    """The least of the upper values where their division in two has the greatest variance between the classes."""
    order = np.argsort(values, kind="stable")
    x, w = values[order], weights[order]
    low = np.cumsum(w)
    mass = np.cumsum(w * x)
    cut = np.flatnonzero(x[1:] > x[:-1])
    if not len(cut):
        return float(x[0]) if len(x) else 0.0
    a, b = low[cut], low[-1] - low[cut]
    between = a * b * ((mass[-1] - mass[cut]) / b - mass[cut] / a) ** 2
    return float(x[cut[np.argmax(between)] + 1])


def content_element(page: Page, strong_text: np.ndarray, rule: PathRule) -> int:
    """The lowest element that holds ``rule.core`` of the strong text; the article or main part around it; no running text itself."""
    mass = np.zeros(len(page.tag))
    np.add.at(mass, [n.element for n in page.nodes], strong_text)
    for i in range(len(mass) - 1, 0, -1):  # parents come before their children
        mass[page.parent[i]] += mass[i]
    root = int(np.flatnonzero(mass >= rule.core * mass[0])[-1])
    at = root
    while at > 0:
        if page.tag[at] in ("article", "main"):
            return at
        at = page.parent[at]
    while root > 0 and (page.tag[root] in INLINE or page.tag[root] in PROSE):
        root = page.parent[root]
    return root


def content_nodes(page: Page, rule: PathRule = PathRule()) -> list[bool]:
    """Which nodes are content."""
    nodes = page.nodes
    if not nodes:
        return []
    length = np.array([len(n.text.strip()) for n in nodes], float)
    points = np.array([len(PUNCTUATION.findall(n.text)) for n in nodes], float)
    linked = np.array([n.linked for n in nodes])
    out = declared(nodes, rule)
    path = np.unique(np.array([n.path for n in nodes]) * 2 + out, return_inverse=True)[1]
    fused = fused_ratios(path, length, points, rule.sigma) * np.where(np.bincount(path, weights=out) > 0, rule.factor, 1.0)
    link_share = np.bincount(path, weights=length * linked) / np.maximum(np.bincount(path, weights=length), 1)
    own_text = (link_share <= rule.links)[path]
    value = fused[path]
    counted = (length > 0) & own_text
    strong = counted & (value >= np.expm1(threshold(np.log1p(value[counted]), length[counted])) * (1 - 1e-9))
    if not strong.any():
        return [False] * len(nodes)
    root = content_element(page, length * strong, rule)
    inside = np.zeros(len(page.tag), bool)
    inside[root] = True
    for i in range(root + 1, len(inside)):
        inside[i] = inside[page.parent[i]]
    within = inside[[n.element for n in nodes]]
    if page.tag[root] in ("", "html", "body"):  # no part of the page: neighbours of the strong paths must be near them
        within &= value >= rule.share * value[strong].max()
    good = strong | (within & ~out & own_text)
    # a link inside running text goes with the nearest element around it that has text
    taken: dict[int, bool] = {}
    for n, ok, own in zip(nodes, good.tolist(), own_text.tolist()):
        if own and n.text.strip():
            taken[n.element] = taken.get(n.element, False) or ok
    for i in np.flatnonzero(~own_text & ~out):
        at = nodes[i].element
        while at > 0 and at not in taken and at != root:
            at = page.parent[at]
        good[i] = taken.get(at, at == root and page.tag[root] not in ("", "html", "body"))
    return good.tolist()


def main_text(page: str, rule: PathRule = PathRule()) -> str:
    read = parsed(page)
    blocks: dict[int, list[str]] = {}
    for node, good in zip(read.nodes, content_nodes(read, rule)):
        if good:
            blocks.setdefault(node.block, []).append(node.text)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def extracted(pages: DataFrame, rule: PathRule = PathRule(), page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    @F.pandas_udf("string")
    def text_of(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in s:
            yield pd.Series([main_text(p, rule) if p else "" for p in part], dtype=object)

    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
