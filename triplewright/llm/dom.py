"""A tolerant HTML reader: element nodes in document order, the text runs they hold, and node features."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*)|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|/([a-zA-Z][^\s/>]*+)[^>]*>|[!?/][^>]*>)""",
    re.S)
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)")
_SIGN = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is markup of another kind, or never shown as text.
RAW = frozenset("script style template noscript textarea title svg math iframe object select canvas xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of the value that is not beyond a BARRIER.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "body": ("head",),
         "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_P_STAYS_OPEN = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary",
                         "li", "dd", "dt"}

#: Words of class, id and role attributes that tell parts of a page, by kind. Fixed values.
KINDS = (
    frozenset("article articlebody content post entry story main body text page-content prose richtext markdown "
              "blogpost singlepost".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topnav skip".split()),
    frozenset("header masthead banner topbar logo branding".split()),
    frozenset("footer copyright colophon legal bottom credits".split()),
    frozenset("sidebar aside widget related recommended recommendations popular trending rail secondary more "
              "complementary".split()),
    frozenset("cookie cookies consent gdpr notice alert popup modal overlay paywall privacy announcement toast "
              "warning".split()),
    frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted dfp outbrain "
              "taboola commercial".split()),
    frozenset("form search newsletter subscribe subscription signup login register contact".split()),
    frozenset("comment comments commentlist disqus reply replies respond discussion reader feedback reviews".split()),
    frozenset("share sharing social follow facebook twitter tags meta byline author date tools print".split()),
)
TAGS = ("article", "main", "p", "heading", "div", "section", "nav", "header", "footer", "aside", "list", "li", "table",
        "form", "quote", "figure", "inline", "link", "body")
_TAG = {**{f"h{i}": "heading" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "list",
        "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table",
        "pre": "quote", "blockquote": "quote", "code": "quote", "figcaption": "figure", "a": "link", "html": "body",
        "button": "form", "label": "form", "fieldset": "form", "details": "div", "center": "div"}
_CODE = {name: i for i, name in enumerate(TAGS)}
_CODE_OF = {**_CODE, **{tag: _CODE[kind] for tag, kind in _TAG.items()}}
_LINK, _STORY, _ASIDE = 1, 2, 4
_AROUND = {"a": _LINK, "article": _STORY, "main": _STORY, "nav": _ASIDE, "footer": _ASIDE, "aside": _ASIDE,
           "form": _ASIDE, "dialog": _ASIDE}
FEATURES = (*(f"tag {t}" for t in TAGS), *(f"own {i}" for i in range(len(KINDS))),
            *(f"above {i}" for i in range(len(KINDS))), "in article", "in boilerplate tag", "depth", "text", "links",
            "nodes", "density", "stops", "runs", "run length", "siblings", "place", "same tag", "share", "position",
            "parent links", "list share")


@dataclass
class Page:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    #: Kinds of all nodes above, and whether a link, an article or a boilerplate tag is around the node.
    above: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    #: (node, block number, raw text)
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def _kinds(attributes: str) -> int:
    """The kinds that the class, id and role words name, one bit each."""
    found = 0
    for values in _ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        words = set(_TOKENS.findall(value.lower())) | set(_TOKENS.findall(_CAMEL.sub("-", value).lower()))
        for bit, kind in enumerate(KINDS):
            if not kind.isdisjoint(words):
                found |= 1 << bit
    return found


class _Tags:
    """The tags of a page, found in time linear in its length.

    A start tag ends at the first ``>`` outside quotes, or at the first one of all if a quote is never closed.
    Looking for it in vain costs the rest of the page, so after the first such tag the ends of all are worked
    out in one pass from the back. Where no ``>`` follows there are no more tags, only text.
    """

    def __init__(self, html: str):
        self.html, self.last, self.signs, self.ends = html, html.rfind(">"), None, None

    def at(self, place: int) -> tuple[int, str | None, str | None, str | None] | None:
        """(end, name of a start tag, its attributes, name of an end tag) of what starts here, if it is a tag."""
        if place > self.last and not self.html.startswith("<!--", place):
            return None
        start = _START.match(self.html, place)
        if start is None or self.ends is None:
            if match := _TOKEN.match(self.html, place):
                return match.end(), match[1], match[2], match[3]
            if start is None:
                return None
            self._find_ends()
        end = self.ends[bisect_left(self.signs, start.end())]
        end = self.html.index(">", start.end()) if end < 0 else end
        return end + 1, start[1], self.html[start.end():end], None

    def _find_ends(self) -> None:
        """For each sign, the end of a tag in which it is the first one; -1 where a quote stays open."""
        self.signs = [m.start() for m in _SIGN.finditer(self.html)]
        self.ends, following = [-1] * (len(self.signs) + 1), {}
        for i in range(len(self.signs) - 1, -1, -1):
            sign = self.html[self.signs[i]]
            if sign == ">":
                self.ends[i] = self.signs[i]
            else:
                self.ends[i] = self.ends[following[sign] + 1] if sign in following else -1
                following[sign] = i


def parse(html: str) -> Page:
    """Nodes and text runs of a page; unclosed and stray tags are mended, nothing raises."""
    page, stack, block, at, place = Page(), [], 0, 0, 0
    found, places = _Tags(html), {}  # places in the stack of the open elements, by tag
    tags, parents, kinds, depths, above, around = (page.tags, page.parents, page.kinds, page.depths, page.above,
                                                   page.around)

    def text(raw):
        if raw and not raw.isspace():
            if not stack:
                open_node("body", "")
            page.runs.append((stack[-1], block, raw))
        elif raw and page.runs and page.runs[-1][1] == block:
            page.runs.append((stack[-1] if stack else 0, block, " "))

    def open_node(tag, attributes):
        kinds.append(_kinds(attributes) if attributes and not attributes.isspace() else 0)
        if stack:
            up = stack[-1]
            parents.append(up)
            depths.append(depths[up] + 1)
            above.append(above[up] | kinds[up])
            around.append(around[up] | _AROUND.get(tags[up], 0) | _AROUND.get(tag, 0) & _LINK)
        else:
            parents.append(-1)
            depths.append(0)
            above.append(0)
            around.append(_AROUND.get(tag, 0) & _LINK)
        tags.append(tag)
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(tags) - 1)

    def topmost(names):
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names, barrier=()):
        top = topmost(names)
        if top >= 0 and top >= topmost(barrier):
            for node in stack[top:]:
                places[tags[node]].pop()
            del stack[top:]

    while (place := html.find("<", place)) >= 0:
        tag_here = found.at(place)
        if tag_here is None:
            place += 1
            continue
        text(html[at:place])
        at, start, attributes, end = tag_here
        place = at
        if start:
            tag = start.lower()
            if tag in BLOCK:
                block += 1
            if tag in RAW:
                if not attributes.endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = place = stop.end() if stop else len(html)
                continue
            if tag == "br":
                text(" ")
            if tag in VOID:
                continue
            if tag in _P_STAYS_OPEN:
                close(("p",), ("td", "th", "li", "dd", "button"))
            if tag in _ENDS:
                close(_ENDS[tag], _BARRIER.get(tag, ("table", "select")))
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            open_node(tag, attributes)
        elif end:
            tag = end.lower()
            if tag in BLOCK:
                block += 1
            close((tag,), ("table", "td", "th") if tag not in ("table", "td", "th", "tr", "tbody", "body", "html") else ())
    text(html[at:])
    return page


def features(pages: list[Page]) -> np.ndarray:
    """One row of ``FEATURES`` for each node of the pages, which are taken as one forest."""
    counts = np.array([len(p.tags) for p in pages], np.int64)
    base, n = np.cumsum(counts) - counts, int(counts.sum())
    def flat(name):
        return np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, n)
    parents, depth, kinds, above, around = map(flat, ("parents", "depths", "kinds", "above", "around"))
    shift = np.repeat(base, counts)
    root, parents = parents < 0, parents + shift
    up = np.where(root, np.arange(n), parents)
    code = np.fromiter((_CODE_OF.get(t, _CODE["inline"]) for p in pages for t in p.tags), np.int64, n)
    runs = [(b + node, len(raw), raw.count(".") + raw.count(",") + raw.count(";"), raw != " ")
            for p, b in zip(pages, base.tolist()) for node, _, raw in p.runs]
    node, length, stops, real = np.array(runs, np.int64).reshape(-1, 4).T
    own, marks, pieces = (np.bincount(node, weights=w, minlength=n) for w in (length, stops, real))
    seen = np.cumsum(own) - own
    first = seen - seen[np.minimum(shift, max(n - 1, 0))]
    listed = np.isin(code, (_CODE["list"], _CODE["li"]))
    total = np.stack([own, own * (around & _LINK > 0), np.ones(n), marks, pieces, own * listed], axis=1)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
    for level in range(len(cuts) - 1, 0, -1):
        some = by_depth[cuts[level - 1]:cuts[level]]
        np.add.at(total, up[some], total[some])
    text, linked, nodes, marks, pieces, listed = total.T
    order = np.argsort(up, kind="stable")
    order = order[~root[order]]
    starts = np.flatnonzero(np.diff(up[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    siblings, place = np.ones(n), np.zeros(n)
    siblings[order] = np.repeat(sizes, sizes)
    place[order] = np.arange(len(order)) - np.repeat(starts, sizes)
    _, which, times = np.unique(np.where(root, -1, up) * len(TAGS) + code, return_inverse=True, return_counts=True)
    same = np.where(root, 1, times[which])
    whole = np.maximum(np.repeat(text[base[counts > 0]], counts[counts > 0]), 1)
    some, line = np.maximum(text, 1), np.maximum(pieces, 1)
    out = np.zeros((n, len(FEATURES)))
    out[np.arange(n), code] = 1
    width = len(TAGS)
    for bit in range(len(KINDS)):
        out[:, width + bit] = kinds >> bit & 1
        out[:, width + len(KINDS) + bit] = above >> bit & 1
    log = np.log1p
    rest = (around & _STORY > 0, around & _ASIDE > 0, depth, log(text), linked / some, log(nodes), log(text / nodes),
            marks / some * 100, log(pieces), log(text / line), log(siblings), place / siblings, same / siblings,
            text / np.maximum(text[up], 1), first / whole, linked[up] / np.maximum(text[up], 1), listed / some)
    for i, column in enumerate(rest):
        out[:, width + 2 * len(KINDS) + i] = column
    return out


def decode(page: Page, margins: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the best labelling that no ancestor or descendant contradicts.

    Down any path a node may be outside, then main, then cut, and never goes back: what is cut out of the main
    text, or never reached it, has no main part below a cut. A node counts by its margin and the logarithm of
    its text; the best total is found from the leaves up.
    """
    n = len(page.tags)
    lengths = np.zeros(n)
    for node, _, raw in page.runs:
        lengths[node] += len(raw)
    for i in range(n - 1, 0, -1):
        if page.parents[i] >= 0:
            lengths[page.parents[i]] += lengths[i]
    gain = (margins * np.log1p(lengths)).tolist()
    outside, main, cut = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        outside[i] -= gain[i]
        main[i] += gain[i]
        cut[i] -= gain[i]
        p = page.parents[i]
        if p >= 0:
            outside[p] += max(outside[i], main[i])
            main[p] += max(main[i], cut[i])
            cut[p] += cut[i]
    state = [0] * n
    for i in range(n):
        p = page.parents[i]
        before = state[p] if p >= 0 else 0
        if before == 0:
            state[i] = int(main[i] > outside[i])
        elif before == 1:
            state[i] = 1 if main[i] >= cut[i] else 2
        else:
            state[i] = 2
    return np.array(state) == 1


def main_text(page: Page, chosen: np.ndarray) -> str:
    """Text runs of the chosen nodes, one line for each block, white space made one space."""
    blocks, last = [], None
    for node, block, raw in page.runs:
        if chosen[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(raw)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)
