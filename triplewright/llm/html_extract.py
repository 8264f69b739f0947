"""Main text of web pages by gradient-boosted trees over DOM nodes.

The trees are Spark's, trained on pages that are composed for it: paragraphs of a bounded sample of the given
pages are put into many layouts whose main part is known. Each page's nodes are scored, and the labelling of
the whole tree with the best total score that contradicts itself nowhere says what is main text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from . import dom

#: Bounds of what the trees learn from: pages whose paragraphs are used, and pages composed of them.
SAMPLE_PAGES = 240
COMPOSED = 1200
TREES, DEPTH = 20, 5

_MARK = ""  # put before main text in composed pages only

# Attribute words that composed pages give to their parts.
_MAIN = ("content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text", "body",
         "single-post", "articleBody", "prose")
_WRAP = ("wrapper", "container", "page", "layout", "site", "row", "col", "inner", "grid", "")
_PARTS = {
    "nav": ("menu", "navbar", "navigation", "main-nav", "breadcrumbs", "pagination", "top-menu", "toc"),
    "header": ("header", "masthead", "site-header", "topbar", "banner", "page-header", "branding"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "legal", "bottom"),
    "aside": ("sidebar", "widget", "related", "recommended", "popular-posts", "right-rail", "secondary", "trending"),
    "notice": ("cookie-notice", "consent", "gdpr-banner", "alert", "popup", "modal", "notice", "announcement"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot", "commercial"),
    "form": ("search-form", "newsletter", "subscribe", "signup", "login-form", "contact-form"),
    "comments": ("comments", "comment-list", "discussion", "replies", "respond", "reader-comments", "feedback"),
    "share": ("share", "social", "tags", "post-meta", "byline", "follow-us", "author-box"),
}


class _Composer:
    """Pages of random layout around given paragraphs."""

    def __init__(self, paragraphs: list[str], seed: int):
        self.random, self.paragraphs = random.Random(seed), paragraphs or ["Text"]

    def words(self, low: int, high: int) -> str:
        words = self.random.choice(self.paragraphs).split() or ["text"]
        count = self.random.randint(low, high)
        at = self.random.randrange(max(1, len(words) - count + 1))
        return " ".join(words[at:at + count])

    def attribute(self, values) -> str:
        value = self.random.choice(values)
        return f' {self.random.choice(("class", "class", "id"))}="{value}"' if value else ""

    def menu(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(self.random.randint(low, high))]
        if self.random.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.random.choice((" ", " | ", "")).join(items)

    def prose(self, low: int, high: int) -> str:
        return "".join(f"<p>{self.words(4, 60)}</p>" for _ in range(self.random.randint(low, high)))

    def part(self, kind: str) -> str:
        r = self.random
        if kind == "nav":
            inner = self.menu(3, 9)
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 6)}</div>", f"<p>{self.words(2, 8)}</p>"))
            inner += self.menu(2, 5) if r.random() < 0.5 else ""
        elif kind == "footer":
            inner = r.choice(("&copy; ", "")) + r.choice((self.words(2, 15), self.menu(2, 6), self.prose(1, 2)))
        elif kind == "aside":
            inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.menu(3, 8), self.prose(1, 3), f"<p>{self.words(5, 40)}</p>"))
        elif kind == "notice":
            inner = r.choice((self.words(5, 30), self.prose(1, 1))) + r.choice(("<button>OK</button>", "", '<a href="/x">ok</a>'))
        elif kind == "ad":
            inner = r.choice((self.words(3, 25), self.prose(1, 1), f'<a href="/x">{self.words(2, 10)}</a>'))
        elif kind == "form":
            inner = f'<label>{self.words(1, 5)}</label><input type="text"><button>{self.words(1, 2)}</button>'
            inner = r.choice(("", f"<p>{self.words(4, 20)}</p>")) + inner
        elif kind == "comments":
            one = r.choice(("comment", "reply", "comment-body", ""))
            tag = r.choice(("div", "li", "article", "section"))
            items = [f'<{tag} class="{one}">' + r.choice(("", f'<b>{self.words(1, 2)}</b>')) + self.prose(1, 3) + f"</{tag}>"
                     for _ in range(r.randint(1, 6))]
            inner = r.choice(("", f"<h2>{self.words(1, 3)}</h2>")) + "".join(items)
            if tag == "li":
                inner = f"<ol>{inner}</ol>"
        else:
            inner = r.choice((self.menu(2, 5), self.words(2, 12)))
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if own and r.random() < 0.55:
            tag = own
            attribute = self.attribute(_PARTS[kind]) if r.random() < 0.4 else ""
        else:
            tag = r.choice(("div", "div", "section", "aside" if kind in ("ad", "share") else "div"))
            attribute = self.attribute(_PARTS[kind])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def story(self) -> str:
        r, out = self.random, []

        def say(low, high):
            text = self.words(low, high)
            if r.random() < 0.15:
                text = f"{self.words(1, 4)} <{(t := r.choice(('b', 'i', 'em', 'strong', 'span')))}>{text}</{t}>"
            if r.random() < 0.12:
                text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 8)}'
            return _MARK + text

        title = f"<h1>{say(2, 14)}</h1>"
        out.append(f"<header>{title}</header>" if r.random() < 0.15 else title if r.random() < 0.85 else "")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{say(3, 120)}" + r.choice(("</p>", "</p>", "</p>", "")))
            elif kind < 0.80:
                out.append(f"<h2>{say(1, 8)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{say(1, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{say(5, 40)}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<pre>{say(3, 30)}</pre>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 6)}</td><td>{say(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.98:
                out.append(f"<p><b>{say(3, 30)}<br>")
            else:
                out.append(f"<div>{say(5, 80)}</div>")
            if r.random() < 0.08:
                out.append(self.part(r.choice(("ad", "ad", "share", "aside", "form", "notice", "nav"))))
        if r.random() < 0.15:
            out.append(self.part(r.choice(("comments", "share", "aside"))))
        inner = "".join(out)
        shape = r.random()
        if shape < 0.38:
            return f"<article{self.attribute(_MAIN) if r.random() < 0.3 else ''}>{inner}</article>"
        if shape < 0.52:
            return f"<main>{inner}</main>"
        if shape < 0.82:
            return f"<div{self.attribute(_MAIN)}>{inner}</div>"
        return f"<div>{inner}</div>" if shape < 0.9 else inner

    def page(self) -> str:
        r = self.random
        before = [k for k in ("notice", "header", "nav", "ad", "form", "share") if r.random() < 0.4]
        after = [k for k in ("share", "aside", "ad", "comments", "form", "nav", "footer", "notice") if r.random() < 0.4]
        r.shuffle(before)
        middle = self.story()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            beside = "".join(self.part(r.choice(("aside", "ad", "comments", "nav"))) for _ in range(r.choice((0, 0, 1, 2))))
            middle = f"<div{self.attribute(_WRAP)}>{r.choice((middle + beside, beside + middle))}</div>"
        return ("<html><head><title>x</title></head><body>" + "".join(map(self.part, before)) + middle
                + "".join(map(self.part, after)) + "</body></html>")


def _paragraphs(html: str) -> list[str]:
    page = dom.parse(html)
    texts = (re.sub(r"[<>&\s]+", " ", dom.unescape(raw)).strip() for _, _, raw in page.runs)
    return [t for t in texts if t]


def _examples(layouts: int):
    """Pages to (features, label) of the nodes with text in ``layouts`` pages composed of each one's paragraphs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield from _composed(frame, layouts)

    return rows


def _composed(frame: pd.DataFrame, layouts: int) -> Iterator[pd.DataFrame]:
    rows, labels = [], []
    for key, html in zip(frame["page_id"], frame["html"]):
        paragraphs = _paragraphs(html)
        for layout in range(layouts):
            page = dom.parse(_Composer(paragraphs, int(key) * layouts + layout).page())
            good, every = np.zeros(len(page.tags)), np.zeros(len(page.tags))
            for node, _, raw in page.runs:
                every[node] += len(raw)
            # Inline parts after a mark belong to the marked block.
            marked = {b for _, b, raw in page.runs if _MARK in raw}
            for node, block, raw in page.runs:
                good[node] += len(raw) if block in marked else 0
            for i in range(len(page.tags) - 1, 0, -1):
                if page.parents[i] >= 0:
                    good[page.parents[i]] += good[i]
                    every[page.parents[i]] += every[i]
            page.runs = [(n, b, raw.replace(_MARK, "")) for n, b, raw in page.runs]
            used = every > 0
            rows.append(dom.features([page])[used])
            labels.append((good[used] / every[used] > 0.5).astype(float))
    if rows:
        yield pd.DataFrame({"values": list(np.concatenate(rows)), "label": np.concatenate(labels)})


def _tree_table(text: str) -> list[list[tuple[int, float, int, int, float]]]:
    """Trees from Spark's text form, each a list of (feature, threshold, left, right, value)."""
    trees, path = [], []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("Tree "):
            trees.append([])
            path = []
        elif test := re.match(r"If \(feature (\d+) <= (\S+)\)", line):
            trees[-1].append((int(test[1]), float(test[2]), len(trees[-1]) + 1, -1, 0.0))
            path.append(len(trees[-1]) - 1)
        elif line.startswith("Else"):
            at = path.pop()
            trees[-1][at] = (*trees[-1][at][:3], len(trees[-1]), 0.0)
        elif leaf := re.match(r"Predict: (\S+)", line):
            trees[-1].append((-1, 0.0, -1, -1, float(leaf[1])))
    return trees


def learn(pages: DataFrame, ws: Workspace) -> tuple[list, list[float]]:
    """(trees, their weights) from the paragraphs of at most SAMPLE_PAGES pages (page_id, html).

    The pages with the smallest hashes of their ids are taken. Without pages with markup there are no trees.
    """
    sample = pages.where("html is not null and page_id is not null").select("page_id", "html")
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(SAMPLE_PAGES)
    sample = ws.save(sample, ws.unique("sample"))
    layouts = -(-COMPOSED // max(1, sample.count()))
    examples = ws.save(sample.repartition(8, "page_id").mapInPandas(
        _examples(layouts), "values array<double>, label double"), ws.unique("examples"))
    kinds = {r.label for r in examples.select("label").distinct().collect()}
    if len(kinds) < 2:
        return [], []
    rows = examples.select(array_to_vector("values").alias("features"), "label").coalesce(6)
    model: GBTClassificationModel = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=32, seed=7, checkpointInterval=-1).fit(rows)
    return _tree_table(model.toDebugString), list(model.treeWeights)


def _margins(trees: list, weights: list[float], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for tree, weight in zip(trees, weights):
        feature, threshold, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = np.where(rows[i, feature[node]] <= threshold[node], left[node], right[node])
        out += weight * value[at]
    return out


def extract(pages: DataFrame, model: tuple[list, list[float]]) -> DataFrame:
    """(page_id, url, text, n_chars) of every row (page_id, url, html), from its whole html.

    Null or empty html, and pages without main text, give an empty text. Repeated rows give repeated rows.
    """
    trees, weights = model

    def rows(batches):
        for batch in batches:
            documents = [dom.parse(h or "") for h in batch.column(2).to_pylist()]
            texts = []
            for at in range(0, len(documents), 64):
                some = documents[at:at + 64]
                margins = _margins(trees, weights, dom.features(some))
                ends = np.cumsum([len(p.tags) for p in some])
                for page, part in zip(some, np.split(margins, ends[:-1])):
                    texts.append(dom.main_text(page, dom.decode(page, part)) if page.tags else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        rows, "page_id long, url string, text string, n_chars long")
