"""Main-text extraction with a tree-structured graphical model.

Every block of a page and every run of text in it is a node with a hidden label: content (or, for a
block, holding content) or not. Node potentials are log-linear in features of the node; potentials
between parent and child say how labels go together. One upward and one downward sum-product pass give
each node's exact marginal; runs of text that are more likely content than not, in page order, are
the text. The parameters maximise the likelihood of labelled pages, whose gradient comes
from the same passes.

Labelled pages can be given; by default the pages of `labelled_pages` are used, which are made from a rule
in several layouts, so that training needs no data of its own.

Defined cases: null or empty html gives an empty text; malformed html is read as dom.py says; a run that is exactly as
likely content as not is content; pages of any length and depth are handled whole; an empty table gives
an empty result; repeated rows give repeated rows; other columns don't matter.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.dom import Node, parse

#: Parts of class and id names that hint at a node's role.
OFF = (
    "nav", "menu", "header", "masthead", "footer", "foot", "sidebar", "aside", "side", "widget", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner",
    "cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "form", "comment", "comments", "reply", "replies",
    "discussion", "disqus", "respond", "related", "recommended", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager", "tags", "meta", "copyright", "legal", "skip", "toc",
)
ON = ("article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page")
_TAGS = (
    "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "dl", "dd", "dt", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "nav",
    "header", "footer", "aside", "form", "fieldset", "body", "html", "head", "address", "dialog", "menu",
)
#: What runs of text say that are no part of an article, in lower case.
_SAYS = (
    "cookie", "privacy policy", "terms of", "all rights reserved", "subscribe", "newsletter", "sign up", "sign in", "log in", "advertisement", "sponsored",
    "share this", "follow us", "related", "read more", "most read", "leave a comment", "leave a reply", "accept", "skip to",
)
_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "main", "article", "alert", "dialog", "form")
_NAMES = [
    "bias", "run", *[f"tag {t}" for t in _TAGS], "tag other", *[f"off {t}" for t in OFF], *[f"on {t}" for t in ON], *[f"role {r}" for r in _ROLES], "hidden",
    *[f"in {t}" for t in ("p", "h1", "h2", "h3", "li", "td", "div", "blockquote", "figcaption", "pre")], "linked all", "linked half", "linked some",
    "short 20", "short 60", "short 150", "long", "sentence", "copyright", "controls", "says",
    *[f"holds {x}" for x in ("most", "much", "some", "little")], *[f"links {x}" for x in ("all", "half", "some", "none")], *[f"prose {x}" for x in (0, 1, 2, 5)], "holds controls",
]
_AT = {n: i for i, n in enumerate(_NAMES)}
_ENDS = ".!?…\"”»"
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
ITERATIONS = 250
RIDGE = 2e-3


def _features(nodes: list[Node]) -> list[list[int]]:
    at, out = _AT, []
    # of each block: characters of text below it, of these in links, runs that end like a sentence, controls
    size, linked, prose, controls = ([0] * len(nodes) for _ in range(4))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if not n.tag:
            size[k], linked[k], controls[k] = len(n.text), n.linked, n.controls
            prose[k] = int(len(n.text) >= 40 and n.text[-1] in _ENDS and 2 * n.linked < len(n.text))
        if n.parent >= 0:
            for held in (size, linked, prose, controls):
                held[n.parent] += held[k]
    total = max(1, size[0]) if nodes else 1
    for k, n in enumerate(nodes):
        f = [0]
        if n.tag:
            f.append(at.get(f"tag {n.tag}", at["tag other"]))
            share, links = size[k] / total, linked[k] / max(1, size[k])
            f.append(at["holds most" if share > 0.5 else "holds much" if share > 0.2 else "holds some" if share > 0.04 else "holds little"])
            f.append(at["links all" if links > 0.8 else "links half" if links > 0.3 else "links some" if links > 0.02 else "links none"])
            f.append(at[f"prose {5 if prose[k] > 4 else 2 if prose[k] > 1 else prose[k]}"])
            if controls[k]:
                f.append(at["holds controls"])
            a = n.attributes
            if a:
                names = set(_SPLIT.split(_CAMEL.sub(r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
                f += [at[f"off {x}"] for x in OFF if x in names] + [at[f"on {x}"] for x in ON if x in names]
                if (role := f"role {a.get('role', '').lower()}") in at:
                    f.append(at[role])
                style = a.get("style", "").replace(" ", "").lower()
                if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
                    f.append(at["hidden"])
        else:
            length = max(1, len(n.text))
            share = n.linked / length
            f.append(1)
            if (kind := f"in {nodes[n.parent].tag}") in at:
                f.append(at[kind])
            if share > 0.8:
                f.append(at["linked all"])
            elif share > 0.4:
                f.append(at["linked half"])
            elif share > 0:
                f.append(at["linked some"])
            f.append(at["short 20" if length < 20 else "short 60" if length < 60 else "short 150" if length < 150 else "long"])
            if n.text[-1] in _ENDS:
                f.append(at["sentence"])
            if length < 200:
                said = n.text.lower()
                if any(x in said for x in _SAYS):
                    f.append(at["says"])
            if "©" in n.text[:40]:
                f.append(at["copyright"])
            if n.controls:
                f.append(at["controls"])
        out.append(f)
    return out


class Forest:
    """Nodes of several pages as arrays; depth by depth, so that a pass is a few numpy steps a level."""

    def __init__(self, pages: list[list[Node]]):
        parent, depth, kind, rows, cols, first = [], [], [], [], [], 0
        for nodes in pages:
            for k, f in enumerate(_features(nodes)):
                rows += [first + k] * len(f)
                cols += f
            parent += [n.parent + first if n.parent >= 0 else -1 for n in nodes]
            depth += [n.depth for n in nodes]
            kind += [0 if n.tag else 1 for n in nodes]
            first += len(nodes)
        self.parent, depth, self.kind = np.array(parent, np.int64), np.array(depth, np.int64), np.array(kind, np.int64)
        self.rows, self.cols, self.n = np.array(rows, np.int64), np.array(cols, np.int64), first
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)

    def marginals(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(label) by node, P(parent label, label) by node); t: [kind, parent label, label], all in logs."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.rows, w[self.cols], self.n)
        up, message = own.copy(), np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            s = up[level][:, None, :] + t[self.kind[level]]
            message[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        belief, pair = up.copy(), np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]  # without what came from the node itself
            joint = above[:, :, None] + t[self.kind[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            joint -= np.logaddexp(belief[level][:, 0], belief[level][:, 1])[:, None, None]
            pair[level] = np.exp(joint)
        belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
        return np.exp(belief), pair


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    pairs: tuple[float, ...]  # [kind, parent label, label], flattened


def train(pages: list[tuple[str, list[str]]]) -> Model:
    """pages: (html, content blocks in normalised text). A block holds content if a run below it does."""
    trees = [parse(h) for h, _ in pages]
    forest, y = Forest(trees), []
    for nodes, (_, blocks) in zip(trees, pages):
        wanted, label = set(blocks), [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            if not nodes[k].tag and nodes[k].text in wanted:
                label[k] = 1
            if label[k] and nodes[k].parent >= 0:
                label[nodes[k].parent] = 1
        y += label
    y = np.array(y)
    below = forest.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[below], y[forest.parent[below]], y[below]), 1)
    w, t, n = np.zeros(len(_NAMES)), np.zeros((2, 2, 2)), len(pages)
    m, v = np.zeros(len(w) + 8), np.zeros(len(w) + 8)
    for step in range(1, ITERATIONS + 1):
        p, pair = forest.marginals(w, t)
        gw = np.bincount(forest.cols, (y - p[:, 1])[forest.rows], len(w))
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kind[below], pair[below])
        g = np.concatenate([gw / n - RIDGE * w, (seen - expected).ravel() / n - RIDGE * t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + d[: len(w)], t + d[len(w) :].reshape(2, 2, 2)
    return Model(tuple(map(float, w)), tuple(map(float, t.ravel())))


def extract_all(pages: list[str], model: Model) -> list[list[str]]:
    """Content blocks of each page, in page order."""
    trees = [parse(h) for h in pages]
    p, _ = Forest(trees).marginals(np.array(model.weights), np.array(model.pairs).reshape(2, 2, 2))
    out, at = [], 0
    for nodes in trees:
        out.append([n.text for k, n in enumerate(nodes) if not n.tag and p[at + k, 1] >= 0.5])
        at += len(nodes)
    return out


def labelled_pages(n: int = 420, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Made pages with their content blocks: layouts, names and wordings drawn by a seeded rule.

    Three kinds of pages: with the elements that HTML has for the parts of a page, with class and id names that
    tell them, and bare ones, of unnamed boxes and table cells, whose parts show only by what they hold.
    """
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mer", "tin", "sa", "ver", "dul", "en", "or", "thi", "pla", "qui", "ré", "ün", "os"]

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        return " ".join(made).capitalize()

    def sentence(low: int = 4, high: int = 60) -> str:
        return words(low, high) + rng.choice([".", ".", ".", "!", "?"])

    def said(low: int, high: int) -> str:
        """A line of what pages say around articles, often in the usual words."""
        line = sentence(low, high)
        if rng.random() < 0.5:
            first, _, rest = line.partition(" ")
            line = f"{first} {rng.choice(_SAYS)} {rest}" if rng.random() < 0.5 else f"{rng.choice(_SAYS).capitalize()} {line}"
        return line

    def named(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        mark = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} box{rng.randint(1, 9)}"', f' class="site-{name}"'])
        return f"<{tag}{mark}>{inner}</{tag}>"

    def box(inner: str) -> str:
        """An element whose name tells nothing."""
        return f"<div{rng.choice(['', '', ' id=\"wrap\"', ' class=\"inner\"', ' class=\"col c1\"', ' id=\"x7\"', ' class=\"row\"'])}>{inner}</div>"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def loose_links(k: int) -> str:
        """Links in a row, without a list."""
        return rng.choice([" ", " | ", " · ", ""]).join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(k))

    pages = []
    for _ in range(n):
        blocks: list[str] = []
        style = rng.choice(["semantic", "semantic", "named", "bare", "bare"])

        def keep(text: str, tag: str = "p") -> str:
            blocks.append(text)
            inner = text
            if tag == "p" and rng.random() < 0.25:
                head, _, rest = text.partition(" ")
                inner = rng.choice([f"<b>{head}</b> {rest}", f'<a href="/x">{head}</a> {rest}', f"<em>{head}</em> {rest}"])
            return f"<{tag}>{inner}</{tag}>" if tag != "p" or rng.random() < 0.8 else f"<p><b>{text}<br>"

        def run_on() -> str:
            """Paragraphs that only line breaks part, in a box of their own."""
            parts = [sentence(6) for _ in range(rng.randint(1, 4))]
            blocks.append(" ".join(parts))
            return f"<div>{'<br><br>'.join(parts)}</div>"

        article = keep(words(3, 12), rng.choice(["h1", "h1", "h2"])) if rng.random() < 0.9 else ""
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.52:
                article += keep(sentence(6))
            elif roll < 0.57:
                article += run_on()
            elif roll < 0.68:
                article += keep(rng.choice([sentence(1, 3), words(1, 2), words(1, 1) + "."]))
            elif roll < 0.75:
                article += keep(rng.choice([" | ".join(words(1, 1) for _ in range(rng.randint(2, 30))), words(6, 40), f"{words(1, 1)} " * rng.randint(2, 20) + rng.choice(["*", "$$$", "1234", "–"])]))
            elif roll < 0.82:
                article += keep(words(2, 6), rng.choice(["h2", "h3"]))
            elif roll < 0.88:
                article += "<ul>" + "".join(keep(sentence(3, 12), "li") for _ in range(rng.randint(2, 4))) + "</ul>"
            elif roll < 0.91:
                article += "<blockquote>" + keep(sentence()) + "</blockquote>"
            elif roll < 0.93:
                article += f"<figure><img src='/i.png'>{keep(words(2, 9), 'figcaption')}</figure>"
            elif roll < 0.96:
                article += "<table><tr>" + "".join(keep(words(1, 3), "td") for _ in range(3)) + "</tr></table>"
            else:
                article += named("div", ["ad", "advert", "promo", "sponsored"], said(3, 15))
        if rng.random() < 0.15:
            article += named("div", ["share", "social", "tags", "related"], links(rng.randint(2, 4)))
        if rng.random() < 0.15:
            article += f"<div><button>{words(1, 2)}</button>{loose_links(2)}</div>"

        menu = f"<nav>{rng.choice([links, loose_links])(rng.randint(3, 8))}</nav>", named("div", ["menu", "nav", "navigation-menu", "breadcrumbs"], links(rng.randint(3, 8)))
        top = f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>", named("div", ["header", "masthead"], f"<p>{words(1, 5)}</p>"), f"<header>{menu[0]}</header>"
        ads = named("div", ["ad", "ads", "advert", "banner", "promo", "sponsor"], said(3, 25)), named("div", ["ad"], f"<p>{said(3, 25)}</p>")
        notices = named("div", ["cookie", "consent", "notice", "alert", "gdpr", "popup"], f"<p>{said(5, 25)}</p><button>{words(1, 2)}</button>"), f'<div role="alert">{said(4, 14)}</div>'
        asides = f"<aside><h3>{words(1, 3)}</h3>{links(3)}<p>{said(5, 25)}</p></aside>", named("div", ["sidebar", "side", "widget", "related"], f"<h3>{words(1, 3)}</h3><p>{said(4, 30)}</p>")
        forms = f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button><p>{said(3, 12)}</p></form>', named("div", ["newsletter", "subscribe", "search", "login"], f"<p>{said(4, 14)}</p><form><input></form>")
        remarks = "".join(rng.choice([f'<div class="comment"><p>{sentence(3, 40)}</p></div>', f'<article class="comment"><h4>{words(1, 2)}</h4><p>{sentence(3, 40)}</p></article>', f"<li><p>{sentence(3, 40)}</p></li>"]) for _ in range(rng.randint(1, 4)))
        comments = rng.choice(["", "", named(rng.choice(["section", "div", "ol"]), ["comments", "replies", "discussion", "respond"], f"<h3>{words(1, 2)}</h3>{remarks}")])
        ends = f"<footer>&copy; {words(1, 3)} &middot; {said(3, 18)}</footer>", f"<footer><p>{said(3, 18)}</p>{links(2)}</footer>", named("div", ["footer", "copyright", "legal"], f"<p>© {said(3, 12)}</p>")
        if style == "bare":
            # parts without a telling name, of links, of the usual words or of controls
            nav = rng.choice([box(links(rng.randint(3, 8))), box(loose_links(rng.randint(3, 8))), f"<p>{loose_links(rng.randint(3, 8))}</p>", links(rng.randint(3, 8))])
            header = rng.choice(["", box(f'<a href="/">{words(1, 3)}</a>'), box(f'<a href="/"><b>{words(1, 2)}</b></a><br>{loose_links(3)}')])
            ad = rng.choice(["", "", box(f'<a href="http://{words(1, 1)}">{said(3, 15)}</a>'), *ads])
            notice = rng.choice(["", "", box(f"<p>{rng.choice(_SAYS[:4]).capitalize()} {words(3, 9)}.</p><button>{words(1, 1)}</button>"), *notices])
            side = rng.choice(["", box(f"<h3>{words(1, 3)}</h3>{links(rng.randint(3, 7))}"), asides[0]])
            form = rng.choice(["", box(f"<form><label>{words(1, 2)}</label><input></form>"), forms[0]])
            footer = rng.choice([box(f"© 2024 {words(1, 4)}"), f"<p>&copy; {words(1, 3)}. All rights reserved.</p>", box(f"<p>© {words(1, 2)}</p><p>{loose_links(3)}</p>"), ends[0]])
            body = article
            for _ in range(rng.randint(0, 3)):
                body = box(body)
            if rng.random() < 0.2:
                body = f"<table><tr><td>{nav}</td><td>{article}</td></tr></table>"
                nav = ""
        else:
            names = ["content", "post", "entry", "article", "story", "main-content", "post-body"]
            body = rng.choice([f"<article>{article}</article>", f"<article>{article}</article>", f"<main><article>{article}</article></main>", f"<main>{article}</main>", f"<main>{named('section', ['content', 'text', 'prose'], article)}</main>"] if style == "semantic" else [named("div", names, article), named("div", names, box(article)), box(named("div", names, article))])
            nav, header, ad, notice, side, form, footer = rng.choice(menu), rng.choice(["", *top]), rng.choice(["", *ads]), rng.choice(["", "", *notices]), rng.choice(["", *asides]), rng.choice(["", *forms]), rng.choice(ends)
        before, after = [header, nav, ad, notice, form, side], [side, comments, form, footer]
        rng.shuffle(before)
        before, after = [x for x in before if rng.random() < 0.7], [x for x in after if rng.random() < 0.8]
        middle = f"{''.join(before)}{body}{''.join(after)}"
        if rng.random() < 0.35:
            middle = named("div", ["wrapper", "container", "page", "layout", "site"], middle) if style != "bare" else box(middle)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{middle}</body></html>", blocks))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """-> (id, *keep, text): one row for each row of pages; blocks joined by one space."""
    model = model or default_model()
    first = pages.select(F.col(id_col), *keep).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [" ".join(b) for b in extract_all([h.as_py() or "" for h in part.column(part.num_columns - 1)], model)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return pages.select(F.col(id_col), *keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, out)
