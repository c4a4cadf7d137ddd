"""Operator 6, main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags); each block is described by its
ancestors' tags, words in their class and id attributes, and its own text. A two-label chain (main text or
not) with weights for features and for neighbouring labels is trained on labelled pages by maximum
likelihood (forward and backward sums, Adam, ridge) and decoded by Viterbi. The labelled pages are built by
`labelled_pages`: many layouts, with and without telling tags, whose every block has a known label.

Training takes a second or two on the driver and depends on no table; extraction is a map over pages.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes, nothing is
dropped or cut for length; null ids and urls and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bound_batches, tidy

_NAME_OF_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Elements whose content is no text of the page, by the end tag that closes them.
_HIDDEN = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template svg iframe object".split()}
_QUOTED = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_TAGS = "article main section nav header footer aside form ul ol table button select head title h1 h2 h3 h4 h5 h6 figure figcaption blockquote pre address dialog menu label p li td div body".split()
#: Words of class, id and role attributes, by what they tell.
_HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "foot": "footer foot bottom copyright legal imprint colophon contentinfo",
    "head": "masthead banner topheader siteheader logo branding",
    "side": "side sidebar aside widget rail related recommend recommended trending popular more complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "note": "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup paywall toast warning privacy",
    "talk": "comment comments reply replies discussion respond disqus feedback reviews thread",
    "share": "share sharing social follow tags tagged tools meta byline",
    "form": "form search login signin register input contact",
    "main": "article content post entry story main body text prose maincontent articlebody",
}
_HINT_OF: dict[str, tuple[str, ...]] = {}
for _k, _v in _HINTS.items():
    for _w in _v.split():
        _HINT_OF[_w] = (*_HINT_OF.get(_w, ()), "in:" + _k)
_SIGNS = [
    ("says:copyright", re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved", re.I)),
    ("says:cookie", re.compile(r"\bcookies?\b|\bconsent\b|privacy policy", re.I)),
    ("says:subscribe", re.compile(r"\bsubscribe\b|\bsign up\b|\bnewsletter\b|\blog ?in\b|\bregister\b", re.I)),
    ("says:ad", re.compile(r"\badvertis|\bsponsored\b|\bbuy now\b|\bclick here\b", re.I)),
    ("says:reply", re.compile(r"\breply\b|\bcomments?\b|\bposted by\b", re.I)),
    ("says:more", re.compile(r"\bread more\b|\brelated\b|\bmore stories\b|\bshare\b", re.I)),
]
_END = re.compile(r"[.!?。！？…\"'”»)]$")


def tokens(html: str):
    """(start, end, tag, attributes, closing) of each piece of markup: tag is None for comments and declarations,
    and the name of a hidden element, with its content, has a "!" before it. Linear in the page's length.

    As browsers do, a quote counts only after an equals sign and hides > up to the next quote of its kind; where
    there is none, and in a tag that is never closed, what follows is read as if there were no quote or no tag."""
    at, n = 0, len(html)
    last_gt, last = html.rfind(">"), {q: html.rfind(q) for q in "\"'"}
    while (at := html.find("<", at)) >= 0:
        follow = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, None, "", False
            at = end
            continue
        m = _NAME_OF_TAG.match(html, at) if at < last_gt else None
        if m is None and follow not in ("!", "?", "/") or at > last_gt:
            at += 1
            continue
        if m is None:
            end = html.find(">", at) + 1
            yield at, end, None, "", False
            at = end
            continue
        end, look = html.find(">", m.end()), m.end()
        while q := _QUOTED.search(html, look, end):
            look = q.end()
            if look > last[q.group(1)]:  # never closed
                continue
            shut = html.find(q.group(1), look)
            if shut > last_gt:
                break
            look = shut + 1
            end = max(end, html.find(">", look))
        tag = m.group(1).lower()
        closing = html[at + 1] == "/"
        rest = html[m.end() : end]
        if not closing and tag in _HIDDEN:
            stop = _HIDDEN[tag].search(html, end + 1)
            shut = html.find(">", stop.end()) if stop else -1
            end, tag = (shut if shut >= 0 else n - 1), "!" + tag
        yield at, end + 1, tag, rest, closing
        at = end + 1


class Block:
    __slots__ = ("text", "features")

    def __init__(self, text: str, features: list[str]):
        self.text, self.features = text, features


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order, with the features of their ancestors and text."""
    if not html:
        return []
    out: list[tuple[str, frozenset, int, str]] = []
    none: frozenset = frozenset()
    stack: list[tuple[str, frozenset, str]] = []  # tag, features of it and its ancestors, nearest block tag
    text: list[str] = []
    linked, at = 0, 0

    def flush():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((t, stack[-1][1] if stack else none, linked, stack[-1][2] if stack else ""))
            text.clear()
        linked = 0

    known = _FEATURES_OF
    links = 0
    for s, end, tag, rest, closing in tokens(html):
        if s > at:
            t = html[at:s]
            if "&" in t:
                t = entities.unescape(t)
            text.append(t)
            if links:
                linked += len(t)
        at = end
        if tag is None or tag[0] == "!":
            if tag:
                text.append(" ")
            continue
        if closing:
            if tag not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if links:
                        links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag not in _INLINE:
            flush()
            while stack and stack[-1][0] in _INLINE:  # inline tags left open end with their block
                links -= stack[-1][0] == "a"
                stack.pop()
            if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "tr", "option", "dt", "dd"):
                stack.pop()
        if tag in _VOID:
            continue
        up = stack[-1] if stack else ("", none, "")
        key = (tag, rest if "=" in rest and tag not in _INLINE else "")
        own = known.get(key)
        if own is None:
            own = _own(*key)
            if len(known) < 50_000:
                known[key] = own
        stack.append((tag, up[1] | own if own else up[1], up[2] if tag in _INLINE else tag))
        links += tag == "a"
    if at < len(html):
        t = html[at:]
        text.append(entities.unescape(t) if "&" in t else t)
    flush()
    n = len(out)
    return [Block(t, [*anc, *_text_features(t, linked, near, k, n)]) for k, (t, anc, linked, near) in enumerate(out)]


_FEATURES_OF: dict[tuple[str, str], frozenset] = {}


def _own(tag: str, rest: str) -> frozenset:
    got = {"under:" + tag} if tag in _TAGS and tag not in ("p", "div", "body", "section", "li", "td") else set()
    for m in _ATTR.finditer(rest):
        for w in _NAME.findall((m.group(1) or m.group(2) or m.group(3) or "").lower()):
            got.update(_HINT_OF.get(w, ()))
    if "hidden" in rest or "display:none" in rest.replace(" ", ""):
        got.add("hidden")
    return frozenset(got)


def _text_features(t: str, linked: int, near: str, k: int, n: int) -> list[str]:
    words = t.count(" ") + 1
    share = linked / len(t)
    f = [
        "bias", "near:" + near if near in _TAGS else "near:?",
        "words:" + ("1" if words < 3 else "2" if words < 8 else "3" if words < 20 else "4" if words < 60 else "5"),
        "links:" + ("0" if share == 0 else "1" if share < 0.3 else "2" if share < 0.8 else "3"),
    ]
    if _END.search(t):
        f.append("ends")
    if k == 0:
        f.append("first")
    if k == n - 1:
        f.append("last")
    if n < 4:
        f.append("few:div" if near == "div" else "few")
    if words < 60:
        f += [name for name, p in _SIGNS if p.search(t)]
    return f


class Crf:
    """A chain of two labels: weights by feature for label 1 against label 0, and label-to-label weights."""

    def __init__(self, weights: dict[str, float], step: np.ndarray):
        self.weights = weights
        self.step = step

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 250, ridge: float = 2e-3) -> "Crf":
        number: dict[str, int] = {}
        longest = max(len(y) for _, y in pages)
        row, col = [], []
        mask, gold = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest), np.int64)
        for r, (xs, y) in enumerate(pages):
            mask[r, : len(y)], gold[r, : len(y)] = True, y
            for k, fs in enumerate(xs):
                for f in set(fs):
                    row.append(r * longest + k)
                    col.append(number.setdefault(f, len(number)))
        row, col = np.array(row), np.array(col)
        both = mask[:, 1:]
        m = len(number)
        theta, m1, m2 = np.zeros(m + 4), np.zeros(m + 4), np.zeros(m + 4)
        pair_gold = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4)
        for it in range(1, rounds + 1):
            e1 = np.bincount(row, theta[:m][col], mask.size).reshape(mask.shape)
            t = theta[m:].reshape(2, 2)
            node, pair = cls._marginals(e1, t, mask)
            g = np.concatenate([np.bincount(col, ((node - gold) * mask).ravel()[row], m), pair.sum(axis=0).ravel() - pair_gold])
            g = g / len(pages) + ridge * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta -= 0.1 * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-8)
        return cls({f: float(theta[i]) for f, i in number.items()}, theta[m:].reshape(2, 2).copy())

    @staticmethod
    def _marginals(e1: np.ndarray, t: np.ndarray, mask: np.ndarray):
        """Probability of label 1 of each block, and the label-pair probabilities summed over each page."""
        pages, n = e1.shape
        e = np.stack([np.zeros_like(e1), e1], axis=2)
        fwd, bwd = np.zeros((pages, n, 2)), np.zeros((pages, n, 2))
        fwd[:, 0] = e[:, 0]
        for k in range(1, n):
            x = fwd[:, k - 1, :, None] + t[None]
            fwd[:, k] = np.where(mask[:, k, None], np.logaddexp(x[:, 0], x[:, 1]) + e[:, k], fwd[:, k - 1])
        for k in range(n - 2, -1, -1):
            x = t[None] + (e[:, k + 1] + bwd[:, k + 1])[:, None, :]
            bwd[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        node = np.exp(np.clip(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None], -50, 0)) * mask
        pair = np.zeros((pages, 2, 2))
        for k in range(1, n):
            x = fwd[:, k - 1, :, None] + t[None] + (e[:, k] + bwd[:, k])[:, None, :] - total[:, None, None]
            pair += np.exp(np.clip(x, -50, 0)) * mask[:, k, None, None]
        return node, pair

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best labels (Viterbi)."""
        w, (s00, s01), (s10, s11) = self.weights, self.step[0].tolist(), self.step[1].tolist()
        a, b, back = 0.0, 0.0, []
        for k, fs in enumerate(features):
            e = 0.0
            for f in fs:
                e += w.get(f, 0.0)
            if k == 0:
                a, b = 0.0, e
                continue
            x0, x1, y0, y1 = a + s00, b + s10, a + s01, b + s11
            back.append((x1 > x0, y1 > y0))
            a, b = max(x0, x1), max(y0, y1) + e
        if not features:
            return []
        out = [int(b > a)]
        for from0, from1 in reversed(back):
            out.append(int(from1 if out[-1] else from0))
        return out[::-1]


def labelled_pages(n: int = 360, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of invented words with the label of each leaf block (1: main text), in page order."""
    g = random.Random(seed)
    syllables = "ka lo mi ren tus va del or in est an po qui sel dra ne fu al ti mer".split()

    def words(lo, hi):
        return " ".join("".join(g.choices(syllables, k=g.randint(1, 4))) for _ in range(g.randint(lo, hi)))

    def sentence(lo=4, hi=22):
        return words(lo, hi).capitalize() + g.choice([".", ".", ".", "!", "?", ".", ""])

    def para():
        t = " ".join(sentence() for _ in range(g.choice([1, 1, 2, 3, 5, 8])))
        if g.random() < 0.2:
            t = t.replace(" ", ' <a href="/x">', 1) + "</a> " + words(2, 6) + "."
        if g.random() < 0.15:
            t = words(1, 3).capitalize() + g.choice([".", ""])  # short blocks are main text too
        return t

    def menu():
        k = g.randint(3, 8)
        tag = g.choice(["<nav>{}</nav>", '<ul class="menu">{}</ul>', '<div id="navbar"><ul>{}</ul></div>', "<header><nav><ul>{}</ul></nav></header>", '<div class="breadcrumbs">{}</div>', "<ul>{}</ul>"])
        return tag.format("".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))), [0] * k

    def boiler(kind):
        t = g.choice([sentence(), sentence(), sentence() + " " + sentence(), words(1, 4)])
        if kind == "ad":
            return g.choice(['<div class="ad">{}</div>', '<div class="ads-box">{}</div>', '<aside class="sponsored">{}</aside>', '<div id="promo">{}</div>', '<p class="advertisement">{}</p>']).format(t), [0]
        if kind == "note":
            t = g.choice([t, t, "We use cookies. " + t, "Subscribe to our newsletter. " + t])
            return g.choice(['<div class="cookie-notice">{}</div>', '<div id="consent"><p>{}</p></div>', '<div role="alert" class="notice">{}</div>', '<div class="newsletter">{}</div>']).format(t), [0]
        if kind == "side":
            k = g.randint(1, 4)
            body = "".join(g.choice(["<p>{}</p>", '<h3>{}</h3>', '<p><a href="/r">{}</a></p>']).format(sentence()) for _ in range(k))
            return g.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<section id="widget-area">{}</section>']).format(body), [0] * k
        if kind == "form":
            return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>', [0, 0]
        if kind == "talk":
            k = g.randint(1, 4)
            body = "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(k))
            return g.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>']).format(body), [0] * k
        if kind == "share":
            return f'<div class="{g.choice(["share", "social", "tags"])}"><a href="#">{words(1, 2)}</a></div>', [0]
        t = g.choice(["&copy; {} &middot; " + t, "Copyright {}. " + t, t + "{}"]).format(words(1, 2))
        return g.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', "<footer><p>{}</p></footer>"]).format(t), [0]

    def head():
        return f"<header><p>{words(1, 5)}</p></header>" if g.random() < 0.5 else f'<div class="masthead">{words(1, 4)}</div>', [0]

    pages = []
    for _ in range(n):
        title = words(3, 10).capitalize()
        # A third of the pages has no heading; some are a paragraph or two and nothing else.
        bare = g.random() < 0.25
        inner, marks = ([], []) if g.random() < (0.7 if bare else 0.3) else ([f"<h1>{title}</h1>"], [1])
        count = g.randint(1, 3) if bare else g.randint(1, 9)
        around = g.choice(["<p>{}</p>", "<div>{}</div>", "{}" if count == 1 else "<div>{}</div>"]) if bare else "<p>{}</p>"
        for _ in range(count):
            roll = 0.0 if bare else g.random()
            if roll < 0.75:
                inner.append(around.format(para()))
                marks.append(1)
            elif roll < 0.82:
                inner.append(f"<h2>{words(2, 6)}</h2>")
                marks.append(1)
            elif roll < 0.88:
                k = g.randint(2, 4)
                inner.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(k)) + "</ul>")
                marks += [1] * k
            elif roll < 0.91:
                inner.append(f"<blockquote>{sentence()}</blockquote>")
                marks.append(1)
            elif roll < 0.94:
                k = g.randint(2, 4)
                inner.append("<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(k)) + "</tr></table>")
                marks += [1] * k
            else:
                h, y = boiler(g.choice(["ad", "share", "note", "side", "talk"]))
                inner.append(h)
                marks += y
        wrap = g.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}", "{}"] if bare else
            ["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post" class="entry">{}</div>', '<div class="story-body">{}</div>', "<div>{}</div>", "{}"]
        )
        parts = [(wrap.format("".join(inner)), marks)]
        for kind in g.sample(["ad", "note", "share"], 0 if bare else g.randint(0, 2)):
            parts.insert(0, boiler(kind))
        if not bare and g.random() < 0.85:
            parts.insert(0, menu())
        if not bare and g.random() < 0.4:
            parts.insert(0, head())
        for kind in g.sample(["side", "form", "talk", "ad", "note"], 0 if bare else g.randint(0, 3)):
            parts.append(boiler(kind))
        if not bare and g.random() < 0.85:
            parts.append(boiler("foot"))
        page, labels = f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body>", [0]
        if g.random() < (0.6 if bare else 0.1):  # no head, perhaps no body either
            page, labels = g.choice(["<html><body>", "<body>", ""]), []
        for h, y in parts:
            page, labels = page + h, labels + y
        pages.append((page + "</body></html>" if "<body>" in page else page, labels))
    return pages


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    """The chain trained on the built-in labelled pages."""
    data = []
    for page, labels in labelled_pages():
        xs = [b.features for b in blocks(page)]
        if len(xs) != len(labels):
            raise ValueError("a labelled page has another number of blocks")
        data.append((xs, labels))
    return Crf.fit(data)


def main_text(html: str | None, model: Crf) -> str:
    found = blocks(html)
    return " ".join(b.text for b, y in zip(found, model.decode([b.features for b in found])) if y)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    model = model or trained()

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
