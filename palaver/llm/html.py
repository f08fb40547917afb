"""Main text of web pages by a maximum-scoring subsequence (7).

A page is a sequence of words and tags.  Words score positive and tags negative;
words of links score by a weight of their own.  One linear scan finds the
contiguous region of the largest sum, whose blocks are the text.

All scores come from labelled pages (``labelled_pages``): of each kind of tag
(name, opening or closing) and of word (plain or of a link), by whether it stands
within an article, beside one, or on a page without any, the logarithm of how
often it lies inside the main text against outside.  Tags never score above zero.
How much tags weigh against words is the value with the best F1 of words there.

The contract's elements without main text (menus, page headers, footers, side
bars, notices, adverts, forms, scripts, styles, reader comments) count as one tag
each and give no text, within the region as well.  Whatever else surrounds an
article (teasers, shares, links to more, taglines) is the scan's to leave out.

Defined results: null and empty pages have empty text.  Unclosed tags end with
their parents, unclosed comments and scripts with the page.  Repeated rows give
repeated results; an empty table has an empty result.  Pages of any length are
read whole.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
SPACE = {"br"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
NEVER = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "noscript", "template", "svg", "canvas", "object", "dialog", "menu", "math", "audio", "video"}
ARTICLE = {"article", "main"}
# Words of class and id that name what the contract leaves out: adverts, notices, reader comments;
HINTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "comment", "comments", "commentlist", "disqus", "replies"}
# and, unless the element calls itself content, menus, headers, footers, side bars, notices.
WEAK = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "notice", "notification", "alert", "disclaimer"}
CONTENT = {"article", "content", "main", "post", "entry", "story", "body", "text"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*+>|<[!?][^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Bounds of a score.
MOST, LEAST = 4.0, 0.01
SPLIT = re.compile(r"[^a-z0-9]+")


def unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds no main text; ``inside``: within an article."""
    if name in NEVER or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    hints: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            hints.update(SPLIT.split(value))
        elif key == "role" and value in ROLES or key == "hidden" and name not in ARTICLE:
            return True
        elif key == "style" and ("display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")):
            return True
    if name in ARTICLE:
        return bool(hints & {"comment", "comments", "reply"})
    return bool(hints & HINTS) or bool(hints & WEAK) and not hints & CONTENT


class Page:
    """Blocks of a page with what the score needs: text, plain and linked words, whether within an article, kinds of the tags before."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, int, bool, list[tuple[str, bool]]]] = []
        self.has_article = False
        self._text: list[tuple[str, bool]] = []
        self._tags: list[tuple[str, bool]] = []
        self._read(html)

    def _close(self, inside: bool) -> None:
        text = " ".join("".join(t for t, _ in self._text).split())
        if text:
            linked = sum(len(t.split()) for t, link in self._text if link)
            words = len(text.split())
            self.blocks.append((text, max(0, words - linked), min(words, linked), inside, self._tags))
            self._tags = []
        self._text = []

    def _read(self, html: str) -> None:
        at, stack, dead = 0, [], 0
        opened: dict[str, int] = {}
        inside = links = 0
        n = len(html)
        while at < n:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text and not dead:
                self._text.append((unescape(text), links > 0))
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if not opened.get(name):
                    if not dead and name == "p":
                        self._close(inside > 0)
                    continue
                while stack:
                    top, was_dead = stack.pop()
                    opened[top] -= 1
                    if top not in INLINE and not dead:
                        self._close(inside > 0)
                    dead -= was_dead
                    inside -= top in ARTICLE and not dead
                    links -= top == "a"
                    if not dead:
                        self._tags.append(("/" + top, inside > 0 or top in ARTICLE))
                    if top == name:
                        break
                continue
            if name in SPACE:
                self._text.append((" ", links > 0))
            if not dead and name not in INLINE and name not in SPACE:
                self._close(inside > 0)
            bad = unwanted(name, m[3], inside > 0)
            if not dead:
                self._tags.append(("-" if bad else name, inside > 0))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path", "img"):
                continue
            if name in RAW:  # ends at its own end tag only
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            stack.append((name, bad))
            opened[name] = opened.get(name, 0) + 1
            if not dead and not bad and name in ARTICLE:
                inside += 1
                self.has_article = True
            dead += bad
            links += name == "a"
        self._close(inside > 0)


Weights = dict[tuple, float]


def place(page: Page, inside: bool) -> str:
    return "in" if inside else "beside" if page.has_article else "free"


def counts(pages: list[tuple[str, list[str]]]) -> dict[tuple, list[int]]:
    """Of each kind of word and tag, how often it lies within the main text of labelled pages, and outside."""
    out: dict[tuple, list[int]] = {}
    for html, gold in pages:
        page, own = Page(html), set(gold)
        hits = [k for k, b in enumerate(page.blocks) if b[0] in own]
        first, last = (hits[0], hits[-1]) if hits else (0, -1)
        for k, (_, words, linked, inside, tags) in enumerate(page.blocks):
            at = place(page, inside)
            for kind, n in ((("word", at), words), (("link", at), linked)):
                out.setdefault(kind, [0, 0])[not first <= k <= last] += n
            for name, within in tags:
                if within and not first < k <= last:
                    continue  # an article's tags at its edges tell nothing
                for kind in (("tag", name, place(page, within)), ("tag", "", place(page, within))):
                    out.setdefault(kind, [0, 0])[not first < k <= last] += 1
    return out


def weights_of(found: dict[tuple, list[int]], scale: float) -> Weights:
    """Scores by logarithmic odds, from MOST down to -MOST for words; for tags from just below zero down, times ``scale``."""
    out = {}
    for kind, (inside, outside) in found.items():
        odds = log((inside + 0.5) / (outside + 0.5))
        out[kind] = scale * min(-LEAST, max(-2 * MOST, odds - MOST / 2)) if kind[0] == "tag" else min(MOST, max(-MOST, odds))
    return out


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """First and last (exclusive) block of the largest sum; (0, 0) if no block scores."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, (_, words, linked, inside, tags) in enumerate(page.blocks):
        at = place(page, inside)
        if total > 0:
            for name, within in tags:
                there = place(page, within)
                total += weights.get(("tag", name, there), weights.get(("tag", "", there), -1.0))
        if total <= 0:
            total, start = 0.0, k
        total += words * weights.get(("word", at), 1.0) + linked * weights.get(("link", at), -1.0)
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract(html: str | None, weights: Weights) -> str:
    page = Page(html or "")
    first, last = region(page, weights)
    return "\n".join(b[0] for b in page.blocks[first:last])


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with the blocks of their main text, built by rule: articles of headings, paragraphs, lists, quotes and
    tables in semantic elements or plain ones, among menus, taglines, teasers and links that no list of names knows."""
    import random

    rng = random.Random(seed)
    syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    link = lambda n: f"<a href='/{word()}'>{prose(n)}</a>"

    def menu() -> str:
        links = [link(rng.randint(1, 3)) for _ in range(rng.randint(3, 14))]
        kind = rng.randrange(4)
        if kind == 0:
            return "<nav><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></nav>"
        if kind == 1:
            return "<div><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></div>"
        if kind == 2:
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in links) + "</tr></table>"
        return f"<div class='{word()}'>" + " | ".join(links) + "</div>"

    def noise() -> str:
        kind = rng.randrange(7)
        if kind == 6:  # a line of words alone
            return f"<div>&copy; {prose(rng.randint(3, 25))}</div>"
        if kind == 0:  # a tagline
            return f"<div class='{word()}'><span>{prose(rng.randint(2, 9))}</span></div>"
        if kind == 1:  # teasers
            return "".join(f"<div class='{word()}'><h3>{link(rng.randint(2, 5))}</h3><div>{prose(rng.randint(3, 10))}</div>{link(2)}</div>" for _ in range(rng.randint(2, 6)))
        if kind == 2:  # shares
            return f"<div class='{word()}'><span>{prose(2)}</span>" + "".join(f"<span>{link(1)}</span>" for _ in range(4)) + "</div>"
        if kind == 3:
            return f"<div class='ad'>{prose(rng.randint(5, 60))}</div>"
        if kind == 4:
            return f"<div><p>{prose(2)} {link(2)} {link(2)} {prose(rng.randint(1, 6))}</p></div>"
        return menu()

    def block(out: list[str], inner: bool) -> str:
        kind = rng.choice("ppppppphlbtdx" if inner else "pppppppphl")
        size = rng.choice((1, 4, 12, 30, 60, 120))
        if kind == "h":
            out.append(prose(rng.randint(1, 8)))
            return f"<h{rng.randint(2, 4)}>{out[-1]}</h2>"
        if kind == "l":
            own = [prose(rng.randint(1, 15)) for _ in range(rng.randint(2, 6))]
            out += own
            return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
        if kind == "t":
            own = [prose(rng.randint(1, 4)) for _ in range(4)]
            out += own
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in own) + "</tr></table>"
        if kind == "x":
            return rng.choice((f"<div class='ad'>{prose(9)}</div>", f"<form><input>{prose(3)}</form>", f"<script>{prose(3)}</script>", f"<aside>{prose(12)}</aside>"))
        a, b, c = prose(size), prose(rng.randint(1, 3)), prose(size)
        tag = {"b": "blockquote", "d": "div"}.get(kind, "p")
        if rng.random() < 0.3:
            out.append(f"{a} {b} {c}")
            return f"<{tag}>{a} <{rng.choice(('b', 'i', 'a'))}>{b}</b> {c}</{tag}>".replace("<i>" + b + "</b>", f"<i>{b}</i>").replace("<a>" + b + "</b>", f"<a href=x>{b}</a>")
        out.append(a)
        return f"<{tag}>{a}</{tag}>"

    pages = []
    for k in range(n):
        title = prose(rng.randint(1, 8))
        gold, tag = [title], ("article", "main", "div", "section", "td")[k % 5]
        body = "".join(block(gold, tag in ARTICLE) for _ in range(rng.randint(2, 9)))
        if tag not in ARTICLE:  # without the element, an article shows by its length
            gold.append(prose(rng.randint(60, 150)))
            body += f"<p>{gold[-1]}</p>"
        lead = ""
        if rng.random() < 0.4:  # a line above the heading
            gold.insert(0, prose(rng.randint(1, 6)))
            lead = f"<p>{gold[0]}</p>"
        own = f"<{tag}>{lead}<h1>{title}</h1>{body}</{tag}>"
        own = f"<table><tr>{own}</tr></table>" if tag == "td" else own
        before, after = "".join(noise() for _ in range(rng.randint(0, 3))), "".join(noise() for _ in range(rng.randint(0, 3)))
        foot = f"<footer>{prose(8)}</footer>" if k % 3 else ""
        pages.append((f"<html><head><title>{title}</title></head><body>{menu()}{before}{own}{after}{foot}</body></html>", gold))
    return pages


def f_score(pages: list[tuple[Page, set[str]]], weights: Weights) -> float:
    """Mean F1 of words."""
    total = 0.0
    size = lambda texts: sum(len(t.split()) for t in texts)
    for page, gold in pages:
        first, last = region(page, weights)
        own = [b[0] for b in page.blocks[first:last]]
        total += 2 * size(t for t in own if t in gold) / max(1, size(own) + size(gold))
    return total / len(pages)


def trained() -> Weights:
    """Scores from the labelled pages, tags scaled for the best mean F1."""
    labelled = labelled_pages()
    found, pages = counts(labelled), [(Page(html), set(gold)) for html, gold in labelled]
    return max((weights_of(found, scale) for scale in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)), key=lambda w: f_score(pages, w))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    weights = trained()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(apply, f"page_id {kind}, url string, text string, n_chars long")
