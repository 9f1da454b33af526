"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element of a page is a row of features: what its own and its ancestors' attribute tokens, hashed, say of the article;
depth, siblings and those of its own kind; the text, links and elements of its subtree; and where it stands to the element
with most text in paragraphs of its own. Boosted trees give each the log-odds that it belongs to the article. A node can
only be kept if its parent is, so the best choice for a whole page is found bottom-up: a subtree is kept if its node's
log-odds and those of the subtrees kept below sum up to more than nothing.

Tokens and trees are learned from a bounded sample of pages. What lies in an <article> or <main> element is labelled
article, the elements around it too, the rest not. Each page is also taken with blocks of other kinds around and in the
article, made of its own words, and its words are set into a page of another make; there, names of classes are those that
the page itself has in its article or around it, or invented. What a token says is its share of article elements in the other half of the sample,
so that trees learn how far to trust it.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import saved

#: Bounds of the fit: pages in the sample, bytes of a page and elements of a page that are learned from.
SAMPLE_PAGES, SAMPLE_BYTES, SAMPLE_NODES = 150, 200_000, 400
TREES, DEPTH, RATE, BINS = 60, 5, 0.25, 24
#: Buckets of tokens, and how many elements of no account are added to those of each.
TOKENS, PRIOR = 1 << 12, 4.0
#: Log-odds from which the likeliest text of a page is kept if nothing else is.
UNLIKELY = -2.0
#: Pages whose nodes are scored at a time, at most, and bytes of html.
PAGES, PAGE_BYTES = 256, 2 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose start ends an open element of the same row.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such a search does not leave.
SCOPES = frozenset("html body div section article main aside nav header footer form ul ol dl table td th blockquote".split())
CLOSES_P = BLOCKS - {"br", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}
KINDS = ("h1 h2 h3 h4 h5 h6", "p pre blockquote", "div section main article", "ul ol li dl dt dd", "a", "b i em strong span u small sub sup code mark abbr time", "html body", "table tbody tr td th")
KIND = {t: k for k, names in enumerate(KINDS) for t in names.split()}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
OPEN = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ENDED = re.compile(r"(?:^|[\s\"'])/\s*\Z")  # a slash that is no part of an unquoted value
LABEL = re.compile(r"x-label=([01])")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Elements in page order: tag, parent (-1: none), buckets of tokens, label (-1: none); texts as (element, text)."""

    tag: list[str]
    parent: list[int]
    tokens: list[tuple[int, ...]]
    label: list[int]
    parts: list[tuple[int, str]]


@lru_cache(1 << 16)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKENS


def parse(source: str) -> Page:
    """The elements and texts of a page; any input gives a tree. A block's start and end appear as texts of None."""
    page = Page(["html"], [-1], [()], [-1], [])
    stack, at, lowered = [0], 0, None
    close = source.rfind(">")
    while at < len(source):
        if at > close:  # what is left can't be markup; a tag that isn't closed is dropped
            rest = OPEN.split(source[at:], maxsplit=1)[0]
            page.parts.append((stack[-1], html.unescape(rest)))
            break
        m = TOKEN.match(source, at)
        at, name = m.end(), m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                page.parts.append((stack[-1], html.unescape(piece) if "&" in piece else piece))
            elif piece.startswith("<![CDATA["):
                page.parts.append((stack[-1], piece[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == name:
                    del stack[k:]
                    break
                if name not in BLOCKS and page.tag[stack[k]] in SCOPES:
                    break
            if name in BLOCKS:
                page.parts.append((stack[-1], None))
            continue
        if name == "html":
            continue
        ends = ENDS.get(name) or ({"p"} if name in CLOSES_P else None)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] in ends:
                    del stack[k:]
                    if name != "tr":
                        break
                elif page.tag[stack[k]] in SCOPES and page.tag[stack[k]] not in ends:
                    break
        words = {f"<{name}>"}
        if attributes := m[3]:
            for a in ATTRIBUTE.finditer(attributes):
                words.update(x.lower() for x in PART.findall(a[1] or a[2] or a[3] or ""))
        label = LABEL.search(attributes) if attributes else None
        page.tag.append(name)
        page.parent.append(stack[-1])
        page.tokens.append(tuple(map(bucket, words)))
        page.label.append(int(label[1]) if label else -1)
        node = len(page.tag) - 1
        if name in BLOCKS:
            page.parts.append((node, None))
        if name in RAW:
            lowered = lowered or source.lower()
            end = lowered.find(f"</{name}", m.end())
            at = len(source) if end < 0 else end
            # the end tag is a token of its own, and has the element on the stack
            stack.append(node)
        elif name not in VOID and not (attributes and ENDED.search(attributes)):
            stack.append(node)
    return page


def features(page: Page, said: np.ndarray) -> np.ndarray:
    """A row for each element. said: what each bucket of tokens says of the article, 0 for nothing."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops = np.zeros(n), np.zeros(n)
    for node, text in page.parts:
        if text and (size := len(text.strip())):
            own[node] += size
            stops[node] += text.count(".") + text.count(",")
    low, high = np.zeros(n), np.zeros(n)
    for i, tokens in enumerate(page.tokens):
        if tokens:
            values = said[list(tokens)]
            low[i], high[i] = values.min(), values.max()
    linked, prose = [False] * n, [0.0] * n
    depth, under, near, sibling, same, children = [0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
    kinds: dict[tuple, int] = {}
    alike = []
    for i in range(n):
        p, own_kind = page.parent[i], (page.parent[i], page.tag[i], page.tokens[i])
        kinds[own_kind] = kinds.get(own_kind, 0) + 1
        alike.append(own_kind)
        if p >= 0:
            depth[i], linked[i] = depth[p] + 1, linked[p] or page.tag[i] == "a"
            sibling[i] = children[p]
            children[p] += 1
            # what the worst element above says, and what the next one above that says much
            under[i] = min(under[p], low[p])
            near[i] = low[p] if low[p] < -1 else high[p] if high[p] > 1 else near[p]
    total, link, stop, size = own.tolist(), (own * np.array(linked)).tolist(), stops.tolist(), [1] * n
    title, ahead = [int(t == "h1") for t in page.tag], np.concatenate([[0.0], np.cumsum(own)[:-1]])
    fields = [int(t in ("input", "button", "select", "textarea", "label", "option")) for t in page.tag]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        total[p] += total[i]
        link[p] += link[i]
        stop[p] += stop[i]
        size[p] += size[i]
        fields[p] += fields[i]
        title[p] += title[i]
        if page.tag[i] in ("p", "pre", "blockquote"):
            prose[p] += (total[i] - link[i]) * (1.0 if under[i] > -1 and low[p] > -1 else 0.2)
    # places to the element with most prose of its own: above it, in it, before or after
    heart = int(np.argmax(prose)) if n > 1 else 0
    place = np.where(np.arange(n) < heart, 0, 3)
    k = heart
    while k >= 0:
        place[k] = 1
        k = page.parent[k]
    for i in range(heart + 1, n):
        if page.parent[i] == heart or place[page.parent[i]] == 2:
            place[i] = 2
    # places to the first element that calls itself the article
    first = next((i for i in range(1, n) if page.tag[i] == "main"), 0) or next((i for i in range(1, n) if page.tag[i] == "article"), 0)
    called = [int(first > 0 and i > first) for i in range(n)]  # 0: before it or none, 1: after it, 2: in it, 3: above it
    for i in range(first, n) if first else ():
        if i == first or called[page.parent[i]] == 2:
            called[i] = 2
    k = page.parent[first] if first else -1
    while k >= 0:
        called[k] = 3
        k = page.parent[k]
    called = np.array(called)
    total, link, stop, size, fields, prose = map(np.array, (total, link, stop, size, fields, prose))
    around, title = np.array(children)[np.maximum(parent, 0)], np.minimum(title, 2)
    same = np.array([kinds[x] for x in alike])
    kind = np.array([KIND.get(t, len(KINDS)) for t in page.tag])
    return np.column_stack([
        low, high, under, near, depth, np.log1p(total), np.log1p(own), np.log1p(size), np.log1p(total / size),
        link / np.maximum(total, 1), np.array(sibling) / np.maximum(around, 1), np.log1p(around), np.log1p(same), stop / np.maximum(total, 1), total / max(total[0], 1),
        total / np.maximum(total[np.maximum(parent, 0)], 1), np.minimum(fields, 4), np.log1p(prose), prose / max(prose[heart], 1),
        title, title[np.maximum(parent, 0)], ahead / max(total[0], 1), place == 0, place == 1, place == 2, place == 3, np.full(n, first > 0), called == 1, called == 2, called == 3, *(kind == k for k in range(len(KINDS) + 1)),
    ]).astype(np.float32)


def main_text(page: Page, odds: np.ndarray) -> str:
    """The text of the elements that the best consistent choice keeps, blocks joined by one blank."""
    gain = odds.tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    kept = [False] * len(gain)
    for i, p in enumerate(page.parent):
        kept[i] = gain[i] > 0 and (p < 0 or kept[p])
    if not any(kept[node] and text and text.strip() for node, text in page.parts):
        # nothing is likely: the likeliest element with text, if it isn't unlikely, and what holds it
        best = max((node for node, text in page.parts if text and text.strip()), key=lambda i: odds[i], default=-1)
        if best >= 0 and (odds[best] > UNLIKELY or len(gain) == 1):
            kept = [gain[i] > 0 and (p < 0 or kept[p]) for i, p in enumerate(page.parent)]
            while best >= 0:
                kept[best], best = True, page.parent[best]
    return " ".join("".join(" " if text is None else text for node, text in page.parts if text is None or kept[node]).split())


def labels(page: Page) -> np.ndarray | None:
    """Whether each element is of the article or holds it; None if the page has no mark of one."""
    own, holds = [-1] * len(page.tag), [False] * len(page.tag)
    for i, p in enumerate(page.parent):
        mine = page.label[i] if page.label[i] >= 0 else (1 if page.tag[i] in ("article", "main") and p >= 0 else -1)
        own[i] = mine if p < 0 or own[p] < 0 or mine == 0 else own[p]
    if 1 not in own:
        return None
    for i in range(len(own) - 1, -1, -1):
        holds[i] = holds[i] or own[i] == 1
        if holds[i] and page.parent[i] >= 0:
            holds[page.parent[i]] = True
    return np.array([x == 1 or (x < 0 and h) for x, h in zip(own, holds, strict=True)])


#: Forms of blocks of other kinds in training pages. {n}: attributes; a, b, c: words, more and more.
BLOCK_FORMS = (
    "<header{n}><h2>{a}</h2><p>{b}</p></header>",
    "<div{n}><a href='/'>{a}</a><p>{b}</p></div>",
    "<nav{n}><a href='/'>{a}</a> <a href='/b'>{b}</a></nav>",
    "<div{n}><ul><li><a href='/'>{a}</a></li><li><a href='/b'>{a}</a></li><li><a href='/c'>{b}</a></li></ul></div>",
    "<aside{n}><h3>{a}</h3><p>{c}</p><ul><li>{a}</li><li>{b}</li></ul></aside>",
    "<div{n}><div><p>{c}</p></div></div>",
    "<div{n}><h4>{a}</h4><ul><li><a href='/'>{b}</a></li><li><a href='/d'>{b}</a></li></ul></div>",
    "<div{n}><p>{c}</p><button>{a}</button></div>",
    "<p{n}>{b}</p>",
    "<div{n}>{c}</div>",
    "<div{n}><p>{b}</p></div>",
    "<form{n}><label>{a}</label><input name='q'><p>{b}</p></form>",
    "<div{n}><p>{c}</p><form><input><button>{a}</button></form></div>",
    "<section{n}><h2>{a}</h2><div><p>{c}</p><p>{c}</p></div><article><p>{c}</p></article></section>",
    "<section{n}><h3>{a}</h3><ol><li><p>{c}</p></li><li><p>{c}</p></li></ol></section>",
    "<div{n}><article><b>{a}</b><p>{c}</p></article><article><b>{a}</b><p>{c}</p></article></div>",
    "<div{n}><p>{c}</p></div>",
    "<div{n}><p>{c}</p><p>{c}</p></div>",
    "<div{n}><a href='#'>{a}</a><a href='#'>{a}</a></div>",
    "<div{n}><a href='#'>{a}</a></div>",
    "<p{n}><a href='#'>{a}</a></p>",
    "<div{n}><span><a href='#'>{a}</a></span></div>",
    "<footer{n}><p>{b}</p><a href='/i'>{a}</a></footer>",
    "<noscript{n}>{b}</noscript>",
)
BEFORE = tuple(x for x in BLOCK_FORMS if "<article>" not in x)
#: Elements that hold the article of training pages; "": none, it lies in the body.
HOLDERS = ("article", "article", "main", "div", "div", "section", "td", "td", "")
NAME = re.compile(r"\b(?:class|id)\s*=\s*[\"']([^\"'<>]+)[\"']", re.I)


@dataclass
class Words:
    """What training pages are made of: a page's words, and the names that it gives to elements in its article and to others."""

    words: list[str]
    inside: list[str]
    outside: list[str]

    def some(self, rng: random.Random, least: int, most: int) -> str:
        at = rng.randrange(len(self.words))
        return html.escape(" ".join(self.words[at : at + rng.randint(least, most)]))


def words_of(source: str, rng: random.Random) -> Words:
    found = re.search(r"<(article|main)\b[^>]*>(.*)</\1\s*>", source, re.S | re.I)
    inner = found[0] if found else ""
    names = lambda part: sorted({n for x in NAME.findall(part) for n in x.split()})
    words = re.sub(r"<[^>]*>", " ", source).split() or ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    return Words(words, names(inner), names(source.replace(inner, " ") if inner else source))


def named(usual: list[str], rng: random.Random) -> str:
    """Attributes: a name that the page has for such elements, an invented one, or none."""
    chance = rng.random()
    if chance < 0.25:
        return ""
    invented = "".join(rng.choices("bcdfghklmnprst", k=2)) + "".join(rng.choices("aeioubdfgklmnrst", k=rng.randint(2, 7)))
    return f' {rng.choice(("class", "class", "id"))}="{rng.choice(usual) if usual and chance < 0.5 else invented}"'


def block(made: Words, rng: random.Random, after: bool = True) -> str:
    """A block that isn't of the article; readers' articles come after it only."""
    return rng.choice(BLOCK_FORMS if after else BEFORE).format(n=named(made.outside, rng) + " x-label=0", a=made.some(rng, 1, 4), b=made.some(rng, 1, 15), c=made.some(rng, 5, 80))


def several(made: Words, rng: random.Random, most: int, after: bool = True) -> str:
    return "".join(block(made, rng, after) for _ in range(rng.randint(0, most)))


def varied(source: str, rng: random.Random) -> str:
    """The page with more blocks, names of classes in the article, and perhaps another element in place of <article>."""
    made, found = words_of(source, rng), re.search(r"<(article|main)\b[^>]*>(.*)</\1\s*>", source, re.S | re.I)
    if not found:
        return source
    inner = found[2]
    if rng.random() < 0.35:  # a short article: its title and a few paragraphs
        spots = [m.end() for m in re.finditer(r"</p>", inner)][: rng.choice((1, 1, 2, 3))]
        inner = inner[: spots[-1]] if spots else inner
    if rng.random() < 0.5:
        inner = re.sub(r"<(p|h1|h2|h3|ul|li)>", lambda m: f"<{m[1]}{named(made.inside, rng)}>" if rng.random() < 0.3 else m[0], inner)
    if rng.random() < 0.3:
        inner = re.sub(r"(<h1\b.*?</h1>)", lambda m: f"<header{named(made.inside, rng) if rng.random() < 0.5 else ''}>{m[0]}</header>", inner, count=1, flags=re.S)
    spots = [m.start() for m in re.finditer(r"<p>", inner)]
    if spots and rng.random() < 0.4:
        k = rng.choice(spots)
        inner = inner[:k] + block(made, rng, False) + inner[k:]
    if rng.random() < 0.15:  # paragraphs that aren't marked as such
        inner = inner.replace("<p>", "<div>").replace("</p>", "</div>")
    name = "article" if rng.random() < 0.4 else rng.choice([x for x in HOLDERS if x])
    own = "" if name in ("article", "main") and rng.random() < 0.6 else named(made.inside, rng)
    body = f"<{name}{own} x-label=1>{inner}{several(made, rng, 2)}</{name}>"
    return source[: found.start()] + several(made, rng, 3, False) + body + several(made, rng, 3) + source[found.end() :]


def part_of_article(tag: str, made: Words, rng: random.Random, mark: str) -> str:
    """A part of an article: a heading, a paragraph, or one of the makes of lists, tables and figures."""
    text = made.some(rng, 2, 10) if tag[0] == "h" else made.some(rng, 4, 90)
    own = (named(made.inside, rng) if rng.random() < 0.3 else "") + mark
    if tag == "links":
        return f"<ul{own}>" + "".join(f"<li><a href='/{k}'>{made.some(rng, 1, 5)}</a></li>" for k in range(rng.randint(2, 5))) + "</ul>"
    if tag == "figure":
        return f"<figure{own}><img src='x.png'><figcaption>{made.some(rng, 2, 20)}</figcaption></figure>"
    if tag == "table":
        head = f"<tr><th>{made.some(rng, 1, 3)}</th><th>{made.some(rng, 1, 3)}</th></tr>" if rng.random() < 0.6 else ""
        return f"<table{own}>{head}<tr><td>{made.some(rng, 1, 6)}</td><td>{text}</td></tr></table>"
    if rng.random() < 0.2:
        text = text.replace(" ", f" <a href='/x'>{made.some(rng, 1, 2)}</a> ", 1)
    text = {"ul": f"<li>{made.some(rng, 2, 20)}</li><li>{text}</li>", "blockquote": f"<p>{text}</p>", "lines": text.replace(" ", "<br><br>", 1)}.get(tag, text)
    return f"<{tag}{own}>{text}</{tag}>" if tag != "lines" else f"<div{own}>{text}</div>"


def composed(made: Words, rng: random.Random) -> str:
    """The words as a page of another make, with its article marked."""
    inner, name = [], rng.choice(HOLDERS)
    mark = "" if name else " x-label=1"
    prose = rng.choice(("p", "p", "p", "div", "lines"))
    for k in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8))):
        tag = ("div" if prose in ("div", "lines") and rng.random() < 0.3 else "h1") if k == 0 and rng.random() < 0.8 else rng.choice([prose] * 5 + ["h2", "h3", "ul", "blockquote", "table", "pre", "links", "links", "figure"])
        part = f"<div{mark}>{made.some(rng, 1, 8)}</div>" if k == 0 and tag == "div" else part_of_article(tag, made, rng, mark)
        inner.append(f"<header{mark}>{part}</header>" if k == 0 and rng.random() < 0.3 else f"<div{mark}>{part}</div>" if rng.random() < 0.1 else part)
        if rng.random() < 0.08:
            inner.append(block(made, rng, False))
    inner.append(part_of_article(prose, made, rng, mark))
    held = "".join(inner)
    body = f"<{name}{named(made.inside, rng)} x-label=1>{held}{several(made, rng, 2)}</{name}>" if name else held
    if name == "td":  # a table that lays the page out, with other columns
        cell = f"<td x-label=0>{several(made, rng, 1, False)}" + "<br>".join(f"<a href='/{k}'>{made.some(rng, 1, 3)}</a>" for k in range(rng.randint(1, 5))) + "</td>"
        body = f"<table><tr>{cell if rng.random() < 0.7 else ''}{body}{cell if rng.random() < 0.3 else ''}</tr></table>"
    plain = rng.random() < 0.15  # nothing else on the page
    around = (lambda most, after=True: "") if plain else (lambda most, after=True: several(made, rng, most, after))
    column = f"{around(2, False)}{body}{around(3)}"
    for _ in range(rng.randint(0, 2) if name else 0):
        column = f"<div{named(made.outside, rng)}>{column}</div>{around(1)}"
    head = "" if plain and rng.random() < 0.5 else f"<head><title>{made.some(rng, 2, 8)}</title></head>"
    return f"<html>{head}<body>{around(2, False)}{column}{around(2)}</body></html>"


def plain_page(made: Words, rng: random.Random) -> Page:
    """A page without any markup: all of it is the article."""
    page = parse("\n".join(made.some(rng, 5, 60) for _ in range(rng.randint(1, 6))))
    page.label[0] = 1
    return page


@dataclass
class Trees:
    """Boosted trees of one depth: features and thresholds of inner nodes (trees, 2^depth - 1), values of leaves; and
    what buckets of tokens say."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    said: np.ndarray | None = None

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees by Newton boosting of the logistic loss, splits among BINS quantiles of each feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(math.log(share / (1 - share)), np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH)))
    odds = np.full(len(y), model.base)
    for k in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for inner in range(2**DEPTH - 1):
            at = np.flatnonzero(node == inner)
            best, pick, cut = 1e-6, 0, np.inf
            if len(at) > 1:
                gt, ht = g[at].sum(), h[at].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], g[at], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, j], h[at], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    if gain.max() > best:
                        best, pick, cut = gain.max(), j, e[gain.argmax()]
            model.feature[k, inner], model.threshold[k, inner] = pick, cut
            node[at] = 2 * inner + 1 + (x[at, pick] > cut)
        leaf = node - (2**DEPTH - 1)
        model.leaf[k] = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        odds += model.leaf[k][leaf]
    return model


def lessons(number: int, source: str) -> list[Page]:
    """What a page of the sample teaches: itself, varied and composed anew, each with an article marked."""
    rng = random.Random(number)
    made = words_of(source, rng)
    pages = [source, *(varied(source, rng) for _ in range(3)), *(composed(made, rng) for _ in range(5))]
    return [p for p in [*map(parse, pages), *([plain_page(made, rng)] if number % 4 == 0 else [])] if labels(p) is not None]


def token_counts(page: Page, y: np.ndarray) -> np.ndarray:
    """(2, TOKENS): of elements with tokens in each bucket, those that aren't of the article and those that are."""
    out = np.zeros((2, TOKENS))
    for tokens, mine in zip(page.tokens, y, strict=True):
        for t in set(tokens):
            out[int(mine), t] += 1
    return out


def saying(counts: np.ndarray) -> np.ndarray:
    """The log-odds of the article given a token, against those of any element."""
    no, yes = counts
    share = (yes.sum() + 1) / (counts.sum() + 2)
    return np.log((yes + PRIOR * share) / (no + PRIOR * (1 - share))) - np.log(share / (1 - share))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Tokens and trees learned from SAMPLE_PAGES rows at most, those whose hashes of id and html are the least, of up to
    SAMPLE_BYTES. A page without <article> or <main> lends its words only; without any page, invented words do."""
    fits = pages.where(F.length(html_col) <= SAMPLE_BYTES).select(F.xxhash64(id_col, html_col).alias("number"), F.col(html_col).alias("html"))
    none = pages.sparkSession.createDataFrame([(k, "") for k in range(20)], "number bigint, html string")
    sample = fits.orderBy("number").limit(SAMPLE_PAGES)
    sample = saved(sample.unionByName(none).orderBy("number").limit(SAMPLE_PAGES).repartition(16, "number"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, TOKENS))
        for batch in batches:
            for k, source in zip(batch.column("number").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for page in lessons(k, source):
                    total[k % 2] += token_counts(page, labels(page))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])

    sums = sample.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(4 * TOKENS)
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(2, 2, TOKENS)
    halves, said = [saying(counts[1]), saying(counts[0])], saying(counts.sum(axis=0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for k, source in zip(batch.column("number").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for page in lessons(k, source):
                    x += features(page, halves[k % 2])[:SAMPLE_NODES].tolist()
                    y += labels(page)[:SAMPLE_NODES].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.bool_())], ["x", "y"])

    got = sample.mapInArrow(rows, "x array<float>, y boolean").toArrow()
    x = np.stack(got["x"].combine_chunks().to_numpy(zero_copy_only=False))
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([y, x]).T)  # rows arrive in any order
    model = boost(x[order], y[order])
    model.said = said
    return model


def extract(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) for each row of pages: the article's text from the whole html.

    Null, empty and textless html give an empty text, html without markup its whole text, malformed html what its parts
    give. Where no element is likely to be of an article, the likeliest with text is taken, if its log-odds are over
    UNLIKELY. Repeated rows get equal results; other columns are left out.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.maximum((np.cumsum(size) - size) // PAGE_BYTES, 0) * (1 << 32) + np.arange(len(size)) // PAGES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                parsed = [parse(x or "") for x in batch.column("html").to_pylist()]
                rows = [features(p, held.value.said) for p in parsed]
                odds = np.split(held.value.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                found = [main_text(p, o) for p, o in zip(parsed, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
