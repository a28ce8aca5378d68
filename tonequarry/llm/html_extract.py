"""Main text of web pages: the contiguous region of highest score.

A page is read as a row of words and tags. Weights, learned from labelled pages (``LABELLED``, the bounded
sample that they are fitted on), say how much a word in its surroundings or a tag speaks for content:
words of content score above zero, tags below. One linear scan finds the contiguous region with the
largest sum. Within it, elements that hold no content are left out: those whose tag says so
(scripts, navigation, forms and the like) and those whose names (class, id, role) speak against it by
weights from the same labelled pages, name by name, once within the article and once outside; a
name that was never seen says nothing. What holds the page's main element (its largest article or
main, else its first heading, else most of its words) is never left out. What is left is joined by
block: white space inside a block becomes one space, blocks are parted by an empty line.

Null and empty pages, and pages with no region above zero, give ''. Unclosed and crossing tags are
taken as they come; work is linear in the page, however long or badly nested. Ties: the first of equal
regions. Repeated rows are rows, null ids too. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import by_batch, table

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold no text of the page, read to their end tag as they stand.
RAW = set("script style noscript template textarea title iframe svg select option object canvas noframes noembed xmp".split())
_TO_THE_END = set("script style textarea title xmp".split())
#: Elements that hold no article.
ASIDE = set("nav aside footer form button menu dialog head label fieldset".split())
#: Those of them, and the page's head, that no heading or number of words makes the main element.
_NEVER = ("nav", "aside", "footer", "header", "button", "menu", "head", "label")
_ENDS_ITSELF = set("p li dt dd tr td th option".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|</?[a-zA-Z][^>]*\Z", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

_PLAIN = "<p>Many words stand here in a long paragraph of the text, which goes on for a while.</p><p>Then <b>some</b> more words follow, with <a>a link</a> in them, until the end.</p>"
_LINKS = "<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>"


def _asides(*names: str) -> list[tuple[str, bool]]:
    return [(f'<div class="{n}"><a>read</a> <a>on</a> now</div>', False) for n in names]


#: (part, content?) of hand-labelled pages; the parts of a page stand in order. Names that stand in parts of both kinds teach little.
LABELLED = [
    [
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><header><a>Home</a><h2>Site</h2></header><nav>{_LINKS}</nav>", False),
        (f"<article><h1>A heading of words</h1>{_PLAIN}</article>", True),
        (f"<aside><h3>More</h3>{_LINKS}</aside><footer><p>All rights reserved by us</p></footer></body></html>", False),
    ],
    [
        ('<html><body><div class="cookie-notice"><p>We use cookies</p><button>OK</button></div><div id="menu"><a>a</a> <a>b</a> <a>c</a></div><div class="ad">Buy this thing now</div>', False),
        ('<div class="content"><h1>Title words</h1><p>A text of words without an article tag, yet long enough to be one, runs here.</p><ul><li>first item of some words</li><li>second item of some words</li></ul><blockquote>Words that are quoted here in full.</blockquote></div>', True),
        ('<div id="comments"><h3>Comments</h3><p>Nice one</p><form><input><textarea></textarea></form></div><div class="footer">Imprint and contact</div></body></html>', False),
    ],
    [
        ('<html><body><table><tr><td><a>x</a></td><td><a>y</a></td></tr></table><form><input type="text"><label>Search</label></form>', False),
        ("<main><h1>News of the day</h1><p>Short text.<br>Another line of it with words.</p><h2>Part two</h2><p>And a last long paragraph with a number of words in it to end the page.</p></main>", True),
        ('<div class="sidebar"><ul><li><a>r</a></li><li><a>s</a></li></ul></div><script>var x = "<p>";</script></body></html>', False),
    ],
    [
        ('<html><body class="layout has-sidebar"><div class="header site-header"><a>Site</a> <a>Search</a></div><div class="navigation navbar nav"><a>Home</a> <a>News</a></div><div class="breadcrumb breadcrumbs"><a>Home</a> <a>Text</a></div>', False),
        (f'<article class="post entry tag-news"><div class="header entry-header"><h1>Heading of words</h1></div><div class="entry-content side-by-side"><div class="side">{_PLAIN}</div></div>', True),
        *_asides("share", "social-share", "share-buttons", "newsletter", "newsletter-signup", "subscribe", "related", "related-posts", "recommended", "advert", "ad-banner", "ads", "advertisement", "sponsored", "promo"),
        (f'<p class="more lead">{_PLAIN}</p></article>', True),
        *_asides("sidebar", "sidebar-left", "widget", "widget-area", "pagination", "pager", "cookie-banner", "consent", "popup", "modal", "overlay", "alert", "notice", "legal", "copyright"),
        ('<div class="footer site-footer">Imprint</div></body></html>', False),
    ],
    [
        ('<html><body><div class="masthead topbar toolbar"><a>Site</a></div><div class="menu main-menu"><a>One</a> <a>Two</a></div><div role="banner"><a>Site</a></div><div role="navigation"><a>Home</a></div><div role="search"><a>Find</a></div>', False),
        (f'<div class="page social-article"><div class="article-body text more"><h2 class="title">Words of a heading</h2>{_PLAIN}</div>', True),
        *_asides("comments", "comment-list", "commentlist", "comment", "comment-body", "reader-comments", "responses", "replies", "respond", "reply", "disqus", "ad", "advert", "banner", "sponsor", "teaser-ad", "promo-box", "newsletter-box", "share-bar", "sharing", "social-bar", "related-links", "recommendations"),
        ("</div>", True),
        *_asides("ad", "sidebar-right", "cookies", "cookie-consent", "gdpr", "alert-box", "notice-bar", "signup", "login", "disclaimer", "legal-notice", "site-footer", "footer-links", "contentinfo", "complementary"),
        ("</body></html>", False),
    ],
    [
        (f'<html><body><div id="top" class="site-nav menu"><a>Home</a></div><div class="side sidebar">{_LINKS}</div>', False),
        (f'<div id="story" class="story tags-travel"><h1>A heading</h1><div class="notice-of-the-day more social side">{_PLAIN}</div><p class="tags label">Words of the story, which are long and go on.</p></div>', True),
        ('<div class="tags"><a>one</a></div><div class="more"><a>older</a></div><div class="social"><a>follow</a></div><div class="comments comment"><p>First of all</p></div></body></html>', False),
    ],
    [
        ("<html><body><div><a>Site</a></div>", False),
        (f'<div class="wrap column"><div><div><h1>Words</h1></div><div><div>A line in a division.</div><div>Another one.</div></div><div>{_PLAIN}</div><div><div><p>Last words.</p></div></div></div></div>', True),
        ("<div><a>Imprint</a></div></body></html>", False),
    ],
]


def names_of(attrs: str) -> list[str]:
    """The words in an element's class, id and role, in lower case: 'main-nav' has two."""
    return sorted({w.lower() for a, b, c in _NAMED.findall(attrs) for w in _PARTS.findall(a or b or c)})


class Page:
    """Tokens (kind, name, text, element) in page order, and the tree of elements; kind is word, open or close."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, str, int]] = []
        self.tag, self.parent, self.names, self.hidden, self.words = ["page"], [0], [()], [False], [0]
        self._read(page)
        n = len(self.tag)
        self.total = list(self.words)
        for e in range(n - 1, 0, -1):  # an element comes after the one around it
            self.total[self.parent[e]] += self.total[e]

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        stack, open_ = [0], Counter()
        endless: set[str] = set()
        put = self.tokens.append
        while at < n:
            m = _TOKEN.search(page, at)
            text = page[at : m.start() if m else n]
            if text:
                put(("word", "", text, stack[-1]))
                self.words[stack[-1]] += len(text.split())
            if not m:
                return
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                put(("close", name, "", stack[-1]))
                if open_[name]:  # a tag that nothing opened closes nothing
                    while True:
                        gone = self.tag[stack.pop()]
                        open_[gone] -= 1
                        if gone == name:
                            break
                continue
            if name in RAW:
                end = None if name in endless else _RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in _TO_THE_END:
                    at = n
                else:
                    endless.add(name)
                    continue
                put(("open", name, "", -1))
                continue
            if name in VOID:
                put(("open", name, "", stack[-1]))
                continue
            if name in _ENDS_ITSELF and self.tag[stack[-1]] == name:
                open_[self.tag[stack.pop()]] -= 1  # one of these ends where the next begins
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.names.append(tuple(names_of(m[3])) if m[3] else ())
            self.hidden.append(bool(m[3]) and bool(_HIDDEN.search(m[3])))
            self.words.append(0)
            stack.append(len(self.tag) - 1)
            open_[name] += 1
            put(("open", name, "", stack[-1]))

    def within(self, tags: tuple[str, ...]) -> list[bool]:
        """For each element whether one around it has one of ``tags``."""
        out = [False] * len(self.tag)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or self.tag[self.parent[e]] in tags
        return out

    def asides(self, against: dict[str, float]) -> list[bool]:
        """For each element whether it is left out, and whether it is within the main article; ``against`` has the weights of names."""
        n = len(self.tag)
        inside = self.within(("article", "main"))
        speaks = [bool(names) and self.tag[e] not in ("body", "html") and sum(against.get(_name(w, inside[e]), 0.0) for w in names) <= AGAINST for e, names in enumerate(self.names)]
        under = [False] * n  # within an element that is spoken against
        for e in range(1, n):
            under[e] = under[self.parent[e]] or speaks[self.parent[e]]
        main = [e for e in range(n) if self.tag[e] in ("article", "main") and not speaks[e]]
        main = [e for e in main if not under[e]] or main
        if main:
            keep = max(main, key=lambda e: (self.total[e], -e))
        else:
            never = self.within(_NEVER)
            keep = next((e for e in range(n) if self.tag[e] == "h1" and not never[e]), None) or max(e for e in range(n) if 2 * self.total[e] >= self.total[0] and not never[e] and self.tag[e] not in _NEVER)
        held, within = [False] * n, [False] * n
        within[keep] = bool(main)
        while keep:
            held[keep] = True
            keep = self.parent[keep]
        out = [False] * n
        for e in range(1, n):
            tag = self.tag[e]
            own = speaks[e] or self.hidden[e] or tag in ASIDE or (tag == "header" and not inside[e])
            out[e] = out[self.parent[e]] or (own and not held[e])
            within[e] |= within[self.parent[e]]
        return out, within


#: Names speak against an element where their log odds sum to this or less; an unseen name counts zero.
AGAINST = -1.0


def _name(word: str, inside: bool) -> str:
    return f"name:{word}:{'in' if inside else 'out'}"


def keys(page: Page, against: dict[str, float]) -> tuple[list[str], list[bool]]:
    """The kind of each token by which it is weighed, and whether it is left out: tokens stand aside, in the main element or in the page."""
    aside, main = page.asides(against)
    out = [e < 0 or aside[e] for *_, e in page.tokens]
    return [f"{kind}:{name}:{'aside' if o else 'main' if main[e] else 'page'}" for (kind, name, _, e), o in zip(page.tokens, out, strict=True)], out


def learn_names(pages=LABELLED, smooth: float = 0.5) -> dict[str, float]:
    """Log odds of content for each name of an element, by the labelled parts in which it stands and whether an article is around it.

    Elements are counted, not words. A name seen only outside speaks inside too, at the same weight, and the other way round.
    """
    good, bad = Counter(), Counter()
    for page in pages:
        within = 0
        for part, content in page:
            p = Page(part)
            inside = p.within(("article", "main"))
            for e, names in enumerate(p.names):
                for w in names:
                    (good if content else bad)[_name(w, inside[e] or within > 0)] += 1
            within += len(re.findall(r"<(?:article|main)\b", part)) - len(re.findall(r"</(?:article|main)\b", part))
    odds = lambda keys: math.log((sum(good[k] for k in keys) + smooth) / (sum(bad[k] for k in keys) + smooth))
    out = {}
    for w in {k.split(":")[1] for k in good | bad}:
        both = _name(w, True), _name(w, False)
        for k in both:
            out[k] = odds([k]) if good[k] + bad[k] else odds(both)
    return out


def learn(pages=LABELLED, smooth: float = 0.5) -> dict[str, float]:
    """Log odds of content for each kind of token and for names; words never below a small gain in the page, tags never above zero."""
    names = learn_names(pages, smooth)
    inside, outside = Counter(), Counter()
    for page in pages:
        for part, content in page:
            p = Page(part)
            for (kind, _, text, _), k in zip(p.tokens, keys(p, names)[0], strict=True):
                (inside if content else outside)[k] += len(text.split()) if kind == "word" else 1
    total_in, total_out = sum(inside.values()), sum(outside.values())
    weights = dict(names)
    for k in inside | outside:
        odds = math.log((inside[k] + smooth) / (total_in + smooth)) - math.log((outside[k] + smooth) / (total_out + smooth))
        # what stands aside is left out anyhow: it must not part the text around it
        low = -0.25 if k == "word::aside" else -0.5 if k.endswith("aside") else -9.0
        weights[k] = max(odds, 0.5) if k in ("word::page", "word::main") else max(low, min(odds, -0.1))
    return weights


WEIGHTS = learn()


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """(first, stop) of the contiguous run of the largest sum above zero, the first of equals; (0, 0) if there is none."""
    best = total = 0.0
    first = stop = start = 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, stop = total, start, k + 1
    return first, stop


def scores(page: Page, told: list[str], weights: dict[str, float]) -> list[float]:
    """What each token adds: its weight, a text's for each of its words. Unseen tags count a little against, less in the main element."""
    return [(len(text.split()) if kind == "word" else 1) * weights.get(k, -0.1 if k.endswith(":main") else -0.5) for (kind, _, text, _), k in zip(page.tokens, told, strict=True)]


def extract(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The text of the best region of one page."""
    if not page:
        return ""
    p = Page(page)
    told, left_out = keys(p, weights)
    first, stop = best_region(scores(p, told, weights))
    blocks: list[list[str]] = [[]]
    for (kind, name, text, _), out in zip(p.tokens[first:stop], left_out[first:stop], strict=True):
        if kind == "word":
            if not out:
                blocks[-1].append(text)
        elif name in BLOCKS:
            blocks.append([])
        elif name in ("br", "img"):
            blocks[-1].append(" ")
    return "\n\n".join(t for b in blocks if (t := " ".join(entities.unescape("".join(b)).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in b["html"].to_pylist()]
        return pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(by_batch(run), "page_id long, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
