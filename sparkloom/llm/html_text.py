"""Main text of web pages by maximum-scoring subsequence.

A page is a run of words and tags. Each tag, and each name in the class, id and role of a section, has a
weight, and so has a word as such. A word scores its own weight plus those of what it stands in, but not
less than nothing. A tag scores the sum of its weights where that is negative, but costs no more than
half a word; an end tag costs nothing. Tags weigh nothing or less, so words score positive and tags
negative. One linear scan finds the contiguous region of the best sum. Blocks in it whose sections
outweigh their words (an advert in the article) are further negative spans and left out; the text of the
others is the result.

The weights are fitted on labelled pages (a logistic regression of whether a block is main text, with
the signs above): labelled_pages() writes PAGES pages by rule, of varied markup and class names. Besides
tags and names, blocks have three features: a copyright sign, whether they stand outside the container of
the page (its <main>, or else its one <article>, if that has most words), and, unless they stand in it,
the share of their words in links.

Defined results: null pages count as empty and give an empty text; empty pages, pages without words and
pages without a positive region give an empty text; pages cut off in a tag, comment or section are read
as far as they go; very long pages are read whole, one at a time; character references are decoded once;
white space inside a block becomes one space; blocks are joined by an empty line; of regions with equal
sums the one that ends first counts, and of those the shortest; nothing else is dropped or capped.
Repeated rows each get their result; columns are taken by name, and others don't matter.
"""

from __future__ import annotations

import dataclasses
import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: Elements whose content is never text, those that nest as sections, and those inside a block.
_SILENT = "script|style|noscript|template|title|svg|iframe|object|select|textarea|button|canvas|audio|video|math"
_SECTION = frozenset("nav header footer aside main article section div form ul ol dl table fieldset figure details dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_EMPTY = frozenset("area base col embed hr link meta param source track".split())
_TOKEN = re.compile(
    rf"(?s)<!--.*?(?:-->|$)|<(?P<silent>(?i:{_SILENT}))(?=[\s>/])[^>]*(?<!/)>"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*?)>"""
    r"|<[!?/][^<>]*>|<[a-zA-Z/!?][^<>]*$|(?P<text>[^<]+|<)"
)
_CLOSING = {x: re.compile(rf"(?i)</{x}\s*>") for x in _SILENT.split("|")}
#: Silent elements that run to the end of the page if they aren't closed; of the others only the tag is hidden then.
_RAW = frozenset(("script", "style", "textarea", "title"))
_NAMED = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[a-z]+")
_MAIN = re.compile(r"""(?i)\brole\s*=\s*["']?main\b""")
#: Features of blocks.
LINK, SIGN, OUTSIDE = "[link]", "[sign]", "[outside]"


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text with its text, open and end with the name and the attributes."""
    at, unclosed = 0, set()
    while at is not None:
        found, at = _TOKEN.finditer(page, at), None
        for m in found:
            if (text := m["text"]) is not None:
                yield "text", "", text
            elif m["name"]:
                yield ("end" if m["end"] else "open"), m["name"].lower(), m["attrs"] or ""
            elif m["silent"] and (name := m["silent"].lower()) not in unclosed:
                if closing := _CLOSING[name].search(page, m.end()):
                    at = closing.end()
                    break
                if name in _RAW:
                    return
                unclosed.add(name)  # none is closed from here on


def names(tag: str, attrs: str, around: list[str]) -> list[str]:
    """The tag and the words of its class, id and role. A header or footer in an article isn't that of the site."""
    found = (x for m in _NAMED.finditer(attrs) for x in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))
    own = tag in ("header", "footer") and any(x in ("article", "main", "section") for x in around)
    return [f"<{tag} in>" if own else f"<{tag}>", *dict.fromkeys(found)]


@dataclasses.dataclass
class Block:
    """A run of text without block tags: its words, how many of them stand in links (0 inside the container), the names of the sections around it and the tag that holds it, whether it stands in a <main> (2) or <article> (1), and the label, if the page has one."""

    text: str
    words: int
    linked: int
    names: tuple[str, ...]
    within: int
    main: bool


def parse(page: str) -> list[Block | tuple[str, ...]]:
    """Blocks, and the names of opened tags, in the order of the page. An end tag closes what it names, or nothing. The attributes ``data-main`` and ``data-not`` label sections."""
    out: list[Block | tuple[str, ...]] = []
    stack: list[tuple[str, list[str], tuple[str, ...], int, bool]] = []  # tag, own names, all names, within, label
    parts: list[str] = []
    opened = Counter()
    words = linked = links = outermost = 0
    holder = ""  # the tag in the section that was opened last and not closed yet

    def close() -> None:
        nonlocal words, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, _, held, within, main = stack[-1] if stack else ("", [], (), 0, False)
            out.append(Block(text, len(text.split()), min(linked, words), (*held, holder) if holder else held, within, main))
        words = linked = 0

    for kind, name, rest in tokens(page):
        if kind == "text":
            n = len(rest.split())
            words, linked = words + n, linked + n * (links > 0)
            parts.append(rest)
            continue
        if name == "a":
            links = 1 if kind == "open" else 0
        if name not in _INLINE:
            close()
            links = 0
        elif name in ("br", "img", "input"):
            parts.append(" ")
        if name not in _SECTION:
            if kind == "open":
                out.append((f"<{name}>",))
            if name not in _INLINE:
                holder = f"<{name}>" if kind == "open" and name not in _EMPTY else ""
            continue
        holder = ""
        if kind == "open":
            own = names(name, rest, [x for x in ("article", "main", "section") if opened[x]])
            opened[name] += 1
            _, _, held, within, main = stack[-1] if stack else ("", [], (), 0, False)
            if name == "article" and not within:
                outermost += 1
                within = 1
            if name == "main" or _MAIN.search(rest):
                within = 2
            out.append(tuple(own))
            stack.append((name, own, tuple(dict.fromkeys((*held, *own))), within, ("data-main" in rest or main) and "data-not" not in rest))
        elif opened[name]:
            while True:
                opened[last := stack.pop()[0]] -= 1
                if last == name:
                    break
    close()
    blocks = [x for x in out if isinstance(x, Block)]
    inside, every = (sum(x.words - x.linked for x in blocks if x.within or k) for k in (0, 1))
    least = 2 if any(x.within == 2 for x in blocks) else int(outermost == 1 and 2 * inside > every)
    for x in blocks:
        x.linked = 0 if least and x.within >= least else x.linked
        extra = [OUTSIDE] * (x.within < least) + [SIGN] * ("\N{COPYRIGHT SIGN}" in x.text)
        if extra:
            x.names = (*x.names, *extra)
    return out


class Weights:
    """word, and a weight for each name and feature, fitted on labelled pages."""

    def __init__(self, labelled: list[str], l2: float = 1e-5, steps: int = 200) -> None:
        found = Counter((tuple(sorted(x.names)), round(x.linked / max(x.words, 1), 1), x.main) for page in labelled for x in parse(page) if isinstance(x, Block) for _ in range(min(x.words, 20)))
        known = {x: k for k, x in enumerate(sorted({n for names, _, _ in found for n in names} | {LINK}))}
        x = np.zeros((len(found), len(known) + 1))
        for k, (names, linked, _) in enumerate(found):
            x[k, [known[n] for n in names]] = 1
            x[k, known[LINK]] = linked
        x[:, -1] = 1
        y, share = np.array([main for _, _, main in found], float), np.array(list(found.values()), float)
        share *= np.where(y > 0, 0.5 / max((share * y).sum(), 1e-9), 0.5 / max((share * (1 - y)).sum(), 1e-9))
        most = np.array([0.0 if n[0] in "<[" else np.inf for n in known] + [np.inf])  # tags and features weigh nothing or less
        least = np.array([-np.inf] * len(known) + [0.1])
        w, t = np.append(np.zeros(len(known)), 1.0), 1.0
        ahead, rate = w, 1 / (0.25 * x.T @ (share * x.sum(1)) + l2)  # bounds of the curvature by coordinate
        for _ in range(steps):  # projected gradient with momentum
            p = 1 / (1 + np.exp(-x @ ahead))
            grad = x.T @ (share * (p - y)) + l2 * np.append(ahead[:-1], 0)
            new = np.clip(ahead - rate * grad, least, most)
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            ahead, w = new + (before - 1) / t * (new - w), new
        self.word = float(w[-1])
        self.tags = {n: float(w[k]) for n, k in known.items() if w[k]}

    def section(self, names: tuple[str, ...]) -> float:
        """What a word scores in such sections, links aside."""
        return self.word + sum(self.tags.get(n, 0.0) for n in names)

    def scores(self, items: list[Block | tuple[str, ...]]) -> list[float]:
        """Of a block the sum of its words, of a tag its cost."""
        link = self.tags.get(LINK, 0.0)
        return [max(0.0, x.words * self.section(x.names) + x.linked * link) if isinstance(x, Block) else max(-self.word / 2, min(0.0, sum(self.tags.get(n, 0.0) for n in x))) for x in items]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run of the best positive sum; of equal ones that which ends first, and of those the shortest. (0, 0) if no sum is positive."""
    best = total = 0.0
    begin, found = 0, (0, 0)
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, found = total, (begin, k + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The blocks of the best region whose words count, joined by an empty line."""
    items = parse(page or "")
    begin, end = best_region(weights.scores(items))
    return "\n\n".join(x.text for x in items[begin:end] if isinstance(x, Block) and weights.section(x.names) > 0)


# Labelled pages ------------------------------------------------------------------------------

#: How many labelled pages are written.
PAGES = 1000
# Class names in common use, by what they mark.
_NAMES = {
    "content": "content main post entry article story text body page-content post-body entry-content article-body main-content blog-post prose",
    "part": "paragraph wrapper inner col row block box container lead intro quote gallery table-wrapper section clearfix",
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs links pager pagination tabs toolbar",
    "header": "header site-header masthead top topbar branding banner-top logo title-bar",
    "footer": "footer site-footer copyright bottom colophon legal credits imprint page-footer",
    "sidebar": "sidebar side widget widget-area rail aside related recommended popular trending tags archive categories",
    "notice": "cookie cookie-notice consent notice alert popup modal banner gdpr message overlay",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle ad-slot banner-ad outbrain taboola",
    "form": "newsletter subscribe signup search search-form login contact-form register mailing",
    "share": "share social sharing follow buttons social-links",
    "comments": "comments comment comment-list discussion responses disqus replies reply thread respond reader-comments",
}
_ATTRIBUTES = ("class", "class", "class", "id")


class _Writer:
    """Writes one labelled page."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        return " ".join("lorem" for _ in range(int(self.rng.integers(low, high))))

    def named(self, role: str, p: float = 1.0) -> str:
        if not self.chance(p):
            return ""
        found = " ".join(dict.fromkeys(self.one(_NAMES[role].split()) for _ in range(int(self.rng.integers(1, 3)))))
        return f' {self.one(_ATTRIBUTES)}="{found}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        found = [f"<a href=x>{self.words(1, 4)}</a>" for _ in range(int(self.rng.integers(low, high)))]
        return self.one([" ".join(found), " | ".join(found), "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>", "".join(f"<p>{x}</p>" for x in found)])

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(int(self.rng.integers(low, high))):
            text = self.words(6, 60)
            if self.chance(0.2):
                text += f" <a href=x>{self.words(1, 5)}</a> " + self.words(2, 20)
            if self.chance(0.15):
                text = f"<b>{text}"
            out.append(self.one([f"<p>{text}</p>", f"<p>{text}", f"<p>{text}<br>{self.words(3, 30)}</p>"]))
        return "".join(out)

    def article(self, header: bool) -> str:
        out = [f"<h1>{self.words(2, 12)}</h1>"]
        if header and self.chance(0.3):
            out = [f"<header>{out[0]}<p>{self.words(3, 12)}</p></header>"]
        for _ in range(int(self.rng.integers(1, 4))):
            part = self.prose(1, 5)
            extra = self.rng.random()
            if extra < 0.1:
                part += f"<h2>{self.words(1, 8)}</h2><ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(3)) + "</ul>"
            elif extra < 0.17:
                part += f"<ol><li>{self.words(2, 20)}<li>{self.words(2, 20)}</ol><blockquote><p>{self.words(4, 30)}</p></blockquote>"
            elif extra < 0.24:
                part += f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table><dl><dt>{self.words(1, 3)}<dd>{self.words(2, 9)}</dl>"
            elif extra < 0.3:
                part += f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure><pre>{self.words(3, 20)}</pre>"
            elif extra < 0.4:
                part += self.one([f"<p><a href=x>{self.words(1, 12)}</a></p>", f"<ul><li><a href=x>{self.words(1, 6)}</a></li><li><a href=x>{self.words(1, 6)}</a></li></ul>"])
            elif extra < 0.6:
                part += self.unwanted(self.one(["advert", "sidebar", "share", "form"]), inside=True)
            if self.chance(0.3):
                tag = self.one(["div", "section"])
                part = f"<{tag}{self.named('part', 0.6)}>{part}</{tag}>"
            out.append(part)
        return "".join(out)

    def unwanted(self, role: str, inside: bool = False) -> str:
        mark = " data-not" if inside else ""
        if role == "menu":
            tag = self.one(["nav", "nav", "div", "ul", "menu"])
            return f"<{tag}{self.named(role, 0.6 if tag != 'nav' else 0.3)}{mark}>{self.links()}</{tag}>"
        if role == "comments":
            each = "".join(self.one([f"<li>{self.words(3, 60)}</li>", f'<div class="comment"><p>{self.words(3, 60)}</p></div>', f'<article class="comment"><p>{self.words(3, 90)}</p></article>', f"<p>{self.words(3, 60)}</p>"]) for _ in range(int(self.rng.integers(1, 7))))
            tag = self.one(["section", "div", "ol", "ul", "aside"])
            return f"<{tag}{self.named(role)}{mark}><h3>{self.words(1, 3)}</h3>{each}</{tag}>"
        if role == "form":
            return self.one([f"<form{self.named(role, 0.6)}{mark}><label>{self.words(1, 4)}</label><p>{self.words(3, 25)}</p><input></form>", f"<div{self.named(role)}{mark}><p>{self.words(3, 25)}</p><form><input></form></div>"])
        tag = self.one({"header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "advert": ["div", "div", "aside", "section"]}.get(role, ["div", "section"]))
        body = self.one([self.words(3, 50), f"<p>{self.words(3, 50)}</p>", self.links(1, 6), f"<h3>{self.words(1, 4)}</h3><p>{self.words(3, 40)}</p>", f"<p>{self.words(3, 30)}</p>{self.links(1, 5)}"])
        if role == "header":
            body = self.one([f"<h1>{self.words(1, 4)}</h1>", f"<a href=x>{self.words(1, 4)}</a>"]) + self.one(["", self.unwanted("menu"), f"<p>{self.words(2, 9)}</p>"])
        elif role == "footer":
            body = self.one(["&copy; ", "&copy; ", ""]) + body
        elif role == "share":
            body = self.links(1, 5)
        named = self.named(role, 0.5 if tag in ("header", "footer", "aside") else 1.0)
        return f"<{tag}{named}{mark}>{body}</{tag}>"

    def page(self) -> str:
        before = [r for r, p in (("notice", 0.3), ("header", 0.6), ("menu", 0.8), ("advert", 0.5), ("sidebar", 0.2)) if self.chance(p)]
        after = [r for r, p in (("share", 0.2), ("advert", 0.3), ("sidebar", 0.4), ("comments", 0.45), ("form", 0.2), ("menu", 0.2), ("footer", 0.9)) if self.chance(p)]
        tag = self.one(["article", "article", "div", "section"])
        body = f"<{tag}{self.named('content', 0.3 if tag == 'article' else 0.8)} data-main>{self.article(tag in ("article", "section"))}</{tag}>"
        if self.chance(0.25):
            body = f"<main>{body}{''.join(self.unwanted(r, inside=True) for r in after if r in ('comments', 'share'))}</main>"
            after = [r for r in after if r not in ("comments", "share")]
        out = [*map(self.unwanted, before), body, *map(self.unwanted, after)]
        if self.chance(0.4):
            out = [f"<div{self.named('part', 0.7)}>", *out, "</div>"]
        return "<html><body>" + "".join(out) + "</body></html>"


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages by rule: ``data-main`` marks the article, ``data-not`` sections in or beside it that aren't."""
    writer = _Writer(np.random.default_rng(seed))
    return [writer.page() for _ in range(n)]


@functools.lru_cache(maxsize=1)
def default_weights() -> Weights:
    return Weights(labelled_pages())


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: list[str] | None = None) -> DataFrame:
    """The columns kept, text and n_chars (its code points)."""
    bound_batches(pages.sparkSession)
    weights = default_weights() if labelled is None else Weights(labelled)
    slim = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x, weights) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*keep, "text", "n_chars"])

    return slim.mapInArrow(work, T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
