"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A tolerant scanner turns a page into leaf blocks: stretches of text between block-level tags,
with the open block-level elements around them. Features are the ancestors' tags, the words of
their class, id, role, itemprop and aria-label attributes, the nearest element whose tag or
words name a kind of content (and whether that kind is the article's or another), and what the
text is like (length, links, punctuation). The field has two labels, content and
other; it is trained by penalised likelihood on labelled pages, which labelled_pages makes
from a grammar of page layouts (a page's own labels can be given instead), and pages are
decoded by Viterbi.

Text inside a block has its character references decoded and its white space folded; br and
inline tags don't end a block. Scripts, styles and other elements that show no text never give
blocks.

Defined results: a NULL or empty page, or one without content, gives an empty text; broken
markup is read as far as it goes; repeated rows are extracted each; an empty table gives an
empty result. Pages are read whole. Other columns are ignored. Each page is read by itself in
Arrow batches; the model is a few hundred weights.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plain

# Fixed values of HTML: elements that start and end blocks, that have no end tag, and that show no text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their text is no markup
HIDDEN = RAW | frozenset("noscript template svg head object canvas audio video annotation annotation-xml".split())
_ENDS_P = BLOCKS - {"html", "body", "button", "option", "select", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "figcaption", "summary"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_HIDDEN_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in HIDDEN}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_OFF = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_QUOTE = re.compile(r"=\s*([\"'])")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # camel case is cut

# Words that name a kind of content, for the nearest-ancestor feature and for layouts.
CONTENT_NAMES = "article content post entry story main body text maincontent".split()
OTHER_NAMES = (
    "nav menu navigation navbar topbar toolbar breadcrumb header masthead banner logo footer foot copyright contentinfo legal sidebar side aside complementary widget related recommended popular trending more ad advert advertisement sponsor "
    "sponsored promo promotion promoted cookie consent privacy notice alert warning gdpr popup modal dialog overlay newsletter subscribe subscription signup form login search comment reply replie respond response discus disqus feedback "
    "share social follow tag meta byline author pagination pager unseen"
).split()
OTHER_TAGS = frozenset("nav header footer aside form dialog button select fieldset menu search".split())
CONTENT_TAGS = frozenset("article main".split())
_OTHER, _CONTENT = frozenset(OTHER_NAMES), frozenset(CONTENT_NAMES)
_INSIDE = sorted((w for w in OTHER_NAMES if len(w) > 4), key=len, reverse=True)
#: Names that say something else in a compound with a word of the subject (meta-analysis, search-results-of-1990).
_WEAK = frozenset("meta legal response respond feedback related more search alert notice warning privacy consent share follow tag author side header banner trending popular".split())
_NEUTRAL = frozenset("box wrap wrapper area block list section item inner outer site page right left inline top bottom bar row col column container slot unit card info link button btn title text content body post entry article main head module panel nav icon".split())
LABELS = ("other", "content")
PAGES, SEED, ROUNDS = 700, 31, 110


class _Node:
    """An open element: its tag, the features of it and its ancestors, and the nearest names of a kind of content."""

    __slots__ = ("tag", "above", "near", "cache")

    def __init__(self, tag: str, above: frozenset, near: tuple[str, ...]):
        self.tag, self.above, self.near = tag, above, near
        self.cache = None


@lru_cache(maxsize=1 << 16)
def _names(value: str) -> tuple[str, ...]:
    """The words of an attribute, without plural s; a word that holds the name of a kind of content is that name too.

    A weak name beside a word that is no part of page layouts isn't one.
    """
    out = set()
    for token in value.strip("\"'").split():
        own = set()
        for w in _WORD.findall(token):
            w = w.lower()
            w = w[:-1] if len(w) > 2 and w[-1] == "s" and w[-2] != "s" else w
            own.add(w)
            if w not in _OTHER:
                own.update([x for x in _INSIDE if x in w][:1])
        if own & _WEAK and not own <= _OTHER | _CONTENT | _NEUTRAL:
            own -= _WEAK
        out |= own
    return tuple(sorted(out))


def _enter(parent: _Node, tag: str, attrs: str, known: frozenset | None) -> _Node:
    words = {w for _, v in _ATTR.findall(attrs) for w in (_names if len(v) < 256 else _names.__wrapped__)(v)} if attrs else set()
    if attrs and _OFF.search(attrs):
        words.add("unseen")
    other, content = sorted(words & _OTHER), sorted(words & _CONTENT)
    own = {f"in:{tag}"} | {f"name:{w}" for w in words}
    if other or tag in OTHER_TAGS:
        near = ("kind:other", *(f"near:{w}" for w in other), *(f"beside:{w}" for w in content), *([f"near:{tag}"] if tag in OTHER_TAGS else []))
    elif content or tag in CONTENT_TAGS:
        near = ("kind:content", *(f"near:{w}" for w in content), *([f"near:{tag}"] if tag in CONTENT_TAGS else []))
    else:
        near = parent.near
    if "kind:other" in near:
        own.add("under:other")
    if known is not None:
        own = {f for f in own if f in known}
    return _Node(tag, parent.above | own, near)


def leaf_blocks(page: str, known: frozenset | None = None) -> list[tuple[str, _Node, int, float]]:
    """(text, innermost element, characters inside links, place in the page from 0 to 1) of each leaf block, in page order."""
    root = _Node("", frozenset(), ("kind:none",))
    stack, opened = [root], Counter()
    out: list[tuple[str, _Node, int, float]] = []
    parts: list[str] = []
    linked = link_depth = 0
    size = max(1, len(page))

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if link_depth:
                linked += len(raw.strip())

    def flush(at: int) -> None:
        nonlocal linked
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                out.append((t, stack[-1], linked, at / size))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        while len(stack) > 1:
            n = stack.pop().tag
            opened[n] -= 1
            if n == tag:
                return

    beyond: dict[str, int] = {}  # from where on something is known not to occur

    def find(what: str, start: int) -> int:
        """As page.find, without searching again where there is none."""
        if start >= beyond.get(what, size + 1):
            return -1
        k = page.find(what, start)
        if k < 0:
            beyond[what] = min(start, beyond.get(what, start))
        return k

    def tag_end(k: int) -> int:
        """The place of the > that ends a tag; size if there is none. A quoted value may hold >; a quote that isn't closed before the next tag's quote is none."""
        g = -1
        while True:
            if g < k:  # what was found stays the next one until it is passed
                g = find(">", k)
            if g < 0:
                return size
            q = _QUOTE.search(page, k, g)
            if q is None:
                return g
            end = find(q[1], q.end())
            if end < 0 or end > g and not (end + 1 >= size or page[end + 1] in " \t\n\r\f/>"):
                return g
            k = end + 1

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            text(page[at:lt])
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith((">", "->"), lt + 4) else find("-->", lt + 4)
                end = find(">", end) if end == lt + 4 else end + 2 if end >= 0 else -1
            else:
                end = find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        closing = after == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        tag = m[0].lower() if len(m[0]) < 64 else ""
        end = find(">", m.end()) if closing else tag_end(m.end())
        attrs, at = page[m.end() : end], end + 1 if end >= 0 else size
        if end < 0 or end >= size:
            break
        if closing:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCKS:
                flush(lt)
                if opened[tag]:
                    close(tag)
            continue
        if tag in HIDDEN:
            if tag == "head":
                flush(lt)
            stop = -1
            if not attrs.endswith("/") and at < beyond.get(f"</{tag}", size + 1):
                name = _HIDDEN_END[tag].search(page, at)
                stop = find(">", name.end()) if name else -1
                if stop < 0:
                    beyond[f"</{tag}"] = at
            if stop >= 0:
                at = stop + 1
            elif tag in ("script", "style") and not attrs.endswith("/"):
                at = size  # other elements that are never closed hide nothing
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link_depth = 1
        elif tag == "img" or tag == "input":
            continue
        elif tag in BLOCKS:
            flush(lt)
            if tag in _ENDS_P and opened["p"]:
                close("p")
            for t in _SAME.get(tag, ()):
                if stack[-1].tag == t:
                    close(t)
            if tag not in VOID:
                stack.append(_enter(stack[-1], tag, attrs, known))
                opened[tag] += 1
    flush(size)
    return out


def text_features(text: str, node: _Node, linked: int, place: float) -> list[str]:
    """Features of a block besides those of its ancestors."""
    n, words = len(text), text.count(" ") + 1
    share = linked / n if n else 0
    f = ["bias", *node.near, f"{node.near[0]}:tag:{node.tag}", f"tag:{node.tag}", f"size:{min(6, n.bit_length() // 2)}", f"words:{min(7, words.bit_length())}", f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    if text[-1] in ".!?…\"”":
        f.append("stop")
    if "©" in text or "™" in text:
        f.append("copyright")
    if text.count(".") + text.count(",") > words / 12:
        f.append("prose")
    f.append(f"place:{int(place * 4) if place < 1 else 3}")
    return f


class Field:
    """Weights of features by label, and of transitions (row: label before)."""

    def __init__(self, weights: dict[str, tuple[float, float]], between: list[list[float]]):
        self.weights, self.between = weights, between
        self.known = frozenset(weights)

    def __reduce__(self):
        return Field, (self.weights, self.between)

    def emission(self, block: tuple[str, _Node, int, float]) -> tuple[float, float]:
        node = block[1]
        if node.cache is None:
            found = [self.weights[f] for f in node.above if f in self.weights]
            node.cache = (sum(w[0] for w in found), sum(w[1] for w in found))
        a, b = node.cache
        for f in text_features(*block):
            w = self.weights.get(f)
            if w is not None:
                a += w[0]
                b += w[1]
        return a, b

    def viterbi(self, blocks: list) -> list[int]:
        """The likeliest labels."""
        (t00, t01), (t10, t11) = self.between
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for i, blk in enumerate(blocks):
            e0, e1 = self.emission(blk)
            if i == 0:
                s0, s1 = e0, e1
                continue
            a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        label = 0 if s0 >= s1 else 1
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1] if blocks else []

    def main_text(self, page: str) -> str:
        blocks = leaf_blocks(page, self.known)
        return "\n\n".join(b[0] for b, y in zip(blocks, self.viterbi(blocks)) if y)


def expected(e: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pages with scores e (page, place, label) where mask is set, and transition scores t: the logarithms of the sums over all labellings, the labels' probabilities and the expected number of each transition."""
    longest = e.shape[1]
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for j in range(1, longest):
        fwd[:, j] = np.where(mask[:, j, None], np.logaddexp.reduce(fwd[:, j - 1, :, None] + t, axis=1) + e[:, j], fwd[:, j - 1])
    for j in range(longest - 2, -1, -1):
        bwd[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(t + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2), 0.0)
    z = np.logaddexp.reduce(fwd[:, -1], axis=1)
    both = mask[:, 1:] & mask[:, :-1]
    pair = np.exp(fwd[:, :-1, :, None] + t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(axis=0)
    return z, np.exp(fwd + bwd - z[:, None, None]), pair


def train(pages: list[tuple[list, list[int]]], rounds: int = ROUNDS, penalty: float = 0.01) -> Field:
    """A field from (blocks, labels) of pages: gradient ascent on the penalised likelihood, by forward and backward sums over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in (*b[1].above, *text_features(*b))})
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(b) for b, _ in pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        for j, b in enumerate(blocks):
            x[i, j, [index[f] for f in (*b[1].above, *text_features(*b))]] = 1
            y[i, j], mask[i, j] = labels[j], True
    flat = x[mask]
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gold = np.zeros_like(w)
    for label in (0, 1):
        gold[:, label] = flat[y[mask] == label].sum(axis=0)
    gold_t = np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), 1)
    m1, m2 = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        e = np.zeros((n, longest, 2))
        e[mask] = flat @ w
        _, p, pair = expected(e, mask, t)
        p = p[mask]
        for k, (v, g) in enumerate(((w, (gold - flat.T @ p) / n - penalty * w / n), (t, (gold_t - pair) / n - penalty * t / n))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            v += 0.1 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, t.tolist())


# --- labelled pages from a grammar of layouts


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its content blocks. Every block's text is unlike the others'."""
    vocabulary = [("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))) for _ in range(200)]

    def say(low: int, high: int, stop: bool = True) -> str:
        w = [rng.choice(vocabulary) + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        return " ".join(w).capitalize().rstrip(",") + (rng.choice(".....!?") if stop else "")

    content: list[str] = []

    def p(low: int = 8, high: int = 90) -> str:
        t = say(low, high, rng.random() < 0.9)
        content.append(t)
        inner = t
        if rng.random() < 0.15:
            cut = t.find(" ", len(t) // 2)
            if cut > 0:
                inner = f"{t[:cut]} <a href='/x'>{t[cut + 1 :]}</a>" if rng.random() < 0.4 else f"{t[:cut]} <b>{t[cut + 1 :]}</b>"
        return f"<p>{inner}</p>" if rng.random() < 0.9 else f"<p>{inner}"

    def heading(k: int) -> str:
        t = say(1, 12, rng.random() < 0.4)
        content.append(t)
        return f"<h{k}>{t}</h{k}>"

    def attrs(words: list[str]) -> str:
        w = rng.choice(words)
        if rng.random() < 0.5:
            more = rng.choice(["box", "wrap", "area", "block", "list", "section", "item", "content", "body", "text", "post", "article", "site", "page", "main", "right", "inline", w])
            pair = (w, more) if rng.random() < 0.6 else (more, w)
            w = rng.choice(["-", "-", "_", "__"]).join(pair) if rng.random() < 0.7 else pair[0] + pair[1].capitalize()
        return f' {rng.choice(["class", "class", "class", "id"])}="{w}"' if rng.random() < 0.8 else f' class="{rng.choice(["row", "col", "inner", "c12"])} {w}"'

    def role(name: str) -> str:
        return f' role="{name}"' if rng.random() < 0.2 else ""

    def holder() -> str:
        """Attributes of the element around the article."""
        w = rng.choice(CONTENT_NAMES)
        if rng.random() < 0.5:
            more = rng.choice([*CONTENT_NAMES, "inner", "wrap", "container", "area", str(rng.randint(1, 999))])
            w = f"{w}-{more}" if rng.random() < 0.7 else w + more.capitalize()
        return f' {rng.choice(["class", "id"])}="{w}"'

    def long_text() -> str:
        return "".join(f"<p>{say(3, 70)}</p>" for _ in range(rng.randint(1, 4))) if rng.random() < 0.5 else say(3, 60, rng.random() < 0.7)

    def links(k: int) -> str:
        items = "".join(f'<li><a href="/{rng.choice(vocabulary)}">{say(1, 4, False)}</a></li>' for _ in range(k))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else " ".join(f'<a href="#">{say(1, 3, False)}</a>' for _ in range(k))

    def noise(kind: str) -> str:
        if kind == "nav":
            body = links(rng.randint(2, 9))
            return f"<nav>{body}</nav>" if rng.random() < 0.4 else f"<div{role('navigation') or attrs(['nav', 'menu', 'navigation', 'navbar', 'topbar', 'breadcrumb', 'breadcrumbs'])}>{body}</div>"
        if kind == "header":
            body = f"<h1>{say(1, 4, False)}</h1>" * (rng.random() < 0.3) + f"<div>{say(1, 8, False)}</div>" + links(3) * (rng.random() < 0.5)
            return f"<header>{body}</header>" if rng.random() < 0.6 else f"<div{role('banner') or attrs(['header', 'masthead', 'banner', 'logo'])}>{body}</div>"
        if kind == "footer":
            body = rng.choice([f"&copy; {say(1, 9)}", long_text(), links(4), f"<p>&copy; {say(2, 9)} &middot; {say(1, 5)}</p>"])
            return f"<footer>{body}</footer>" if rng.random() < 0.6 else f"<div{role('contentinfo') or attrs(['footer', 'foot', 'copyright', 'legal'])}>{body}</div>"
        if kind == "ad":
            return f"<{(d := rng.choice(['div', 'div', 'aside', 'section']))}{attrs(['ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'promotion', 'promoted'])}>{long_text()}</{d}>"
        if kind == "hidden":
            off = rng.choice(["hidden", 'style="display:none"', "aria-hidden=true", 'style="visibility: hidden"'])
            return f"<{(d := rng.choice(['div', 'section']))} {off}>{long_text()}</{d}>"
        if kind == "side":
            body = f"<h3>{say(1, 4, False)}</h3>" + rng.choice([links(4), long_text()])
            return f"<aside>{body}</aside>" if rng.random() < 0.4 else f"<{(d := rng.choice(['div', 'section', 'aside']))}{role('complementary') or attrs(['sidebar', 'side', 'widget', 'related', 'recommended', 'popular', 'trending', 'aside'])}>{body}</{d}>"
        if kind == "notice":
            how = role("alert") or attrs(["cookie", "cookies", "consent", "notice", "alert", "warning", "gdpr", "popup", "modal", "overlay", "privacy"])
            tag = rng.choice(["div", "div", "div", "section", "dialog", "p"])
            if tag == "p":
                return f"<p{how}>{say(3, 60)}</p>"
            return f"<{tag}{how if tag != 'dialog' else ' open'}>{long_text()}{'<button>' + say(1, 2, False) + '</button>' if rng.random() < 0.5 else ''}</{tag}>"
        if kind == "form":
            body = f"<label>{say(1, 4, False)}</label><input name=q><button>{say(1, 2, False)}</button>"
            body = f"<p>{say(3, 20)}</p>" * (rng.random() < 0.4) + body
            return f"<form>{body}</form>" if rng.random() < 0.7 else f"<div{attrs(['newsletter', 'subscribe', 'signup', 'form', 'login', 'search'])}>{body}</div>"
        if kind == "share":
            return f"<div{attrs(['share', 'social', 'follow', 'tags', 'meta', 'byline', 'pagination', 'pager', 'toolbar'])}>{rng.choice([links(3), say(1, 10, False)])}</div>"
        one = lambda: f"<{(d := rng.choice(['div', 'li', 'article', 'p']))}{attrs(['comment', 'reply', 'comments', 'response']) if rng.random() < 0.7 else ''}>{rng.choice(['<b>' + say(1, 2, False) + '</b> ', ''])}{long_text() if d != 'p' else say(3, 60)}</{d}>"
        body = f"<h2>{say(1, 3, False)}</h2>" * (rng.random() < 0.7) + "".join(one() for _ in range(rng.randint(1, 5)))
        return f"<{(d := rng.choice(['section', 'div', 'ol', 'aside']))}{attrs(['comments', 'comment', 'replies', 'respond', 'responses', 'feedback'])}>{body}</{d}>"

    def article() -> str:
        out = []
        if rng.random() < 0.08:  # bare text
            t = [say(8, 60) for _ in range(rng.randint(1, 4))]
            content.append(" ".join(t))
            return rng.choice(["<br>", "<br><br>", " <br/> "]).join(t)
        if rng.random() < 0.85:
            h = heading(1)
            r = rng.random()
            out.append(f"<header>{h}</header>" if r < 0.12 else f'<div class="{rng.choice(["post", "entry", "article"])}-header">{h}</div>' if r < 0.18 else h)
        for _ in range(rng.randint(1, 12)):
            out.append(p(1, 90) if rng.random() < 0.25 else p())
            r = rng.random()
            if r < 0.1:
                out.append(heading(rng.choice([2, 3])))
            elif r < 0.15:
                kept = [say(2, 15) for _ in range(rng.randint(2, 4))]
                content.extend(kept)
                out.append("<ul>" + "".join(f"<li>{k}</li>" for k in kept) + "</ul>")
            elif r < 0.19:
                content.append(say(5, 40))
                out.append(f"<blockquote>{content[-1]}</blockquote>")
            elif r < 0.22:
                content.append(say(5, 40))
                out.append(f"<pre>{content[-1]}</pre>" if rng.random() < 0.3 else f"<div>{content[-1]}</div>")
            elif r < 0.25:
                content.append(say(2, 15))
                out.append(f"<figure><img src=x><figcaption>{content[-1]}</figcaption></figure>")
            elif r < 0.28:  # a part of the article under a name of its own
                tag = rng.choice(["section", "section", "div"])
                own = rng.choice(["discussion", "results", "meta-analysis", "method", "background", "summary", "legal-history", "search-results-1990", "related-work", "conclusion", "response-times", "notice-period"])
                out.append(f'<{tag} {rng.choice(["class", "class", "id"])}="{own}">' + (heading(2) if rng.random() < 0.6 else "") + p() + (p() if rng.random() < 0.5 else "") + f"</{tag}>")
            elif r < 0.44:
                out.append(noise(rng.choice(["ad", "ad", "share", "form", "side", "notice", "hidden", "nav", "footer"])))
        if rng.random() < 0.2:
            out.append(noise("comments"))
        elif rng.random() < 0.1:
            out.append(noise("share"))
        return "".join(out)

    kinds = [[k for k in ("nav", "header", "notice", "ad", "form", "side", "share", "nav", "hidden") if rng.random() < 0.4], [k for k in ("comments", "side", "ad", "form", "footer", "share", "notice", "nav", "footer") if rng.random() < 0.4]]
    rng.shuffle(kinds[0])
    top = "".join(map(noise, kinds[0]))
    body = article()
    style = rng.random()
    if style < 0.45:
        body = f"<article{holder() if rng.random() < 0.3 else ''}>{body}</article>"
        body = f"<main>{body}</main>" if rng.random() < 0.3 else body
    elif style < 0.6:
        body = f"<main>{body}</main>"
    elif style < 0.92:
        body = f"<{(d := rng.choice(['div', 'div', 'section']))}{holder()}>{body}</{d}>"
    else:
        body = f"<div>{body}</div>"
    page = f"<!DOCTYPE html><html><head><title>{say(1, 6)}</title><style>p{{}}</style></head><body>{top}<script>var a='<p>'</script>{body}{''.join(map(noise, kinds[1]))}</body></html>"
    if rng.random() < 0.3:
        own = rng.choice(["wrapper container", "site has-sidebar", "header-fixed", "page with-nav", "layout", "row col"])
        page = page.replace("<body>", f'<body><div id="page" class="{own}">').replace("</body>", "</div></body>")
    return page, content


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list, list[int]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page, content = labelled_page(rng)
        blocks, own = leaf_blocks(page), Counter(content)
        labels = []
        for b in blocks:
            labels.append(int(own[b[0]] > 0))
            own[b[0]] -= 1
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(pages: DataFrame, field: Field | None = None, key: str = "page_id", page: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, carried columns, text)."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            texts = [f.main_text(h) for h in b.column("_h").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])

    base = pages.select(*names, plain(page).alias("_h"))
    return base.mapInArrow(run, base.drop("_h").schema.add("text", "string"))
