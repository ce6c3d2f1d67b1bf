"""The scanner on broken and long markup, the field against enumeration, and pages that no grammar made."""

import itertools
import time

import numpy as np

from tallystream.llm import html_extract as H

LONG = "Sorel mitadu kanofe, rilota benu damisa poretu lakine sofira. Temo ladi pasoru nemika, tolade firune basemo."


def blocks(page):
    return [b[0] for b in H.leaf_blocks(page)]


def test_markup():
    assert blocks("<p>a<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b</p>") == ["ax=2 b"]
    for tag in ("svg", "canvas", "video", "audio", "object", "template", "noscript", "textarea", "title", "iframe"):
        assert blocks(f"<p>one</p><{tag}>shown, as it never ends<p>two</p>")[-1] == "two" and blocks(f"<p>one</p><{tag} a=b>no</{tag} ><p>two</p>") == ["one", "two"]
    assert blocks("<p>one</p><script>if (a<b) '<p>no</p>'") == ["one"] and blocks("<p>one<style/>two</p>") == ["onetwo"]
    assert blocks('<p title="a>text</p><p class="b">more</p>') == ["text", "more"] and blocks("<p title=\"a>b\" id='c>d'>text</p>") == ["text"]
    assert blocks("<p title='never closed>text</p>") == ["text"] and blocks("<p title = \"x\" data-q=it's>text</p>") == ["text"]
    assert blocks("a < b <3 c<") == ["a < b <3 c<"] and blocks("<!-->a<!-- <p> -->b<!x>c<?y>d<!-- open") == ["abcd"]
    assert blocks("<P>A</P ><DIV\nclass=x>B</div>") == ["A", "B"] and blocks("<p>x <a href=y") == ["x"] and blocks("</") == ["</"]


def test_time_is_linear():
    for unit in ("<a ", "<a href='", '<a href="x>', "<svg>", "<p title='a>", "<!--", "<!-- a ->", "</", "<", "<p", "<textarea>", "</a ", "<a =\"", "<div>", "&amp", "<script"):
        page = unit * (1_000_000 // len(unit))
        began = time.perf_counter()
        H.leaf_blocks(page)
        assert time.perf_counter() - began < 4, unit


def test_ends_and_attributes_without_number():
    for page in ("<textarea>" + "</textarea " * 180_000, "<p>a</p><script>" + "</script/" * 100_000, "<p " + "a='b' " * 350_000 + ">text</p>", "<p " + "a='b>' " * 150_000 + ">text</p>", "<svg>" * 1000 + "</svg " * 150_000):
        began = time.perf_counter()
        found = blocks(page)
        assert time.perf_counter() - began < 4, page[:30]
        assert ("text" in found) == page.endswith("text</p>")
    assert blocks("<p>a</p><textarea>x</textarea b</textarea>y</textarea><p>c</p>") == ["a", "y", "c"] and blocks("<p>a<textarea>b</textareas>c</textarea >d</p>") == ["ad"]


def test_field_against_enumeration():
    rng = np.random.default_rng(5)
    t = rng.normal(size=(2, 2))
    e, n = rng.normal(size=(3, 6, 2)), [6, 4, 1]
    mask = np.arange(6)[None, :] < np.array(n)[:, None]
    z, p, pair = H.expected(np.where(mask[:, :, None], e, 0), mask, t)
    want_pair = np.zeros((2, 2))
    for k, length in enumerate(n):
        score = {y: sum(e[k, j, y[j]] for j in range(length)) + sum(t[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=length)}
        total = np.log(sum(np.exp(v) for v in score.values()))
        assert abs(total - z[k]) < 1e-9
        for y, v in score.items():
            for a, b in zip(y, y[1:]):
                want_pair[a, b] += np.exp(v - total)
        for j in range(length):
            assert abs(sum(np.exp(v - total) for y, v in score.items() if y[j]) - p[k, j, 1]) < 1e-9
        field = H.Field({}, t.tolist())
        field.emission = lambda b: b
        assert tuple(field.viterbi([tuple(x) for x in e[k, :length].tolist()])) == max(score, key=score.get)
    assert np.allclose(want_pair, pair)


def test_sections_of_an_article():
    field = H.default_field()
    head = "<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav>"
    foot = "<footer>&copy; 2020 Us</footer></body></html>"
    for inner in (f"<p class='meta-analysis'>{LONG}</p>", f"<section class='discussion'><h2>Of it</h2><p>{LONG}</p></section>", f"<section id='legal-history'><p>{LONG}</p></section>", f"<p class='lead'>{LONG}</p>"):
        text = [x for x in (["Of it"] if "Of it" in inner else []) + [LONG]]
        for frame in ("<article>%s</article>", "<main><div class='post-body'>%s</div></main>", "<div id='content'>%s</div>"):
            page = head + frame % f"<h1>The title of it</h1><p>{LONG} {LONG}</p>{inner}<p>{LONG} And.</p>" + foot
            assert field.main_text(page) == "\n\n".join(["The title of it", f"{LONG} {LONG}", *text, f"{LONG} And."]), (inner, frame)
    comments = f"<section class='comments'><h3>2 comments</h3><div class='comment'><b>Bo</b><p>{LONG}</p></div><div class='comment'><p>{LONG}</p></div></section>"
    assert field.main_text(head + f"<article><h1>The title of it</h1><p>{LONG} {LONG}</p></article>{comments}" + foot) == f"The title of it\n\n{LONG} {LONG}"
