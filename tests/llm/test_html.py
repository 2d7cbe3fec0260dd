"""Pages that no part of the library made, the tree decoder against all assignments, and broken pages in linear time."""

import itertools
import random
import time

import numpy as np
import pytest

from millrace.llm import html_extract as h


@pytest.fixture(scope="module")
def model():
    return h.train([])


LONG = "The river rose in the night, and by morning the lower fields lay under water. Nobody in the village had seen it so high before."
MORE = "Old people spoke of a flood long ago, when the mill was lost. This time the mill stood, but its wheel turned no more for a week."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"{LONG} <b>bold</b> {MORE}", f"{LONG} bold {MORE}"),
        (f"{LONG}<br>{MORE}<br>{LONG}", f"{LONG} {MORE} {LONG}"),
        (f"<p>{LONG}</p>{MORE}", f"{LONG} {MORE}"),
        (f"<p title=it's>{LONG}</p><p>We don't {MORE}</p><p>Third. {LONG}</p>", f"{LONG} We don't {MORE} Third. {LONG}"),
        (f"{LONG}", LONG),
        ("just text, no markup at all", "just text, no markup at all"),
        (f"<html><head><title>t</title><p>{LONG}</p></html>{MORE}", f"{LONG} {MORE}"),
        (f"<p>{LONG} a &lt; b &amp; c&nbsp;d 1 < 2</p><p>{MORE}</p>", f"{LONG} a < b & c d 1 < 2 {MORE}"),
        (f'<p data-x="a > b" class=\'x\'>{LONG}</p><p>{MORE}</p>', f"{LONG} {MORE}"),
        ("", ""),
        (None, ""),
        ("   \n ", ""),
    ],
)
def test_text_is_kept(model, page, want):
    assert h.extract(model, [page])[0] == want


FOREIGN = [
    # a journal of tables within tables
    f"<table width=100%><tr><td class=nav><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Links</a></td><td><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></td></tr></table>",
    # a page of a site builder
    f"<div id='__app'><div class='css-1x2y navbar'><a href=/>Home</a><a href=/x>Sign in</a></div><main><div class='css-99'><h1>The flood</h1><div><p>{LONG}</p></div><div><p>{MORE}</p></div></div></main><div class='css-7 footer'>© 2024 Some firm, all rights reserved</div></div>",
    # a weblog
    f"<body><div class='sidebar'><h3>About</h3><p>I write here.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div class='hentry'><div class='entry-content'><p>{LONG}</p><blockquote>{MORE}</blockquote></div></div><div id='comments'><p>Nice one!</p></div></body>",
]


@pytest.mark.parametrize("page", FOREIGN)
def test_foreign_layouts(model, page):
    got = h.extract(model, [page])[0]
    assert LONG in got and MORE in got
    assert not any(x in got for x in ("Home", "Sign in", "all rights", "Nice one", "I write here"))


def best_by_trial(nodes, odds):
    """Greatest gain over all consistent assignments: 0 outside, 1 content, 2 dropped."""
    top = -np.inf
    for states in itertools.product((0, 1, 2), repeat=len(nodes) - 1):
        states = (0, *states)
        ok = all(states[k] in {0: (0, 1, 2), 1: (1, 2), 2: (2,)}[2 if n.parent.tag in h.NEVER else states[n.parent.order]] and (states[k] == 2 or n.tag not in h.NEVER) for k, n in enumerate(nodes) if k)
        if ok:
            top = max(top, sum(o for s, o in zip(states, odds) if s == 1))
    return top


def test_decoder_against_all_assignments():
    rng = random.Random(2)
    for _ in range(120):
        page = ""
        for _ in range(rng.randint(1, 6)):
            page += rng.choice(["<div>", "<section>", "<p>", "</div>", "<ul><li>", "<select>", "</section>", "<b>"]) + rng.choice(["", "text of some length ", "x"])
        nodes = h.parse(page)
        if len(nodes) > 9 or len(nodes) == 2 and nodes[1].tag == "body":
            continue
        raw = np.array([rng.uniform(-3, 3) for _ in nodes])
        odds = raw * np.array([1 + min(n.own, 400) / 40 for n in nodes])
        got = h.decode(nodes, raw)
        assert not got[0] and not any(got[k] and n.tag in h.NEVER for k, n in enumerate(nodes))
        assert abs(sum(o for g, o in zip(got, odds) if g) - best_by_trial(nodes, odds)) < 1e-9


@pytest.mark.parametrize("bad", ['<a "' * 250_000, "<div>" * 40_000 + "</b>" * 40_000, "<ul><li><ul>" + "<div>" * 15_000 + "<li>x</li>" * 15_000, "<p><button>" + "<div>" * 40_000, "<" * 400_000, '<a b="' * 100_000, "<a b<" * 100_000, "<!-" * 200_000])
def test_broken_pages_take_linear_time(bad):
    began = time.process_time()
    h.parse(bad)
    assert time.process_time() - began < 10


def test_tags_end_as_in_html():
    tag = lambda page: [(s, n, a.strip()) for _, s, n, a in h.markup(page) if n]
    assert tag("<p title=it's>x</p>") == [("", "p", "title=it's"), ("/", "p", "")]
    assert tag("<a href='x>y' b>z") == [("", "a", "href='x>y' b")]
    assert tag('<a "b>c') == [("", "a", '"b')]
    assert tag('<a b="c>d') == []
    assert tag("<!-- <p> --><p><?x <b>?><!doctype <i>") == [("", "p", "")]
    assert tag("<script>if (a<b) {}</script ><p>") == [("", "script", ""), ("", "p", "")]
    assert [t for t, *_ in h.markup("1 < 2 & <3")] == ["1 < 2 & <3"]
