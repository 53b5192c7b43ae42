"""Page extraction against pages built piece by piece, and its cost on broken pages."""

import random
import time

import pytest

from evidentia.llm.html_text import main_text
from tests.llm.data import prose

MENU = ['<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>', "<header><h1>Site name</h1></header>",
        '<div class="sidebar"><a href="/x">Other story</a></div>', "<footer>Contact and legal text</footer>", '<div class="ad">Buy now, cheap</div>',
        '<form><label>Name</label><input name="q"><button>Send</button></form>', "<script>var a = '<p>no</p>';</script>", "<style>p { color: red }</style>",
        '<div id="comments"><p>First comment by a reader, who wrote some words here.</p></div>', "<aside>Related things</aside>", "<!-- <p>hidden</p> -->"]


def block(rng, seed):
    """One block of an article as markup, and the text it stands for."""
    text = prose(seed, rng.randint(12, 40))
    kind = rng.randrange(7)
    if kind == 0:
        return f"<p>{text}</p>", text
    if kind == 1:
        words = text.split()
        return f"<p>{' '.join(words[:3])}  <a href='/r'>{' '.join(words[3:])}</a>.</p>", f"{' '.join(words[:3])} {' '.join(words[3:])}."
    if kind == 2:
        items = [prose(seed + i, 4) for i in range(3)]
        return "<ul>" + "".join(f"<li><a href='/{i}'>{t}</a>" for i, t in enumerate(items)) + "</ul>", " ".join(items)
    if kind == 3:
        return f"<h2>{text[:30].strip()}</h2>", text[:30].strip()
    if kind == 4:
        return f"<blockquote>{text} &amp; &lt;more&gt; &eacute;</blockquote>", f"{text} & <more> é"
    if kind == 5:
        return f"<div><b>{text[:20].strip()}</b>\n\t {text[20:].strip()}<br>end</div>", f"{text[:20].strip()} {text[20:].strip()} end"
    return f"<p>{text} <code>a < b</code>", f"{text} a < b"


@pytest.mark.parametrize("seed", range(25))
def test_pages_built_from_known_blocks(seed):
    rng = random.Random(seed)
    blocks = [block(rng, 100 * seed + i) for i in range(rng.randint(3, 9))]
    name = rng.choice(["article", "main"])
    body = []
    for markup, _ in blocks:
        body.append(markup)
        if rng.random() < 0.3:
            body.append(rng.choice(MENU[4:]))
    page = rng.sample(MENU, 4) + [f"<{name}>", *body, f"</{name}>"] + rng.sample(MENU, 3)
    html = f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(page)}</body></html>"
    assert main_text(html) == " ".join(" ".join(t.split()) for _, t in blocks)


WHERE = ["<html><body><main>{}</main></body></html>", "<html><body><article>{}</article></body></html>", "<html><body><div>{}</div></body></html>"]
BEFORE, AFTER = f"<p>{prose(1, 30)}</p>", f"<p>{prose(2, 30)}</p>"


@pytest.mark.parametrize("where", WHERE)
@pytest.mark.parametrize("inner, text", [
    ("<p>See also <a href='/x'>the long report about everything</a>.</p>", "See also the long report about everything."),
    ("<ul><li><a href='/x'>First cited work</a></li><li><a href='/y'>Second cited work</a></li></ul>", "First cited work Second cited work"),
])
def test_linked_prose_and_lists_between_prose_stay(where, inner, text):
    assert main_text(where.format(BEFORE + inner + AFTER)) == f"{prose(1, 30)} {text} {prose(2, 30)}"


def test_a_menu_at_the_edge_of_a_page_without_article_goes():
    menu = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul>"
    assert main_text(WHERE[2].format(menu + BEFORE + AFTER)) == f"{prose(1, 30)} {prose(2, 30)}"


BROKEN = {
    "open tags": "<a " * 350_000, "unmatched ends": "<i>" * 80_000 + "</q>" * 80_000, "quotes": '<a "' * 250_000, "mixed quotes": "<a '\">" * 150_000,
    "cells": "<p><table><tr><td>" + "<i>" * 40_000 + "<p>x</p>" * 40_000, "angles": "<" * 500_000, "deep": "<div>" * 100_000 + "x",
    "attributes": "<div " + "id " * 200_000 + ">hello</div>", "classes": '<div class="' + "nav-" * 100_000 + 'x">y</div>', "comments": "<!-" * 300_000,
    "link items": "<div>" + "<li><a>x</a></li>" * 40_000 + "</div>",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_cost_in_proportion(name):
    start = time.perf_counter()
    main_text(BROKEN[name])
    assert time.perf_counter() - start < 20  # quadratic work would take minutes


def test_broken_markup_keeps_the_text():
    assert main_text("a < b and <b>c</b> 3<4 <!doctype x><!-- c --> &lt;d&gt;") == "a < b and c 3<4 <d>"
    assert main_text("<p>one <a href='x>two</a> three</p>") == "one two three"
    assert main_text("text and <a unfinished") == "text and <a unfinished"
