"""Extraction from awkward pages: articles in parts whose names look like asides, and long pages of tags without an end."""

from __future__ import annotations

import time

import pytest

from seedlake.llm import html

TREE = html.trained()
PARAGRAPHS = [" ".join(f"word{i * 37 + k}" for k in range(40)) for i in range(5)]
ARTICLE, TEXT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), " ".join(PARAGRAPHS)
COMMENT = "<p>A reader wrote this rather long comment, which is no part of what the page is about, not today.</p>"
PAGE = '<html><body><nav><a href="/x">One</a></nav>{}<footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(
    "wrap",
    [
        "<div id='search'><article>{}</article></div>",
        "<div class='content social'><article>{}</article></div>",
        "<div class='legal'><article>{}</article></div>",
        "<form id='aspnetForm'><article>{}</article></form>",
        "<article class='featured promo'>{}</article>",
        "<form id='aspnetForm'><div class=nav>Home</div>{}</form>",
        "<div class=promo><main>{}<section class='comments'>" + COMMENT + "</section></main></div>",
        "<article>{}</article><div class='comments'><article>" + COMMENT + "</article></div>",
        "<article>{}</article><div class='promo'><article>" + COMMENT + "</article></div>",
        "<div>{}<div class='comments'><article>" + COMMENT + "</article></div></div>",
        "<article>{}</article><form class='newsletter'>" + COMMENT + "</form>",
    ],
)
def test_article_is_kept_alone(wrap):
    assert html.main_text(PAGE.format(wrap.format(ARTICLE)), TREE) == TEXT


@pytest.mark.parametrize("part", ["<form class='newsletter'>{}</form>", "<div class='comments'>{}</div>", "<div class='related'><article>{}</article></div>", "<aside><article>{}</article></aside>", "<div class='ad'>{}</div>"])
def test_page_without_article(part):
    assert html.main_text(PAGE.format(part.format(COMMENT)), TREE) == ""


def test_short_paragraphs_of_a_named_part():
    lines = [f"Line {i} is short." for i in range(50)]
    assert html.main_text(PAGE.format("<div id='main'>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"), TREE) == " ".join(lines)


def test_quotes_without_an_end():
    assert html.main_text('<body><article><p title=">">one two three</p><p class="x>four five six</p></article>', TREE) == "one two three four five six"


@pytest.mark.parametrize("piece", ["<a ", "<noscript>x", "<div>", '<a ">" ', "<![CDATA[>", "<b><div>", "<i></b>", "<svg>", "<!", "<", "a=", "<script>", "<p a='"])
@pytest.mark.parametrize("before, after", [("", ""), ("<b><div>", ">")])
def test_long_page_of_open_tags(piece, before, after):
    began = time.monotonic()
    html.main_text(before + piece * (1_000_000 // len(piece)) + after, TREE)
    assert time.monotonic() - began < 20  # a square would take hours
