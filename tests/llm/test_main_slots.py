"""Main text of pages that mark no article, by the template of their host alone; and pages that a careless parser would not survive."""

from __future__ import annotations

import random
import re
import time

import pytest

from dpspark.llm import extract
from dpspark.llm.common import table
from tests.llm.test_operators import prose


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("least, removed", [(0.95, r"<(/?)(?:article|main)\b"), (0.95, r"<(/?)(?:article|main|nav|footer)\b")])
def test_given_pages_without_marks(spark, least, removed):
    """Articles renamed to plain elements, then menus and footers too and no names at all: as many texts stay the same."""
    pages = [(p["page_id"], p["url"], p["html"]) for p in table(spark, "/root/testdata/sf0.1", "pages").collect()]
    bare = [(i, u, re.sub(removed, r"<\1div", h)) for i, u, h in pages]
    if "nav" in removed:
        bare = [(i, u, re.sub(r' class="[^"]*"', "", h)) for i, u, h in bare]
    want, got = texts(spark, pages), texts(spark, bare)
    assert sum(got[i] == t for i, t in want.items()) >= least * len(want)


def site(i: int, rng: random.Random) -> tuple[str, str]:
    """A page without marks or telling names, and its main text: a menu, a side column of changing teasers, a title beside the body."""
    title, parts = prose(10_000 + i, 6), [prose(20_000 + 10 * i + k, rng.randint(15, 60)) for k in range(rng.randint(2, 6))]
    teasers = "".join(f"<div class=z{k}><p>{prose(rng.randrange(10**6), 6)}</p></div>" for k in range(3))
    body = f"<p>{parts[0]}</p><ul><li>{parts[1]}</li></ul>" + "".join(f"<div class=q><p>{x}</p></div>" for x in parts[2:])
    page = f"<html><body><div class=a><div class=b><p>Home</p><p>About us and them</p></div></div><div class=c><div class=d><h1>{title}</h1><div class=e>{body}</div></div><div class=f>{teasers}</div></div><div class=g><p>All rights kept by nobody</p></div></body></html>"
    return page, " ".join([title, *parts])


def test_slots_between_nested_classes(spark):
    rng = random.Random(7)
    made = [site(i, rng) for i in range(40)]
    got = texts(spark, [(i, f"https://site.example/{i}", p) for i, (p, _) in enumerate(made)])
    assert sum(got[i] == t for i, (_, t) in enumerate(made)) >= 38


def test_names_that_say_something_else(spark):
    page = "<div class='share-price'><p>Market text here.</p></div><div class='share-buttons'>Tweet</div><div class='comment-list'>c</div><div class='article-tags-history'>On tags.</div>"
    assert extract.main_text(page, frozenset(), None) == "Market text here. On tags."


def test_odd_pages_take_no_longer(spark):
    n = 10**6
    odd = ["<a " * n, "<div>" * 10**5, "<div>x" * 10**5 + "</b>" * 10**5, "<script " * n, "<! " * n, '<a "' * n, "<a '\"" * n, "<p <p>" * 10**5, "</div>" * n, "<!--" * n, "<script>" + "</scrip" * n, "<style>" * n, "&" * n, "<" * n]
    began = time.time()
    for page in odd:
        extract.blocks(page)
    assert time.time() - began < 60
    rows = [(i, f"http://odd.example/{i}", p[:400_000]) for i, p in enumerate(odd)]
    assert set(texts(spark, rows)) == set(range(len(odd)))


def test_tags_that_are_cut_short():
    cases = {"a <b": "a", "a <b c": "a", "<p>one<p two": "one", "<p>x < y & z": "x < y & z", "<div title='a>b'>in</div>": "in", "<p class=x<b>t</b>": "t", "1 <2 <a href=\"q\">l</a> 3> 4": "1 <2 l 3> 4"}
    for page, want in cases.items():
        assert extract.main_text(page, frozenset(), None) == want


def test_slot_sizes_add_up():
    page = "<body><div><p>abc</p><div><p>de</p></div></div><p>f</p></body>"
    found, tree = extract.blocks(page)
    every = frozenset(tree.place)
    sizes = {(depth, chars) for _, depth, chars in extract.slot_sizes(page, frozenset(), every)}
    assert sizes == {(0, 6), (1, 6), (2, 5), (3, 2)} and [b.text for b in found] == ["abc", "de", "f"]
