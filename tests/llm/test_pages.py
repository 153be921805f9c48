"""Long and broken pages in linear time, and what is text of a page."""

import time

import pytest

from saleslens.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.labelled_pages())


PROSE = "This is a paragraph of the article with a good number of plain words in it, as articles have."


def page(body):
    return f"<html><head><title>x</title></head><body><nav><a href='/'>home</a></nav><article><h1>A title</h1><p>{PROSE}</p>{body}<p>{PROSE}</p></article></body></html>"


@pytest.mark.parametrize("body", [
    "<p>" + "word<br>" * 100_000 + "</p>", "<a " * 100_000, "<a \"" * 100_001, "<" * 100_000, "<!x " * 100_000, "<select>" * 50_000, "<b>" * 50_000 + "<h1>" * 50_000,
    "<div>" * 50_000 + "</foo>" * 50_000, "<foo " + "x='" * 100_001, "</p>" * 100_000, "<?" * 100_000, "<!--" * 100_000, "<p>" * 100_000, "<span>a</span>" * 60_000])
def test_long_pages_take_seconds(body, model):
    start = time.process_time()
    H.main_text(page(body), model)
    assert time.process_time() - start < 20


def test_formulas_and_noscript_are_text(model):
    got = H.main_text(page(f"<p>{PROSE} The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> is known.</p>"
                           f"<noscript><p>{PROSE} Without scripts.</p></noscript><video>no video here</video>"), model)
    assert f"{PROSE} The sum a+b is known." in got.split("\n\n") and f"{PROSE} Without scripts." in got and "no video" not in got


def test_bare_signs_are_text(model):
    got = H.main_text(page(f"<p>{PROSE} if a<b then c, 3 < 4 and d<e</p><p>{PROSE} \"quoted' and <em title=\"a>b\">said</em></p>"), model)
    assert f"{PROSE} if a<b then c, 3 < 4 and d<e" in got.split("\n\n") and f"{PROSE} \"quoted' and said" in got


def test_tags():
    def tags(text):
        found, at, scan = [], 0, H._Tags(text)
        while at < len(text):
            begin, at, slash, name, raw = scan.after(at)
            if name:
                found.append((slash + name, raw))
        return found

    assert tags("<a href='x>y'>t</A ><br/><!-- <b> --><i") == [("a", " href='x>y'"), ("/a", " "), ("br", "/")]
    assert tags("<p title=it's>x</p>") == [("p", " title=it's"), ("/p", "")]
    assert tags("a < b <c <d>") == [("d", "")]
