"""Main text of awkward pages: broken and deep markup in bounded time, pages without article elements, weak marks."""

import time

import pytest

from tidemark.llm import htmltext

ARTICLE = ["The harbour was quiet that morning, and the boats lay still.", "Short one.", "Nobody had seen the keeper since the storm had passed."]
LINKS = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(8))


@pytest.mark.parametrize(
    "html",
    ["<p>hello</p><![if foo", "<p>hello</p><!-- foo", "<p>hello</p><! foo", "<p>hello</p><![", "<p>hello</p><a href='x", "<p>hello</p></di", "<p>hello</p><?x"],
)
def test_markup_that_never_closes(html):
    assert htmltext.main_text(html) == "hello"


@pytest.mark.parametrize("part", ["<![ ", "<!--", "<a href='", "</", "<div>word ", "<b>", "<div>x<div>", "<a>x", "<", "&", "<li>x<b>", "<div class=comments>", "<article>y "])
def test_time_is_in_proportion(part):
    def took(n):
        start = time.process_time()
        htmltext.main_text("<p>x</p>" + part * n + "<p>end")
        return time.process_time() - start

    took(100)
    assert took(50_000) < 12 * took(12_500) + 0.5  # a quadratic parser takes 16 times as long, and minutes


def test_ratios_find_the_article_without_its_elements():
    body = "".join(f"<p>{p}</p>" for p in ARTICLE)
    page = f"<body><div><ul>{LINKS}</ul></div><div><h1>The keeper</h1>{body}</div><div><ul>{LINKS}</ul></div></body>"
    assert htmltext.main_text(page) == "\n".join(["The keeper", *ARTICLE])
    bare = "".join(f"<p><a href=/{i}>Go {i}</a></p>" for i in range(8)) + body + "".join(f"<p><a href=/{i}>Go {i}</a></p>" for i in range(8))
    assert htmltext.main_text(bare) == "\n".join(ARTICLE)  # no container at all: from the first to the last dense line


def test_clusters_decide_where_regions_end(monkeypatch):
    bare = "<p><b>1</b> <i>2</i> <b>3</b> <i>4</i></p>" * 8 + "".join(f"<p>{p}</p>" for p in ARTICLE)
    found = htmltext.main_text(bare)
    monkeypatch.setattr(htmltext, "threshold", lambda values: float(values.min()))
    assert htmltext.main_text(bare) != found and found.endswith("\n".join(ARTICLE)) and len(found) < len("\n".join(ARTICLE)) + 10


def test_even_pages_are_kept_whole():
    assert htmltext.main_text("<p>hello there friend</p><p>a < b and more</p>") == "hello there friend\na < b and more"


def test_weak_marks_give_way_to_dense_text():
    kept = "<article><p>" + ARTICLE[0] + "</p><div class='share-price'><p>" + ARTICLE[2] + "</p></div><div class='share'><p>" + ARTICLE[1] + "</p></div></article>"
    assert htmltext.main_text(kept) == ARTICLE[0] + "\n" + ARTICLE[2]
    assert htmltext.main_text("<article><p>" + ARTICLE[0] + "</p><div class='share-links'><a href=/>A</a> <a href=/>B</a></div></article>") == ARTICLE[0]
    assert htmltext.main_text("<article><p>" + ARTICLE[0] + "</p></article><div class='comment-list'><p>" + ARTICLE[2] * 3 + "</p></div>") == ARTICLE[0]
