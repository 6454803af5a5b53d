"""Articles inside elements that look like asides."""

import pytest

from tidemark.llm import htmltext


@pytest.mark.parametrize("wrap", ["<form>{}</form>", "<div class='content with-sidebar'>{}</div>", "<article class='post no-comments'>{}</article>", "<form><div class='no-sidebar'>{}</div></form>"])
def test_wrapped_articles_stay(wrap):
    body = [f"Paragraph {i} " + "of rather plain prose " * 12 for i in range(5)]
    nav = "<nav><ul><li><a href=/>Menu</a><li><a href=/b>More</a></ul></nav>"
    page = f"<html><body>{wrap.format(nav + ''.join(f'<p>{x}</p>' for x in body) + '<div class=comments><p>nice</p></div>')}<footer>foot</footer></body></html>"
    assert htmltext.main_text(page) == "\n".join(" ".join(x.split()) for x in body)
