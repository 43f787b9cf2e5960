"""Pages without a body or an element keep their prose; pages of menus alone have none."""

from chronoglass.llm import html_text

PAGES = {
    "<p>First words of a page without a body, quite a few.</p><p>And a second paragraph follows it here.</p>": "First words of a page without a body, quite a few.\nAnd a second paragraph follows it here.",
    "Just text &amp; nothing else": "Just text & nothing else",
    "<html><body><nav><a href=/>Home</a> <a href=/x>Other</a></nav><footer>&copy; x</footer></body></html>": "",
    "<div class=menu><a href=/>Home</a></div>": "",
    "<a href=/>Home</a><script>x()</script>": "",
    "": "",
}


def test_bare_pages():
    assert dict(zip(PAGES, html_text.main_text(html_text.trained(), list(PAGES)), strict=True)) == PAGES


def test_generated_pages():
    """A rescue finds no text where there is none, and makes no page worse."""
    make, forest = html_text._Pages(777), html_text.trained()
    better = empty = 0
    for _ in range(60):
        page, kept = html_text._labelled(make.page())
        want = html_text.text_of(page, kept)
        got = html_text.text_of(page, html_text.decode(page, forest.log_odds(html_text.features([page]))))
        saved = got or html_text.plain_text(page)
        assert want or not saved
        empty += not want
        better += (saved == want) - (got == want)
    assert empty >= 5 and better >= 1
