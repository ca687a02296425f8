"""What is and is not part of an article, and long pages of awkward shapes."""

import time

import pytest

from fairlead.llm.htmltext import _cut

STORY = "<h1>Title</h1><p>First words of the story.</p><p>Second words of it.</p>"
TEXT = "Title\nFirst words of the story.\nSecond words of it."
LONG = "<p>" + "so much more to say about it than the story has " * 40 + "</p>"


def page(*parts):
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>"


AROUND = [
    f"<nav>{LONG}</nav>",
    f"<footer>{LONG}</footer>",
    f"<aside>{LONG}</aside>",
    f'<div class="comments">{LONG}</div>',
    f'<section class="comments-area"><ol><li><article class="comment-body">{LONG}</article></li></ol></section>',
    f'<aside class="related"><article class="card">{LONG}</article></aside>',
    f'<div class="related-posts"><article><h1>Other</h1>{LONG}</article></div>',
    f'<div id="cookie-notice">{LONG}</div>',
    f'<div class="sidebar"><article class="card">{LONG}</article></div>',
    f"<dialog>{LONG}</dialog>",
    f'<div style="display: none">{LONG}</div>',
    f"<form>{LONG}</form>",
]
HOLDERS = ["<article>{}</article>", '<div class="post-content">{}</div>', "<main><div>{}</div></main>", '<div id="a1"><div>{}</div></div>']


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("holder", HOLDERS)
def test_however_long_what_is_around_stays_out(around, holder):
    assert _cut(page(holder.format(STORY), around), None) == TEXT
    assert _cut(page(around, holder.format(STORY)), None) == TEXT


@pytest.mark.parametrize("around", AROUND)
def test_also_inside_of_the_article(around):
    assert _cut(page(f"<article>{STORY}{around}</article>"), None) == TEXT


@pytest.mark.parametrize("wrapper", ['<form id="aspnetForm">{}</form>', '<div class="main with-sidebar">{}</div>', '<div class="content no-comments">{}</div>', '<div class="page-header-fixed">{}</div>'])
def test_wrappers_named_for_the_layout_are_looked_into(wrapper):
    inner = f"<article>{STORY}</article><div class='comments'>{LONG}</div>"
    assert _cut(page(wrapper.format(inner)), None) == TEXT
    assert _cut(page("<div>a logo and a slogan</div>", wrapper.format(inner)), None) == TEXT


@pytest.mark.parametrize("long", ["<svg>" * 180_000, "<b>x<table>" + "<i></b>" * 140_000, "<div><p>x" * 100_000, "<p><i>" * 150_000 + "</p>" * 100_000, "<" * 1_000_000])
def test_long_pages_take_time_in_proportion(long):
    began = time.perf_counter()
    _cut(page(f"<article>{STORY}", long), None)
    assert time.perf_counter() - began < 20  # seconds for about a megabyte; what grows with the square takes minutes
