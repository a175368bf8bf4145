"""Main text of pages: made-up templates whose article is known, words of class and id that name content too, hostile markup."""

from __future__ import annotations

import html
import random
import time

import pytest

from tagstream.llm.extract import main_text

BOILERPLATE = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>",
    '<div class="ad">Buy this now, it is very cheap and very good, really.</div>',
    '<div class="cookie-notice"><p>We use cookies on this site to make all of it better for you.</p></div>',
    '<aside class="sidebar"><p>Popular posts of the week, all of them in one list.</p></aside>',
    '<div id="sidebar-left"><ul><li><a href=/x>One</a></li><li><a href=/y>Two</a></li></ul></div>',
    '<form action="/s"><label>Search</label><input name=q><button>Go</button></form>',
    '<script>var x = "<p>not text</p>";</script><style>p{color:red}</style>',
    '<div class="newsletter-signup">Subscribe to the newsletter and read the best of it each week.</div>',
    '<div class="share-buttons"><a href=#>Tweet</a> <a href=#>Post</a></div>',
    '<div class="related-posts"><h3>More</h3><ul><li><a href=/1>A post</a></li><li><a href=/2>Another</a></li></ul></div>',
    '<section id="comments"><h3>Comments</h3><p>First! I read all of it and want to say a few words about it here.</p></section>',
    '<ol class="comment-list"><li class="comment">I do not agree with any of this, and here is why I think so.</li></ol>',
    '<p hidden>Nobody sees this line of text, as it is hidden.</p><div style="display: none">Nor this line of text here.</div>',
    '<div role="alert">The site goes down for an hour tonight, so save your work.</div>',
]


def sentence(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdeéно") for _ in range(draw.randint(2, 9))) for _ in range(n)).capitalize() + "."


def block(draw: random.Random) -> tuple[str, str]:
    """Markup of a block and its text."""
    text = sentence(draw, draw.randint(12, 60))
    kind = draw.randint(0, 6)
    if kind == 0:
        title = sentence(draw, 4)
        return f'<h2 id="{draw.choice(["related-work", "search", "discussion", "form-validation", "notice"])}">{title}</h2><p>{text}</p>', f"{title}\n\n{text}"
    if kind == 1:
        return f"<p>{text[:20]}<b>{text[20:40]}</b>{text[40:]}", text
    if kind == 2:
        return f"<blockquote>\n {text.replace(' ', chr(10), 3)} \n</blockquote>", text
    if kind == 3:
        return f"<p>{html.escape(text)} &amp; <a href='/z'>{text[:9]}</a></p>", f"{text} & {text[:9]}".strip()
    if kind == 4:
        items = [sentence(draw, 9) for _ in range(3)]
        return "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>", "\n\n".join(items)
    if kind == 5:
        return f'<section id="{draw.choice(["discussion", "search-algorithms", "responses", "related"])}"><p class="social-science">{text}</p><p>{text}</p></section>', f"{text}\n\n{text}"
    return f'<div class="hidden-markov">{text}<br>{text}</div>', f"{text} {text}"


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<article class="post">', ""), ('<div id="content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="xyz">', "</div>"), ('<div role="main">', "</div>")])
def test_made_up_pages(open_, close):
    draw = random.Random(open_)
    marked = "<article" in open_ or "<main" in open_
    for _ in range(60):
        title = sentence(draw, 5)
        blocks = [block(draw) for _ in range(draw.randint(4, 9))]
        inner = [b for b, _ in blocks]
        if marked:
            for _ in range(draw.randint(0, 2)):
                inner.insert(draw.randint(1, len(inner)), draw.choice(BOILERPLATE))
        around = [draw.choice(BOILERPLATE) for _ in range(draw.randint(0, 6))]
        cut = draw.randint(0, len(around))
        body = f"{''.join(around[:cut])}{open_}<h1>{title}</h1>{''.join(inner)}{close}{'' if marked and not close else ''.join(around[cut:])}<footer>&copy; Site, all of it</footer>"
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'><header><h1>Site</h1></header>{body}</body></html>"
        assert main_text(page) == "\n\n".join([title, *(t for _, t in blocks)]), page


def test_a_cut_off_tag_is_left_out():
    assert main_text("<article><p>some words here</p><p>and more <b") == "some words here\n\nand more"
    assert main_text("<p>3 < 4 and a <!-- comment --> b <!-- no end") in ("3 < 4 and a b", "3 < 4 and a b <!-- no end")


LONG = "A long paragraph of the text that this page is about, with many words in it, so that it counts as content. "


def test_teasers_and_real_text_outside():
    teaser = "<article><h2>Teaser</h2><p>Read more about it here, soon.</p></article>"
    real = "".join(f"<p>{LONG * 3}{k}</p>" for k in range(5))
    want = "\n\n".join(f"{LONG * 3}{k}" for k in range(5))
    assert main_text(f"<body>{teaser}<div class=text>{real}</div></body>") == want
    assert main_text(f"<body>{teaser}<main>{real}</main></body>") == want
    assert main_text(f'<body><article>{real}</article><article class="card">{LONG}</article></body>') == want
    assert main_text(f"<body><article>{real}</article><article>{LONG * 2}</article></body>") == f"{want}\n\n{LONG * 2}".strip()
    assert main_text(f'<div class="related-work">{real}</div>') == want


def test_nothing_inside_an_article_goes_on_one_word():
    parts = ['<section id="search-algorithms"><p>{}</p></section>', '<p class="social-science">{}</p>', '<div class="hidden-markov">{}</div>', '<section id="discussion"><p>{}</p></section>', '<div id="notice">{}</div>', "<p>{} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p>", '<table><tr><td>{}</td></tr></table>', '<figure><figcaption>{}</figcaption></figure>']
    for part in parts:
        text = main_text(f"<article><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></article>")
        assert text.count(LONG.strip()) == 3, part
    assert "x+1" in main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p></article>")
    assert main_text(f'<article><p>{LONG}a <span class="hidden">no</span> b</p></article>') == LONG + "a b"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" * 60_000 + "x" + "</i>" * 60_000, "<div><b>" * 30_000 + "</p></i>" * 30_000, "<p><i><hr>" * 30_000, "<div>" + "<b>" * 30_000 + "<hr>" * 30_000, '<div class="related">' * 30_000 + "x y", "<i><div>" * 20_000 + "</i>" * 20_000 + "</table>" * 20_000, "<article>" * 20_000 + "x" + "</main>" * 20_000, "<li class=comment>" * 30_000 + "<form>x", "<p " * 50_000, '<a href="' * 30_000, "<a/b" * 30_000, "<!--" * 50_000, "<p>x</p>" + "<!--" * 50_000 + ">", "</" * 50_000])
def test_deep_and_broken_markup_takes_linear_time(page):
    began = time.time()
    main_text(page)
    small = time.time() - began
    assert small < 4
