import html as entities
import random
import time

import pytest

from tessera.llm import html

PROSE = "Some more prose stands here, long enough to be found. " * 3


def page(inside, marked=True):
    tag = "article" if marked else "div"
    return f"<html><body><nav><a href=x>Menu</a></nav><{tag}><h1>Title</h1>{inside}<p>{PROSE}</p></{tag}><footer>All rights</footer></body></html>"


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<p title=it's>Hello, don't stop here.</p>", "Hello, don't stop here."),
        ('<p data-id="comments-3">Kept.</p>', "Kept."),
        ('<p title="a hidden gem">Kept.</p>', "Kept."),
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<p class="social-science">Kept.</p>', "Kept."),
        ("<p>See <a href=y>a link that is most of this paragraph</a>.</p>", "See a link that is most of this paragraph."),
        ("<p><a href=y>Nothing but a link</a></p>", "Nothing but a link"),
        ("<p>Short.</p><div class=ad>Buy</div>", "Short."),
        ("<ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a><li><a>five</a></ul>", None),
        ("<header><h2>Headline</h2><p>by someone</p></header>", "Headline" ),
        ("<div class='cookie-banner'>Cookies?</div><section id=comments><p>First!</p></section>", None),
        ("<p hidden>gone</p><p style='color:red; display: none'>gone</p><p>a &lt; b&nbsp;&amp; c<br>d &#233;</p>", "a < b & c d é"),
        ("<p>1 < 2 and 3 > 2<script>if (a</p>) b()</script></p>", "1 < 2 and 3 > 2"),
        ("<p>open <b>bold</p><p>closed</b></p>", "open bold closed"),
    ],
)
def test_what_the_article_keeps(inside, text, marked):
    if "header" in inside and not marked:
        text = None  # a header outside of an article is the page's
    want = " ".join(filter(None, ["Title", text, PROSE.strip()]))
    assert html.main_text(page(inside, marked)) == want


def test_text_outside_of_a_marked_article_needs_far_more():
    inner = page("")
    assert html.main_text(inner.replace("</article>", "</article><div>A line of some eighty characters that nobody marked as anything at all.</div>")) == f"Title {PROSE.strip()}"
    long = "A second part of the text that its author put outside of the article. " * 10
    assert html.main_text(inner.replace("</article>", f"</article><p>{long}</p>")) == f"Title {PROSE.strip()} {long.strip()}"


def test_awkward_pages():
    assert [html.main_text(p) for p in (None, "", "<p>", "<!-- x", "<script>x", "<a t=it's" * 3)] == [""] * 6
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<p>Few words</p>") == "Few words"
    assert html.main_text('<article><p>Before <a title="x>y</a> the quote never ends</p></article>').startswith("Before")


@pytest.mark.parametrize("bad", ["<a t=it's", "<a t='x ", '<p class="x', "</x>", "<div>", "<", "<!--", '<div class="ad">', "</p><td>", "<div></span>"])
def test_broken_markup_takes_linear_time(bad):
    began = time.process_time()
    html.main_text(bad * 8000)
    assert time.process_time() - began < 0.5


def generate(rng):
    """A page and, by construction, its main text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    marked = rng.random() < 0.5
    want, inside = [], []

    def keep(tag, text, attributes=""):
        want.append(text)
        shown = entities.escape(text)
        if rng.random() < 0.3 and " " in shown:
            head, tail = shown.split(" ", 1)
            shown = f"<{(t := rng.choice('bi'))}>{head}</{t}>" + rng.choice([" ", "\n", "\t ", "<br>"]) + tail
        inside.append(f"<{tag}{attributes}>{shown}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"))

    keep("h1", line(rng.randint(1, 8)))
    keep("p", line(rng.randint(60, 90)))
    for _ in range(rng.randint(0, 12)):
        kind = rng.randrange(8)
        if kind < 3:
            keep("p", line(rng.choice([1, 2, 5, 40, 120])), rng.choice(["", " title=it's", ' data-id="menu"', ' class="lead"', " id=footer"]))
        elif kind == 3:
            keep("h2", line(2), rng.choice(["", ' id="comments"']))
        elif kind == 4:
            inside.append("<ul>")
            for _ in range(3):
                keep("li", line(rng.randint(3, 9)) + " & <" + word() + ">")
            inside.append("</ul>")
        elif kind == 5:
            inside.append(rng.choice(["<div class=ad>", '<aside id="x">', '<div role="complementary">', "<form>", '<div class="share-buttons">', "<section hidden>"]))
            inside.append(f"<p>{line(30)}</p>")
            inside.append("</" + inside[-2][1:].split(" ")[0].rstrip(">") + ">")
        elif kind == 6:
            inside.append(f"<!-- {line(4)} <p> --><script>var x = '<p>{line(3)}</p>';</script><style>p {{}}</style>")
        else:
            keep("blockquote", line(rng.randint(1, 30)))
    keep("p", line(20))
    tag = rng.choice(["article", "main"]) if marked else "div"
    menu = "".join(f"<li><a href=/{word()}>{line(2)}</a></li>" for _ in range(rng.randint(0, 8)))
    before = rng.choice(["", f"<header><div>{line(6)}</div></header>", f"<nav><ul>{menu}</ul></nav>", f"<ul>{menu}</ul>" if not marked else "", f'<div class="sidebar">{line(90)}</div>'])
    after = rng.choice(["", f"<footer>&copy; {line(4)}</footer>", f'<section class="comments"><article class="comment"><p>{line(40)}</p></article></section>', f'<div id="related">{line(9)}</div>'])
    return f"<!DOCTYPE html><html><head><title>{line(3)}</title></head><body>{before}<{tag}>{''.join(inside)}</{tag}>{after}</body></html>", " ".join(" ".join(want).split())


def test_generated_pages():
    rng = random.Random(3)
    for k in range(500):
        source, want = generate(rng)
        assert html.main_text(source) == want, (k, source)


def test_query_keeps_rows_and_columns(spark):
    rows = [(1, "u", page(""), 5), (1, "u", page(""), 5), (None, None, None, None), (3, "v", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    whole = f"Title {PROSE.strip()}"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", whole, len(whole))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html.extract(pages.limit(0)).count() == 0
