import html
import random
import re

import numpy as np
import pytest

from plotline.llm import extraction as E
from plotline.llm.shared import table

SENTENCE = "The council met on Tuesday to talk about the bridge, and agreed that it should be mended before winter comes."
BODY = [SENTENCE + " " + SENTENCE, "Short one.", SENTENCE * 3, "Nobody spoke against it.", SENTENCE * 2]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Page {k}</a></li>" for k in range(6)) + "</ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Paper. All rights reserved in every country of the world.</p></footer>"
HEAD = "<head><title>Bridge &amp; tunnel</title><style>p{margin:0}</style><script>var a='<p>no text</p>';</script></head>"
TITLE = "Bridge to be mended"
WANTED = "\n\n".join([TITLE, *BODY])


def page(body, head=HEAD):
    return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


LAYOUTS = {
    "article": f"{MENU}<div class='ad'>Buy {SENTENCE}</div><article><h1>{TITLE}</h1>{PARAGRAPHS}</article>{FOOT}",
    "main": f"<header><h1>The Paper</h1>{MENU}</header><main><h1>{TITLE}</h1>{PARAGRAPHS}</main><aside><p>{SENTENCE}</p></aside>{FOOT}",
    "divs": f"<div id='header'>The Paper</div><div class='top-menu'>{MENU}</div><div id='content'><h1>{TITLE}</h1>{PARAGRAPHS}</div><div class='sidebar'><p>{SENTENCE}</p></div>",
    "title outside": f"{MENU}<div class='page'><h1>{TITLE}</h1><div class='text'>{PARAGRAPHS}</div></div>{FOOT}",
    "sections": f"{MENU}<article><h1>{TITLE}</h1><section>{PARAGRAPHS[: PARAGRAPHS.index('<p>Nobody')]}</section><section>{PARAGRAPHS[PARAGRAPHS.index('<p>Nobody') :]}</section></article>",
    "body": f"{MENU}<h1>{TITLE}</h1>{PARAGRAPHS}{FOOT}",
    "plain menu": f"<div><a href='/'>Home</a> | <a href='/a'>About us</a></div><h1>{TITLE}</h1>{PARAGRAPHS}<p><a href='/x'>Imprint</a> <a href='/y'>Contact</a></p>",
    "notice": f"<div class='cookie-notice'><p>{SENTENCE} {SENTENCE}</p><button>Yes</button></div><article><h1>{TITLE}</h1>{PARAGRAPHS}</article>",
    "comments": f"<article><h1>{TITLE}</h1>{PARAGRAPHS}</article><section id='comments'><h2>Readers say</h2><article class='comment'><p>{SENTENCE * 4}</p></article></section>",
    "comments inside": f"<article><h1>{TITLE}</h1>{PARAGRAPHS}<div class='commentList'><article><p>{SENTENCE * 9}</p></article></div></article>",
    "form": f"<form><label>Search</label><input name='q'><select><option>one<option>two</select></form><article><h1>{TITLE}</h1>{PARAGRAPHS}<form><p>Your mail address, please</p></form></article>",
    "marked around": f"<div class='layout sidebar-right'><article><h1>{TITLE}</h1>{PARAGRAPHS}</article></div>",
    "negated": f"<div class='has-sidebar'><h1>{TITLE}</h1>{PARAGRAPHS}</div>",
    "advert inside": f"<article><h1>{TITLE}</h1>{PARAGRAPHS.replace('<p>Short', '<div class=ad-slot><p>Buy now, buy cheap, buy often!</p></div><p>Short')}</article>",
    "title in header": f"<header>The Paper</header><article><header><h1>{TITLE}</h1><p>by someone</p></header>{PARAGRAPHS}</article>",
    "title in marked header": f"<div id='siteHeader'><h1>The Paper</h1></div><article><div class='post-header'><h1>{TITLE}</h1><p>by someone</p></div>{PARAGRAPHS}</article><div class='ADS'>{SENTENCE}</div>",
    "table": f"<table><tr><td>{MENU}</td><td><h1>{TITLE}</h1>{PARAGRAPHS}</td></tr></table>",
    "roles": f"<div role='banner'>The Paper</div><div role='navigation'>{SENTENCE}</div><div role='main'><h1>{TITLE}</h1>{PARAGRAPHS}</div><div role='contentinfo'>{SENTENCE}</div>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert E.main_text(page(LAYOUTS[layout])) == WANTED


def test_short_paragraphs_at_the_ends_stay():
    texts = ["One.", "Two.", *BODY, "Three."]
    plain = "".join(f"<p>{t}</p>" for t in texts)
    for before, after in (("", ""), (MENU, FOOT), ("<ul><li><a href='/'>Home</a><li><a href='/b'>News</a></ul>", "")):
        assert E.main_text(page(f"{before}<h1>{TITLE}</h1>{plain}{after}")) == "\n\n".join([TITLE, *texts])


def test_text_within_blocks():
    body = "<article><h1>Caf&eacute;&nbsp;&#8211; <i>new</i>\n\t menu</h1><p>one<br>two <b>th</b>ree<p>four &lt;five&gt; &amp;amp; six &#x1F600;<li>a<li>b<!-- no --><table><tr><td>c<td>d</table>"
    inline = "<article><p>one <script>x()</script>two <span class='ad'>buy <b>now</b></span>three <svg><text>four</text></svg><math>x=1</math></p><span class='ad'><p>five</p></span></article>"
    assert E.main_text(inline) == "one two three x=1"
    assert E.main_text(body) == "Café – new menu\n\none two three\n\nfour <five> &amp; six 😀\n\na\n\nb\n\nc\n\nd"


def test_pages_without_text_and_broken_ones():
    assert [E.main_text(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- open", MENU)] == [""] * 7
    assert E.main_text("just words") == "just words"
    assert E.main_text("<p>one</b></i></div><p>two <a href='x") == "one\n\ntwo"
    assert E.main_text(f"<head><title>t<p>{SENTENCE}") in (SENTENCE, "")  # a title that never ends holds the rest
    assert E.main_text(f"<head><meta charset=utf-8><p>{SENTENCE}") == SENTENCE


def test_very_long_and_deep_pages():
    words = " ".join(["word"] * 200_000)
    assert E.main_text(page(f"{MENU}<article><p>{words}</p></article>")) == words
    assert E.main_text("<div>" * 5000 + SENTENCE) == SENTENCE
    many = "".join(f"<p>{k} {SENTENCE}" for k in range(5000))
    assert E.main_text(page(f"<article>{many}</article>")).count("\n\n") == 4999
    assert E.main_text("<b>" * 20_000 + "</i>" * 20_000 + SENTENCE + "</p>" * 20_000) == SENTENCE


def test_smoothing_and_threshold_against_plain_sums():
    rng = random.Random(2)
    values = np.array([rng.choice((1.0, 300.0)) * rng.random() for _ in range(30)])
    for k, got in enumerate(E.smoothed(values)):
        near = {j: np.exp(-((j - k) ** 2) / 2) for j in range(max(0, k - 3), min(30, k + 4))}
        assert abs(got - sum(w * values[j] for j, w in near.items()) / sum(near.values())) < 1e-9
    assert len(E.smoothed(np.array([2.0]))) == 1
    cut = E.threshold(np.array([1.0, 2, 3, 101, 102, 103]))
    assert abs(cut - 52) < 1e-6 and E.threshold(np.array([7.0, 7.0])) == 7


def by_pattern(source):
    """The article of a page whose layout is known, cut out by patterns."""
    inner = re.sub(r"</?(p|h1)>", "\n", re.search("<article>(.*)</article>", source, re.S)[1])
    inner = re.sub("</?b>", "", inner.replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(line).split()) for line in inner.split("\n")) if x)


def test_whole_table_against_patterns(spark, tiny):
    pages = table(spark, tiny, "pages")
    found = {r["page_id"]: r for r in E.extract_text(pages).collect()}
    given = pages.collect()
    assert len(found) == len(given)
    for r in given:
        got = found[r["page_id"]]
        assert (got["url"], got["text"], got["n_chars"]) == (r["url"], by_pattern(r["html"]), len(got["text"]))


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, _id string"
    rows = [(1, None, None, "x", 1, "y"), (None, "u", "", "x", 1, "y"), (2, "u", "<p>a</p>", None, None, None), (2, "u", "<p>a</p>", "x", 1, "y")]
    found = E.extract_text(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1)], key=str)
    assert not E.extract_text(spark.createDataFrame([], schema)).collect()
