"""Pages that name, nest or link their article in awkward ways."""

import time

import pytest

from erspark.llm import html_text

NAV = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
FOOT = "<div class=footer>All rights reserved</div>"


def paragraphs(word, n):
    return [(word + " ") * 40 + f"{word}{i}." for i in range(n)]


def tags(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def text_of(body):
    return html_text.main_text(f"<html><body>{NAV}{body}{FOOT}</body></html>").split("\n\n")


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "layout-sidebar", "content-sidebar-wrap", "with-ads article"])
def test_names_of_a_wrapper_lose_no_article(name):
    a = paragraphs("alpha", 4)
    assert text_of(f'<div class="{name}"><h1>Title</h1>{tags(a)}</div>') == ["Title", *a]


@pytest.mark.parametrize("name", ["comments", "post-comments", "cookieNotice", "related-posts", "ad-slot", "newsletter signup", "site-header"])
def test_named_noise_goes(name):
    a = paragraphs("alpha", 4)
    assert text_of(f'<article><h1>Title</h1>{tags(a)}</article><div class="{name}">{tags(paragraphs("noise", 6))}</div>') == ["Title", *a]
    if name != "site-header":
        assert text_of(f'<article><h1>Title</h1>{tags(a)}<div id="{name.split()[0]}">{tags(paragraphs("noise", 6))}</div></article>') == ["Title", *a]


def test_title_section_and_list_of_an_article():
    a, b = paragraphs("alpha", 2), paragraphs("omega", 6)
    body = f"<article><h1>Title</h1><div class=body>{tags(b)}</div></article>"
    assert text_of(body) == ["Title", *b]
    assert text_of(f"<main><section>{tags(b)}</section><section><h2>Two</h2>{tags(a)}</section></main>") == [*b, "Two", *a]
    assert text_of(f"<article>{tags(a)}<ul><li>one thing</li><li><a href=z>another</a> one</li></ul></article>") == [*a, "one thing", "another one"]
    assert text_of(f"<article>{tags(a)}<table><caption>T</caption><tr><th>k<td>v</table><blockquote>Said</blockquote><pre>x  y</pre></article>") == [*a, "T", "k", "v", "Said", "x y"]


def test_linked_paragraphs_stay_and_lists_of_links_go():
    a = paragraphs("alpha", 3)
    assert text_of(f'<article>{tags(a[:2])}<p><a href="r">The whole report</a></p>{tags(a[2:])}<div><a href=1>one</a></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>') == [*a[:2], "The whole report", a[2]]


def test_hidden_math_and_forms():
    a = paragraphs("alpha", 2)
    assert text_of(f'<article>{tags(a)}<p hidden>no</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><form>{tags(["no"])}</form><div role="complementary">no</div></article>') == [*a, "Let x=2."]


def test_references_and_white_space():
    assert text_of("<article><p> a&nbsp;&lt;b&gt;&#x41;\n\t c<br>d </p><p> </p></article>") == ["a <b>A c d"]


@pytest.mark.parametrize("make", [lambda n: "<div>x" * n, lambda n: "<b>" * n + "<div>x</div>y" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<section>" * n + "</p></span></section2>" * n, lambda n: "<p>x<li>" * n])
def test_time_grows_with_the_page(make):
    def took(n):
        began = time.process_time()
        html_text.main_text(make(n))
        return time.process_time() - began

    took(500)
    assert took(50_000) < 40 * max(took(5_000), 0.05)


def test_clashing_columns_and_ties(spark):
    html = f"<div>{tags(['one two three four'])}</div><div>{tags(['five six seven eight'])}</div>"
    df = spark.createDataFrame([(1, "kept", html, 5, "o"), (2, "kept", None, 6, "o")], "page_id long, url string, html string, n_chars int, __own string")
    got = {r["page_id"]: r.asDict() for r in html_text.extract(df).collect()}
    assert got[2] == {"page_id": 2, "url": "kept", "__own": "o", "text": "", "n_chars": 0}
    assert got[1]["text"] == "one two three four\n\nfive six seven eight" and got[1]["n_chars"] == len(got[1]["text"])
