"""Pages whose article is split over several containers."""

from erspark.llm import html_text

NAV = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
FOOT = "<div class=footer>All rights reserved</div>"


def paragraphs(word, n):
    return [(word + " ") * 66 + f"{word}{i}." for i in range(n)]


def tags(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_all_sections_of_an_article():
    a, b = paragraphs("alpha", 5), paragraphs("omega", 8)
    page = f"<body>{NAV}<article><h1>Title</h1><section>{tags(a)}</section><section>{tags(b)}</section></article>{FOOT}</body>"
    assert html_text.main_text(page).split("\n\n") == ["Title", *a, *b]


def test_title_and_lead_beside_the_body():
    lead, b = paragraphs("lead", 1), paragraphs("omega", 8)
    page = f"<body>{NAV}<div id=wrap><h1>Title</h1>{tags(lead)}<div class=body>{tags(b)}</div></div>{FOOT}</body>"
    assert html_text.main_text(page).split("\n\n") == ["Title", *lead, *b]


def test_articles_side_by_side():
    a, b = paragraphs("alpha", 3), paragraphs("omega", 8)
    page = f"<body>{NAV}<article>{tags(a)}</article><article>{tags(b)}</article>{FOOT}</body>"
    assert html_text.main_text(page).split("\n\n") == [*a, *b]


def test_captions_stay():
    b = paragraphs("omega", 4)
    page = f"<body>{NAV}<article>{tags(b[:2])}<figure><img src=x><figcaption>A caption</figcaption></figure>{tags(b[2:])}</article>{FOOT}</body>"
    assert html_text.main_text(page).split("\n\n") == [*b[:2], "A caption", *b[2:]]
