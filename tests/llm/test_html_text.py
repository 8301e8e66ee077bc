import pytest

from folioseek.llm.html_text import extract_main_text, main_text

LONG = "It was the day of the week on which all of them had to be there, and so they were, as it is with such things when they are to be done by all of us in the time that is left for it."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav>
<div id=cookie-notice>{LONG}</div><!-- <p>{LONG}</p> --><div class="content"><h2>The &lt;title&gt;</h2>
<p>{LONG} <b>bo</b>ld &amp;  more<br>and more.<p>Short.<p>{LONG}<br><br>{LONG}
<div class="post-comments"><p>{LONG} A reader.</p></div></div><aside>{LONG}</aside>
<form>{LONG}<button>Go</button></form><div class=adBanner>{LONG}</div><footer>&copy; {LONG}</footer></body></html>"""


def test_rules_without_an_article():
    assert main_text(PAGE).split("\n") == ["The <title>", f"{LONG} bold & more and more.", "Short.", LONG, LONG]


def test_rules_within_an_article():
    page = PAGE.replace('<div class="content">', "<article><header><h1>Head</h1></header>", 1).replace("</div></div><aside>", "</div></article><aside>")
    assert main_text(page).split("\n") == ["Head", "The <title>", f"{LONG} bold & more and more.", "Short.", LONG, LONG]
    symbols = "<article><p>" + "xx%%% yy$$$ | zz### " * 20 + "</p></article>"  # prose without stop words
    assert main_text(symbols) == ("xx%%% yy$$$ | zz### " * 20).strip()


def test_an_article_is_a_prior_only():
    body, card = f"<div><p>{LONG} {LONG}</p><p>Brief.</p><p>{LONG} {LONG} End.</p></div>", "<article><a href=x>Teaser</a></article>"
    want = [f"{LONG} {LONG}", "Brief.", f"{LONG} {LONG} End."]
    assert main_text(body + card).split("\n") == want  # the text lies outside of the only article
    assert main_text(f"{body}<article class=related><p>{LONG} {LONG} {LONG} {LONG} {LONG}</p></article>").split("\n") == want
    assert main_text(f'{body}<article hidden><p>{LONG} {LONG}</p></article>').split("\n") == want
    article = f"<article><p>{LONG} {LONG} {LONG}</p></article>"
    assert main_text(f"<div>Brief.</div>{article}<div>Brief.</div>") == f"{LONG} {LONG} {LONG}"
    assert main_text(f"{article}<div>{LONG} {LONG}</div>").split("\n") == [f"{LONG} {LONG} {LONG}", f"{LONG} {LONG}"]
    symbols, link = "xx%%% yy$$$ | zz### " * 10, "<p><a href=x>Some link of the list</a></p>"
    assert main_text(f"<article><p>{LONG} {LONG}</p>{link}<p>{symbols}</p>{link}</article>") == f"{LONG} {LONG}"  # stop words are looked at
    assert main_text(f'<main class="sidebar-left"><p>{LONG} {LONG}</p></main>') == f"{LONG} {LONG}"


def test_short_blocks_inherit():
    links = "<p><a href=x>Some link of the list</a></p>"
    assert main_text(f"<p>{LONG} {LONG}</p><p>Brief.</p><p>{LONG} {LONG}</p>").split("\n")[1] == "Brief."
    assert "Brief" not in main_text(f"{links}<p>Brief.</p>{links}<p>{LONG} {LONG}</p>")
    assert main_text("<p>Only this.</p>") == "" and main_text("<article><p>Only this.</p></article>") == "Only this."


TWO = f"<p>{LONG} {LONG}</p><p>Brief.</p><p>{LONG}</p>"


@pytest.mark.parametrize(
    "start", ["<form id=aspnet>", "<fieldset>", '<div class="elementor-widget text">', '<div class="page-with-sidebar">', '<div class="layout-sidebar">',
              '<div class="social-science">', '<section id="legal-analysis">', '<div class="entry-content related">', "<div class=widget><form>"]
)
def test_names_of_whole_pages(start):
    """What is named as no part of an article, but holds the page's prose, is the layout; what it names inside stays out."""
    want = [f"{LONG} {LONG}", "Brief.", LONG]
    inner = f"<div class=sidebar><p>{LONG}</p></div><div class=comments><p>{LONG} {LONG} {LONG} {LONG} {LONG}</p></div>"
    for page in (TWO, TWO + inner, f"<article>{TWO}</article>{inner}"):
        assert main_text(f"<body><p>Site</p>{start}{page}</body>").split("\n")[-3:] == want
    assert main_text(f"<article>{TWO}</article>{start}{TWO}{TWO}").split("\n") == want or "with-sidebar" in start  # beside an article
    assert main_text(f"<body>{TWO}{start}{TWO}").split("\n") == want or "with-sidebar" in start  # beside as much of other prose


def test_doubtful_elements_deep():
    assert main_text("<form><div class=widget>" * 10_000 + TWO) == f"{LONG} {LONG}\nBrief.\n{LONG}"
    page = "".join(f"<div class=widget><p>{LONG}</p>" for _ in range(3_000))
    assert main_text(page).count(LONG) == 1500  # those inside the half that holds most: a bound on work, linear in the page


def test_other_languages_and_brief_pages():
    russian = "Вчера вечером жители города собрались на площади, чтобы отметить начало весны и послушать музыку. " * 3
    links = "<p><a href=x>Some link of the list</a></p>"
    assert main_text(f"{links}<div><h1>Весна</h1><p>{russian}</p><p>Коротко.</p><p>{russian}</p></div>{links}").split("\n") == [
        "Весна", russian.strip(), "Коротко.", russian.strip()]
    assert main_text(f"<div class=cookies>{LONG}</div><p>{russian}</p>") == russian.strip()
    assert main_text("<h1>Closed</h1><p>The shop is closed today.</p>") == "Closed\nThe shop is closed today."
    assert main_text(f"<div class=ad>{LONG}</div><article><p>Brief.</p></article>") == "Brief."
    assert main_text("<h1>Closed</h1><p>Home</p>") == "" == main_text(f"<h1>Closed</h1><p>It is closed.</p>{links}")


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<script>", "<!--", "<p title='a>b", "&#0;&#x110000;&nbsp;", "<a></b></a></p></div>", "a < b", "<br><br>"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_truncated_and_quoted():
    assert main_text(f'<article><p title="a > b">{LONG}</p><p>{LONG[:50]}').split("\n") == [LONG, LONG[:50]]
    assert main_text(f"<article><P>{LONG}</P><script>if (a</b) x</script><p>End.").split("\n") == [LONG, "End."]


def test_long_page_is_whole_and_linear():
    page = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n") == 19_999
    assert main_text("<div " * 20_000) == "" and main_text("<p>" + "'\"" * 20_000) is not None


def test_frame(spark):
    rows = [(1, "u", PAGE, "x", 3), (1, "u", PAGE, "x", 3), (None, None, None, None, None), (2, "v", "", "y", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_main_text(pages).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", len(main_text(PAGE)))] * 2 + [(None, None, 0), (2, "v", 0)]
    assert got[0]["text"] == main_text(PAGE) and got[2]["text"] == ""
    assert extract_main_text(spark.createDataFrame([], pages.schema)).count() == 0
