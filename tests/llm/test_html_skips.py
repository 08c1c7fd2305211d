"""Pages whose skipped elements lack an end, and scripts that look like tags."""

import time

import pytest

from noticelake.llm import html_text

BODY = "<article><h1>News of the day</h1><p>The first paragraph of an article of some length.</p><p>Short.</p></article>"
TEXT = "News of the day\n\nThe first paragraph of an article of some length.\n\nShort."
AFTER = "<article><p>The first paragraph of an article of some length.</p></article>"
LINE = "The first paragraph of an article of some length."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body>{BODY}",
        f"<html><head><title>x</title><meta charset=utf-8>{BODY}</html>",
        f"<html><head><script>if (a<b) s = \"'</b>\";</script></head><body>{BODY}",
        f"<html><head><script>s='<head>'; t=a<b\";</script></head><body>{BODY}<p class=\"x\"></p>",
        f"<head><style>a:after{{content:'</head'}}</style><title>a<b\"</title></head>{BODY}",
    ],
)
def test_a_head_loses_no_page(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["svg", "button", "select", "object", "math", "template"])
def test_a_skip_ends_with_its_container(name):
    assert html_text.main_text(f"<body><div><{name}><i>x</i></div>{AFTER}") == LINE
    assert html_text.main_text(f"<body><table><tr><td><{name}>x</td></tr></table>{AFTER}") == LINE
    assert html_text.main_text(f"<body><div><{name}><div>x</div></{name}>{AFTER}</div>") == LINE
    assert html_text.main_text(f"<body><div><{name}>x</{name}>{AFTER}") == LINE
    assert LINE in html_text.main_text(f"<body><{name}>{AFTER}")


def test_scripts_in_skipped_elements_are_raw():
    for inner in ("<script>a<b\"; '<button>'</script>", "<style>x{content:'<svg>'}</style>"):
        for name in ("button", "object", "template", "svg"):
            assert html_text.main_text(f"<body><div><{name}>{inner}</{name}></div>{AFTER}<p class=\"\"></p>") == LINE
    assert html_text.main_text(f"<body><svg><title/><path/></svg>{AFTER}") == LINE
    assert html_text.main_text(f"<body><svg><foreignObject><div>no</div></foreignObject></svg>{AFTER}") == LINE
    assert html_text.main_text(f"<body><button>a<button>b</button>{AFTER}") == LINE


PARA = "A long paragraph of the article that says what has to be said about the matter in so many words and then some more of them."


@pytest.mark.parametrize(
    "outer",
    ['<div class="content has-sidebar">', '<div class="post-content comments-open">', '<div id="main" class="header-fixed">', "<body class='sidebar menu'><div>", "<form id=aspnetForm><div id=content>", "<div class=no-sidebar>", "<main class='notice'>"],
)
def test_classes_that_only_mention_furniture(outer):
    assert html_text.main_text(f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>{outer}<p>{PARA}</p><p>{PARA} Again.</p></div>") == f"{PARA}\n\n{PARA} Again."


def test_the_head_of_an_entry_stays():
    page = f'<div class="entry"><div class="entry-header"><h1>A title of some words</h1></div><p>{PARA}</p></div><div class="comment-list"><p>{PARA}</p></div><article class="comment"><p>{PARA}</p></article>'
    assert html_text.main_text(page) == f"A title of some words\n\n{PARA}"


def test_neighbours_decide_where_nothing_is_marked():
    links = "<div><a>More news</a></div><div><a>Other news of today</a></div>"
    assert html_text.main_text(f"{links}<p>{PARA}</p><p>Yes.</p><p>{PARA}</p>{links}<div>Write to us at any time</div>{links}") == f"{PARA}\n\nYes.\n\n{PARA}"
    tree, used = html_text.block_tree(), set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(html_text.FEATURES[t[0]])
            walk(t[2]), walk(t[3])

    walk(tree)
    assert used & {"words_before", "density_before"} and used & {"words_after", "density_after"}


def test_attributes_by_the_rules_of_html():
    for tag in ("<p title=don't>", "<p title='a>b' x>", '<p a = "1>2"b>', "<p =x>", "<p/>", "<p title=\"it's\">", "<p\n class\n=\n'x'\n>", "<p title=a\"b>"):
        assert html_text.main_text(f"<article>{tag}{PARA}</p>{tag}Short.</p></article>") == f"{PARA}\n\nShort.", tag
    assert html_text.main_text(f'<article><p title="no end>{PARA}</p><p>{PARA}</p></article>').endswith(PARA)
    assert html_text.main_text(f"<article><p>{PARA}</p><p>a <3 b</p><p clas") == f"{PARA}\n\na <3 b"


@pytest.mark.parametrize("piece", ["<a ", "<p title=\"x ", "<svg><title>", "<p title=don't>", "<!-- ", "<script>", "< ", "<div><button>", "<div a=b></section>", "<p x='y>"])
def test_a_page_of_a_megabyte_takes_little_time(piece):
    began = time.process_time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 6


def test_empty_repeated_and_clashing(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>", "x", 1)] * 2 + [(2, None, "", "y", 2), (None, "v", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    assert got == [(0, "", 0), (1, PARA, len(PARA)), (1, PARA, len(PARA)), (2, "", 0)]
    assert html_text.extract_text(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract_text(pages.limit(0)).count() == 0


def test_formulas_stay_and_references_end_with_their_piece_of_text(spark):
    from noticelake.llm import html_text

    long = "This is the main text of the page, which is long enough to be told from what stands around it, sentence after sentence. " * 3
    page = f"<body><article><p>{long}</p><p>The value of <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> is here; {long}</p><p>a &lt<i>;</i> b &amp;lt; {long}</p></article></body>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = html_text.extract_text(df).first().text
    assert "The value of x is here;" in text and "a <; b &lt;" in text and "\\x" not in text
