"""Main text of pages: probes of what belongs to an article, pages that never end, votes on repeated parts, an independent reading."""

import re
import time
import tracemalloc
from html import unescape

import pytest

from tidewatch.llm import html_text
from tidewatch.llm.queries import QUERIES

STORY = "The story goes on and on. " * 20
PLAIN = STORY.strip()


def text(page):
    blocks = html_text.blocks_of(page)
    return html_text.text_at(blocks, html_text.best_path(blocks)[0])


@pytest.mark.parametrize("name", "share menu notice widget related popup modal newsletter login promo".split())
def test_article_words_do_not_drop_parts_of_an_article(name):
    assert text(f"<article><p>{STORY}</p><div class={name}><p>About the {name} itself.</p></div></article>") == f"{PLAIN}\nAbout the {name} itself."


@pytest.mark.parametrize("name", "ad-hoc side-effects top-side header-image menu-items foot-care legal search-results copyright-law".split())
def test_words_within_a_class_do_not_condemn_it(name):
    assert text(f"<body><div class=page><div class={name}><p>{STORY}</p></div><div class=more><p>And more of it.</p></div></div>") == f"{PLAIN}\nAnd more of it."


@pytest.mark.parametrize("part", ["<div class=ad>buy</div>", "<div id=comments><p>a reader</p></div>", "<ol class='comment-list'><li>a reader</ol>", "<aside>side</aside>", "<form><p>sign up</form>", "<nav>menu</nav>", "<div role=navigation>menu</div>", "<script>x</script>", "<footer>by them</footer>", "<!-- note -->"])
def test_boilerplate_in_an_article_goes(part):
    assert text(f"<body><article><p>{STORY}</p>{part}<p>The end.</p></article></body>") == f"{PLAIN}\nThe end."


@pytest.mark.parametrize("part", ["<div class=site-footer><p>All rights reserved by us.</p></div>", "<header><p>The name of this site here.</p></header>", "<div class='main_nav'><p>Go here and there today.</p></div>", "<div id=cookie-banner><p>We use cookies on this site.</p></div>", "<div role=banner><p>The name of this site here.</p></div>"])
def test_boilerplate_beside_an_article_without_its_element_goes(part):
    assert text(f"<body>{part}<p>A lead that stands in the body.</p><div class=story><p>{STORY}</p></div>{part}</body>") == f"A lead that stands in the body.\n{PLAIN}"


def test_all_articles_and_leads_of_a_page():
    assert text(f"<body><article class=a><p>One. {STORY}</p></article><article class=b><p>Two.</p></article></body>") == f"One. {PLAIN}\nTwo."
    lead = "A lead of some words that opens it."
    assert text(f"<body><div class=lead><p>{lead}</p></div><div class=story><p>{STORY}</p></div></body>") == f"{lead}\n{PLAIN}"


def test_forms_around_pages_and_in_them():
    assert text(f"<body><form action=x><div class=main><p>{STORY}</p><input><button>Go</button></div></form></body>") == PLAIN
    assert text("<body><form action=x><article><p>short</p></article></form></body>") == "short"
    assert text(f"<body><form><p>sign in</p></form><div><p>{STORY}</p></div><form><p>find</p></form></body>") == PLAIN
    assert text("<body><form><p>sign in</p></form></body>") == ""


ENDLESS = {
    "tag": "<a " * 350_000,
    "inline": "<font>x" * 150_000,
    "block": "<div>word word " * 70_000,
    "quote": '<a "x>y" ' * 110_000 + "'",
    "list": "<section>" * 100_000 + "<ul><li>a" * 10_000,
    "paragraph": "<ul><li>" + "<section>" * 50_000 + "<p>a" * 100_000,
    "script": "<script>" + "</script " * 110_000,
    "comment": "<!-- " * 200_000,
    "class": '<p class="' * 100_000,
    "form": "<form>" * 150_000 + "<p>x",
    "article": "<article>" * 100_000 + "text " * 10_000,
    "end": "</b>" * 250_000,
    "link": "<a>x" * 200_000,
    "advert": "<span class=ad>x" * 65_000,
    "kinds": "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>w" for i in range(50_000)),
}


@pytest.mark.parametrize("name", ENDLESS)
def test_broken_pages_take_linear_time(name):
    began = time.process_time()
    page = html_text.blocks_of(ENDLESS[name])
    html_text.text_at(page, html_text.best_path(page)[0], [1])
    html_text.doubts(page)
    assert time.process_time() - began < 12


@pytest.mark.parametrize("name", ["tag", "inline", "quote", "class"])
def test_broken_pages_take_little_memory(name):
    tracemalloc.start()
    html_text.blocks_of(ENDLESS[name][:200_000])
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_unending_tags_keep_text():
    assert text("<article><p>before <a href=x and after") == "before <a href=x and after"
    assert text("<article><p>a < b and c <3 d</p></article>") == "a < b and c <3 d"
    assert text('<article><p title="a>b">in <i>it</p><p>and <b class=">x</b>y</p></article>').startswith("in it\nand")


def test_hosts_vote_on_repeated_parts(spark):
    page = "<article><p>Story {0} of {0}. {1}</p><div class=notice><p>{2}</p></div></article>"
    rows = [(i, "http://a.net/x", page.format(i, STORY, "We have moved.")) for i in range(6)]
    rows += [(10 + i, "http://b.net/x", page.format(i, STORY, f"A note on story {i}.")) for i in range(6)]
    rows += [(20 + i, "http://c.net/x", page.format(1, STORY, "We have moved.")) for i in range(6)]  # copies of one page
    got = {r.page_id: r.text.split("\n")[1:] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == [] for i in range(6))
    assert all(got[10 + i] == [f"A note on story {i}."] and got[20 + i] == ["We have moved."] for i in range(6))


def test_votes_tie_and_rows_repeat(spark):
    a, b = f"<body><div class=a><p>{STORY}</p></div></body>", f"<body><div class=b><p>{STORY}</p></div></body>"
    rows = [(1, "http://h.net", a), (1, "http://h.net", a), (2, "http://h.net", b), (3, "http://h.net", b), (None, "http://h.net", None)]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(i, PLAIN, len(PLAIN)) for i in (1, 1, 2, 3)] + [(None, "", 0)], key=str)


def plain_article(html):
    """The article by patterns alone: block tags are line breaks, other tags vanish, br is a blank."""
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    lines = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", inner)
    cells = (unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))) for x in lines)
    return "\n".join(x for x in (" ".join(c.split()) for c in cells) if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_page_as_an_independent_reading(spark, sf):
    folder = f"/root/testdata/{sf}"
    want = {r.page_id: plain_article(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op8_html_extraction"](spark, folder).collect()}
    assert got == want
