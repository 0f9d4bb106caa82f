"""HTML extraction: whole tables against an element reader of its own, and the rules of either pass one by one."""

import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from runweave.llm import html_text, queries

SF = "/root/testdata/sf0.001"
LONG = "The cat is on the mat and it was a good day for all of us. " * 6
INLINE = {"a", "b", "i", "em", "strong", "span", "br", "code", "sup", "sub", "small"}


class Article(HTMLParser):
    """Blocks of the article elements of pages that hold no layout inside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def by_reader(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    return "\n\n".join(" ".join(b.split()) for b in reader.blocks if b.strip())


def test_the_query_gives_the_articles_of_the_whole_table(spark):
    got = {r.page_id: r for r in queries.queries()["op5_html_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, by_reader(r.html)) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_both_passes_decide_blocks(spark):
    decided = {"good": 0, "short": 0}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        found, vetoes = html_text.blocks(r.html)
        html_text.rule_out(found, vetoes, html_text.counted(found))
        for label in html_text.first_pass(found):
            decided[label] = decided.get(label, 0) + 1
    assert decided["good"] > 100 and decided["short"] > 100


def test_without_an_article_the_passes_find_most_of_it(spark):
    found = total = junk = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = by_reader(r.html).split("\n\n")
        got = html_text.main_text(r.html.replace("<article", "<div").replace("</article", "</div")).split("\n\n")
        total += sum(map(len, want))
        found += sum(len(x) for x in want if x in got)
        junk += sum(x not in want for x in got if x)
    assert junk == 0 and found > 0.8 * total


def test_html(spark):
    page = "<html><head><title>t</title><script>'</p>'</script></head><body><nav><a href=x>menu</a></nav><header>top</header><article><h1>A &amp; B</h1><p>One <b>two\n three<br>four<p>Five</p><aside>note</aside></article><div class=comments><p>" + "it is the best of all " * 9 + "</p></div><footer>&copy;</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("block", F.lit(1))
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect())
    assert got == [(1, "A & B\n\nOne two three four\n\nFive")] * 2 + [(2, ""), (3, ""), (4, "")]
    empty = html_text.extract_text(df.limit(0))
    assert empty.columns == ["page_id", "url", "text"] and empty.count() == 0


def test_short_blocks_follow_their_neighbours():
    long = f"<p>{LONG}</p>"
    assert "Short." in html_text.main_text(f"<div>{long}<p>Short.</p>{long}</div>")
    assert "Short." not in html_text.main_text(f"<div>{long}</div><p>Short.</p><div class=menu>{long}</div>")
    # the page's ends are no neighbours; of two that differ the nearer one decides
    assert html_text.main_text(f"<p>First.</p>{long}<p>Last.</p>").split("\n\n")[::2] == ["First.", "Last."]
    assert html_text.main_text(f"{long}<p>Near.</p><p>Far.</p><p>Farther.</p><nav>menu</nav>").split("\n\n")[1:] == ["Near."]
    assert html_text.main_text("<p>Only.</p>") == ""


def test_densities_decide_outside_articles():
    assert html_text.main_text(f"<p>{LONG}</p><p>{'buy now cheap offers today ' * 9}</p><p>{LONG}</p>").count("cheap") == 0
    linked = f"<p><a href=x>{LONG}</a></p>"
    assert html_text.main_text(f"<p>{LONG}</p>{linked}") == LONG.strip()
    other = "東京は日本の首都であり世界最大の都市の一つである" * 8
    assert html_text.main_text(f"<p>{other}</p><p>短い。</p><p>{other}</p>") == f"{other}\n\n短い。\n\n{other}"


def test_nothing_outside_a_decided_article_stays():
    assert html_text.main_text(f"<article><p>{LONG}</p></article><p>{LONG}</p><p>Short.</p>") == LONG.strip()
    # an article that pass 1 finds no good block in leaves the rest of the page to the passes
    assert html_text.main_text(f"<article><p>Teaser</p></article><p>{LONG}</p>") == f"Teaser\n\n{LONG.strip()}"


def test_linked_blocks_of_an_article_stay():
    page = "<article><p>See <a href=x>the full report of the committee</a>.</p><ul><li><a href=y>A source</a><li><a href=z>Another</a></ul><nav><a href=n>menu</a></nav></article>"
    assert html_text.main_text(page) == "See the full report of the committee.\n\nA source\n\nAnother"


def test_open_anchors_end_and_links_around_blocks_do_not():
    for opened in ("<a name=top>", "<a id='href=x' name=top>", "<a href=x>"):
        assert html_text.main_text(f"<div>{opened}<p>{LONG}</p><p>{LONG}</p></div>") == "\n\n".join([LONG.strip()] * 2)
        assert html_text.main_text(f"<div>{opened}<p>{LONG}</p><a name=b></a><p>{LONG}</p></div>") == "\n\n".join([LONG.strip()] * 2)
    assert html_text.main_text(f"<div><a href=x><p>{LONG}</p></a></div>") == ""


def test_articles_override_layout_words():
    for outer in ("<div class='page has-sidebar'>", "<div id=share>", "<div class=overlay>", "<body class=menu-open>"):
        assert html_text.main_text(f"{outer}<article><p>One.</p><div class=share>Share it</div></article><div class=menu><p>Two.</p></div></div>") == "One."
        assert html_text.main_text(f"{outer}<main><p>One.</p></main></div>") == "One."
    assert html_text.main_text("<main class=sidebar-right><p>One.</p></main>") == "One."
    assert html_text.main_text("<article><p>One.</p><div class=comments><article><p>No.</p></article></div></article><article class=comment-body>No.</article><aside><article>No.</article></aside>") == "One."


def test_classes_of_elements_with_implied_ends():
    assert html_text.main_text("<article><p>One.<p class=ad>Buy now!<p>Two.<div>Three.</div></article>") == "One.\n\nTwo.\n\nThree."
    assert html_text.main_text("<article><ul><li>One<li class=share>Share<ul><li>it</ul><li>Two</ul></article>") == "One\n\nTwo"
    assert html_text.main_text("<article><table><tr><td>One<td class=sidebar>No<table><tr><td>no</table><td>Two<tr class=ad><td>No<tr><td>Three</table><dl><dt>A<dd class=promo>No<dt>B</dl></article>") == "One\n\nTwo\n\nThree\n\nA\n\nB"


BODY = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
WANT = f"Title\n\n{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"


def test_a_hint_does_not_delete_a_page():
    menu = "<nav><a href=x>menu</a></nav>"
    search = "<form class=search><label>Search the site for words that you are looking for in it</label><input></form>"
    for page in (
        f"<form id=main>{menu}<div>{BODY}</div>{search}</form>",
        f"<form id=main>{menu}<article>{BODY}</article></form>",
        f"<main><div class='comments-enabled'>{BODY}</div></main>",
        f"{menu}<div class='page-with-sidebar sidebar'>{BODY}</div>",
        f"<div class='elementor widget'>{BODY}</div>",
        f"<nav><a href=x>menu</a><article>{BODY}</article>",
        f"<noscript>enable it<article>{BODY}</article>",
        f"<div><nav><ul><li><a href=x>menu</a></ul></div><article>{BODY}</article>{search}",
    ):
        assert html_text.main_text(f"<html><body>{page}<footer>Imprint</footer></body></html>") == WANT, page
    # an element left open in an article rules out what comes before the next running text
    page = f"<article><h1>Title</h1><p>{LONG}</p><nav><a href=x>menu</a><p>Short.</p><p>{LONG}</p></article>"
    assert html_text.main_text(page) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_vetoes_stay_where_other_text_is_left():
    for other in ("<div class=comments>", "<aside>", "<div class=widget>", "<noscript>", "<form>", "<p class=ad>"):
        name = other[1:].split(" ")[0].strip(">")
        for page in (f"<div>{BODY}</div>{other}{LONG}</{name}>", f"{other}{LONG}</{name}><div>{BODY}</div>", f"<article>{BODY}{other}{LONG}</{name}></article>"):
            assert html_text.main_text(page) == WANT, page
    assert html_text.main_text(f"<article>{BODY}<div class=comments>{LONG}</article>") == WANT
    # comments are the last to give way
    assert html_text.main_text(f"<div class=comments><p>{LONG}{LONG}</p></div><div class=widget>{BODY}</div>") == WANT


def test_deep_and_long_pages_take_linear_time():
    begin = time.perf_counter()
    assert html_text.main_text("<div class=x>" * 100_000 + "<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert time.perf_counter() - begin < 5
