import pytest
from pyspark.sql import functions as F

from eventboard.functions import predicates as pr
from eventboard.functions import text as tx
from eventboard.operators import pages as pg
from eventboard.operators import pick
from eventboard.operators.follow import follow_links
from eventboard.operators.outline import selector
from eventboard.plans.tables import table

PAGE = """<html><head><title>Tab</title><script>var a="<a href='/no'>no</a>";</script></head><body>
<!-- <a href='/commented'>x</a> -->
<header><h1> Main &amp; more </h1><time datetime="2026-01-02">Jan 2</time></header>
<ul class="news-list"><li class="item one"><a href="/en/news/9?x=1">First <b>link</b></a><p>unclosed
<li class="item"><div class="row entry-1"><a href='#top'>Second</a> 3 days ago</div></ul>
<noscript><article>hidden</article></noscript>
<article class="card"><a href=plain.html>Third</a></article></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, PAGE)], "snapshot_id long, body string")


@pytest.mark.parametrize(
    ("href", "base", "cut", "expected"),
    [
        ("/en/news/9?x=1", "https://a.example", True, "https://a.example/en/news/9"),
        ("https://b.example/x", "https://a.example", False, "https://b.example/x"),
        ("//c.example/x", "https://a.example/d", False, "https://c.example/x"),
        ("x/y", "https://a.example/d/e?q#f", False, "https://a.example/d/x/y"),
        ("x", "https://a.example", False, "https://a.example/x"),
        ("../x", "https://a.example/d/e/f", False, "https://a.example/d/x"),
        ("./x", "https://a.example/d/e", False, "https://a.example/d/x"),
        ("../../../x", "https://a.example/d/e", False, "https://a.example/x"),
        ("?p=2", "https://a.example/d?p=1", False, "https://a.example/d?p=2"),
        ("#top", "https://a.example", False, None),
        ("", "https://a.example", False, None),
        ("mailto:a@b", "https://a.example", False, "mailto:a@b"),
    ],
)
def test_resolve_url(value, href, base, cut, expected):
    assert value(lambda: tx.resolve_url(F.lit(href), base, cut)) == expected


def test_text_forms(value):
    html = "<html><script>x</script><p>A&amp;B</p><p> c </p><!-- d --></html>"
    assert value(lambda: tx.html_to_text(F.lit(html))) == "A&amp;B c"
    assert value(lambda: tx.html_to_text(F.lit(html), sep="")) == "A&B c "
    assert value(lambda: tx.page_text(F.lit("<b>x</b>"), F.lit("http"))) == "<b>x</b>"
    assert value(lambda: tx.page_text(F.lit("<b>x</b>"), F.lit("browser"))) == "x"
    assert value(lambda: tx.first_heading(F.lit("<h2> a <i>b</i> </h2><h1>c</h1>"))) == "a b"
    assert value(lambda: tx.first_line(F.lit(" one\ntwo"))) == "one"


def test_links(page):
    rows = pg.extract_links(page).orderBy("pos").collect()
    wanted = [(r.href, r.text) for r in rows if r.href and r.href not in ("/no", "/commented")]
    assert wanted == [("/en/news/9?x=1", "First link"), ("#top", "Second"), ("plain.html", "Third")]


def test_elements_ignore_scripts_comments_and_noscript(page):
    rows = pg.extract_elements(page, ["a", "article", ".item"]).orderBy("pos").collect()
    assert [(r.tag, r.text.strip().split("\n")[0]) for r in rows] == [
        ("li", "First linkunclosed"), ("a", "First link"), ("li", "Second 3 days ago"), ("a", "Second"), ("article", "Third"), ("a", "Third"),
    ]
    assert rows[0].classes == ["item", "one"] and rows[1].attrs == {"href": "/en/news/9?x=1"}
    # An unclosed paragraph and list item end where the next item starts.
    assert rows[2].parent_pos == rows[0].parent_pos


def test_selectors(page):
    def tags(*texts):
        return [r.text.strip() for r in pg.extract_elements(page, list(texts)).orderBy("pos").collect()]

    assert tags("a@/news/") == ["First link"]
    assert tags(".news-list a") == ["First link", "Second"]
    assert tags("div*entry") == ["Second 3 days ago"]
    assert tags("article.card") == ["Third"]
    assert selector("#main")["id"] == "main"


def test_context_and_closest(page):
    rows = {r.text: r for r in pg.with_context(page, ["a"], ["li", "div*row"]).collect()}
    assert rows["Second"].card_text == "Second 3 days ago"
    assert rows["Second"].context.startswith("Second 3 days ago Second 3 days ago")
    assert rows["Third"].card_text is None


def test_first_n_and_titles(spark, page):
    links = pg.extract_links(page)
    assert [r.pos for r in pg.first_n(links, 2).collect()] == [0, 1]
    assert pg.first_title(page).first().title == "Main & more"
    assert pg.time_elements(page).first().value == "2026-01-02"


def test_table_rows(spark):
    html = "<table><tr><td>26.1</td><td>Jan <b>8</b>, 2026</td></tr><tr><td></td><td>x</td></tr></table><table><tr><td>a</td><td>b</td></tr></table>"
    rows = pg.table_rows(spark.createDataFrame([(1, html)], "snapshot_id long, body string")).collect()
    assert [r.cells for r in rows] == [["26.1", "Jan 8, 2026"]]


def test_follow_links_is_one_to_one(spark):
    links = spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "source string, url string")
    pages = spark.createDataFrame(
        [(1, "u1", "2026-01-01", "old"), (2, "u1", "2026-01-02", "new")],
        "snapshot_id long, requested_url string, fetched_at string, fact string",
    )
    out = {r.source: r for r in follow_links(links, pages, "use_listing").collect()}
    assert len(out) == 2 and out["s1"].article_fact == "new"
    assert (out["s2"].found, out["s2"].use_listing) == (False, True)


def test_picks_inside_the_row_equal_those_over_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    rows = pg.extract_links(pages, keys=["page_id"])
    inside = pages.select("page_id", pg.links_of(F.col("body")).alias("links"))
    assert inside.select("page_id", F.inline("links")).exceptAll(rows).count() == 0
    words = ["que", "der", "the"]

    def same(got, want):
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()

    match = pr.matches_any(F.col("text"), words)
    first = inside.select("page_id", F.inline(F.slice("links", 1, 3)))
    same(first, pg.first_n(rows, 3, keys=["page_id"]))
    best = pick.match_or_first_in(F.col("links"), lambda i: pr.matches_any(i["text"], words))
    same(inside.select("page_id", best.alias("i")).filter("i IS NOT NULL").select("page_id", "i.*"), pick.pick_match_or_first(rows, match, ["page_id"]))
    counts = pick.relevant_in(F.col("links"), lambda i: pr.matches_any(i["text"], words), lambda i: i["href"].isNotNull())
    want = pick.relevant_count(rows.withColumn("event_at", F.col("href")), match, ["page_id"])
    same(inside.filter(F.size("links") > 0).select("page_id", *counts), want)
