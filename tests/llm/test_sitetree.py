"""Main text where names mislead and where a notice stands among an article's paragraphs."""

from pairscape.llm import sitetree

PAGES = "page_id long, url string, html string"


def test_names_around_an_article_do_not_drop_it(spark):
    html = '<body><div class="has-sidebar with-comments"><div class="widget-area">Menu</div><article><p>Own text.</p><div class="share">Share</div></article></div></body>'
    (got,) = sitetree.main_text(spark.createDataFrame([(1, "http://a.b/1", html)], PAGES)).collect()
    assert got.text == "Own text."


def test_notice_on_all_pages_is_no_main_text(spark):
    page = "<body><article><h1>Title {0}</h1><p>Own text {0}.</p><p>Tell your friends about us.</p></article></body>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in range(20)] + [(100 + i, f"http://c.d/{i}", page.format(7)) for i in range(20)] + [(200, "http://e.f/1", page.format(1))]
    got = {r.page_id: r.text for r in sitetree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Title {i}\n\nOwn text {i}." for i in range(20))
    # copies of one page, and a host of one page, say nothing about their texts
    notice = "\n\nTell your friends about us."
    assert all(got[100 + i] == f"Title 7\n\nOwn text 7.{notice}" for i in range(20))
    assert got[200] == f"Title 1\n\nOwn text 1.{notice}"
