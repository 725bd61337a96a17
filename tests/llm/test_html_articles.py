"""Articles keep every sentence, however many pages of the host repeat it."""

import pytest

from skyledger.llm import html_extract

PAGE = ("<html><body><nav><ul><li>Start</li><li>About us</li></ul></nav><div class='teaser'><p>Read our paper every day of the week.</p></div>{body}"
        "<footer><p>All rights reserved by the owner of these pages.</p></footer></body></html>")


def _page(i, wrapped):
    sentences = [f"Report {i}", f"The river rose again on day {i} and took the old bridge of village {i} with it.",
                 "Nothing else happened in the valley on that day.", f"We counted {i * 37} birds. Nothing else happened in the valley on that day."]
    body = "<h1>{}</h1><p>{}</p><p>{}</p><p>{}</p>".format(*sentences)
    return PAGE.format(body=f"<{wrapped}>{body}</{wrapped}>"), sentences


@pytest.mark.parametrize("pages", [1, 4, 8, 20, 50])
@pytest.mark.parametrize("wrapped", ["article", "main"])
def test_articles_keep_their_sentences(spark, pages, wrapped):
    made = [_page(i, wrapped) for i in range(pages)]
    rows = [(i, f"https://news.example/{i}", page) for i, (page, _) in enumerate(made)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    teaser = "Read our paper every day of the week."
    for i, (_, sentences) in enumerate(made):
        assert [x for x in got[i] if x != teaser] == sentences
    if pages >= html_extract.SUPPORT:  # outside an article a block of template words alone goes
        assert not any(teaser in text for text in got.values())


def test_odd_pages(spark):
    kinds = "page_id long, url string, html string, host string, blocks string, words string, text string"
    assert html_extract.extract(spark.createDataFrame([], kinds)).count() == 0
    long = "<article>" + "<p>" + "word " * 400000 + "end</p></article>"
    rows = [(1, "https://a.example/1", long, "x", "x", "x", "x"), (2, None, None, None, None, None, None), (None, "", "", "", "", "", "")] * 2
    got = sorted((r.page_id or 0, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(0, 0)] * 2 + [(1, 5 * 400000 + 3)] * 2 + [(2, 0)] * 2
