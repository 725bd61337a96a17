"""Template classes are ordered and nested, and roles are split by the gaps of classes."""

import random

from skyledger.llm import html_extract

PAGE = "<html><body><div><p>{top}</p></div><div><p>More from this site today, as every day</p></div><div>{end}</div></body></html>"


def _texts(spark, pages):
    rows = [(i, f"https://news.example/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _own(i):
    return f"Day{i} saw bird{i} and tree{i} near river{i}"


def test_tokens_of_no_fixed_order_are_no_template(spark):
    """The same sentences on every page, in another order on each."""
    rnd, facts = random.Random(1), ["Gold is heavy metal indeed", "Water boils when hot enough", "Stone falls down every time", "Birds fly over green fields"]
    order = [rnd.sample(facts, 4) for _ in range(24)]
    got = _texts(spark, [PAGE.format(top=_own(i), end="".join(f"<p>{x}</p>" for x in order[i])) for i in range(24)])
    assert got == {i: [_own(i), *order[i]] for i in range(24)}


def test_roles_are_split_by_gaps(spark):
    """A sentence that ends every page, and that some pages quote in a container of the same path."""
    end = "All rights reserved by owners"
    quoted = {i: i % 4 == 1 for i in range(24)}
    got = _texts(spark, [PAGE.format(top=_own(i) + (f"</p><p>{end}" if quoted[i] else ""), end=f"<p>{end}</p>") for i in range(24)])
    assert got == {i: [_own(i), end] if quoted[i] else [_own(i)] for i in range(24)}


def test_lists_of_changing_length(spark):
    """What the items of a list share is template, however many there are."""
    def items(i):
        return [f"name{i}x{k} city{i}x{k}" for k in range(1 + i % 5)]

    got = _texts(spark, [PAGE.format(top=_own(i), end="<ul>" + "".join(f"<li>Posted just now by {x} who likes this post</li>" for x in items(i)) + "</ul>") for i in range(24)])
    assert got == {i: [_own(i), *items(i)] for i in range(24)}


def test_classes_that_cross_are_not_both_template(spark):
    """Two classes whose turns overlap: the lesser one is text."""
    def end(i):
        a, b, c, d = "Alpha beta gamma delta epsilon zeta", "Seven eight nine ten eleven", "Omega psi chi phi upsilon tau", "Ten more words stand here"
        return "".join(f"<p>{x}</p>" for x in ((a, b, c, d) if i % 3 else (a, c)))

    got = _texts(spark, [PAGE.format(top=_own(i), end=end(i)) for i in range(24)])
    for i in range(24):
        assert got[i] == ([_own(i), "Seven eight nine ten eleven", "Ten more words stand here"] if i % 3 else [_own(i)])
