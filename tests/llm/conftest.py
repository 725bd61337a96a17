import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and copies."""
    word = lambda i: "w" + "abcdefghij"[i % 10] * (1 + i % 4) + str(i)
    base = [" ".join(word(k * 7 + j) for j in range(80)) for k in range(6)]
    rows = [(10 + k, t, "en", "s", len(t)) for k, t in enumerate(base)]
    rows += [(30, base[0], None, None, None), (31, base[0] + " extra", "en", "s", 0), (32, base[1].replace(word(20), "changed"), "en", "s", 0)]
    rows += [(40, None, "en", "s", 0), (41, "", "en", "s", 0), (42, " \n\t ", "en", "s", 0), (None, "no id here", "en", "s", 0)]
    rows += [(50, "one two", "en", "s", 0), (51, "ONE two", "en", "s", 0), (52, "x" * 20000, "en", "s", 0), (53, base[2] * 40, "en", "s", 0)]
    rows += [(60, "twice the same row", "en", "s", 0)] * 2
    rows += [(70, "mail a.b@c.org or +1 (858) 555-2896 later 858-555-2896, 10.0.0.1 and 4644348398010899 é.", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
