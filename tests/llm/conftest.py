import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, start long, tag string, `_lang` string, `_fp` string, `__nth` string, `_words` string, `_spans` string, `_text` string, `_mix` string, `h.i` string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), -1, -1.0, -1, -1, *["mine"] * 9) for i, t, l, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (None, "no id here", "en", "b"), (None, None, None, None), (4, LONG, "en", "b"), (5, LONG, "de", "b"), (6, " \t\n ", "en", None), (7, "Ünïcode ﬁne \x0b“quotes” 中文", "zz", "c"), (8, "### $$$ %%%", "en", "c"), (1, "another text of the same id", "en", "a")]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, []).where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, None), (8, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
