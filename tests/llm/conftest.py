import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, norm int, row string, id string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty, blank and long texts, ties and repeated rows, and columns with names that operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    long = " ".join(words[i * i % 8] + str(i % 97) for i in range(30_000))
    texts = [None, "", "  \t\n", "one", "one two", "The  same\ttext here", "the same text HERE", "The same text here", long, long, "Zeile eins   ende", "é" * 500, "call +1 (988) 555-2485 or a.b@c.de"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], None, "x", i, "r", "i", "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id", None, None, None, None, None, None, None, None), (None, "one", "en", "a", 1, "x", 1, "r", "i", "k")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
