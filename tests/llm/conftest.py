import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, digest string, rank int"


@pytest.fixture(scope="session")
def documents_of(spark):
    """A table of documents from (doc_id, text) pairs, with further columns named like inner ones."""

    def make(rows):
        full = [(i, t, ["en", None, "de"][n % 3], ["a", "b", None][n % 3], None if t is None else len(t), "k", "s", "d", 1)
                for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, COLUMNS)

    return make


LONG = "word " * 60_000 + "x" * 1_200_000 + " end"
#: Null and empty texts, null ids, repeated rows, ties, one very long text, one very long word.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a text without an id"), (None, None), (4, "one"), (5, "two words"),
    (6, "the same text for two rows"), (6, "the same text for two rows"), (7, "the  same text\nfor two rows"),
    (8, LONG), (9, "Ünïcode ẞharp 日本語 \x1c text　here"), (10, "one"),
]


@pytest.fixture(scope="session")
def awkward(documents_of):
    return documents_of(AWKWARD)


@pytest.fixture(scope="session")
def no_documents(documents_of):
    return documents_of([(1, "x")]).limit(0)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
