import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture
def files_of(spark):
    """A classified corpus from a dict of path -> text."""
    from codescope.sources.corpus import classify_files

    def make(texts: dict[str, str | None]):
        return classify_files(spark.createDataFrame(list(texts.items()), "path string, text string"))

    return make


@pytest.fixture(params=["broadcast", "shuffled"])
def join_way(request, monkeypatch):
    """Run a test with lists treated as small, and again as too large for broadcast and literal filters."""
    if request.param == "shuffled":
        from codescope.plans import joins

        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(joins, "INLINE_PATHS", 0)
        monkeypatch.setattr(joins, "INLINE_NAMES", 0)
    return request.param
