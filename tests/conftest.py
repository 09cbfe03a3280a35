import pytest

from graphloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Graph from pairs or triples."""
    from graphloom.graph import Graph

    def build(edges, directed=True):
        edges = list(edges)
        weighted = bool(edges) and len(edges[0]) == 3
        return Graph(spark.createDataFrame(edges, "src long, dst long" + (", weight double" if weighted else "")), directed)

    return build


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="session")
def rows_of():
    return rows
