import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 97} number{i}." for i in range(20_000))
    plain = "A clean sentence of ordinary words stands here and says something. It goes on for a while, and then it ends."
    return [
        (1, plain, "en", "a", 5),
        (1, plain, "en", "a", 5),
        (2, plain, "en", "b", 5),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 3),
        (6, long, "en", "a", len(long)),
        (None, "no id for this text but it has some words of its own to say, and ends.", "en", None, 9),
        (7, "x", "", "", 1),
        (8, "😀 " * 30 + "astral +1 (212) 555-0199 a@b.co", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same with columns named like those that operators make."""
    names = "id th fp found terms kept lines size score label held_out source_size target taken row host path rule at span words anchor".split()
    return edges.selectExpr("*", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 4, 6, 8)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
