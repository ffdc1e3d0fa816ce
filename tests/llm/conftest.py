import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, text_of_row string"
PROSE = "the cat sat on the mat and the dog ran over the hill to see what the cat had seen there"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, names used inside the operators."""
    rows = [(1, PROSE, "en", "a", 1, 0.5, 1, "x"), (1, PROSE, "en", "a", 1, 0.5, 1, "x"), (2, PROSE, "en", None, None, None, None, None),
            (3, None, "en", "a", 0, 0.1, 2, "y"), (4, "", None, "a", 0, 0.1, 2, "y"), (5, " \t\n ", "fr", "a", 0, 0.1, 2, "y"),
            (None, PROSE + " again", None, None, None, None, None, None), (6, "word", "fr", "b", 4, 0.2, 3, "z"),
            (7, ("le chat noir et le chien blanc sont dans la maison " * 3000), "fr", "b", 0, 0.3, 4, "z"), (8, "123 !!! 456", "fr", "b", 4, 0.2, 3, "z"),
            (2, "another text of the same id with quite other words in it than the first one had", "en", "c", 1, 0.5, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
