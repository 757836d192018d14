import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank, short and long texts, repeated rows, further columns."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    rows = [
        (None, None, None, None, None, 1), (1, "", None, "a", 0, 2), (2, " \n\t ", "x", "b", 1, 5),
        (3, "x", "x", "b", 1, 5), (3, "x", "x", "b", 1, 5), (4, "one two", "en", "a", 7, 0),
        (5, "Hello  world A b c d e f", None, "a", 0, 3), (6, "hello world\ta b c d e f", None, None, 0, 3),
        (None, "hello world a b c d e f", "en", None, 3, 4), (7, "a b c d e f g h i j k l m", "en", "c", 25, 4),
        (8, "a b c d e f g h i j k l z", "en", "c", 25, 4), (9, long, "en", "long", len(long), 4), (10, long + " end", "en", "long", 1, 4),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept int"
    ).cache()
