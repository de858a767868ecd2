import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{n % 97} of{n % 89}" for n in range(40_000))
    rows = [
        (1, "the cat sat on the mat", "en", "a"),
        (1, "the cat sat on the mat", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, "no id here but words", "en", "b"),
        (None, None, None, None),
        (4, " \n\t ", None, "c"),
        (5, long, "en", "a"),
        (6, long, "en", "d"),
        (7, "1234 5678 !!", "fr", "a"),
        (8, "le chat et la souris été", "fr", "a"),
        (9, "中文 \U0001f600 <|endoftext|>", None, "e"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 7) for r in rows], ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
