import pytest

from proseloom.session import ship_package

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, place int, words string, host string"


@pytest.fixture(scope="session")
def ready(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(ready):
    """Nulls in every column, empty and long texts, copies, a repeated id, clashing names."""
    long = "word another third fourth fifth sixth " * 4000
    rows = [
        (1, "A plain text with some words in it, of no great length.", "en", "s1"),
        (2, "A plain text with some words in it, of no great length.", "en", "s2"),
        (2, "A plain text with some words in it, of no great length.", "en", "s2"),
        (3, None, "de", "s1"),
        (4, "", "de", None),
        (5, " \n\t\n ", None, "s3"),
        (6, long, "en", "s1"),
        (7, "x" * 30_000, "fr", "s2"),
        (8, "éèà 漢字 😀\n" * 50, "fr", "s2"),
        (9, "12345 !!! ...", "fr", "s4"),
        (10, "one", "en", "s1"),
        (None, "Text without an id stands here on its own.", "en", "s1"),
        (None, None, None, None),
    ]
    return ready.createDataFrame([(*r, None, 0.5, 1, "w", "h") for r in rows], ODD).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
