import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    base = "Winter brings the long nights that every traveller in the northern hills knows too well and fears a little."
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, base.replace("nights", "days"), "en", None, 1),
        (4, None, None, None, None), (5, "", "en", "s", 0), (6, " \n\t ", "en", "s", 3), (7, "1234 5678 !?", None, "s", 9),
        (8, "Üben macht den Meister, sagt man, und der Schlüssel liegt dort. " * 40, "de", "s", 1), (9, "a", "en", "s", 1),
        (9, "a", "en", "s", 1), (10, "x" * 30000, "en", "s", 1), (11, (base + " ") * 3 + "Ende.", "en", "s", 1),
        (12, "日本語のテキスト。" * 20 + base, None, "s", 1), (None, base, "en", "s", 1),
    ]
    wide = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ", id long, ids string, length int, piece int, start int, score int, tokens string, block int, node int, component int, kept int, rank int"
    full = [r + (7, "x", 7, 7, 7, 7, "x", 7, 7, 7, 7, 7) for r in rows]
    return spark.createDataFrame(full, wide + clash).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
