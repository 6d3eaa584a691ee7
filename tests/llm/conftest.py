import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    word = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    long = " ".join(f"{w}{i}" for i in range(4000) for w in word.split()[:3])
    rows = [
        (1, long, "en", "a/b", 1), (1, long, "en", "a/b", 1), (2, None, None, None, None),
        (3, "", "en", "c", 0), (None, f"{word} one two three four five six seven eight nine", "fr",
                                None, 5),
        (4, " \t\n ", None, "c", 3), (1, f"{word} other words stand in this row of the same id "
                                         "and they go on to twenty", "en", "x", 9),
        (5, "x" * 50_000, "en", "c", 50_000),
    ]
    shape = f"{DOCUMENT}, row string, match string, words array<string>, _place int, kept string"
    return spark.createDataFrame(
        [(*r, "mine", f"m{i}", ["w"], i, "k") for i, r in enumerate(rows)], shape
    )
