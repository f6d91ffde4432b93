import pytest

#: Rows that every text operator must take: nulls, empty and long texts, repeats, clashing names.
WORDS = "the harbour lights were seen from far across the quiet water while small boats came home before night fell".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    import random

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    a, b = text(60), text(40)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (2, a, "en", "s1"), (3, a + " " + text(3), "de", "s2"), (4, b, None, None), (5, "", "en", "s2"),
        (6, None, None, "s1"), (7, "  \t\n", "en", None), (8, text(9000), "en", "s2"), (9, "x" * 50_000, "en", "s1"), (10, "ü☃ \U0001f600\x00", "en", "s3"),
        (None, b, "en", "s1"), (11, "one two", "en", "s3"), (12, "one  two\n", "en", "s3"),
    ]
    df = spark.createDataFrame([(i, t, l, s, len(t or ""), 1, "n", 2.0, i, 5, True) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, node string, size double, _id long, _n int, kept boolean")
    return df.repartition(3).persist()
