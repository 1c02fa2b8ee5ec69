"""Documents with everything that may go wrong in them."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score double, label int"


def documents(spark, texts, sources=None):
    """Rows 1, 2, … of ``texts`` with columns whose names the operators use themselves."""
    rows = [
        (i, t, "en", sources[i - 1] if sources else f"s{i % 3}", None if t is None else len(t), "b", 0.5, None)
        for i, t in enumerate(texts, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark, extra=()):
    """Null id, null text, empty, blank, one word, a very long text, and a row twice."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (None, "an id is missing here", "en", "a", 1, "b", 0.5, None),
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "", 0, "b", 0.5, 1),
        (3, " \t\n", "en", "a", 3, "b", 0.5, 1),
        (4, "word", "en", "a", 4, "b", 0.5, 1),
        (5, long, "en", "b", len(long), "b", 0.5, 1),
        (6, "twice the same row", "en", "b", 18, "b", 0.5, 1),
        (6, "twice the same row", "en", "b", 18, "b", 0.5, 1),
        *[(i, t, "en", "c", len(t), "b", 0.5, 1) for i, t in enumerate(extra, 7)],
    ]
    return spark.createDataFrame(rows, SCHEMA)
