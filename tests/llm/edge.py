"""A small documents table with what is odd: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n ", "de", "b"),
    (6, "12345 !!! ???", "de", ""),
    (7, LONG, "en", "a"),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund.\nDer schnelle braune Fuchs springt über den faulen Hund!", "de", "b"),
    (9, "é 😀 <|im_end|>\r\nx  y\t", "fr", "c"),
    (None, "no key here", "en", "a"),
    (10, "a", "en", None),
    (10, "a", "en", None),
]


def documents(spark):
    """The rows, with extra columns named like those of results."""
    rows = [(*r, len(r[1] or ""), "extra", 1.0, 7) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double, fp long")
