"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = "The quick brown fox jumps over the lazy dog. " * 3000
TEXTS = [
    None, "", "   \n\t ", "one", "two words", LONG, "Same text here for all.", "Same text here for all.",
    "naïve café ΑΣ 日本語 👍🏽 <|endoftext|> tail", "tabs\tand\r\nlines\n\n\nmore", "  lead and trail  ", "1234 5678 !!! ???",
    "word " * 40, "x" * 5000, "don't we'll they're",
]
CLASHES = "facts int, quality int, language string, words int, n_words int, kept int, _words int, score double, id int, block int"


def odd_documents(spark):
    """All texts, one id null, one row twice, and columns named like the operators' own."""
    rows = [(n if n else None, text) for n, text in enumerate(TEXTS)] + [(6, TEXTS[6])]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    extra = spark.createDataFrame([(1, 2, "z", 3, 4, 5, 6, 0.5, 7, 8)], CLASHES)
    return docs.join(extra)


def empty_documents(spark):
    return odd_documents(spark).limit(0)
