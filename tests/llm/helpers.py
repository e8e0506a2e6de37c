"""Small tables with every odd case, for the tests of the text operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (2, "", "en", None, 0),
    (3, " \t\n\v\f\r ", None, "a", 7),
    (4, "word", "en", "a", 4),
    (None, "word", "en", "a", 4),
    (5, "Ünïcödé ſtraße K \x1c\x1f\x85\xa0 x", "de", "a", None),
    (6, "the same words again and again " * 3000, "en", "a", 90000),
    (7, "x" * 100_000, "en", "a", 100_000),
    (8, "a b c d e f g h i j k\n" * 5, "en", "a", 110),
    (9, "\x00 nul and \U0001f600 emoji", "en", "a", 20),
]


def table(spark, rows=ODD, extra=True):
    """``rows`` as documents; with other columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("n_words", "score", "kept", "fingerprint", "component_id", "spans", "__g", "d2", "key", "block", "label", "quality", "item_id"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df
