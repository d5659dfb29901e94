"""Rows that every operator has to bear: nulls, empty and very long texts, ties and repeated rows, a clashing column."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = "word " * 60_000


def rows(*more):
    base = [
        (1, None, None, None, None, "x"),
        (2, "", "en", "s", 0, "x"),
        (3, " \t\r\n\x0b\x0c ", "en", "s", 7, "x"),
        (4, "one two three", "en", "s", 13, "x"),
        (4, "one two three", "en", "s", 13, "x"),
        (5, LONG, "en", "s", len(LONG), "x"),
        (None, "no id at all here in this row", "en", None, 29, "x"),
        (6, "Üñí © 漢字 🙂 x", None, "s", 12, "x"),
    ]
    return base + list(more)


def frame(spark, *more):
    return spark.createDataFrame(rows(*more), SCHEMA)
