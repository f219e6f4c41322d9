"""Documents that every operator on documents has to take: nulls, empty and long texts, ties, repeated rows, odd columns."""

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six\nshared line of exactly six words", "en", "s", 10, 0, "x"), (2, "", "en", "s", 0, 0, "x"), (3, None, None, None, None, None, None), (None, "no id but some words here today", "en", "s", 1, 1, "y"),
    (4, LONG, "en", "s", 1, 1, "z"), (5, "one two three four five six\nshared line of exactly six words", "en", "s", 10, 0, "x"), (5, "one two three four five six\nshared line of exactly six words", "en", "s", 10, 0, "x"),
    (6, " \t\n\n ", "en", "s", 1, 1, "z"), (7, "mail a.b@c.de card 4111111111111111 token = \"0123456789abcdef0123\" \U0001f999", "en", "s", 1, 1, "z"), (7, "another text under one id", "fr", "s", 1, 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, rid string"


def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
