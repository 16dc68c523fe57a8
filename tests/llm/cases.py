"""Awkward tables that every operator has to take."""

LONG = " ".join(f"word{k % 997} item{k % 13}" for k in range(40_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, copy_no int, size int, part int, blob binary, repeated string, Mapping string"
ROWS = [
    (1, "a plain text about nothing in particular, with some words in it", "en", "a", 10, 1.0, "x", 1, 2, 3, b"z", "r", "m"),
    (2, None, "en", "a", None, None, None, None, None, None, None, None, None),
    (3, "", None, None, 0, 0.0, "", 0, 0, 0, b"", "", ""),
    (4, LONG, "de", "b", len(LONG), 1.0, "x", 1, 2, 3, b"z", "r", "m"),
    (1, "a plain text about nothing in particular, with some words in it", "en", "a", 10, 1.0, "x", 1, 2, 3, b"z", "r", "m"),
    (None, "a text whose id is null and that says little", "en", "b", 3, 1.0, "x", 1, 2, 3, b"z", "r", "m"),
    (5, "!!! ... ???", "en", "b", 11, 1.0, "x", 1, 2, 3, b"z", "r", "m"),
    (6, "œuvre naïve – “déjà vu” 漢字 🙂", "fr", "c", 11, 1.0, "x", 1, 2, 3, b"z", "r", "m"),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
