import pytest

#: Columns that operators use as names of their own.
CLASHES = ("key", "id", "row", "sha", "copies", "size", "target", "first", "sig", "chunk", "word", "event", "n", "bucket", "base", "cand", "spans", "_lang", "_text", "_mix_doc_id", "_nth", "rank", "length", "piece")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "b"),
    (2, "one two three four five six seven", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (None, "x y", "fr", None),
    (None, None, None, None),
    (5, LONG, "fr", "b"),
    (6, "word", "fr", ""),
    (7, " \t\r\n\x0b\x0c ", "en", "c"),
    (8, "éàü ß 你好 \U0001f600 <|endoftext|> \x00 end", "de", "c"),
    (9, "a" * 70_000, "de", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
