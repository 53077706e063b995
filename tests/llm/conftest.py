import pytest

#: Null ids and texts, empty and white texts, ties, repeated rows, very long texts, and columns whose names clash.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "s", "a"), (1, "the quick brown fox jumps over the lazy dog again and again", "s", "a"),
    (None, "no id here at all, but ten words are in this text", None, None), (2, None, "s", "b"), (3, "", None, "c"), (4, " \n\t ", "s", "d"),
    (5, "word " * 30_000, "s", "e"), (6, "x" * 100_000, "t", None), (2, "same id, other text", "t", "f"), (7, "Ünïé \U0001f600 text\u0000 with\r\nodd \x1c marks </s>", "t", "g"),
]


@pytest.fixture(scope="session")
def odd(spark):
    names = "doc_id long, text string, source string, lang string, row_key string, fp long, kept string, shard string, size string, score string, n_chars long"
    return spark.createDataFrame([(*r, "k", 1, "x", "y", "z", "w", len(r[1] or "")) for r in ODD], names)
