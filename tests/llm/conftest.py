import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, n_words string, size int, shard int, media binary, kept boolean"
PLAIN = "The quick brown fox jumps over the lazy dog and then it runs away from all of the others"


def odd_rows():
    """Nulls, empty and white texts, long ones, ties, repeated rows, odd characters."""
    texts = [
        None, "", " \n\t ", "one", "two words", PLAIN, PLAIN, PLAIN.upper(), PLAIN + " now", "x" * 70_000, "word " * 30_000, "a b c d e " * 400,
        "é漢字😀 ́\x1c\x85 <|endoftext|> isn't\r\n\r\n  it?  ", "### $$$ *** 12 | 34", "line\nline\n\nline\nother\n",
        "mail a.b@c.example.org or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111, not 300.1.1.1", "\x00 zero \x00",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t) if t else None, 5, 6, "x", 7, 8, b"m", True) for i, t in enumerate(texts)]
    return [*rows, rows[5], (40, *rows[5][1:]), (None, "no id here at all but ten words are in this text", *rows[5][2:])]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
