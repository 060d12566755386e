import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rank int"

#: Odd texts: null, empty, white only, one word, ties and repeats, long runs, other scripts, special strings.
ODD = [
    None, "", " \t\n", "one", "one", "two words", "a b c a b c a b c", "x\nx\nx\nx\n\nx", "Σίσυφος ΑΣ İstanbul ﬁn é é", "it's they'll we'd I'm",
    "<|endoftext|> in <|startoftext|>text <|x|>", "x" * 3000, "word " * 4000, "漢字 かな 한국어 🎉👩‍👩‍👧 \U0001f1eb\U0001f1f7", "tab\tnew\x0bline\x0cfeed\rend", "1234567890 $%&* ###", "▁ ▁▁ a▁b   c", "  two  spaces   three ", "\n\nlines\n\n",
    "#### $$$$ the end", "\x00 nul \x7f", "the quick brown fox jumps over the lazy dog " * 3,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "clash", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], rows[6]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
