import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, seg int, root string, score double, h long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "the quick brown fox jumps over a lazy dog and runs away " * 4000
    texts = [
        None, "", "   \n\t", "word", "two words", long, "the same text twice over, word for word", "Ünḯcode İ Σς ½² \U0001f600 done",
        "<|endoftext|> is <|startoftext|> text\x1cwith\x85odd space", "A�B  c", "a" * 70000,
    ]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or ""), i, None, 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (99, texts[6], None, "src0", 1, None, "r", None, None), (None, texts[6], None, None, None, 1, None, None, 1)]
    rows += [(None, None, None, None, None, None, None, None, None), (50, texts[6] + " more", "en", "src1", 4, 1, "", 1.0, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
