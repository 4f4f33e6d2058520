import pytest

SF = "/root/testdata/sf0.001"

LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 400
EDGES = [
    (None, None, None),
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n", None),
    (4, "One", "en"),
    (5, "one two", "en"),
    (6, LONG, "en"),
    (7, LONG.upper(), "en"),
    (8, LONG + "tail", "fr"),
    (9, "x" * 5000, "de"),
    (10, "漢字 é🙂 mixed ﬁ token = 'abcdef123'", None),
    (10, "漢字 é🙂 mixed ﬁ token = 'abcdef123'", None),
    (None, "no id but text and more text than one word", "en"),
]


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls everywhere, empty, blank, long, repeated and tied rows, and columns that clash with outputs."""
    clash = "ids string, decoded string, digest string, kept string, keep_id string, score string, lang_pred string, n_words string, items string, runs string, found string, base string, n_tokens string, row string, ref string, class string, component_id string, text_sha256 string"
    n = clash.count(",") + 1
    return spark.createDataFrame([(*r, *["mine"] * n) for r in EDGES], "doc_id bigint, text string, lang string, " + clash)


@pytest.fixture(scope="session")
def empty(given):
    return given.limit(0)
