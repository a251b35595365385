import pytest

LONG = " ".join(f"word{i % 997} extra{i}" for i in range(30_000))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns whose names the operators use inside
CLASHES = "fp string, nid string, th string, pos int, key string, host string, base_failed string, spans string, " \
          "__rn string, __host string, __fp string, __root string, __doc_id string, __th string, __dropped string, " \
          "n_words string, chunk string, root string, __text string"


def odd_documents():
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties."""
    texts = [None, "", " ", "\n\n", "!?", "one", "a b c d", "Ünï ödd ſtuff 中文 text\tand more space",
             "x" * 5000, LONG, "<|endoftext|> and <|endoftext|>", "same words here and again", "same words here and again",
             "tab\tsep\x0b\x0c\r\nlines", "nul\x00char", "don't we'll I'm '' 's", "1 2 3 ½ ² ٣", "   lead and trail   "]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, "a null id", None, None, None), (None, "a null id", None, None, None),
             (None, None, None, None, None), (6, "another text under a used id", "en", "s1", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="session")
def odd_wide(spark):
    extra = [None] * len(CLASHES.split(", "))
    return spark.createDataFrame([(*r, *extra) for r in odd_documents()], f"{DOCS}, {CLASHES}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
