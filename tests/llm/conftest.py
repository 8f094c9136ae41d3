import pytest

from storecast.llm.common import start

ODD_TEXTS = [None, "", " ", "\n\t", "a", "one two three", "Ünï çødé 漢字 😀", "x\r\n\r\ny  z", "dup line\ndup line",
             "word " * 3000, "z" * 30_000, "# $ % & | < > *", "it's 'LL they'RE <|endoftext|>", "same text here", "same text here"]


@pytest.fixture(scope="session")
def llm(spark):
    return start(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls in every column, empty, long, tied and repeated rows, and columns
    whose names the operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else f"s{i % 4}", f"k{i}", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id", None, None, None, None), (3, "same id other text", "en", "s1", "x", 1),
             (13, "same text here", "en", None, "twin", 2)]
    return llm.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, kept string, size long")


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], "doc_id long, text string, lang string, source string, kept string, size long")
