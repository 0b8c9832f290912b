import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, quality string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, long and foreign texts; columns with clashing names."""
    random.seed(11)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "été", "日本", "it's", "<|endoftext|>", "a,b", "Don't"]
    texts = [None, "", " \n\t ", "one", "One two", "x" * 3000, "The the  the\n\nthe", "A   b \n c  ", "á   b"]
    texts += [" ".join(random.choices(words, k=random.randint(1, 80))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"start{i} {passage} end{i}" for i in range(6)] + [passage, "\n".join(["same line here"] * 9), " ".join(random.choices(words, k=9000))]
    rows = [(i * 7, t, "en", "s" if i % 3 else None, None if i % 5 else len(t or ""), "i", "s", "q") for i, t in enumerate(texts)]
    return rows + [(9000 + i, texts[20], "en", "s", 1, "i", "s", "q") for i in range(5)] + [rows[30], rows[51]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
