import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, `row` int, mark int, "
          "block int, node int, shard int, slot int, size int, score double, lang_pred string, `_text` string")


def as_docs(spark, texts, lang="en"):
    """Documents with ids by position, and columns whose names the operators use themselves."""
    rows = [(i, t, lang, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", 1, 2, 3, 4, 5, 6, 7, 0.5, "xx", "y")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and wordless texts, a very long one, repeats, ties, and other alphabets."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    base = " ".join(words)
    near = " ".join(words[:140] + ["other"] + words[141:])
    long = " ".join(f"long{rng.randrange(3000)}" for _ in range(40_000))
    return [None, "", " \t\n", base, base, near, base.upper(), "one", "one two", "¿qué? ñandú ßtraße 漢字 🙂",
            "a" * 5000, "12345 67890 !!", "mail me@x.example.com, 10.0.0.1 or +1 (555) 555-0100 4111 1111 1111 1111",
            long, long + " tail", None, "", "line\nline\nline\n\nother line"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return as_docs(spark, odd_texts)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
