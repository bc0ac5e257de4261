import random

import pytest

EXTRA = "h string, c string, k1 long, n long, id string, label string, part int, rank int, length int, `rows` string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in each column, empty and very long texts, repeated rows, ties, and further columns with names that operators might use themselves."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, long_one = text(120), text(30_000)
    rows = [
        (1, a, "en", "s0", 5), (1, a, "en", "s0", 5), (2, a, "en", "s1", None), (3, None, "en", "s0", 0), (4, "", None, None, 0), (None, a + " more", "en", "s0", 1), (5, long_one, "en", None, 9), (6, long_one + " end", "fr", "s0", 9),
        (7, "short", "en", "s0", 5), (8, "   \n\t ", "en", "s0", 5), (9, "日本語テキスト 😀 é <|endoftext|> x", "ja", "s2", 3), (None, None, None, None, None), (10, text(300) + "\n" + a, "en", "s0", 7),
    ]
    return spark.createDataFrame([(*r, "x", None, 1, 2, "i", "l", 3, 4, 5, "r") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
