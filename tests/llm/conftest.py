import random

import pytest

HARD = ["", " ", "\n\t", "a", "é", "'s 'll can't 12,5 %&!", "\x00\x1f\x85  x", "<|endoftext|> end",
        "日本語 text 𝒳 é ſecret K", "A" * 3000, "word " * 2000, "x1" * 1500]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "er", "tion", "ing", "an", "st", "ou", "ré", "ung", "ción", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every hard case: nulls, empty and long texts, copies, repeated rows and
    columns whose names clash with what the operators add."""
    texts = HARD + [prose(i, 3 + 17 * i) for i in range(40)] + [prose(3, 60)] * 3 + [None, None]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1.5) for i, t in enumerate(texts)]
    rows += [rows[20], (None, prose(5, 90), None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "spans string, score double").repartition(4)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text) of every row, null texts as empty ones."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
