import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def make_documents(seed: int = 0, n: int = 60) -> list[tuple]:
    """Small documents with exact copies, near copies, shared passages, odd and empty texts; columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    texts = [None, "", "   \n\t ", "one", "two words", "A" * 400, "Ab " * 200, " ".join(vocabulary) * 40]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15 and len(texts) > 10:
            texts.append(rng.choice(texts[8:]))
        elif kind < 0.25 and len(texts) > 10:
            texts.append((rng.choice(texts[8:]) or "").upper().replace("É", "é").replace("SS", "ß"))
        elif kind < 0.5 and len(texts) > 10:
            words = (rng.choice(texts[8:]) or "x").split()
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.65:
            texts.append(f"{sentence(rng.randint(1, 30))} {passage} {sentence(rng.randint(1, 30))}")
        else:
            texts.append(sentence(rng.randint(1, 120)))
    order = list(range(n))
    rng.shuffle(order)
    rows = []
    for doc_id, i in enumerate(order):
        source = None if doc_id % 11 == 0 else f"s{doc_id % 4}"
        rows.append((doc_id, texts[i], None if doc_id % 7 == 0 else "en", source, None if doc_id % 5 == 0 else len(texts[i] or ""), 7, "x"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column and rows that repeat."""
    same = "the same text of more than fifty bytes, which two rows carry under one identifier"
    return spark.createDataFrame([(1, same, None, None, None, None, None), (1, same, None, None, None, None, None), (None, same, "en", "a", 3, 1, "k"), (None, None, None, None, None, None, None), (2, None, "en", "a", 0, 0, "k")], SCHEMA)
