import random

import pytest

WORDS = "river stone garden morning letter window season orchard candle harbour meadow violin".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, long and short ones, nulls, empties and odd characters."""
    r = random.Random(5)
    texts = [sentence(r, r.choice((1, 2, 3, 8, 20, 60, 200))) for _ in range(120)]
    base = sentence(r, 80).split()
    near = []
    for _ in range(40):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(80)] = "changed" + str(r.randrange(9))
        near.append(" ".join(words))
    odd = [None, "", "   ", "\n\t", "Ä", "123 456", "日本語 テキスト です", "\x1f\x85", "a" * 3000, sentence(r, 6000), "x", "x y", "X Y"]
    return list(enumerate(texts + near + texts[:10] + [base and " ".join(base)] * 30 + odd))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(k, t, "en", "s", 0, "clash") for k, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def chains():
    """Threes of texts of which the middle one alone is linked with both others, under 3 words / 90 or 5 / 80."""
    rows = []
    for k in range(150):
        width, size = (3, 9 + k // 2 % 3) if k % 2 else (5, 5 + k // 2 % 5)
        words = [f"w{k}x{i}" for i in range(size + width - 1)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "y"])), (3 * k + 2, " ".join([*words, "y", "z"]))]
    return rows
