import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    rng = random.Random(5)
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows(prose):
    long = prose(4000)
    near = long.split()
    near[7] = "changed"
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, long), (7, " ".join(near)), (7, "same id, other text"), (8, long), (8, long),
            (None, "no id at all"), (None, long), (9, prose(30)), (10, "日本語 テキスト ünï 😀 " * 30)]
