import random

import pytest

WORDS = "the of and river stone light water under mountain slowly carried whose morning letter winter garden silver paper window quiet harbor second bright coffee seven market along wooden planet".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + (str(r.randrange(100)) if r.random() < 0.5 else "") for _ in range(n)]
    for k in range(9, n, 10):
        words[k] += ".\n" if k % 20 == 19 else "."
    return " ".join(words)


def cases() -> list[tuple]:
    """Rows with nulls in every column, empty and very long texts, copies, near-copies, shared passages, ties and repeated rows."""
    base = prose(1, 200)
    passage = prose(2, 70)
    near = base.split(" ")
    near[100] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, passage + " " + prose(3, 80)), (5, prose(4, 60) + " " + passage), (6, prose(5, 300)),
        (7, ""), (8, None), (9, " \n\t "), (10, "one"), (11, "one two three"), (12, "One two\x00three"), (13, prose(6, 12) + " <|endoftext|> it's  we'll\t\t x éé 中文 \U0001f600  "),
        (14, prose(7, 30_000)), (15, "a" * 5000), (None, base), (None, None), (16, prose(8, 90)), (16, prose(8, 90)), (17, "ha ha ha " * 40), (18, "same line here\n" * 30), (19, "  double  spaces \n \n  end \n "), (-5, prose(9, 120)),
    ]
    return rows


SCHEMA = "doc_id long, text string, n_tokens string, ids string, n_words string, w string, key string, batch string, digest string"


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark):
    """The cases, with columns whose names operators use inside."""
    full = [(*x, None, "x", "y", None, "k", "b", "d") for x in cases()]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabularies():
    return pytest.importorskip("public_tokenizers")
