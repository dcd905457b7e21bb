import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, fingerprint int, key string, fp string, h string, length string, part int"


def make_docs(spark, texts, parts=3):
    """(doc_id, text) pairs as documents, with more columns of names that operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "w", 1, "k", "f", "h", "l", 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_texts():
    """Nulls, empty and very long texts, ties and repeated rows."""
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma,", "déjà", "日本", "x1", "the", "of", "and", "MIT", "license"]
    prose = [" ".join(r.choice(words) for _ in range(r.randrange(1, 150))) + r.choice(["", ".\n", "\n\nmore"]) for _ in range(30)]
    out = list(enumerate(prose)) + [(100, None), (101, ""), (102, " \n\t "), (None, "no id here"), (None, None), (103, "one"), (104, "one two")]
    out += [(105, prose[0]), (106, prose[0]), (107, prose[1]), (107, prose[1]), (108, prose[2]), (108, "other text"), (109, "long " * 60_000), (110, "😀" * 3000), (111, "a\x00b\x1fc\x85d")]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return make_docs(spark, odd_texts())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
