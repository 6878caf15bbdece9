import random

import pytest


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text, lang, source); extra columns are set to clash with inner names."""

    def make(rows, partitions=3):
        full = [(d, t, "en" if len(r) < 2 else r[0], "s0" if len(r) < 2 else r[1], len(t) if t is not None else None, 1, "x", 0.5) for d, t, *r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, bucket int, packed string, x0 double"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
