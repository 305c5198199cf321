import random

import pytest

@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def with_clashes(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, rep long, label string, row int, host string"
        schema += ", _score int, _row int, _key int, _text int, _spans string, Shard int, size int, virtual_slot int, position int, before int, within int, bucket int, comp int, component_id int, kept int"
        full = [(i, t, None, "s", None, 1.0, "x", 5, "y", 3, "h", 1, 2, 3, 4, "z", 5, 6, 7, 8, 9, 10, 11, 12, 13, 14) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "ONE"), (7, "a b c d e"), (8, "\x0bé ß 日本 x@y.de 1.2.3.4\n\n.")]


@pytest.fixture
def long_text(rng):
    """Some megabytes, much more than a chunk: prose, then one word and one line of 600,000 characters each."""
    from texts import prose

    return "\n".join([prose(rng, 60_000), "x" * 600_000, prose(rng, 120_000).replace("\n", " "), "end."])


@pytest.fixture
def edges():
    return list(EDGES)
