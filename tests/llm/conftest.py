import random

import duckdb
import pytest

from rolegrid.llm.registry import ship


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with extra columns whose names clash with the operators' own."""

    def make(texts, ids=None, source=None):
        ids = ids if ids is not None else list(range(len(texts)))
        rows = [(i, t, "en", (source[k] if source else f"s{k % 3}"), len(t) if t is not None else None, "x", 7)
                for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, part int").repartition(3)

    return make


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def sql():
    """Rows of an oracle over in-memory tables."""

    def run(text, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        cur = con.execute(text)
        return [d[0] for d in cur.description], sorted(cur.fetchall(), key=repr)

    return run


WORDS = "the of and to in is that was for on with as by at from or an be this which zebra quartz violin maple orchid".split()


@pytest.fixture
def prose(rng):
    def make(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n", "é"]) for _ in range(n))

    return make
