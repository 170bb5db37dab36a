import random
import re

import numpy as np
import pytest
import xxhash

from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.components import components
from rolegrid.llm.simhash import candidates, fingerprint, near_duplicates, plan_parts


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute(pairs):
    prints = [(i, slow_fingerprint(t)) for i, t in pairs]
    ids = {i for i, _ in prints if i is not None}
    linked = [(a, b) for a, x in prints for b, y in prints if a is not None and b is not None and (x ^ y).bit_count() <= 2]
    up = roots(ids, linked)
    return sorted((i, f"{x:016x}", up[i]) for i, x in prints)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("text", ["", "one", "Two Words", "a b c", "É a\x0bB\x1cc d é é é é", "x " * 500, "A b C " * 40_000])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_shares_the_hash_with_the_sql_function(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_against_all_pairs(spark, bucket):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(6))) for b in base for _ in range(12)} | {0, 2**63, 3}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)], "fp bigint, node bigint")
    plan = plan_parts(np.array(prints, np.uint64), 10**8)
    assert sum(t + 1 for _, t in plan) == 3
    found = {tuple(x) for x in candidates(nodes, plan, bucket=bucket).collect()}
    true = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in found)
    assert roots(range(len(prints)), found) == roots(range(len(prints)), true)


def test_components_of_chains_stars_and_repeats(spark):
    r = random.Random(5)
    order = r.sample(range(1000), 300)
    links = list(zip(order, order[1:])) + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7), (8000, 7999), (8000, 7999)]
    df = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = roots(nodes, [(a, b) for a, b in links if a != b])
    assert dict(map(tuple, components(df).collect())) == want
    assert components(df.limit(0)).count() == 0


def test_odd_texts_copies_and_ids(spark, docs_of, prose):
    long = prose(300)
    texts = [None, "", "  \n", "a", "A", "b", long, long, long + " x", prose(30), "y" * 200_000, prose(5), prose(5)]
    docs = docs_of(texts, ids=[5, 9, 3, 4, 2, 1, 30, 20, 40, 50, 60, 61, 62])
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs)) == brute(pairs)
    assert near_duplicates(docs_of([])).count() == 0
    rows = {(r.doc_id, r.component_id) for r in near_duplicates(docs_of(["same", "same", "other"], ids=[None, 4, None])).collect()}
    assert rows == {(None, 4), (4, 4), (None, None)}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got(QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs])
