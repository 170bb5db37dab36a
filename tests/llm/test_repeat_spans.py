import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rolegrid.llm.catalog import ORACLES, QUERIES
from rolegrid.llm.repeat_spans import remove_repeats
from rolegrid.llm.run_index import RunIndex, suffix_order


def brute(pairs, length=200):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                hit[k : k + length] = True
        kept = bytes(b for b, h in zip(t, hit) if not h)
        spans = int((hit[1:] & ~hit[:-1]).sum() + hit[0]) if len(t) else 0
        out.append((i, len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.drop("kept").collect()), key=repr)


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_matching_statistics_against_all_pairs(letters):
    r = random.Random(letters)
    for _ in range(60):
        x = bytes(r.randrange(letters) for _ in range(r.randrange(0, 90)))
        x = x[: len(x) // 3] * r.randrange(1, 5) if r.random() < 0.5 else x
        text = np.frombuffer(x, np.uint8)
        if x:
            assert list(suffix_order(text)) == sorted(range(len(x)), key=lambda k: x[k:])

        def match(i, j):
            return next((k for k in range(len(x) - max(i, j)) if x[i + k] != x[j + k]), len(x) - max(i, j))

        want = [max([0] + [match(i, j) for j in range(len(x)) if j != i]) for i in range(len(x))]
        index = RunIndex(text)
        assert list(index.matching_statistics()) == want
        assert index.lengths.sum() == len(x) and (len(x) == 0 or (np.diff(index.symbols) != 0).all())


def corpus(prose, rng):
    base = [prose(120) for _ in range(14)]
    texts = [None, "", "short", "a" * 900, "ab" * 300, "For " * 400, "é" * 150, base[0], base[0], base[1][:199], base[1][:200], base[1][:201]]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(len(a))
        texts.append(prose(rng.randrange(20)) + a[:cut] + prose(1) + a[cut:] + b[rng.randrange(len(b)) :] * rng.randrange(3))
    return texts


@pytest.mark.parametrize(("hot", "shard"), [(1 << 20, 1 << 20), (1 << 20, 4_000), (1_200, 4_000), (0, 1 << 20)])
def test_against_brute_force(docs_of, prose, rng, monkeypatch, hot, shard):
    monkeypatch.setattr("rolegrid.llm.repeat_spans.HOT_BYTES", hot)
    monkeypatch.setattr("rolegrid.llm.repeat_spans.SHARD_BYTES", shard)
    texts = corpus(prose, rng)
    want = brute(list(enumerate(texts)))
    assert got(remove_repeats(docs_of(texts))) == want
    assert any(r[3] > 1 for r in want)


def test_long_texts_are_cut_alike(docs_of, prose, rng, monkeypatch):
    monkeypatch.setattr("rolegrid.llm.repeat_spans.STEP", 500)
    monkeypatch.setattr("rolegrid.llm.repeat_spans.WINDOWS", 37)
    texts = corpus(prose, rng)
    assert got(remove_repeats(docs_of(texts))) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids_and_empty(docs_of, prose):
    a, b = prose(80), prose(80)
    pairs = [(1, a), (1, a), (1, b), (None, b), (None, prose(80)), (2, "z" * 300_000)]
    assert got(remove_repeats(docs_of([t for _, t in pairs], ids=[i for i, _ in pairs]))) == brute(pairs)
    assert remove_repeats(docs_of([])).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got(QUERIES["op1_repeat_spans"](spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs])


def test_the_sql_gives_the_same_rows(docs_of, prose, rng, sql):
    texts = corpus(prose, rng)
    cols, want = sql(ORACLES["op1_repeat_spans"], documents=docs_of(texts).select("doc_id", "text"))
    assert cols == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(want, key=repr) == brute(list(enumerate(texts)))
