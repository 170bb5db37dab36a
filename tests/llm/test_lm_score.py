import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rolegrid.llm import byte_trie as bt
from rolegrid.llm import lm_score
from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.lm_score import score_texts


def symbols(text):
    return [bt.PAD] * bt.DEPTH + list((text or "").encode().lower()) + [bt.END]


class Slow:
    """Prediction by partial matching from plain dictionaries, one symbol at a time."""

    def __init__(self, texts):
        self.nodes = defaultdict(Counter)
        for t in texts:
            s = symbols(t)
            for i in range(bt.DEPTH, len(s)):
                for k in range(bt.DEPTH + 1):
                    self.nodes[tuple(s[i - k : i])][s[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(bt.DEPTH, -1, -1):
            node = self.nodes.get(tuple(context[len(context) - k :]))
            if not node:
                continue
            left = {s: n for s, n in node.items() if s not in excluded}
            if left:
                escape = len(left) if len(node) < bt.ALPHABET else 0
                total = sum(left.values()) + escape
                if symbol in left:
                    return out * left[symbol] / total
                out *= escape / total
            excluded |= set(node)
        return out / (bt.ALPHABET - len(excluded))

    def score(self, text):
        s = symbols(text)
        return sum(math.log10(self.p(s[i - bt.DEPTH : i], s[i])) for i in range(bt.DEPTH, len(s)))


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def base(texts, text):
    count = Counter(w for t in texts for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    return [count[w] for w in [*(text or "").encode().lower().split(), None]], n, v


def agrees(rows, ids, texts):
    learned = [t for i, t in zip(ids, texts) if trained(i)]
    slow = Slow(learned)
    assert len(rows) == len(ids)
    want = sorted((-1 if i is None else i, not trained(i), t) for i, t in zip(ids, texts) for t in [t or ""])
    got = sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score))
    for (i, held, _), r in zip(want, got):
        assert (r.doc_id is None and i == -1) or r.doc_id == i
        assert r.held_out == held
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for i, t in zip(ids, texts):
        c, n, v = base(learned, t)
        expected = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        score = slow.score(t)
        assert any(r.n_tokens == len(c) and r.n_known == sum(x > 0 for x in c) and r.train_tokens == n and math.isclose(r.base_score, expected, abs_tol=1e-9)
                   and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9) for r in by_id[i])


def test_equals_brute_force(docs_of, prose, monkeypatch):
    texts = [prose(40) for _ in range(30)] + ["", None, "A", "new Wörds\x0bhere\x1cthere", "same same", "same same", "z" * 3000]
    ids = list(range(len(texts) - 3)) + [7, 7, None]
    agrees(score_texts(docs_of(texts, ids)).collect(), ids, texts)


def test_many_small_blocks_merged_level_by_level(docs_of, prose, monkeypatch):
    texts = [prose(30) for _ in range(40)]
    monkeypatch.setattr(lm_score, "FAN", 2)
    docs = docs_of(texts)
    few = {r.doc_id: r.score for r in score_texts(docs, shards=3).collect()}
    many = {r.doc_id: r.score for r in score_texts(docs.repartition(9), shards=5).collect()}
    assert few.keys() == many.keys() and all(math.isclose(few[k], many[k], rel_tol=1e-12) for k in few)


def test_probabilities_after_a_context_add_up_to_one(rng):
    texts = [bytes(rng.choice(b"abcab ") for _ in range(rng.randrange(40))) for _ in range(50)] + [bytes(range(256)) * 2]
    keys, counts = bt.add(*(lambda k: (k, np.ones(len(k), np.int64)))(np.concatenate([w for w, _, _ in bt.windows(texts)])))
    trie = bt.levels(keys, counts, [])
    contexts = np.concatenate([rng.sample(sorted(set((keys >> bt.BITS).tolist())), 200), [0, (97 << 36) | (98 << 27)]]).astype(np.int64)
    for c in contexts:
        p = 10 ** bt.log_probability(trie, (c << bt.BITS) | np.arange(bt.ALPHABET))
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()


def test_slices_of_a_giant_text_are_its_windows(rng):
    texts = [b"", b"abc", bytes(rng.randrange(256) for _ in range(1000)), b"x" * 64]
    whole = np.concatenate([w for w, _, _ in bt.windows(texts)])
    for part in (1, 7, 64, 500):
        got, places, sizes = (np.concatenate(x) for x in zip(*bt.windows(texts, part)))
        assert (got == whole).all() and sizes.sum() == len(whole)
        assert [sizes[places == k].sum() for k in range(4)] == [len(t) + 1 for t in texts]


def test_lookup_finds_every_key(rng):
    keys = np.unique(np.array([rng.randrange(1 << 54) for _ in range(5000)] + list(range(3000)), np.int64))
    asked = np.array(rng.choices(keys.tolist(), k=20_000), np.int64)
    assert (bt.Lookup(keys, keys * 0.5)(asked) == asked * 0.5).all()
    with pytest.raises(KeyError):
        bt.Lookup(keys, keys * 0.5)(np.array([1 << 60]))


def test_nothing_learned_is_uniform_and_no_rows_give_none(docs_of):
    from pyspark.sql import functions as F

    r = score_texts(docs_of(["ab"]), learn=F.lit(False)).collect()[0]
    assert math.isclose(r.score, -3 * math.log10(257)) and (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 2)
    assert score_texts(docs_of([])).count() == 0


def test_held_out_texts_are_likelier_than_by_words(spark):
    rows = QUERIES["op13_lm_score"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score < 0 for r in rows)
