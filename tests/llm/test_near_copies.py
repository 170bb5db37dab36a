import random

import corpus_pipeline as p
import pytest

from rolegrid.llm.near_copies import near_copies
from tests.llm.test_simhash import roots


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(pairs):
    sets = [(i, grams(t)) for i, t in pairs]
    links = [(i, j) for i, a in sets for j, b in sets if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b) > 0)]
    return roots({i for i, _ in pairs}, links)


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"edit{r.randrange(10**9)}"
    return " ".join(words)


def test_stage_against_brute_force_jaccard(spark, docs_of):
    r = random.Random(11)
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d f"]
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        texts += [" ".join(base), *[edited(r, base, r.randrange(0, max(2, len(base) // 30))) for _ in range(3)]]
    pairs = list(enumerate(texts))
    want = {i for i, root in brute(pairs).items() if i == root}
    assert len(want) < len(texts) - 60
    assert {x.doc_id for x in p.near_stage(spark, docs_of(texts), "").collect()} == want


@pytest.mark.parametrize("bucket", [2, 16])
def test_crowd_of_edited_copies(docs_of, bucket):
    r = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    texts = [edited(r, base, r.randrange(1, 4)) for _ in range(120)] + [edited(r, [f"v{k}" for k in range(200)], 1) for _ in range(30)]
    pairs = list(enumerate(texts))
    assert {x.doc_id: x.first_id for x in near_copies(docs_of(texts), bucket).collect()} == brute(pairs)


def test_rows_that_repeat_an_id_lose_only_the_copy(spark, docs_of):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    left = p.near_stage(spark, docs_of([a, a, b, b, None], ids=[3, 5, 5, 7, None]), "").collect()
    assert sorted((x.doc_id or -1, x.text) for x in left) == [(-1, None), (3, a), (5, b)]


def test_twins_in_a_crowd_that_shares_a_template(docs_of):
    """Every two texts share 0.70 of their shingles, twins 0.82: more nodes under each band key than are paired."""
    r = random.Random(13)
    own = lambda n: " ".join(f"u{r.randrange(10**12)}" for _ in range(n))
    template = " ".join(f"t{k}" for k in range(350))
    texts = []
    for _ in range(250):
        pair = own(34)
        texts += [f"{template} {pair} {own(40)}" for _ in range(2)]
    texts += [f"{template} {own(74)}" for _ in range(250)]
    a, b, c = grams(texts[0]), grams(texts[1]), grams(texts[-1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.84 and 0.68 < len(a & c) / len(a | c) < 0.72
    got = {x.doc_id: x.first_id for x in near_copies(docs_of(texts)).collect()}
    assert got == {k: k - k % 2 if k < 500 else k for k in range(750)}


def test_no_rows_and_a_very_long_text(docs_of):
    assert near_copies(docs_of([])).count() == 0
    r = random.Random(14)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(long), edited(r, long, 500), "short text of six words here", None]
    assert {x.doc_id: x.first_id for x in near_copies(docs_of(texts)).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_stages_on_an_empty_table_and_on_odd_rows(spark, docs_of):
    """Null, empty and very long texts, repeated rows: no stage loses a clean document."""
    r = random.Random(15)
    clean = " ".join(f"w{r.randrange(3000)}" for _ in range(30_000))
    docs = docs_of([None, "", clean, "few plain words stand here", "few plain words stand here"], ids=[1, 2, 3, 4, None])
    for name, stage in p.STAGES[1:4]:
        assert stage(spark, docs_of([]), "/root/testdata/sf0.001").count() == 0, name
        kept = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert {1, 3}.issubset({x.doc_id for x in kept}) and clean in {x.text for x in kept}, name


def test_simhash_links_are_within_two_bits_and_exactly_similar(spark, docs_of, monkeypatch):
    """The stage's first links are SimHash's; with the shingles' candidates left out they still carry the copies."""
    from rolegrid.llm import near_copies as nc
    from tests.llm.test_simhash import slow_fingerprint

    r = random.Random(16)
    base = [[f"w{r.randrange(5000)}" for _ in range(400)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [edited(r, b, 1) for b in base] * 2 + ["one two", "a b c"]
    prints, sets = [slow_fingerprint(t) for t in texts], [grams(t) for t in texts]
    want = roots(set(range(len(texts))), [
        (i, j) for j in range(len(texts)) for i in range(j)
        if (prints[i] ^ prints[j]).bit_count() <= 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert len(set(want.values())) < len(texts) - 6  # more than the equal texts
    monkeypatch.setattr(nc, "links", lambda nodes, sets_of, bucket, known: known)
    assert {x.doc_id: x.first_id for x in near_copies(docs_of(texts)).collect()} == want
