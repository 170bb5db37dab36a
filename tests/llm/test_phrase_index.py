import pytest

from rolegrid.llm.catalog import ORACLES
from rolegrid.llm.phrase_index import decontaminate, proximity_matches


@pytest.fixture
def items_of(spark):
    def make(texts, ids=None):
        return spark.createDataFrame([(i, t, "x", 3) for i, t in zip(ids or range(len(texts)), texts)],
                                     "item_id bigint, text string, term string, pos int")

    return make


def same(docs, items, sql):
    cols, want = sql(ORACLES["op9_phrase_index"], documents=docs.select("doc_id", "text"), benchmark=items.select("item_id", "text"))
    assert sorted(map(tuple, decontaminate(docs, items).select(*cols).collect()), key=repr) == want
    return {r[cols.index("doc_id")]: dict(zip(cols, r)) for r in want}


def test_planted_overlapping_short_and_odd(docs_of, items_of, sql, prose):
    long = [prose(40) for _ in range(12)]
    items = [*long, "Rare Tiny Item", "one", None, "", "!!!", "the the the the the the the the the the the", long[0]]
    texts = [None, "", "...", "one", "ONE-two", "rare, tiny: item", "RARE tiny\x00item", "the " * 300, "É é one É", "x" * 200_000]
    texts += [f"{prose(20)} {long[k % 12]} {prose(9)} {long[(k * 5) % 12][30:150]} {prose(2)}" for k in range(60)] + [prose(50) for _ in range(30)]
    texts += [long[3].upper(), " ".join(long), texts[12], texts[12]]
    rows = same(docs_of(texts), items_of(items), sql)
    assert rows[7]["contaminated"] and rows[3]["n_items"] == 1 and not rows[2]["contaminated"]


def test_one_passage_in_every_document(docs_of, items_of, sql, prose):
    passage = prose(30)
    same(docs_of([f"{passage} {k} {prose(k % 7)} {passage}" for k in range(300)]), items_of([passage, prose(20)]), sql)


def test_empty_tables_null_and_repeated_ids(docs_of, items_of, sql):
    assert decontaminate(docs_of([]), items_of(["a b"])).count() == 0
    assert [r.contaminated for r in decontaminate(docs_of(["a b"]), items_of([])).collect()] == [False]
    docs = docs_of(["say a b now", "say a b now", "a b"], ids=[1, 1, None])
    got = sorted((r.doc_id or -1, r.n_hit) for r in decontaminate(docs, items_of(["a b", "a b"], ids=[4, 4])).collect())
    assert got == [(-1, 2), (1, 2), (1, 2)]


def test_rows_and_items_without_an_id_are_searched(docs_of, items_of):
    docs = docs_of(["clean text here", "say a b now", "say a b now", "x y", None], ids=[None, None, 3, None, None])
    got = sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, items_of(["a b", "x y"], ids=[None, 8])).collect())
    assert got == [(0, 0, 0, False), (2, 2, 1, True), (3, 0, 0, False), (4, 2, 0, True), (4, 2, 0, True)]


def test_proximity_against_brute_force(spark, docs_of, prose):
    texts = [prose(60) for _ in range(25)] + ["zebra violin", None, "zebra a b c violin", "violin " * 50 + "zebra"]
    docs = docs_of(texts)
    asked = {1: ["zebra", "violin"], 2: ["maple"], 3: ["zebra", "orchid", "the"], 4: ["zebra", "nowhere"], 5: []}
    queries = spark.createDataFrame(list(asked.items()), "query int, terms array<string>")
    import re
    held = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for k, t in enumerate(texts)}
    count = lambda term: sum(w.count(term) for w in held.values())
    want = set()
    for q, terms in asked.items():
        if terms:
            lead = min(terms, key=lambda t: (count(t), t))
            want |= {(q, d, p) for d, w in held.items() for p, x in enumerate(w) if x == lead
                     and all(t in w[max(0, p - 4) : p + 5] for t in terms)}
    assert {tuple(r) for r in proximity_matches(docs, queries, 4).collect()} == want


def test_plan_runs_no_python(docs_of, items_of):
    plan = decontaminate(docs_of(["a b"]), items_of(["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
