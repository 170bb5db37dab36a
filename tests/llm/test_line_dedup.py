import numpy as np

from rolegrid.llm.catalog import ORACLES
from rolegrid.llm.line_dedup import build_index, dedup_lines, line_keys, probe
from rolegrid.llm.perfect_hash import PerfectHash


def same(df, sql, docs):
    cols, want = sql(ORACLES["op4_line_dedup"], documents=docs.select("doc_id", "text"))
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == want
    return want


def test_perfect_hash_is_minimal_and_rejects_nothing_it_holds():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    at = PerfectHash.build(keys)
    assert sorted(at(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).n == 0


def test_matches_sql_on_repeats_ties_and_odd_texts(spark, docs_of, sql, prose):
    shared = ["A Shared Line of Text", "  a shared line of text\t", "éééééééééé", "short"]
    texts = [None, "", "\n", "\n\n a \n"] + ["\n".join([prose(6), shared[k % 4], prose(3), shared[(k + 1) % 4]]) for k in range(60)]
    texts += [texts[10], texts[10], "x" * 300_000 + "\nA shared line of text", "éééééÉÉÉÉÉ\nÉÉÉÉÉééééé"]
    docs = docs_of(texts)
    want = same(dedup_lines(docs, shards=7), sql, docs)
    assert any(r[2] for r in want)


def test_hot_line_is_split_over_tasks(spark, docs_of, sql, monkeypatch):
    monkeypatch.setattr("rolegrid.llm.line_dedup.PROBE_ROWS", 10)
    docs = docs_of([f"the same line everywhere\nown line number {k}" for k in range(200)])
    same(dedup_lines(docs, shards=16), sql, docs)


def test_empty_table_null_and_repeated_ids(spark, docs_of):
    assert dedup_lines(docs_of([])).count() == 0
    docs = docs_of(["a line of text here", "a line of text here", "a line of text here", "a line of text here"], ids=[3, 3, None, 5])
    rows = sorted((r.doc_id or -1, r.n_dropped, r.text) for r in dedup_lines(docs).collect())
    assert rows == [(-1, 0, "a line of text here"), (3, 0, "a line of text here"), (3, 0, "a line of text here"), (5, 1, "")]


def test_foreign_documents_probe_an_index(spark, docs_of):
    index = build_index(line_keys(docs_of(["a known line one", "a known line one", "another line"]), 4))
    asked = line_keys(docs_of(["a known line one\nunknown line!", "another line"], ids=[10, 11]), 4)
    assert [r.doc_id for r in probe(asked, index).collect()] == [10]
