import public_tokenizers

import corpus_pipeline as p
from rolegrid.llm.catalog import ORACLES
from rolegrid.llm.piece_scan import pieces
from rolegrid.llm.site_bayes import classify
from tests.llm.test_simhash import brute as simhash

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version_on_its_own_input(spark, sql, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    left = {}
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, SF)
        if k < 4:
            assert tuple(out.columns) == p.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r.asDict() for r in after.collect()}
        left[name] = len(rows)
        if name == "quality classifier":
            kept = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert rows == {i: r for i, r in before.items() if i in kept} and len(rows) < len(before)
        if name == "line dedup":
            cols, want = sql(ORACLES["op4_line_dedup"], documents=docs.select("doc_id", "text"))
            sizes = {r[cols.index("doc_id")]: r[cols.index("n_lines")] - r[cols.index("n_dropped")] for r in want}
            assert rows.keys() == before.keys()
            assert all((r["text"].count("\n") + 1 if r["text"] else 0) in (sizes[i], sizes[i] - 1) and r["n_chars"] == len(r["text"]) for i, r in rows.items())
        if name == "simhash near-dedup":
            assert rows == {i: before[i] for i, _, root in simhash([(i, r["text"]) for i, r in before.items()]) if i == root}
        if name == "benchmark decontamination":
            cols, want = sql(ORACLES["op9_phrase_index"], documents=docs.select("doc_id", "text"), benchmark=bench)
            clean = {r[cols.index("doc_id")] for r in want if not r[cols.index("contaminated")]}
            assert rows == {i: before[i] for i in clean}
        if name == "sentencepiece":
            library = pieces(public_tokenizers.path("piece_bpe_32k.model")).library
            assert {i: (r["ids"], r["text"]) for i, r in rows.items()} == {i: (library.encode(r["text"]), r["text"]) for i, r in before.items()}
        docs = after
    assert left["sentencepiece"] == p.run(spark, SF).count()
    assert len(p.STAGES) == 5


def test_null_and_empty_documents_pass_through(spark, docs_of):
    docs = docs_of([None, "", "one clean line of text", "another line of text here"], ids=[1, 2, 3, None])
    for _, stage in p.STAGES[:4]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {1, 3, None}
    assert p.piece_stage(spark, docs, SF).count() == 3
