import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.token_store import cuts_at_blanks, read_documents, read_store, train_dictionary, write_store

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(pairs):
    """Ids of whole texts, in ascending doc_id order."""
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0], p[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_odd_texts_round_trip(spark, docs_of, prose, monkeypatch, block):
    monkeypatch.setattr("rolegrid.llm.token_store.BLOCK_BYTES", block)
    texts = [None, "", " ", "\n\n", "don't  stop<|endoftext|>now <|endoftext|>", "é ́x y z\x1cq", "ΟΔΟΣ ΣΑΣ. Straße İ", "1234567 3.14$$$",
             "word " * 20_000, "x" * 50_000, "̸ ≠", "x\x00y\x0bz"] + [prose(40) for _ in range(60)] + ["twice", "twice"]
    docs = docs_of(texts)
    path = write_store(docs, PATH)
    assert got(read_store(spark, path)) == brute(list(enumerate(texts)))
    tok = Tokenizer.from_file(PATH)
    some = {r.doc_id: r.ids for r in read_documents(spark, path, [4, 8, 30]).collect()}
    assert some == {k: tok.encode(texts[k], add_special_tokens=False).ids + [1] for k in (4, 8, 30)}


def test_null_and_repeated_ids_and_empty_table(spark, docs_of):
    pairs = [(5, "b"), (None, "n"), (5, "a"), (2, "z")]
    docs = docs_of([t for _, t in pairs], ids=[i for i, _ in pairs])
    assert got(read_store(spark, write_store(docs, PATH))) == brute(pairs)
    path = write_store(docs_of([]), PATH)
    assert read_store(spark, path).count() == 0 and read_documents(spark, path, []).count() == 0


def test_query_against_whole_encodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(QUERIES["op2_token_store"](spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_another_vocabulary_gives_its_own_ids(spark, docs_of, prose):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert cuts_at_blanks(PATH) and not cuts_at_blanks(path)
    texts = [prose(80), "  two  blanks \n and a line", "a b", "é ü 日本", "", None, prose(30)]
    tok = Tokenizer.from_file(path)
    want = {k: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in read_store(spark, write_store(docs_of(texts), path)).collect()} == want


def test_long_texts_get_a_dictionary_too(docs_of, prose):
    docs = docs_of([prose(20_000) for _ in range(24)])
    assert len(train_dictionary(docs, PATH)) > 1000
