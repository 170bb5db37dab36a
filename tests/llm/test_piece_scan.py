import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rolegrid.llm import piece_scan
from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.piece_scan import Part, check_model, combine, decode, encode, normal, pieces, product, resolve, split

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["the", "internationalization", "\n", "  ", " ", "x", "é", "日本語", "aaaaaaa", "==========", "ing", "1234", "http://a.b/c", "   ", "\t", "𝔘", "▁", "ed and"]


def parts_of(text, size):
    m, s = pieces(MODEL), normal(text)
    cut = split(s, size, 2 * m.longest)
    return [Part(m, body, a, b, k == 0, k == len(cut) - 1) for k, body, a, b in cut]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 40])
def test_scan_gives_the_librarys_ids(size):
    r = random.Random(size)
    for _ in range(120):
        text = "".join(r.choice(BITS) + (" " if r.random() < 0.3 else "") for _ in range(r.randrange(1, 30)))
        parts = parts_of(text, size)
        at = resolve([p.transfer() for p in parts])
        assert [i for p, a, b in zip(parts, at, at[1:]) for i in p.backtrace(a, b)] == pieces(MODEL).encode(text)


def test_combining_is_associative_and_leaves_one_path():
    ms = [p.transfer() for p in parts_of("aaaaaaaatheinternational==========1234ing" * 2, 5)]
    left, right = ms[0], ms[-1]
    for m in ms[1:]:
        left = combine(left, m)
    for m in ms[-2::-1]:
        right = combine(m, right)
    assert left == right == [((0, 0), (0, 0))]


@pytest.mark.parametrize("size,width", [(3, 2), (5, 3), (9, 4)])
def test_products_of_ranges_leave_the_same_states(size, width):
    ms = [p.transfer() for p in parts_of("aaaaaaaatheinternational==========1234ing and more" * 3, size)]
    ranges = [ms[k : k + width] for k in range(0, len(ms), width)]
    ends = resolve([product(r) for r in ranges])
    inner = [resolve(r, a, b) for r, a, b in zip(ranges, ends, ends[1:])]
    assert [x for r in inner for x in r[:-1]] + [inner[-1][-1]] == resolve(ms)


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    def changed(change):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(pieces(MODEL).library.serialized_model_proto())
        change(model)
        return model.SerializeToString()

    check_model(changed(lambda m: None))
    for change in (lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"),
                   lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False),
                   lambda m: setattr(m.trainer_spec, "byte_fallback", False)):
        with pytest.raises(ValueError):
            check_model(changed(change))


def test_documents_against_the_library(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(piece_scan, "RANGE", 3)
    texts = [None, "", " ", "  a", "▁▁", "a\x00b", "<s> <0x0A> </s>", prose(400), "x" * 900, prose(300) + "q" * 700 + prose(200), "é" * 333, prose(90), prose(90)]
    docs = docs_of(texts)
    m = pieces(MODEL)
    for size in (64, 10_000):
        got = {r.doc_id: r for r in decode(encode(docs, MODEL, size), MODEL).collect()}
        assert {k: list(r.ids) for k, r in got.items()} == {k: m.library.encode(t or "") for k, t in enumerate(texts)}
        assert all(got[k].text == (t or "").replace("▁", " ") for k, t in enumerate(texts))
        assert all(got[k].text == m.library.decode(list(got[k].ids)) for k, t in enumerate(texts))
        assert sorted(encode(docs, MODEL, size, with_text=True).collect()) == sorted(got.values())
    assert got[7].n_chunks == 1


def test_repeated_rows_nulls_and_empty(spark, docs_of, prose):
    text = prose(200)
    docs = docs_of([text, text, text, "b"], ids=[1, 1, None, 1])
    rows = sorted((r.doc_id or 0, len(r.ids)) for r in encode(docs, MODEL, 50).collect())
    n = len(pieces(MODEL).encode(text))
    assert rows == [(0, n), (1, len(pieces(MODEL).encode("b"))), (1, n), (1, n)]
    assert encode(docs_of([]), MODEL).count() == 0


def test_query_against_the_library(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_piece_scan"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = pieces(MODEL).library.encode(r.text)
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
