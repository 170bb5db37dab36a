from rolegrid.llm.catalog import ORACLES, QUERIES
from rolegrid.llm.line_rules import base_rules, quality_rules


def same(docs, sql):
    cols, want = sql(ORACLES["op5_line_rules"], documents=docs.select("doc_id", "text", "source"))
    assert sorted(map(tuple, quality_rules(docs).select(*cols).collect()), key=repr) == want
    return {r[cols.index("doc_id")]: dict(zip(cols, r)) for r in want}


def test_against_sql(docs_of, sql, prose):
    bar = "Home | About us | Contact\tand more words so that this line is a long one indeed "
    texts = [None, "", " \t\n ", "a b", "a a a a a", "x " * 3_000, "é É ###$$$ <a> & b|c", "a b c d a b c", " a  a  a", "y" * 100_000]
    texts += [f"{bar}\n{prose(60)}\n{bar.upper()}" for _ in range(40)] + [" ".join(f"z{k}" for k in range(60)) + "\n" + prose(30) for _ in range(60)]
    texts += [" ".join(f"w{(k * 7) % 400} v{k % 90}" for k in range(3_000))] * 2 + [prose(400) for _ in range(20)]
    rows = same(docs_of(texts, source=[None if k % 5 == 0 else f"s{k % 2}" for k in range(len(texts))]), sql)
    verdicts = {(r["base_failed"], r["kept"]) for r in rows.values()}
    assert verdicts == {(True, False), (False, True), (False, False)}
    assert rows[7]["n_repeat_words"] == 6


def test_rare_lines_cost_nothing(docs_of, sql, prose):
    rows = same(docs_of([prose(80) for _ in range(30)], source=["one"] * 30), sql)
    assert all(r["removed_words"] == 0 for r in rows.values())


def test_the_limit_does_not_loosen_with_the_host(docs_of, sql):
    bar = "one line that stands in twenty-five documents of a large host"
    texts = [f"{bar if k < 25 else 'own line'} {'' if k < 25 else k}\n" + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(2_600)]
    rows = same(docs_of(texts, source=["big"] * len(texts)), sql)
    assert all((rows[k]["removed_words"] > 0) == (k < 25) for k in rows)


def test_null_and_repeated_ids_and_empty(docs_of, prose):
    assert quality_rules(docs_of([])).count() == 0
    text = prose(60)
    got = sorted((r.doc_id or -1, r.n_words) for r in quality_rules(docs_of([text, text, text], ids=[2, 2, None])).collect())
    assert got == [(-1, len(text.split())), (2, len(text.split())), (2, len(text.split()))]


def test_query_and_plan(spark, sql, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols, want = sql(ORACLES["op5_line_rules"], documents=docs)
    assert sorted(map(tuple, QUERIES["op5_line_rules"](spark, "/root/testdata/sf0.001").select(*cols).collect()), key=repr) == want
    plan = quality_rules(docs_of(["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert base_rules(docs_of(["a b"])).first().n_words == 2


def test_kept_texts_lose_their_frequent_lines(docs_of, sql, prose):
    bar = "Home | About us | Contact"
    own = [prose(60).replace("\n", " ") + f" own{k}\n\nlast {k}" for k in range(30)]
    texts = [f" {bar.upper()}\t\n{t}\n{bar}" for t in own] + [f"{bar}\n{own[0]}", "\n".join([bar] * 40 + [own[1]]), None]
    docs = docs_of(texts, source=["a"] * 30 + ["b", "a", "a"])
    rows = same(docs, sql)
    out = {r.doc_id: r.text for r in quality_rules(docs).collect()}
    assert rows[30]["kept"] and out[30] == texts[30] and out[31] is None and out[32] is None
    kept = [i for i in range(30) if rows[i]["kept"]]
    assert kept and [out[i] for i in kept] == [own[i] for i in kept]
    lost = {i: len((texts[i] or "").split()) - len(out[i].split()) for i in out if rows[i]["kept"]}
    assert lost == {i: rows[i]["removed_words"] for i in lost}
