import math

import pytest

from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.site_bayes import classify, features, fit, score, site_rates


@pytest.fixture
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, quality int, toxic int, found string, low int")

    return make


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    got = {r.doc_id: r.kept for r in classify(docs, labels.where("doc_id % 4 <> 0")).collect()}
    rows = held.collect()
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    low = [r for r in rows if r.quality == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(got[r.doc_id] for r in clean) >= 0.99 * len(clean)
    assert sum(not got[r.doc_id] for r in low) >= 0.98 * len(low)
    # A tenth of the toxic labels sit on texts without any mark that others share.
    assert sum(not got[r.doc_id] for r in toxic) >= 0.8 * len(toxic)


def test_sparse_sites_shrink_to_the_overall_rate(spark):
    logit = lambda p: math.log(p / (1 - p))
    rows = [("big", "en", 3.0, -3.0)] * 400 + [("big", "en", -3.0, -3.0)] * 100 + [("tiny", "en", 3.0, -3.0)] + [("calm", "en", -3.0, -3.0)] * 500
    rows += [(None, None, 0.0, None)]
    shifts = {r.host: r for r in site_rates(spark.createDataFrame(rows, "source string, lang string, low double, toxic double")).collect()}
    assert shifts["big"].shift_low > 0 > shifts["calm"].shift_low
    assert 0 < shifts["tiny"].shift_low < shifts["big"].shift_low + logit(0.9)
    assert abs(shifts["tiny"].shift_low) < abs(logit(0.95))
    assert len(shifts) == 4


def test_every_document_is_scored_alike_with_nulls_and_repeats(docs_of, labels_of, prose):
    texts = [prose(60) + " awfulword" * (k % 2) for k in range(80)] + [None, "", "z" * 100_000, "### $$$ &&&"]
    docs = docs_of(texts)
    labels = labels_of([(k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (70, None, 1), (71, 1, None), (9999, 1, 1)])
    rows = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert all(rows[k].kept == (k % 2 == 0) for k in range(80))
    assert all(rows[k].kept for k in (80, 81, 82))  # nothing was labelled low: no evidence
    again = classify(docs_of(["clean words", "clean words", "x awfulword"], ids=[1, 1, None], source=[None, None, "s"]), labels_of([]))
    assert [r.kept for r in again.collect()] == [True] * 3
    assert classify(docs_of([]), labels).count() == 0


def test_features_and_one_score():
    assert {f for f in features("Word, WORD. longerword") if " " not in f} == {"word", "longerword", "^longe"}
    assert {"symbols 2", "symbols 12", "ab#$xxxx"} <= features("ab#$" + "x" * 4) and "symbols 1" not in features("ab#$xxxx")
    assert "capitals 0" in features("ABC") and "repeats 1" in features("w " * 20) and features("") == set()


def test_score_is_the_sum_of_weights(docs_of):
    got = score(docs_of(["a b c", "b b"]), {"low": ({"a": 1.0, "b": 0.5}, -2.0), "toxic": None}).collect()
    assert sorted((r.doc_id, r.low, r.toxic) for r in got) == [(0, -0.5, None), (1, -1.5, None)]


def test_query_scores_all(spark):
    assert QUERIES["op7_site_bayes"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def rate(x):
    return 1 / (1 + math.exp(-x))


def posteriors(rows, evidence):
    """Posterior log-odds of rows (source, lang) with their evidence, for one head, by plain sums."""
    logit = lambda p: math.log(p / (1 - p))
    paths, hosts = {}, {}
    for (source, lang), x in zip(rows, evidence):
        for table, key in ((paths, (source, lang)), (hosts, source)):
            n, total = table.get(key, (0, 0.0))
            table[key] = (n + 1, total + rate(x))
    n, total = len(rows), sum(map(rate, evidence))
    mean = min(max(total / n, 1e-6), 1 - 1e-6)

    def strength(groups):
        spread = n - sum(c * c for c, _ in groups) / n
        if len(groups) < 2 or spread <= 0:
            return 1e6
        between = (sum(c * (t / c - mean) ** 2 for c, t in groups) - (len(groups) - 1) * mean * (1 - mean)) / spread
        return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6

    k_host, k_path = strength(list(hosts.values())), strength(list(paths.values()))
    out = []
    for (source, lang), x in zip(rows, evidence):
        host_n, host_total = hosts[source]
        path_n, path_total = paths[source, lang]
        host_rate = (host_total + k_host * mean) / (host_n + k_host)
        path_rate = (path_total + k_path * host_rate) / (path_n + k_path)
        out.append(x + logit(min(max(path_rate, 1e-6), 1 - 1e-6)) - logit(mean))
    return out


def test_posteriors_against_plain_sums(spark, labels_of, prose, rng):
    sites = [("big", "en")] * 5 + [("big", "de"), ("small", "en"), (None, "fr"), ("small", None)]
    docs, labels = [], []
    for k in range(240):
        source, lang = rng.choice(sites)
        low, toxic = rng.random() < (0.6 if source == "big" else 0.1), rng.random() < 0.3
        docs.append((k, prose(30) + " junkword spamword" * low + " awfulword" * toxic, source, lang, "x"))
        labels.append((k, int(not low), int(toxic)))
    docs += [(900, None, "big", "en", "x"), (901, "", "lone", "en", "x"), (7, docs[7][1], "small", "en", "x")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, p_low string").repartition(4)
    known = labels_of(labels[:200])
    model = fit(table, known)
    assert all(model.values())
    want = {}
    for head in ("low", "toxic"):
        weights, base = model[head]
        evidence = [base + sum(weights.get(f, 0.0) for f in features(t or "")) for _, t, *_ in docs]
        for row, x in zip(docs, posteriors([(r[2], r[3]) for r in docs], evidence)):
            want.setdefault((row[0], row[2], row[3]), {})[head] = rate(x)
    rows = classify(table, known).collect()
    assert len(rows) == len(docs) and len(want) == len(docs)
    for r in rows:
        w = want[r.doc_id, r.source, r.lang]
        assert math.isclose(r.p_low, w["low"], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r.p_toxic, w["toxic"], rel_tol=1e-9, abs_tol=1e-12)
        assert r.kept == (w["low"] <= 0.5 and w["toxic"] <= 0.5)


def test_the_site_level_corrects_verdicts(spark, rng):
    """Noisy evidence on sites with different true rates: fewer wrong verdicts with the sites' shifts than without."""
    rows = []
    for host, share, n in (("bad", 0.9, 600), ("good", 0.03, 1500), ("mixed", 0.5, 300)):
        for _ in range(n):
            low = rng.random() < share
            rows.append((host, rng.choice(["en", "de"]), rng.gauss(1.0 if low else -1.0, 1.4), None, low))
    table = spark.createDataFrame(rows, "source string, lang string, low double, toxic double, truth boolean")
    shift = {(r.host, r.path): r.shift_low for r in site_rates(table).collect()}
    alone = sum((x > 0) != truth for _, _, x, _, truth in rows)
    moved = sum((x + shift[host, path] > 0) != truth for host, path, x, _, truth in rows)
    assert moved < 0.9 * alone
