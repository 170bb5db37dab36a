"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence: two logistic models (low quality, toxic) over a document's distinct words, word beginnings and coarse
shares of symbols, capitals and repeats give log-odds per document. They are fitted on at most SAMPLE_LABELS labelled documents chosen by the hash of
their ids (a documented bound on fitting); features are counted per class with grouped aggregation and at most
FEATURES of the most telling ones are kept.

Sites: a document's host is its source, its path the language section of the host. ``site_rates`` sums the evidence
of all documents per path, host and overall. A host's rate is shrunk towards the overall rate and a path's rate
towards its host's, the more the fewer documents it has; the weights of the priors come from the spread of the rates
between groups (method of moments), so they too follow the data. A document's posterior log-odds are its evidence
moved by its path's rate against the overall rate. A document is rejected when either posterior passes one half.

A site with a third of all documents costs one row per task in the sums. The site table is joined by path; Spark sends
it to every task only where it is small, and can otherwise split the large path.

Edge cases: null text is an empty text; null source or language is a site of its own; labels without a value, or of
documents not in the table, are left out; without two classes in the labels a model gives no evidence, and nothing is
rejected for it; rows that repeat a doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.shared import narrow, stash

SAMPLE_LABELS = 20_000
FEATURES = 4_000
#: Documents that a feature needs, and how far beyond chance it must speak for a head.
LEAST, LEAST_Z = 4, 5.0
HEADS = ("low", "toxic")
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EDGES = ".,;:!?\"'()[]"


def _level(share: float) -> int:
    """Halvings from the whole down to the share, 12 at most."""
    return min(12, int(-math.log2(share)))


def features(text: str) -> set[str]:
    """Distinct words, beginnings of long words (marked ^), and which powers of two the shares of symbols, bars,
    exclamation marks, capitals and words that repeat the one before reach."""
    words, raw = text.lower().split(), text.encode()
    found = {w.strip(EDGES) for w in words}
    found.discard("")
    found |= {"^" + w[:5] for w in found if len(w) > 6}
    for name, n, whole in (
        ("symbols", sum(map(text.count, SYMBOLS)), len(text)), ("bars", text.count("|"), len(text)), ("shouts", text.count("!"), len(text)),
        ("capitals", len(raw) - len(raw.translate(None, CAPITALS)), len(raw)), ("repeats", sum(map(eq, words, words[1:])), len(words)),
    ):
        if n:
            found |= {f"{name} {k}" for k in range(_level(n / whole), 13)}
    return found


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_LABELS) -> DataFrame:
    """(low, toxic, found): labels and features of the sampled documents. A label sample holds at most 2 x limit rows."""
    known = narrow(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    every = max(1, -(-known.count() // limit))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * limit).select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays(
                [part["low"], part["toxic"], pa.array([sorted(features(t or "")) for t in part["text"].to_pylist()], pa.list_(pa.string()))],
                names=["low", "toxic", "found"])

    # At most 2 x limit rows of three numbers.
    sample = narrow(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("low", "toxic", "text")
    return stash(sample.mapInArrow(run, "low int, toxic int, found array<string>"), "labelled")


def _telling(sample: DataFrame, head: str, total: int, positive: int) -> list[str]:
    """Features that speak most for the head (z score of their share of positives), bounded by FEATURES. Copies of a
    text count once. Features that speak against it are left out: a short text lacks them without being bad."""
    p = positive / total
    counted = sample.dropDuplicates(["found"]).select(head, F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum(head).alias("k"))
    z = (F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    rows = counted.where(F.col("n") >= LEAST).select("f", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    return [r.f for r in rows]


def _logistic(rows: list[list[int]], y: np.ndarray, width: int, rounds: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Weights (last one the intercept) by gradient steps with momentum and per-weight scale."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    w = np.zeros(width + 1)
    w[-1] = math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        score = np.bincount(at, w[col], len(rows)) + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(col, gap[at], width) + ridge * w[:-1] / len(rows), gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[dict[str, float], float] | None]:
    """head -> (weight per feature, intercept), or None without two classes."""
    sample = labelled(docs, labels)
    row = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    model: dict[str, tuple[dict[str, float], float] | None] = {}
    for head in HEADS:
        if not row["n"] or not 0 < row[head] < row["n"]:
            model[head] = None
            continue
        names = _telling(sample, head, row["n"], row[head])
        place = {f: k for k, f in enumerate(names)}

        def run(parts: Iterator[pa.RecordBatch], place: dict[str, int] = place, head: str = head) -> Iterator[pa.RecordBatch]:
            for part in parts:
                hits = [[place[f] for f in found if f in place] for found in part["found"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[head], pa.array(hits, pa.list_(pa.int32()))], names=["y", "hits"])

        rows = sample.select(head, "found").mapInArrow(run, "y int, hits array<int>").collect()
        w = _logistic([r.hits for r in rows], np.array([r.y for r in rows], float), len(names))
        model[head] = ({f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-3}, float(w[-1]))
    return model


def score(docs: DataFrame, model: dict[str, tuple[dict[str, float], float] | None], carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, low, toxic) and the carried columns: log-odds of each head, null where it has no model."""
    kinds = dict(docs.dtypes)
    kept = ["doc_id", "source", "lang", *carry]
    weights = {h: m for h, m in model.items() if m is not None}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list[float | None]] = {h: [] for h in HEADS}
            for text in part["text"].to_pylist():
                found = features(text or "")
                for h in HEADS:
                    if h in weights:
                        table, base = weights[h]
                        hit = found & table.keys() if len(found) < len(table) else [f for f in table if f in found]
                        out[h].append(base + math.fsum(table[f] for f in hit))
                    else:
                        out[h].append(None)
            yield pa.RecordBatch.from_arrays([part[n] for n in kept] + [pa.array(out[h], pa.float64()) for h in HEADS], names=[*kept, *HEADS])

    need = [*kept, *([] if "text" in carry else ["text"])]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in kept) + ", low double, toxic double"
    return narrow(docs, *need).mapInArrow(run, schema)


def _rate(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_rates(scored: DataFrame) -> DataFrame:
    """(host, path, shift_low, shift_toxic): what a document's log-odds gain from its site."""
    paths = scored.groupBy(F.coalesce("source", F.lit("\u0000")).alias("host"), F.coalesce("lang", F.lit("\u0000")).alias("path")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(_rate(F.col(h))).alias(h) for h in HEADS])
    paths = stash(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(h).alias(f"host_{h}") for h in HEADS])
    overall = paths.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    if not overall["n"]:
        return paths.select("host", "path", *[F.lit(0.0).alias(f"shift_{h}") for h in HEADS])

    def strength(groups: DataFrame, n: str, total: str, mean: float) -> float:
        """Documents that a prior counts for: large where the groups' rates hardly differ beyond chance."""
        if not 0 < mean < 1:
            return 1e6
        row = groups.agg(F.count(F.lit(1)).alias("g"), F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"),
                         F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, F.lit(2))).alias("ss")).first()
        spread = row["n"] - row["n2"] / row["n"]
        if row["g"] < 2 or spread <= 0:
            return 1e6
        between = (row["ss"] - (row["g"] - 1) * mean * (1 - mean)) / spread
        return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6

    out, shifts = paths.join(hosts, "host"), []
    for h in HEADS:
        if overall[h] is None:
            shifts.append(F.lit(0.0).alias(f"shift_{h}"))
            continue
        mean = min(max(overall[h] / overall["n"], 1e-6), 1 - 1e-6)
        k_host, k_path = strength(hosts, "host_n", f"host_{h}", mean), strength(paths, "n", h, mean)
        host_rate = (F.col(f"host_{h}") + k_host * mean) / (F.col("host_n") + k_host)
        path_rate = (F.col(h) + k_path * host_rate) / (F.col("n") + k_path)
        shifts.append((_logit(F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))) - math.log(mean / (1 - mean))).alias(f"shift_{h}"))
    return out.select("host", "path", *shifts)


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, the carried columns, p_low, p_toxic, kept) of every row of docs."""
    scored = stash(score(docs, fit(docs, labels), carry), "scored")
    sites = stash(site_rates(scored.select("source", "lang", *HEADS)), "sites")
    joined = scored.join(sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[f"shift_{h}" for h in HEADS]),
                         (F.coalesce("source", F.lit("\u0000")) == F.col("_host")) & (F.coalesce("lang", F.lit("\u0000")) == F.col("_path")))
    p = {h: F.coalesce(_rate(F.col(h) + F.col(f"shift_{h}")), F.lit(0.0)) for h in HEADS}
    return joined.select("doc_id", "source", "lang", *carry, p["low"].alias("p_low"), p["toxic"].alias("p_toxic"),
                         ((p["low"] <= 0.5) & (p["toxic"] <= 0.5)).alias("kept"))
