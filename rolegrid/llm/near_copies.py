"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. ``sketches`` reduces a text to its SimHash fingerprint (that of ``simhash``), a digest of its shingle set and, for each of
   BANDS bands, a hash of ROWS minimum hashes. Texts with equal sets are one node from here on.
2. ``simhash_links`` pairs nodes whose fingerprints differ in at most 2 bits, by ``simhash.candidates``, and keeps those
   whose exact similarity is high enough. What they connect is one group; pairs inside a group are not looked at again.
   Texts at a similarity of 0.8 differ in about ten bits, which no part of 64 bits finds, so the other pairs come from 3 to 5.
3. ``links`` pairs nodes that share a band key. Two texts at similarity s share one with probability s^ROWS,
   so at 0.8 a pair is missed by all of 16 bands with probability 1e-5 (less above 0.8).
4. A key shared by more than BUCKET nodes makes no pairs. Nodes that have such a key, the crowded ones, are paired by their
   rarest shingles instead: in any common order, two sets of similarity 0.8 share one of their first |set| / 5 + 1 shingles, and
   in the order of rising frequency those are the ones that few nodes have. This loses no pair, however crowded
   the text that they share.
5. A rare shingle may crowd too, among copies of one text with a few edits each. Its nodes are compared with LEADERS of
   them, first of all the one with the fewest shingles of its own; that links most of them into one group. Each
   node that is still outside its shingle's largest group is then compared with all nodes of the shingle that leave room
   for the similarity beside the shingles that few nodes have, so no link between groups is lost either; pairs inside the
   largest group, which decide nothing, are not made.
6. ``verified`` keeps the candidates whose exact Jaccard similarity is high enough; what links connect is one group.

Edge cases: texts with fewer words than a shingle have one shingle, all their words; texts without words (or null) are
equal to each other and to nothing else; repeated rows and ids are rows of one node; ties go to the smallest doc_id; an
empty table gives no rows. Shingles and sets are identified by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.components import components
from rolegrid.llm.shared import as_bytes, batches, narrow, stash
from rolegrid.llm.simhash import SAMPLE, candidates, fingerprint, plan_parts

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 3
#: Nodes with one key that are all paired with each other, and those that all are compared with where even rare shingles crowd.
BUCKET, LEADERS = 16, 3
_CHUNK = 1 << 12
_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.unique(np.fromiter((digest(line[a : e - 1]) for a, e in zip(starts[:n], ends[size - 1 :])), np.uint64, n))


def band_keys(held: np.ndarray) -> np.ndarray:
    """BANDS keys of a non-empty set."""
    least = np.full(_SEEDS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(held), _CHUNK):
        least = np.minimum(least, ((held[k : k + _CHUNK] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in least.reshape(BANDS, ROWS)], np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, node, size, keys): th is the hash of the text, fp its fingerprint, node the digest of its shingle set."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                held = shingles(text)
                fp, node = np.array([fingerprint(text), xxhash.xxh3_64_intdigest(held.tobytes())], np.uint64).view(np.int64).tolist()
                yield doc_id, th, fp, node, len(held), band_keys(held).view(np.int64).ravel().tolist() if len(held) else []

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        lambda parts: batches(rows(parts), schema, 1_000), "doc_id bigint, th bigint, fp bigint, node bigint, size bigint, keys array<bigint>")


def _paired(keyed: DataFrame, by: list[str], bucket: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (x, y) of nodes that share a key which at most bucket nodes have, the rows (by, node, size) of other keys)."""
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    crowded = stash(counts.where(F.col("n") > bucket).drop("n"), "crowded")
    few = keyed.join(crowded, by, "left_anti").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("all")).where(F.size("all") > 1)
    pairs = few.select("all", F.posexplode("all").alias("at", "x")).select("x", F.explode(F.slice("all", F.col("at") + 2, F.lit(bucket))).alias("y"))
    return pairs, stash(keyed.join(crowded, by), "in-crowds")


def _stars(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each node of a key beside the key's LEADERS: the one with the fewest shingles of its own, one with about as few,
    and any one, the same in as many keys as they have."""
    weight = [F.col("own"), F.floor(F.col("own") / 4), F.lit(0)]
    first = [F.min(F.struct(weight[j].cast("bigint"), F.xxhash64("node", F.lit(j)), "node", "size")).alias(f"l{j}") for j in range(LEADERS)]
    led = rows.join(rows.groupBy(*by).agg(*first), by)
    return led.select(F.struct("node", "size").alias("x"), F.explode(F.array(*[
        F.struct(F.col(f"l{j}.node").alias("node"), F.col(f"l{j}.size").alias("size")) for j in range(LEADERS)])).alias("y"))


def rare_shingles(sets: DataFrame, bucket: int) -> DataFrame:
    """(shingle, node, size, own, at): of each set (node, held) the first |set| - ceil(0.8 |set|) + 1 shingles in the order of
    how many sets have them, rarest first (at counts them from 0). own: how many of the set's shingles at most bucket sets have."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for node, held in zip(part["node"].to_pylist(), part["held"]):
                shingle = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingle), node)), pa.array(np.full(len(shingle), len(shingle))), pa.array(shingle)], names=["node", "size", "shingle"])

    every = stash(sets.mapInArrow(run, "node bigint, size bigint, shingle bigint"), "crowd-shingles")
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ordered = every.join(often, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    first = F.col("size") - F.floor((4 * F.col("size") + 4) / 5) + 1
    own = F.size(F.filter("all", lambda s: s["n"] <= bucket)).alias("own")
    return ordered.select("node", "size", own, F.posexplode(F.slice("all", F.lit(1), first.cast("int"))).alias("at", "s")).select(
        F.col("s.shingle").alias("shingle"), "node", "size", "own", "at")


def _comparable(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of pairs (x, y) whose sizes allow the similarity."""
    near = (F.col("x.node") != F.col("y.node")) & (F.least("x.size", "y.size") >= SIMILAR * F.greatest("x.size", "y.size"))
    return pairs.where(near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def simhash_links(prints: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b), similar, of nodes (node, size) that rows (fp, node) give fingerprints within 2 bits; sets_of as in ``links``."""
    held = stash(prints.distinct(), "prints")
    heads = stash(held.groupBy("fp").agg(F.min("node").alias("head")), "print-heads")
    n = heads.count()
    sample = np.array([r.fp for r in heads.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    same = held.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = candidates(heads.withColumnRenamed("head", "node"), plan_parts(sample, n)) if n > 1 else same.limit(0)
    sized = nodes.select("node", "size")
    both = same.unionByName(near).join(sized.select(F.col("node").alias("a"), F.struct("node", "size").alias("x")), "a").join(
        sized.select(F.col("node").alias("b"), F.struct("node", "size").alias("y")), "b")
    pairs = stash(_comparable(both), "simhash-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return stash(verified(pairs, stash(sets_of(asked), "simhash-sets")), "simhash-links")


def _between(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one group (node, component)."""
    a, b = grouped.select(F.col("node").alias("a"), F.col("component").alias("ga")), grouped.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    apart = F.coalesce(F.col("ga") != F.col("gb"), F.lit(True))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(apart).select("a", "b")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], bucket: int = BUCKET, known: DataFrame | None = None) -> DataFrame:
    """(a, b) of nodes (node, size, keys): similar pairs that connect what similar pairs connect, those of ``known`` among
    them. sets_of gives the sets (node, held) of nodes (node)."""
    keyed = nodes.where(F.size("keys") > 0).select("node", "size", F.posexplode("keys").alias("band", "key"))
    few, crowd = _paired(keyed, ["band", "key"], bucket)
    crowd_sets = stash(sets_of(crowd.select("node").distinct()), "crowd-sets")
    rare, dense = _paired(stash(rare_shingles(crowd_sets, bucket), "rare"), ["shingle"], bucket)
    pairs = _comparable(reduce(DataFrame.unionByName, [few, rare, _stars(dense, ["shingle"])]))
    pairs = stash(pairs if known is None else _between(pairs, components(known)), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = verified(pairs, stash(sets_of(asked), "shingle-sets"))
    found = stash(found if known is None else found.unionByName(known), "links")
    grouped = components(found)
    placed = stash(dense.join(grouped, "node", "left").select("shingle", "node", "size", "at", (F.col("size") - F.col("own")).alias("common"), F.coalesce("component", "node").alias("grp")), "placed")
    sizes = placed.groupBy("shingle", "grp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"))
    # Nodes that share one of their own shingles are paired by it above. Others have at most the rest of the smaller one
    # in common, which has to be 4/9 of both sizes together for a similarity of 0.8, and so at least 0.8 of each.
    rest = placed.where(5 * F.col("common") >= 4 * F.col("size"))
    outside = rest.join(largest, "shingle").where("grp <> main").select("shingle", F.struct("node", "size").alias("x"), F.col("common").alias("own_common"), F.col("at").alias("own_at"), F.col("grp").alias("own_grp"))
    # Of the smaller set 8/9 have to be shared, so the first shared shingle is among its first 1/9.
    early = F.when(F.col("x.size") <= F.col("y.size"), 9 * F.col("own_at") <= F.col("x.size")).otherwise(9 * F.col("at") <= F.col("y.size"))
    enough = 9 * F.least("own_common", "common") >= 4 * (F.col("x.size") + F.col("y.size"))
    more = outside.join(rest.select("shingle", F.struct("node", "size").alias("y"), "common", "at", "grp"), "shingle").where((F.col("own_grp") != F.col("grp")) & enough & early)
    left = stash(_comparable(more).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    return found.unionByName(verified(left, crowd_sets))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. sets: (node, held), held the packed shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y in zip(part["x"], part["y"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * both >= 4 * (len(x) + len(y) - both))  # SIMILAR, in whole numbers
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, held) of docs (node, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in as_bytes(part.column(1))], pa.binary())], names=["node", "held"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, held binary")


def near_copies(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, first_id) of every row with a doc_id: th is xxhash64(text), first_id the smallest doc_id of the group."""
    docs = narrow(docs, "doc_id", "text").where("doc_id is not null")
    marked = stash(sketches(docs), "sketches")
    nodes = stash(marked.groupBy("node").agg(F.min(F.struct("doc_id", "th", "size", "keys")).alias("r")).select("node", "r.*"), "nodes")

    def sets_of(some: DataFrame) -> DataFrame:
        """One text of each node, as its set. Equal texts under one doc_id are one row."""
        asked = some.join(nodes, "node").select("node", "doc_id", "th")
        texts = docs.withColumn("th", F.xxhash64("text")).join(asked, ["doc_id", "th"]).dropDuplicates(["node"])
        return shingle_sets(texts)

    by_print = simhash_links(marked.select("fp", "node"), nodes, sets_of)
    linked = components(links(nodes, sets_of, bucket, by_print))
    grouped = nodes.select("node", "doc_id").join(linked, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    first = grouped.groupBy("component").agg(F.min("doc_id").alias("first_id"))
    heads = stash(grouped.join(first, "component").select("node", "first_id"), "heads")
    return marked.select("doc_id", "th", "node").join(heads, "node").select("doc_id", "th", "first_id")
