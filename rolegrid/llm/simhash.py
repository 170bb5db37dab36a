"""SimHash near-dedup with generalised pigeonhole search.

A text's fingerprint has a bit set where more than half of its word shingles' XXH64 values have it. Two texts are
linked when their fingerprints differ in at most ``radius`` bits; a component is what links connect.

Search works on distinct fingerprints (exact copies are one node, aggregated before any join):

1. ``plan_parts`` groups correlated bits into the same part, so that the other parts stay selective, and splits the
   radius into unequal thresholds t_i with sum(t_i) = radius - parts + 1 (t_i = -1: part not probed). By the
   generalised pigeonhole principle two fingerprints within the radius agree within t_i bits in some part i. The
   thresholds come from dynamic programming over candidate counts estimated on a bounded sample; the sample steers
   cost only, never results.
2. ``candidates`` indexes every fingerprint by its part values and probes with all values within t_i bits. Pairs are
   verified with a bit count.
3. A part value shared by more than BUCKET fingerprints makes no pairs. Its fingerprints are linked through their
   neighbours at one bit instead: two fingerprints are within 2 bits exactly if they share such a neighbour (or are
   one themselves), and at most 65 fingerprints share one, so the work stays in proportion to the rows.

Edge cases: texts with fewer words than a shingle count as one shingle; a text without words (or null) has
fingerprint zero, linked like any other; rows without a doc_id make no node and get the component of their
fingerprint if it has one; rows that repeat a doc_id are one node per fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.components import components
from rolegrid.llm.shared import as_bytes, narrow, stash

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
SAMPLE = 5_000
#: Fingerprints with one part value that are still paired with each other.
BUCKET = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and ASCII space only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        top = min(n, k + _CHUNK)
        got = np.fromiter(
            (digest(line[a : e - 1], SEED) for a, e in zip(starts[k:top], ends[k + shingle - 1 : top + shingle - 1])), "<u8", top - k)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = np.array([fingerprint(t, shingle) for t in as_bytes(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of like size, each grown from the strongest correlation left."""
    x = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    x -= x.mean(axis=0)
    spread = np.sqrt((x * x).sum(axis=0))
    like = np.abs(x.T @ x) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(like, -1)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        left = sorted(free)
        seed = max(left, key=lambda b: like[b, left].max())
        group = [seed]
        while len(group) < width:
            rest = sorted(free.difference(group))
            group.append(max(rest, key=lambda b: like[b, group].sum()))
        groups.append(sorted(group))
        free.difference_update(group)
    return groups


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _part_values(sample: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(sample), np.int64)
    for k, b in enumerate(bits):
        out |= ((sample >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def plan_parts(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe. sample: distinct fingerprints out of n."""
    scale = (n / max(len(sample), 1)) ** 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, radius + 3):
        groups = _group_bits(sample, parts)
        cost = []
        for bits in groups:
            values, counts = np.unique(_part_values(sample, bits), return_counts=True)
            row, pairs, done = {-1: 0.0}, 0.0, 0
            for t in range(radius + 1):
                masks = _masks(len(bits), t)
                if len(masks) > 600:  # that many probes for each fingerprint are never the cheapest
                    break
                for mask in masks[done:]:
                    at = np.minimum(np.searchsorted(values, values ^ mask), len(values) - 1)
                    hit = values[at] == values ^ mask
                    pairs += float((counts * np.where(hit, counts[at], 0)).sum()) - (mask == 0) * len(sample)
                done = len(masks)
                row[t] = pairs / 2 * scale + n * len(masks)
            cost.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (sofar, chosen) in table.items():
                for t, c in row.items():
                    if spent + t not in step or sofar + c < step[spent + t][0]:
                        step[spent + t] = (sofar + c, [*chosen, t])
            table = step
        if radius - parts + 1 in table:
            total, chosen = table[radius - parts + 1]
            if best is None or total < best[0]:
                best = (total, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    assert best is not None
    return best[1]


def _value(fp: Column, bits: list[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


def candidates(nodes: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS, bucket: int | None = None) -> DataFrame:
    """Verified links (a, b) of nodes (fp, node), fp distinct: enough of them to connect whatever is connected."""
    if radius != 2:
        raise ValueError("the path for crowded part values is written for a radius of 2")
    bucket = bucket or BUCKET
    held = nodes.select("fp", "node", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), _value(F.col("fp"), bits).alias("key")) for i, (bits, _) in enumerate(plan)])).alias("k"))
    index = held.select("k.part", "k.key", "fp", "node")
    asked = index
    if any(t for _, t in plan):
        spread = None
        for i, (bits, t) in enumerate(plan):
            masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(len(bits), t)])
            spread = masks if spread is None else F.when(F.col("part") == i, masks).otherwise(spread)
        asked = index.select("part", F.explode(spread).alias("mask"), "key", "fp", "node").select(
            "part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "fp", "node")
    crowded = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("part", "key")
    crowded = stash(crowded, "crowded")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = (
        index.join(crowded, ["part", "key"], "left_anti")
        .join(asked.select("part", "key", F.col("fp").alias("fp2"), F.col("node").alias("node2")), ["part", "key"])
        .where((F.col("fp") != F.col("fp2")) & near).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    )
    return pairs.unionByName(_links_by_neighbour(asked.join(crowded, ["part", "key"], "left_semi").select("fp", "node").distinct()))


def _links_by_neighbour(nodes: DataFrame) -> DataFrame:
    """Links that connect all nodes within 2 bits of each other, over shared neighbours at 1 bit or less."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint") for b in range(BITS)])
    around = nodes.select("node", "fp", F.explode(flips).alias("flip")).select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    # At most 65 distinct fingerprints lie within one bit of a point, so the list is bounded.
    met = around.groupBy("mid").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    return met.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    marked = stash(fingerprints(docs, shingle), "fingerprints")
    nodes = stash(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    n = nodes.count()
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    # Nodes are smallest doc_ids; where a doc_id repeats, two fingerprints can share one and are then one node.
    linked = components(candidates(nodes, plan_parts(sample, n, radius), radius)) if n > 1 else None
    if linked is not None:
        nodes = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    else:
        nodes = nodes.select("fp", F.col("node").alias("component_id"))
    return marked.join(nodes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
