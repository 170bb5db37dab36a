"""Benchmark decontamination over a distributed positional inverted index, with built-in expressions only.

Words are maximal runs of digits, letters and non-ASCII characters, with A-Z lower-cased. A window is ``WINDOW``
consecutive words of an item; an item with fewer words (but some) is one window of all of them.

1. ``term_counts`` counts the windows' terms over all documents (map-side combine).
2. ``rank_terms`` orders each window's terms by those counts, rarest first.
3. ``postings`` stores, for the two rarest terms of each window, one row per occurrence in the training text:
   (term, doc_id, pos) and, for the rarest, the words around it. Rows are dealt by document, never gathered by term,
   so a frequent term has no hot group.
4. ``phrase_matches`` intersects the offset-adjusted lists (pos - offset = start of the window) of the rarest and the
   second rarest term and compares the remaining terms at their offsets: exact matches only.
5. ``hits`` merges overlapping matches per document.

``proximity_matches`` finds the places where all terms of a query lie within a number of words.

Edge cases: null text has no words; items or documents without words match nothing; a row without a doc_id is a
document of its own text (``doc_key``) and searched like others; rows that repeat a doc_id are one document and share its
hits; items that repeat an item_id count once; an item without an id makes words hit and documents contaminated, but is
not among the items counted and named; empty tables give no hits, and every document is still returned. Terms are
compared as strings; hashes only route them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.shared import narrow, stash

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. Pure ASCII texts (most) take the fast built-in; others must keep their other capitals."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), GAPS), ""), F.array().cast("array<string>"))


def doc_key() -> Column:
    """What rows of one document share: the doc_id, or the text of a row without one."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, terms, items): distinct windows with the ids of the items that have them."""
    held = narrow(items, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    each = held.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k + 1, size))).alias("terms"))
    # The items that share a window are part of the stated query set.
    return each.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(
        F.xxhash64("terms").alias("window"), "terms", "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of each of the given distinct terms; 0 where there are none."""
    seen = narrow(docs, "text").select(F.explode(words(F.col("text"))).alias("term"))
    counted = seen.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rank_terms(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, terms, items, first, second): the two rarest terms as (n, at, term). Windows with a term that occurs
    nowhere are left out; windows of one word have no second."""
    spread = asked.select("window", "terms", F.posexplode("terms").alias("at", "term")).join(counts, "term")
    order = spread.groupBy("window", "terms").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("ranked"))
    return order.where(F.col("ranked")[0]["n"] > 0).join(asked.select("window", "terms", "items"), ["window", "terms"]).select(
        "window", "terms", "items", F.col("ranked")[0].alias("first"), F.get("ranked", F.lit(1)).alias("second"))


def postings(docs: DataFrame, wanted: DataFrame, around: int = 0) -> DataFrame:
    """(term, doc, pos, left, context) of the wanted terms; doc is the document's key. wanted: (term, with_context). context holds the words
    from pos - around to pos + around where asked for, left how many of them stand before pos."""
    held = narrow(docs, "doc_id", "text").select(doc_key().alias("doc"), words(F.col("text")).alias("w"))
    each = held.select("doc", "w", F.posexplode("w").alias("pos", "term"))
    left = F.least("pos", F.lit(around))
    return each.join(wanted, "term").select(
        "term", "doc", "pos", left.alias("left"),
        F.when(F.col("with_context"), F.slice("w", F.col("pos") - left + 1, left + around + 1)).alias("context"))


def phrase_matches(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc, start, len, items) of every exact occurrence of a window."""
    at1, at2 = F.col("first")["at"], F.col("second")["at"]
    lead = (
        found.where("context is not null").join(ranked.withColumn("term", F.col("first")["term"]), "term")
        .where((F.col("pos") >= at1) & (F.slice("context", F.col("left") - at1 + 1, F.size("terms")) == F.col("terms")) & (F.col("left") >= at1))
        .select("window", "doc", (F.col("pos") - at1).alias("start"), F.size("terms").alias("len"), "items", "second")
    )
    follow = (
        found.join(ranked.where("second is not null").withColumn("term", F.col("second")["term"]), "term")
        .select("window", "doc", (F.col("pos") - at2).alias("start"))
    )
    both = lead.where("second is not null").join(follow, ["window", "doc", "start"], "left_semi")
    return lead.where("second is null").unionByName(both).select("doc", "start", "len", "items")


def hits(matches: DataFrame) -> DataFrame:
    """(doc, n_hit, items): words inside any match, and the items with matches as sorted strings."""
    spans = matches.groupBy("doc", "start").agg(F.max("len").alias("len"))
    reach = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        more = F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    covered = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("s")).select(
        "doc", F.aggregate("s", reach, step)["n"].alias("n_hit"))
    named = matches.select("doc", F.explode("items").alias("item")).groupBy("doc").agg(
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    none = F.array().cast("array<string>")
    return covered.join(named, "doc", "left").select("doc", "n_hit", F.coalesce("items", none).alias("items"))


def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """hits() of the items' windows in docs."""
    asked = stash(windows(items, size), "windows")
    terms = stash(asked.select(F.explode("terms").alias("term")).distinct(), "terms")
    ranked = stash(rank_terms(asked, stash(term_counts(docs, terms), "term-counts")), "ranked")
    firsts = ranked.select(F.col("first")["term"].alias("term"), F.lit(True).alias("with_context"))
    seconds = ranked.where("second is not null").select(F.col("second")["term"].alias("term"), F.lit(False).alias("with_context"))
    wanted = stash(firsts.unionByName(seconds).groupBy("term").agg(F.max("with_context").alias("with_context")), "wanted")
    found = stash(postings(docs, wanted, size - 1), "postings")
    return hits(phrase_matches(found, ranked))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    found = find_items(docs, items, size).withColumnRenamed("doc", "hit_doc")
    sized = narrow(docs, "doc_id", "text").select("doc_id", doc_key().alias("doc"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    joined = sized.join(found, F.col("doc") == F.col("hit_doc"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    names = F.coalesce("items", F.array().cast(T.ArrayType(T.StringType())))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query, doc_id, pos): places pos of a query's rarest term that have all its other terms at most ``within``
    words away. queries: (query, terms array<string>), terms lower-cased; repeated terms count once. Rows without a
    doc_id have no name to be returned under and are not searched.

    Positions are put in bins of ``within`` words and a bin is only compared with its neighbours."""
    asked = stash(queries.select("query", F.array_distinct("terms").alias("terms")), "queries")
    each = asked.select("query", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    terms = stash(each.select("term").distinct(), "terms")
    counts = term_counts(docs, terms)
    rarest = each.join(counts, "term").groupBy("query", "n_terms").agg(F.min(F.struct("n", "term"))["term"].alias("rarest")).where("n_terms > 0")
    named = narrow(docs, "doc_id", "text").where("doc_id is not null")
    found = stash(postings(named, terms.withColumn("with_context", F.lit(False))).select("term", "doc", "pos"), "postings")
    bins = F.floor(F.col("pos") / max(within, 1))
    lead = found.join(stash(rarest, "rarest"), found["term"] == F.col("rarest")).select("query", "n_terms", "rarest", "doc", F.col("pos").alias("lead"))
    near = lead.withColumn("bin", F.explode(F.array(*[F.floor(F.col("lead") / max(within, 1)) + d for d in (-1, 0, 1)])))
    rest = found.join(each.select("query", "term"), "term").select("query", "term", "doc", "pos", bins.alias("bin"))
    met = near.join(rest, ["query", "doc", "bin"]).where(F.abs(F.col("pos") - F.col("lead")) <= within)
    return (
        met.select("query", "n_terms", "doc", "lead", "term").distinct().groupBy("query", "n_terms", "doc", "lead")
        .agg(F.count(F.lit(1)).alias("n")).where("n = n_terms").select("query", F.col("doc").cast(named.schema["doc_id"].dataType).alias("doc_id"), F.col("lead").alias("pos"))
    )
