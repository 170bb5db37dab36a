"""Quality rules with cross-document line frequency, in built-in expressions only.

Words are maximal runs without ASCII space. Per document: word_chars, n_symbols, n_dup_lines, n_repeat_words and the
base verdict (``base_failed``). Across documents: a line is normalised (ASCII space stripped at both ends, A-Z
lower-cased) and hashed; ``line_frequency`` counts the distinct documents of a host that have it. A line in more
than MIN_DOCS documents of a host, however large the host, is removed from that host's documents, and a
document that loses more than DEPLETED of its words is rejected. ``quality_rules`` returns the kept documents' texts
without such lines.

Long texts: everything of one document is computed inside its row, over arrays; nothing is exploded but lines.
Repeated windows come from sorted 64-bit window hashes; a text with few repeated values takes a short list of them,
others sort (hash, position) pairs, so the cost stays n log n. A frequent line of a large host is combined on the map
side when counted; the join that brings the counts back is one that Spark may split where it is skewed.

Edge cases: null or empty text has no words (base_failed); a null source is a host of its own; rows that repeat a
doc_id are one document to the line counts, and what they lose is measured over all of them; rows without a doc_id
are counted for no line and get the base verdict; an empty table gives no rows. Lines are identified by 128 bits, the
windows of one text by 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.phrase_index import lower_ascii
from rolegrid.llm.shared import narrow, stash

GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_DOCS = 20
DEPLETED = 0.5
#: Up to so many distinct repeated windows a list is searched for each window.
_SHORT = 24


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _covered(starts: Column, span: int) -> Column:
    """Words covered by windows of span words at the given ascending starts."""
    zero = F.struct(F.lit(-span).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(s - a["last"], F.lit(span))).alias("n")))["n"]


def base_rules(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), and text and source with carry."""
    held = ["text", "source"] if carry else []
    text = F.coalesce("text", F.lit(""))
    one = narrow(docs, "doc_id", "text", *held[1:]).select(
        "doc_id", *held, _words(text).alias("w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    grams = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "doc_id", *held, F.size("w").alias("n"), F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), grams.alias("grams"))
    three = two.withColumn("sorted", F.sort_array("grams"))
    four = three.withColumn("again", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (F.get("sorted", i - 1) == x)))).drop("sorted")
    spots = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("again", g), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(ordered, a)["g"] == F.get(ordered, b)["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda p, k: same(k, k - 1) | same(k, k + 1)), lambda p: p["i"]))

    five = four.withColumn("pairs", F.when(F.size("again") > _SHORT, pairs))
    six = five.select(
        "doc_id", *held, F.col("n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size("again") == 0, F.array().cast("array<int>")).when(F.size("again") <= _SHORT, spots).otherwise(
            repeated(F.col("pairs"))).alias("starts"))
    done = six.select(
        "doc_id", *held, "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("starts"), 3).cast("bigint").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return done.withColumn("base_failed", failed)


def document_lines(docs: DataFrame) -> DataFrame:
    """(host, h1, h2, doc_id, words): each line with a word once per document, with the words of all its repeats."""
    held = narrow(docs, "doc_id", "text", "source").where("doc_id is not null and text is not null")
    lines = held.select("doc_id", host_name().alias("host"), F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(WORD))
    keyed = lines.select("doc_id", "host", line_key(F.col("line")).alias("key"), F.size(_words(F.col("line"))).alias("words"))
    return keyed.select("host", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "words").groupBy(
        "host", "h1", "h2", "doc_id").agg(F.sum("words").alias("words"))


def line_frequency(lines: DataFrame) -> DataFrame:
    """(host, h1, h2, n_docs): in how many documents of the host the line stands."""
    return lines.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))


def line_key(line: Column) -> Column:
    return F.regexp_replace(lower_ascii(line), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def host_name(source: str = "source") -> Column:
    return F.coalesce(source, F.lit("\u0000"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, h1, h2) of the lines in more than min_docs documents of the host."""
    return line_frequency(lines).where(F.col("n_docs") > min_docs).select("host", "h1", "h2")


def depleted(lines: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id, total, removed, away): words in all lines, and in lines of often, where there are any; away holds
    those lines as (host, h1, h2)."""
    removed = lines.join(often, ["host", "h1", "h2"], "left_semi").groupBy("doc_id").agg(
        F.sum("words").alias("removed"), F.collect_set(F.struct("host", "h1", "h2")).alias("away"))
    total = lines.groupBy("doc_id").agg(F.sum("words").alias("total"))
    return total.join(removed, "doc_id")


def without_lines(text: Column, host: Column, away: Column) -> Column:
    """text without the lines whose (host, h1, h2) away holds."""
    def gone(line: Column) -> Column:
        key = line_key(line)
        return line.rlike(WORD) & F.array_contains(away, F.struct(host.alias("host"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    return F.when(away.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~gone(x)), "\n"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """base_rules, the verdict kept, removed_words (those in lines above the limits) and text: a kept document's text
    without those lines, null for the others."""
    lines = stash(document_lines(docs), "document-lines")
    often = stash(frequent_lines(lines, min_docs), "frequent-lines")
    lost = depleted(lines, often).select(F.col("doc_id").alias("lost_doc"), "total", "removed", "away")
    joined = base_rules(docs, carry=True).join(lost, F.col("doc_id") == F.col("lost_doc"), "left")
    gone = F.coalesce("removed", F.lit(0).cast("bigint"))
    verdict = ~F.col("base_failed") & (gone <= DEPLETED * F.coalesce("total", F.lit(0)))
    judged = joined.withColumn("kept", F.when(F.col("total").isNull(), ~F.col("base_failed")).otherwise(verdict))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", gone.alias("removed_words"),
        F.when(F.col("kept"), without_lines(F.col("text"), host_name(), F.col("away"))).alias("text"))
