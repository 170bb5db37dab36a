"""The corpus pipeline: documents through a chain of text operators, one Parquet table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm.line_dedup import dedup_lines
from rolegrid.llm.near_copies import near_copies
from rolegrid.llm.phrase_index import doc_key, find_items
from rolegrid.llm.piece_scan import encode
from rolegrid.llm.registry import ship
from rolegrid.llm.shared import narrow, new_path, stash
from rolegrid.llm.site_bayes import classify
from rolegrid.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as low quality or toxic, go. Rows are judged each, repeats alike; a null or
    empty text has no evidence against it; without labels, or on an empty table, nothing goes."""
    return classify(docs, table(spark, sf_dir, "labels"), carry=("text", "n_chars")).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the document with the smallest doc_id holds too go from all others; n_chars follows the text. A null
    text becomes an empty one; documents stay even where no line does."""
    kept = dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash fingerprints within 2 bits link texts, and shared five-word shingles those that differ in more; either way a link
    takes an exact Jaccard similarity of 0.8. Of linked texts the smallest doc_id stays; rows without a doc_id stay."""
    gone = near_copies(docs).where("doc_id <> first_id").select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")).distinct()
    held = narrow(docs, *COLUMNS)
    return held.join(gone, (held["doc_id"] == gone["gone"]) & (F.xxhash64(held["text"]) == gone["gone_th"]), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts have no words and stay; rows without
    a doc_id are searched too; an item without words finds nothing."""
    hit = find_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc").alias("hit"))
    held = narrow(docs, *COLUMNS)
    return held.join(hit, doc_key() == F.col("hit"), "left_anti")


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text): the SentencePiece ids, and the text decoded from them by the same task. A null or
    empty text has no ids; repeated rows are encoded each."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode(docs, model, with_text=True).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "text")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", piece_stage),
]
#: A fitted classifier, linked near copies and SentencePiece ids have no SQL; the tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    ship(spark)
    docs = narrow(table(spark, sf_dir, "documents"), *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage-{k}", new_path(spark, f"pipeline-{k}"))
    return docs
