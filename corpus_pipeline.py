"""A corpus pipeline over ``documents``: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and hands what it reads back to the next stage.

Every row is a document of its own, whatever its doc_id: rows without one and rows that share one each get their own
decision.  Where a stage prefers the smaller document, rows without a doc_id come last, and rows that share one
come in the order of a hash of their texts.  Packing packs such rows one by one, under the doc_id they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm.common import stage
from sitesift.llm.near_dedup import near_duplicates
from sitesift.llm.packing import pack
from sitesift.llm.quality import score_quality
from sitesift.llm.queries import fit_fold, quality_labels, tokenizer_path
from sitesift.llm.secret_scan import redact, scan, train
from sitesift.llm.substring_dedup import dedup_substrings


SIMILAR = 80  # percent of shared shingles from which documents are near duplicates (op3's report takes 85)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, a number no other row has, in the order of doc_id: doc_id itself if none is null or repeated,
    else a number staged with the rows."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n"))
    if not ids.filter("id is null or n > 1").limit(1).count():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    # the last key only spreads equal rows over the tasks
    rows = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.rand(3))
    return stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def by_row(rows: DataFrame) -> DataFrame:
    """The texts of ``numbered`` rows, with _row for a doc_id."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rows = numbered(docs)
    scored = score_quality(rows, quality_labels(spark, sf_dir), fit_fold, carry=("_row",))
    return rows.join(scored.filter("predicted = 0").select("_row"), "_row", "left_anti").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a similarity of 0.8 or more): the one with the smallest doc_id.
    Texts without a word are near duplicates of nothing."""
    rows = numbered(docs)
    gone = near_duplicates(by_row(rows), SIMILAR).filter("not kept").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document has are cut; a document that lost some is its words joined by
    one space."""
    rows = numbered(docs)
    cut = dedup_substrings(by_row(rows)).filter("n_removed > 0").select(F.col("doc_id").alias("_row"), F.col("kept").alias("_text"))
    return with_text(rows, cut).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark."""
    rows = numbered(docs)
    scanned = scan(by_row(rows), train(docs))
    hidden = redact(scanned.filter("size(found) > 0")).select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    return with_text(rows, hidden).select(docs.columns)


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed`` (_row, _text) and n_chars to match; other rows as they are."""
    both = docs.join(changed, "_row", "left")
    new = F.col("_text").isNotNull()
    both = both.withColumn("text", F.when(new, F.col("_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(new, F.length("_text").cast("long")).otherwise(F.col("n_chars")))
    return both.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, with their sequence and offset."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("secret scans", hide_secrets),
    ("packing", pack_sequences),
]

# Not expressible in SQL: classifier, tokenizer and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
