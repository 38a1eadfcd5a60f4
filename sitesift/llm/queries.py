"""The registered queries of this subpackage and, where SQL can express one, its SQL.

Each query applies an operator to its whole table with production parameters and keeps the columns of its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe_tree import round_trip
from .common import table
from .filter_audit import AUDIT_SQL, audit
from .fingerprints import fingerprint_edits
from .hard_negatives import mine
from .near_dedup import near_duplicates
from .packing import pack
from .quality import score_quality
from .secret_scan import report, scan, train
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .url_filter import judge, labelled_urls
from .url_filter import train as train_urls
from .warc import archive

# Fixed values of the word vocabulary: its pre-token pattern (on lower-cased text) and special strings.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# The URL rules.
URL_RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_fold(doc_id: Column) -> Column:
    """Fold 0 or 1 for the rows to learn from; null for held-out rows."""
    rest = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3
    return F.when(rest == 0, 0).when(rest == 2, 1)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(scan(docs, train(docs)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir), fit_fold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), WORD_PATTERN, WORD_SPECIAL, 2048)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), URL_RULES, train_urls(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(
        table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0,
        lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
    )


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_secret_scan, op3_near_dedup, op4_packing, op5_quality, op6_fingerprints, op7_nearest,
    op8_token_counts, op9_warc, op10_bpe_round_trip, op11_filter_audit, op12_url_filter, op13_hard_negatives,
)}
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": AUDIT_SQL}
