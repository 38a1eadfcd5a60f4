"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every shingle is hashed once; the upper bits of the hash name a bin, and a bin keeps its smallest hash.  A bin
without a shingle borrows from a filled one that a universal hash of the two bins picks (optimal
densification), so equal sets stay equal and similar sets borrow alike.  The lowest eight bits of each
bin are kept, eight bins to a long; likeness is the share of equal bins, less what chance makes equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, shuffle_parts, stage, unequal_bytes

BINS, BITS, SHINGLE = 128, 8, 5
BIN_SHIFT = 64 - 7  # the upper 7 bits name one of 128 bins


def lanes(text: Column) -> Column:
    """array<bigint>: BINS bytes, eight to a long; an empty array for a text without words.

    Shingles are five words in a row (all words, if fewer).
    """
    words = F.array_remove(F.split(text, WORD_GAP), "")

    def of(w):
        n = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
        return F.when(F.size(w) > 0, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))

    sorted_hashes = F.sort_array(once(words, of))  # signed order keeps the bins together
    bin_of = lambda h: F.shiftrightunsigned(h, BIN_SHIFT).cast("int")
    least = once(sorted_hashes, lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))

    def dense(kept):
        # the lender of bin b: the filled bin whose hash with b is smallest; its low byte rides along
        def lent(b):
            tag = lambda h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(-256)).bitwiseOR(h.bitwiseAND(F.lit(255)))
            return F.array_min(F.transform(kept, tag))

        def fill(filled):
            own = lambda b: F.get(kept, (F.array_position(filled, b) - 1).cast("int"))
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(own(b), lent(b)).bitwiseAND(F.lit(255)))

        return once(F.transform(kept, bin_of), fill)

    def packed(values):
        def lane(k):
            start = F.lit(0).cast("long")
            return F.aggregate(F.slice(values, k * 8 + 1, 8), start, lambda acc, v: F.shiftleft(acc, 8).bitwiseOR(v))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lane)

    empty = F.expr("cast(array() as array<bigint>)")
    return once(least, lambda kept: F.when(F.size(kept) > 0, once(dense(kept), packed)).otherwise(empty))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed one time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hex_string(lane: Column) -> Column:
    return F.array_join(F.transform(lane, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Of bins that differ, one in 2^BITS looks equal by chance; the share of equal bins is corrected by that.
    Two texts without words are alike (1); one without and one with words are not (0).
    """

    unequal = unequal_bytes(a, b)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def neighbours(docs: DataFrame) -> DataFrame:
    """id, next_id, before_id, before_take: the next row's id by descending doc_id, cyclic, and of the row before
    this one its id and how much text it takes.

    Only ids and lengths are sorted: ranges of ids are numbered in tasks of their own, and the ends of the
    ranges (one row each) are linked up.
    """
    spark = docs.sparkSession
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.col("n_chars") / 3)).alias("take"))
    parts = shuffle_parts(spark)
    cut = stage(ids.repartitionByRange(parts, F.col("doc_id")).withColumn("slice", F.spark_partition_id()), "ids")
    w = Window.partitionBy("slice").orderBy(F.col("doc_id").desc())
    inner = cut.select(
        "slice", F.col("doc_id").alias("id"), F.lead("doc_id").over(w).alias("next_id"),
        F.lag("doc_id").over(w).alias("before_id"), F.lag("take").over(w).alias("before_take"),
    )
    ends = cut.groupBy("slice").agg(F.max("doc_id").alias("top"), F.min(F.struct("doc_id", "take")).alias("low"))  # a row a slice
    ring = Window.orderBy(F.col("slice").desc())
    all_ends = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "slice",
        F.coalesce(F.lead("top").over(ring), F.first("top").over(all_ends)).alias("after_slice"),
        F.coalesce(F.lag("low").over(ring), F.last("low").over(all_ends)).alias("before_slice"),
    )
    return inner.join(ends, "slice").select(
        "id", F.coalesce("next_id", "after_slice").alias("next_id"), F.coalesce("before_id", "before_slice.doc_id").alias("before_id"),
        F.coalesce("before_take", "before_slice.take").alias("before_take"),
    )


def fingerprint_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """The fingerprint of each text and of an edited copy, and two likenesses.

    The edit replaces the last third of a text (by code points) with the start of the next document in
    descending doc_id (after the last, the first).  The text is shuffled once, by doc_id; its neighbour gets only
    the piece it needs.

    Null text is empty; an empty text has the empty fingerprint.  Rows that share a doc_id are all returned, and
    as a neighbour that id stands with its smallest text; rows without a doc_id have no neighbour, are
    returned with an edit that only cuts, and near_next 0 (1 if they have no words).  A single document is its
    own neighbour.  An empty table gives no row; other columns are not read.
    """
    # no cast of what is long already: it would leave an alias on one of the two uses, and the exchange would be made twice
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    ring = neighbours(rows.select("doc_id", "n_chars"))
    # the one exchange of texts: both uses below have the same columns before it, so it is made once
    dealt = rows.filter("doc_id is not null").repartition(shuffle_parts(docs.sparkSession), "doc_id")
    dealt = dealt.withColumn("lead", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1)
    linked = dealt.join(ring, F.col("doc_id") == F.col("id")).drop("id")
    piece = F.when(F.col("n_chars") > 0, F.expr("substring(text, 1, int(before_take))")).otherwise("")
    sent = linked.filter("lead").select(F.col("before_id").alias("sent_to"), piece.alias("tail"))
    both = linked.join(sent, F.col("doc_id") == F.col("sent_to"), "left").select("doc_id", "text", "n_chars", "lead", "next_id", "tail")
    none = rows.filter("doc_id is null").select("doc_id", "text", "n_chars", F.lit(False).alias("lead"), F.lit(None).cast("long").alias("next_id"), F.lit("").alias("tail"))
    take = F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), F.substring(F.coalesce("tail", F.lit("")), F.lit(1), take.cast("int")))

    def marked(part: DataFrame) -> DataFrame:
        return part.withColumn("edited", edited).select(
            "doc_id", "n_chars", "lead", "next_id", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            lanes(F.col("text")).alias("lanes"), lanes(F.col("edited")).alias("edited_lanes"))

    # every text is fingerprinted once; from here on rows are a few hundred bytes
    prints = stage(marked(both).unionByName(marked(none)), "prints")
    of_next = prints.filter("lead").select(F.col("doc_id").alias("of"), F.col("lanes").alias("next_lanes"))
    prints = prints.join(of_next, F.col("next_id") == F.col("of"), "left")
    nothing = F.expr("cast(array() as array<bigint>)")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", hex_string(F.col("lanes")).alias("fingerprint"), hex_string(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.coalesce("next_lanes", nothing)).alias("near_next"),
    )
