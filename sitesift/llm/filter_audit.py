"""How document filters overlap in every order of application.

Each document is reduced to a bit mask of the filters it fails, and the table to counts per part and mask.  A
recursive CTE then walks all orders: it extends each prefix with the filters not used yet, joins the part's mask
cells, carries the bits applied so far, and emits that step's figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Filter E is the duplicate filter, the others look at one text.
LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII white-space characters."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = words_of(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cells: array<struct<mask, n, good, toxic>>, one struct for each mask that occurs in the part.

    Only keys, masks and digests of texts are shuffled.  Copies are told by the SHA-256 of their texts: of each
    digest, documents that do not have its smallest doc_id fail E.  The counts of a digest are summed by part
    before the smallest doc_id is joined, so a text that a third of all rows hold is a few rows by then.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        text_failures(text).alias("bits"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
    ), "masks")
    # rows without a doc_id find no label; the salt deals them over all tasks
    rows = rows.groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1024))).otherwise(0))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")
    ).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(marks, ["doc_id", "salt"], "left").select(
        "doc_id", "part", "bits", "digest",
        F.struct("n", (F.col("n") * F.coalesce("q", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic")).alias("c"),
    )
    names = ("n", "good", "toxic")
    per = rows.groupBy("digest", "part", "bits").agg(
        F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("own"),
        *[F.sum(f"c.{x}").alias(x) for x in names],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(f"c.{x}")).otherwise(0)).alias(f"no_id_{x}") for x in names],
    )
    least = per.groupBy("digest").agg(F.min("first").alias("least"))

    def repeated(x: str) -> Column:
        """How many of the rows fail E: all that have a doc_id, but for the one that is the smallest of the digest."""
        rest = F.col(x) - F.col(f"no_id_{x}")
        return F.when(F.col("first") == F.col("least"), rest - F.col(f"own.{x}")).when(F.col("first").isNotNull(), rest).otherwise(0)

    cell = lambda mask, value: F.struct(mask.alias("mask"), *[value(x).cast("long").alias(x) for x in names])
    both = per.join(least, "digest").select("part", F.explode(F.array(
        cell(F.col("bits"), lambda x: F.col(x) - repeated(x)), cell(F.col("bits").bitwiseOR(F.lit(DUPLICATE)), repeated),
    )).alias("x"))
    sums = both.groupBy("part", "x.mask").agg(*[F.sum(f"x.{x}").alias(x) for x in names])
    # at most 32 structs a part
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("cells"))


WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT w.part, concat(w.prefix, m.letter), w.applied | m.bit, w.step + 1, m.letter,
    aggregate(filter(c.cells, x -> x.mask & (w.applied | m.bit) = 0), 0L, (s, x) -> s + x.n),
    aggregate(filter(c.cells, x -> x.mask & m.bit > 0 AND x.mask & w.applied = 0), 0L, (s, x) -> s + x.n),
    aggregate(filter(c.cells, x -> x.mask & m.bit > 0 AND x.mask & w.applied > 0), 0L, (s, x) -> s + x.n),
    aggregate(filter(c.cells, x -> x.mask = m.bit), 0L, (s, x) -> s + x.n),
    aggregate(filter(c.cells, x -> x.mask & m.bit > 0 AND x.mask & w.applied = 0), 0L, (s, x) -> s + x.good),
    aggregate(filter(c.cells, x -> x.mask & m.bit > 0 AND x.mask & w.applied = 0), 0L, (s, x) -> s + x.toxic)
  FROM walk w JOIN {moves} m ON m.applied = w.applied JOIN {cells} c ON c.part = w.part
)
SELECT * FROM walk WHERE step > 0
"""


def walk_orders(cells: DataFrame) -> DataFrame:
    """One row for each part and prefix of an order (325 a part), with the figures of the prefix's last step."""
    spark = cells.sparkSession
    n = len(LETTERS)
    unused = [(a, x, 1 << i) for a in range(1 << n) for i, x in enumerate(LETTERS) if not a >> i & 1]
    moves = spark.createDataFrame(unused, "applied int, letter string, bit int")  # 80 rows
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")  # rows grow with the number of parts
    try:
        return stage(spark.sql(WALK, cells=cells, moves=moves), "walk")
    finally:
        spark.conf.unset(ROW_LIMIT) if limit is None else spark.conf.set(ROW_LIMIT, limit)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; a part is a source.  One row for each
    part, order of the five filters and step, zeros included.

    Null text is empty, a null source is the empty string.  Rows without a doc_id fail E for nobody, are no copies
    themselves and have no label; repeated rows of a doc_id count one by one and are no copies of each other.  Of
    several label rows of a doc_id, one with a mark is enough.  An empty table gives no row; other columns are
    not read.
    """
    steps = walk_orders(stage(mask_cells(docs, labels), "cells"))
    orders = steps.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    orders = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, at)"))
    # an order's prefix of k letters is shared by (5 - k)! orders
    weight = F.factorial(len(LETTERS) - F.col("step"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return orders.join(steps, ["part", "prefix"]).join(shares, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    )


# DuckDB: the same walk over all masks, with joins and sums at every prefix.
AUDIT_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS repeated
  FROM texts
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masked AS (
  SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * (regexp_matches(text, '[#$%&*|]'))::INT + 16 * repeated::INT AS mask,
    coalesce(q, 0) AS q, coalesce(t, 0) AS t
  FROM split LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(q) AS good, sum(t) AS toxic FROM masked GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, applied, step, letter, bit, earlier) AS (
  SELECT '', 0, 0, '', 0, 0
  UNION ALL
  SELECT prefix || l.letter, applied | l.bit, step + 1, l.letter, l.bit, applied FROM walk JOIN letters l ON applied & l.bit = 0
), steps AS (
  SELECT part, prefix, step, letter,
    coalesce(sum(n) FILTER (WHERE mask & applied = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY part, prefix, step, letter
), orders AS (SELECT prefix AS filter_order FROM walk WHERE step = 5),
rows AS (SELECT s.*, filter_order FROM steps s JOIN orders ON starts_with(filter_order, s.prefix))
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM rows
"""
