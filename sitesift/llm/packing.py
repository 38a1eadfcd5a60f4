"""Sequence packing as a cutting-stock problem, solved by column generation.

1. One pass over the text encodes each document and cuts it into full sequences and one remainder.  It
   returns, per piece, its place, length and checksum, and counts remainders by length class.
2. The class histogram (at most ``seq_len / step`` numbers, whatever the input) is all the driver sees.
   Column generation covers it with patterns: a small linear program over the patterns known so far gives
   prices for the classes, a knapsack dynamic program finds the pattern worth most at these prices, until
   none beats the cost of one sequence.  Counts are rounded down; best-fit decreasing on class counts packs
   what is left.
3. Pieces are ranked within their class (rank inside the task plus an offset from the per-task counts), and
   a pattern owns a range of ranks in each of its classes; so class and rank give sequence and slot by
   arithmetic.  Offsets are running sums inside a sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, stage, text_only
from .tokens import word_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, slice int, rank long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, seq_len: int, step: int, text: str = "text") -> DataFrame:
    """Pieces of each document: full sequences (class 0, as they need no partner) and a remainder.

    The class of a remainder is its length in steps, rounded up.  ``rank`` counts a class inside the task
    ``slice``; both are fixed once the table is staged.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in slices(batches, "text"):
            rows = []
            keys = b.column("doc_id").to_pylist()
            for key, ids in zip(keys, word_ids(path, as_bytes(b.column("text"))), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, seq_len):
                    piece = ids[4 * start : 4 * (start + seq_len)]
                    n = len(piece) // 4
                    c = 0 if n == seq_len else -(-n // step)
                    rank = seen[c] = seen.get(c, -1) + 1
                    rows.append((key, start, n, zlib.crc32(piece), total, c, part, rank))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return text_only(docs, text=text).mapInArrow(run, PIECES)


def best_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the items (class i takes i + 1 of ``room``) worth most together."""
    worth, take = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        n = min(w, len(prices))
        got = prices[:n] + worth[w - 1 :: -1][:n]
        k = int(np.argmax(got))
        worth[w], take[w] = (got[k], k) if got[k] > worth[w - 1] else (worth[w - 1], -1)
    out, w = np.zeros(len(prices), int), room
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            out[take[w]] += 1
            w -= take[w] + 1
    return worth[room], out


def column_generation(demand: np.ndarray, room: int, rounds: int = 2000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often (fractions) the linear program uses each to meet ``demand`` with fewest sequences.

    The master keeps one basic column a class with demand; a priced-in column replaces the one that the ratio
    test names (revised simplex).  Starts from ``room // size`` equal items per pattern.
    """
    have = np.flatnonzero(demand)
    need = demand[have].astype(float)
    basis = np.diag([float(room // (i + 1)) for i in have]) if len(have) else np.zeros((0, 0))
    inverse = np.linalg.inv(basis) if len(have) else basis
    for turn in range(rounds):
        if not len(have):
            break
        prices = np.zeros(len(demand))
        prices[have] = np.maximum(inverse.sum(axis=0), 0)  # each sequence costs one
        value, pattern = best_pattern(prices, room)
        if value <= 1 + 5e-4:  # the optimum is at least the present number of sequences over this value
            break
        column = np.einsum("ij,j->i", inverse, pattern[have].astype(float))
        level = np.einsum("ij,j->i", inverse, need)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, level / column, np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern[have]
        step = inverse[out] / column[out]
        inverse = inverse - np.outer(column, step)
        inverse[out] = step
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
    patterns = []
    for k in range(len(have)):
        p = np.zeros(len(demand), int)
        p[have] = np.rint(basis[:, k]).astype(int)
        patterns.append(p)
    return patterns, np.maximum(inverse @ need, 0) if len(have) else np.zeros(0)


def whole_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold exactly ``demand``."""
    left, out = demand.astype(int).copy(), []
    patterns, level = column_generation(demand, room)
    for p, x in sorted(zip(patterns, level, strict=True), key=lambda t: -t[1]):
        n = int(x + 1e-6)
        n = min([n, *(left[i] // p[i] for i in np.flatnonzero(p))])
        if n > 0:
            out.append((p, n))
            left -= n * p
    while left.any():  # each turn empties the largest class left as far as its best fill repeats
        p, free = np.zeros(len(left), int), room
        for i in range(len(left) - 1, -1, -1):
            k = min(left[i], free // (i + 1))
            if k > 0:
                p[i], free = k, free - k * (i + 1)
        n = min(left[i] // p[i] for i in np.flatnonzero(p))
        out.append((p, int(n)))
        left -= n * p
    return out


def pack(docs: DataFrame, path: str, end_id: int = 2, seq_len: int = 4096, step: int = 16, text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset (see the module).

    Null and empty texts are one piece holding the end id alone; texts of any length are cut into full
    sequences and a remainder; equal rows are packed one by one; an empty table gives no row; a null doc_id
    stays null; other columns are not read.  ``step`` is the grain of the length classes: a remainder may
    leave up to ``step - 1`` ids of its class unused, the only padding beside a pattern's own rest.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, path, end_id, seq_len, step, text), "pieces")
    # per task and class: at most tasks x classes rows
    runs = pieces.groupBy("class", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("class", "slice", before.alias("before"))
    totals = {r["class"]: r["n"] for r in runs.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # seq_len / step rows
    classes = seq_len // step
    demand = np.array([totals.get(i + 1, 0) for i in range(classes)], dtype=np.int64)
    first, owned, ranked = totals.get(0, 0), [], [0] * classes
    for p, times in whole_patterns(demand, classes):
        slot = 0
        for i in np.flatnonzero(p):
            owned.append((int(i) + 1, ranked[i], ranked[i] + int(p[i]) * times, int(p[i]), int(first), slot))
            ranked[i] += int(p[i]) * times
            slot += int(p[i])
        first += times
    owned.append((0, 0, totals.get(0, 0), 1, 0, 0))
    # one entry a class and pattern: bounded by the classes, not by the input
    ranges = F.broadcast(spark.createDataFrame(owned, "class int, low long, high long, per long, base long, slot long"))
    numbered = pieces.join(offsets, ["class", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    r, inside = F.col("rank"), F.col("rank") - F.col("low")
    placed = numbered.join(ranges, ["class"]).filter((r >= F.col("low")) & (r < F.col("high")))
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div per")).withColumn("slot", F.col("slot") + inside % F.col("per"))
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"),
    )
