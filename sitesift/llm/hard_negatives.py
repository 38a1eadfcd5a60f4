"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions.  For an anchor a and a row x the angle between them lies
between max |a_r - x_r| and min(a_r + x_r, 2 pi - a_r - x_r) over the directions r, so their inner product lies between two
bounds, which are widened by more than any rounding can be.  Only pairs whose interval meets a window that is still
open get their integer inner product.

Anchors (a stated query set) meet all rows in a grid: chunks of anchors by slices of rows.  A task reads a slice
as a stream beside one chunk, so memory is bounded by the chunk and a batch, whatever a slice or a label holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, shuffle_parts, stage

SCALE = 256  # a component x becomes floor(256 * x)
ANGLE_SLACK = 1e-6  # arccos is off by less than 2e-8 when its argument is off by 1e-16
EXACT_FLOAT = 2.0**53
BATCH = 1024
ANCHOR, ROW = 0, 1


def points(table: DataFrame, anchors: Callable[[Column], Column], relabel: Callable[[Column, Column], Column]) -> DataFrame:
    """vec_id, label, v (array<long>), anchor: the rows that take part, with their final label and integer components."""
    usable = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('inf'))"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(usable)
    return rows.select(
        "vec_id", relabel(F.col("vec_id"), F.col("label")).cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"),
        anchors(F.col("vec_id")).alias("anchor"),
    )


def matrix(lists: list, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros, which add nothing to an inner product."""
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def choose_directions(rows: DataFrame, dims: int, count: int, sample: int) -> np.ndarray:
    """``count`` unit vectors: of about ``sample`` rows picked by a hash, each the one farthest in angle from those before."""
    some = hash_sample(rows.filter("exists(v, x -> x <> 0)"), "vec_id", sample, rows.count()).orderBy("vec_id").limit(2 * sample)
    v = matrix([r.v for r in some.select("v").collect()], dims).astype(float)
    if not len(v):
        return np.zeros((0, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, out = np.full(len(v), -2.0), []
    for _ in range(min(count, len(v))):
        out.append(v[int(np.argmin(near))])
        near = np.maximum(near, v @ out[-1])
    return np.array(out)


def with_angles(rows: DataFrame, directions: np.ndarray, dims: int) -> DataFrame:
    """``rows`` with their norm, their angles to the directions, and the nearest direction."""
    schema = "vec_id long, label long, v array<long>, anchor boolean, norm double, angles array<double>, near int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v").to_pylist(), dims).astype(float)
            norm = np.sqrt((v * v).sum(axis=1))
            unit = v / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(unit @ directions.T, -1, 1)) if len(directions) else np.zeros((len(v), 0))
            near = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(v))
            cols = [*b.columns, pa.array(norm), pa.array(list(angles), pa.list_(pa.float64())), pa.array(near.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "norm", "angles", "near"])

    return rows.mapInArrow(measure, schema)


class Side:
    """Rows of one batch, or the anchors of one chunk, as arrays."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.id, self.label, self.norm = get("vec_id"), get("label"), get("norm")
        self.v = matrix(batch.column("v").to_pylist(), dims)
        self.angles = np.array(batch.column("angles").to_pylist()).reshape(len(self.id), -1)


def most(norms: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """The largest integer score that a product of norms and a largest cosine allow, widened for rounding."""
    x = norms * cos
    return x + np.abs(x) * 1e-9 + 1


def gaps(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the smallest and the largest angle that two sets of rows can have, by the angles to the directions."""
    shape = len(a), len(x)
    low, high = np.zeros(shape), np.full(shape, math.pi)
    for r in range(a.shape[1]):
        s = a[:, r, None] + x[None, :, r]
        np.minimum(high, np.minimum(s, 2 * math.pi - s), out=high)
        np.maximum(low, np.abs(a[:, r, None] - x[None, :, r]), out=low)
    return np.cos(np.clip(low - ANGLE_SLACK, 0, math.pi)), np.cos(np.clip(high + ANGLE_SLACK, 0, math.pi))


def open_pairs(a: Side, x: Side, wanted: np.ndarray, least: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of ``wanted`` whose score interval meets [least, highest] of the anchor."""
    if not a.angles.shape[1]:  # no direction, so only zero vectors: any pair may do
        return np.nonzero(wanted)
    # first the whole batch: the angles of its rows lie in one range a direction
    lo, hi = x.angles.min(axis=0), x.angles.max(axis=0)
    away = np.maximum(np.maximum(a.angles - hi, lo - a.angles).max(axis=1), 0)
    cos = np.cos(np.clip(away - ANGLE_SLACK, 0, math.pi))
    reach = np.where(cos >= 0, x.norm.max(), x.norm.min()) * a.norm
    some = np.flatnonzero((most(reach, cos) >= least) & wanted.any(axis=1))
    if not len(some):
        return some, some
    cos_high, cos_low = gaps(a.angles[some], x.angles)
    norms = a.norm[some, None] * x.norm[None]
    meets = (most(norms, cos_high) >= least[some, None]) & (-most(norms, -cos_low) <= highest[some, None])
    i, j = np.nonzero(meets & wanted[some])
    return some[i], j


def scores(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs (i, j)."""
    top = np.abs(a.v).max(initial=0) * float(np.abs(x.v).max(initial=0)) * max(1, a.v.shape[1])
    if top >= 2.0**63:
        return np.array([sum(int(p) * int(q) for p, q in zip(a.v[m], x.v[n], strict=True)) for m, n in zip(i, j, strict=True)], object)
    if top < EXACT_FLOAT and len(i) * 8 > len(a.id) * len(x.id):
        return (a.v.astype(float) @ x.v.T.astype(float))[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = np.einsum("nd,nd->n", a.v[i[s : s + (1 << 16)]], x.v[j[s : s + (1 << 16)]])
    return out


class Best:
    """The first k hits (score descending, id ascending) of each slot, kept while rows stream by."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(slots, -np.inf)  # the k-th score of a slot, once it has k

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.floor[slot[last]] = np.nextafter(score[last].astype(float), -np.inf)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]


def streamed(rows: Iterator[pa.RecordBatch], dims: int, begin, meet, end) -> Iterator[pa.RecordBatch]:
    """Walks the cells (chunk, slice) of a sorted partition: anchors first, then rows in batches of BATCH."""
    cell, held, state = None, [], None
    for batch in rows:
        key = batch.column("chunk").to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + batch.column("slice").to_numpy(zero_copy_only=False)
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if s == e:
                continue
            if key[s] != cell:
                if state is not None:
                    yield from end(*state)
                cell, held, state = key[s], [], None
            if kind[s] == ANCHOR:
                held.append(batch.slice(s, e - s))
                continue
            if not held:
                continue
            if state is None:
                chunk = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                state = begin(chunk, Side(chunk, dims))
            for k in range(s, e, BATCH):
                meet(*state, Side(batch.slice(k, min(BATCH, e - k)), dims))
    if state is not None:
        yield from end(*state)


def grid(anchors: DataFrame, rows: DataFrame, chunks: int, parts: int) -> DataFrame:
    """Anchors and rows dealt to the cells of the grid, sorted so that a cell is its anchors, then its rows by direction.

    A hash of vec_id deals both, so no label, cluster or group of copies gathers in a cell.
    """
    h = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    a = anchors.withColumns({"chunk": h(chunks, 1), "kind": F.lit(ANCHOR), "slice": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    x = rows.withColumns({"slice": h(parts, 2), "kind": F.lit(ROW), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    both = a.unionByName(x, allowMissingColumns=True)
    return both.repartition(chunks * parts, "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind", "near", "vec_id")


def nearest_of_label(anchors: DataFrame, rows: DataFrame, dims: int, chunks: int, parts: int, k: int) -> DataFrame:
    """anchor_id, id, score: each slice's first k other rows of an anchor's label."""

    def begin(_, a):
        return a, Best(len(a.id), k)

    def meet(a, best, x):
        wanted = (a.label[:, None] == x.label) & (a.id[:, None] != x.id)
        i, j = open_pairs(a, x, wanted, best.floor, np.full(len(a.id), np.inf))
        if len(i):
            best.add(i, scores(a, x, i, j), x.id[j])

    def end(a, best):
        yield pa.RecordBatch.from_arrays([pa.array(a.id[best.slot]), pa.array(best.id), pa.array(list(best.score), pa.int64())], ["anchor_id", "id", "score"])

    found = grid(anchors, rows, chunks, parts).mapInArrow(lambda b: streamed(b, dims, begin, meet, end), "anchor_id long, id long, score long")
    return found.groupBy("anchor_id").agg(first_k(k).alias("best"))


def first_k(k: int) -> Column:
    """The first k structs (score, id) of a group: at most k a slice are collected."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "id")))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["low"]).alias("score")))


def window_hits(anchors: DataFrame, rows: DataFrame, dims: int, chunks: int, parts: int, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive (its place), id, score: each slice's first k rows of other labels in the window of a positive."""

    def begin(chunk, a):
        best_of = chunk.column("best").to_pylist()
        owner = np.array([n for n, b in enumerate(best_of) for _ in b], np.int64)
        place = np.array([m for b in best_of for m in range(len(b))], np.int64)
        top = np.array([p["score"] for b in best_of for p in b], np.int64)
        return a, Best(len(owner), k), owner, place, top

    def meet(a, best, owner, place, top, x):
        # a window's floor rises to the k-th hit it has; windows of negative positives are empty
        floor = np.where(top >= 0, np.maximum(np.floor(low / high * top * (1 - 1e-9)) - 1, best.floor), np.inf)
        least, highest = np.full(len(a.id), np.inf), np.full(len(a.id), -np.inf)
        np.minimum.at(least, owner, floor)
        np.maximum.at(highest, owner, top.astype(float))
        i, j = open_pairs(a, x, (a.label[:, None] != x.label) & np.isfinite(least)[:, None], least, highest)
        if not len(i):
            return
        s = scores(a, x, i, j)
        # the windows of anchor n are slots first[n] to first[n + 1]
        first = np.searchsorted(owner, np.arange(len(a.id) + 1))
        for m in range(int(np.diff(first).max(initial=0))):
            slot = first[i] + m
            has = slot < first[i + 1]
            slot = np.where(has, slot, 0)
            inside = has & (s * high >= top[slot] * low) & (s <= top[slot]) & (s >= best.floor[slot])
            if inside.any():
                best.add(slot[inside], s[inside], x.id[j[inside]])

    def end(a, best, owner, place, top):
        cols = [pa.array(a.id[owner[best.slot]]), pa.array(place[best.slot].astype(np.int32)), pa.array(best.id), pa.array(list(best.score), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["anchor_id", "place", "id", "score"])

    return grid(anchors, rows, chunks, parts).mapInArrow(lambda b: streamed(b, dims, begin, meet, end), "anchor_id long, place int, id long, score long")


def mine(table: DataFrame, anchors: Callable[[Column], Column], relabel: Callable[[Column, Column], Column], positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, directions: int = 16, sample: int = 4_096, chunk_rows: int = 2_048,
         slice_rows: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``table`` has vec_id, embedding and label.  An anchor's positives are its first ``positives`` other rows of its label by
    integer inner product (ties: the smaller vec_id); for each, the first ``negatives`` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.  So a negative positive_score has no
    negatives.  Exact: the bounds only spare work.  ``sample`` bounds the rows from which directions are taken.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; zero vectors do.  Vectors of
    different lengths meet as if the shorter ended in zeros.  Rows that share a vec_id are one another's copy: they
    are merged into the one with the smallest label and vector.  Scores beyond 64 bits end the query with an
    overflow.  An empty table gives no row; other columns are not read.
    """
    rows = points(table, anchors, relabel).groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("x")).select("vec_id", "x.*")
    rows = stage(rows, "points")
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    dims = max(size.dims or 0, 1)
    marked = stage(with_angles(rows, choose_directions(rows, dims, directions, sample), dims), "angles")
    chunks, parts = max(1, math.ceil(size.a / chunk_rows)), max(shuffle_parts(spark), math.ceil(size.n / slice_rows))
    asked = marked.filter("anchor").drop("anchor")
    every = marked.drop("anchor")
    best = stage(nearest_of_label(asked, every, dims, chunks, parts, positives), "positives")
    asked = asked.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id")  # anchors without a positive have no row
    hits = window_hits(asked, every, dims, chunks, parts, negatives, low, high).groupBy("anchor_id", "place").agg(first_k(negatives).alias("hits"))
    out = hits.join(best, "anchor_id").select("anchor_id", F.get("best", F.col("place")).alias("p"), F.posexplode("hits").alias("at", "h"))
    return out.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("h.score").alias("negative_score"),
    )
