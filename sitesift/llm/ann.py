"""Nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample on the driver: a node splits its sample at the median of a random
projection.  Every row is then routed to its leaf in each tree.  A query walks all trees through one priority
queue, ordered by how far it lies on the wrong side of the splits on the way, until the leaves it took hold a
given share of all rows and enough different ones for an answer, or all leaves of one tree.  Queries and rows meet
by (tree, leaf); a leaf scores them as one matrix product and hands on the best only.

The search runs in two draughts: the first leaves of each query give it a score that its k-th neighbour surely
reaches; from the other leaves only rows reaching that score go on.  Equal vectors are searched as one; of
their ids only as many as can be in an answer are kept.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, stage


class Forest:
    """Per tree, node k splits at ``at[k]`` along ``w[k]`` into nodes ``low[k]`` and ``high[k]``; a leaf has low -1."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [self._tree(sample, leaf, rng) for _ in range(trees)]
        self.leaves = [int((low < 0).sum()) for _, _, low, _, _ in self.trees]
        # the sample's rows by leaf, routed as the table's rows are
        self.rows = []
        for leaves in self.route(sample).T:
            order = np.argsort(leaves, kind="stable")
            at, first = np.unique(leaves[order], return_index=True)
            self.rows.append(dict(zip(at.tolist(), np.split(order, first[1:]), strict=True)))

    @staticmethod
    def _tree(x: np.ndarray, leaf: int, rng):
        dim, w, at, low, high, share = x.shape[1], [], [], [], [], []
        todo = [(np.arange(len(x)), -1, False)]
        while todo:
            ids, parent, right = todo.pop()
            k = len(w)
            if parent >= 0:
                (high if right else low)[parent] = k
            normal = rng.normal(size=dim)
            p = x[ids] @ normal
            m = np.median(p) if len(ids) else 0.0
            split = len(ids) > leaf and (p < m).any()
            w.append(normal if split else np.zeros(dim))
            at.append(m if split else 0.0)
            low.append(-1)
            high.append(-1)
            share.append(len(ids) / max(1, len(x)))
            if split:
                todo += [(ids[p >= m], k, True), (ids[p < m], k, False)]
        return np.array(w), np.array(at), np.array(low), np.array(high), np.array(share)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, (w, at, low, high, _) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            moving = np.arange(len(x))[low[node] >= 0]
            while len(moving):
                k = node[moving]
                right = np.einsum("ij,ij->i", x[moving], w[k]) >= at[k]
                node[moving] = np.where(right, high[k], low[k])
                moving = moving[low[node[moving]] >= 0]
            out[:, t] = node
        return out

    def search(self, q: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
        """(tree, leaf), nearest first, until the leaves hold ``share`` of the rows (counted once a tree) and
        ``least`` different ones of the sample, or until they are all leaves of one tree."""
        queue, out, held, met = [(0.0, t, 0) for t in range(len(self.trees))], [], 0.0, set()
        side, left = [w @ q - at for w, at, *_ in self.trees], list(self.leaves)
        while held < share or len(met) < least:
            far, t, k = heapq.heappop(queue)
            _, _, low, high, rows = self.trees[t]
            if low[k] < 0:
                out.append((t, k))
                held += rows[k]
                left[t] -= 1
                if not left[t]:  # every row is in some leaf of this tree
                    break
                if len(met) < least:
                    met.update(self.rows[t].get(k, np.zeros(0, int)).tolist())
                continue
            d = side[t][k]
            heapq.heappush(queue, (far + min(d, 0.0) ** 2, t, int(high[k])))
            heapq.heappush(queue, (far + max(d, 0.0) ** 2, t, int(low[k])))
        return out


def vectors(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (doubles): rows with an id and a vector of finite numbers, not all zero, of the most frequent length."""
    v = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()  # a row a length
    return v.filter(F.size("v") == (size["n"] if size else 0))


def nearest(
    rows: DataFrame, queries, k: int = 20, trees: int = 24, leaf_rows: int = 512, sample_rows: int = 16_000, first: float = 0.06, share: float = 1.0,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row that
    ``queries(vec_id column)`` names, the row itself left out.

    ``share`` is the number of rows a query looks at over all trees, as a share of the table (a row counts
    once a tree); ``first`` is the part looked at in the first draught.  ``sample_rows`` bounds the fit.  At least
    k + 1 different vectors are looked at, and all of them if there are ``leaf_rows`` or fewer.

    Vectors that are null, zero, hold a null or a number that is not finite, or have another length than most take
    no part; nor do rows without an id.  Repeated rows count once.  Ties go to the smaller vec_id.  With fewer
    than ``k`` others all are returned; an empty table gives no row; other columns are not read.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    points = usable(rows, key, vector).distinct()
    keep = k + 1  # any copy beyond these can't be in an answer: k of them and the query itself precede it
    ranked = points.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= keep)
    groups = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = stage(groups.withColumn("gid", F.col("ids")[0]), "vectors")
    n = groups.count()
    if not n:
        return spark.createDataFrame([], out)
    x = np.array([r["v"] for r in hash_sample(groups.select("gid", "v"), "gid", sample_rows, n).collect()])
    if not len(x):
        x = np.array([r["v"] for r in groups.select("v").limit(sample_rows).collect()])
    size = n if n <= leaf_rows else min(leaf_rows, n // 128)  # few vectors are one leaf, searched whole
    forest = spark.sparkContext.broadcast(Forest(x, trees if n > leaf_rows else 1, max(4, size * len(x) // n)))  # bounded by the sample

    def route(batches):
        for b in batches:
            v = np.array(b.column("v").to_pylist())
            if len(v):
                leaves = forest.value.route(v)
                t = np.tile(np.arange(leaves.shape[1], dtype=np.int32), len(v))
                again = pa.array(np.repeat(np.arange(len(v)), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(leaves.ravel()), b.column("gid").take(again), pa.array([r.tobytes() for r in v], pa.binary()).take(again)],
                    names=["tree", "leaf", "gid", "v"],
                )

    def probe(batches):
        for b in batches:
            v = np.array(b.column("v").to_pylist())
            for row, q in zip(b.column("gid").to_pylist(), v, strict=True):
                seen = forest.value.search(q, share, keep)
                held = np.cumsum([forest.value.trees[t][4][leaf] for t, leaf in seen])
                draught = (held > first).astype(np.int32)
                draught[: min(2, len(draught))] = 0
                t, leaf = np.array(seen, np.int32).T
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array([row] * len(t), pa.int64()), pa.array([q.tobytes()] * len(t), pa.binary()), pa.array(draught)], names=["tree", "leaf", "qid", "v", "draught"])

    def best(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(here) and len(asked):
            a = np.frombuffer(b"".join(here["v"]), np.float64).reshape(len(here), -1)
            gid, floor = here["gid"].to_numpy(), asked["floor"].to_numpy(float)
            for i in range(0, len(asked), 256):
                q = np.frombuffer(b"".join(asked["v"].iloc[i : i + 256]), np.float64).reshape(-1, a.shape[1])
                rough = q @ a.T
                for j, row in enumerate(rough):
                    top = np.flatnonzero(row >= floor[i + j] - 1e-9)
                    if len(top) > keep:
                        cut = np.partition(row[top], len(top) - keep)[len(top) - keep]
                        top = top[row[top] >= cut - 1e-9]
                    # the score itself is summed in one order, whichever leaf it is met in
                    parts.append((np.full(len(top), asked["qid"].iloc[i + j]), gid[top], (a[top] * q[j]).sum(axis=1)))
        if not parts:
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "gid": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame(dict(zip(("qid", "gid", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    found_schema = "qid long, gid long, score double"
    index = groups.select("gid", "v").mapInArrow(route, "tree int, leaf int, gid long, v binary")
    index = stage(index, "index")
    # a query vector is searched once, for all rows that hold it
    # (asked of all its ids: those kept for answers need not hold a query)
    asked = stage(points.filter(queries(F.col("vec_id"))).join(groups.select("v", "gid"), "v").select(F.col("vec_id").alias("query_id"), F.col("gid").alias("qid")), "asked")
    asking = groups.join(asked.select(F.col("qid").alias("gid")).distinct(), "gid", "left_semi").select("gid", "v")
    probes = stage(asking.mapInArrow(probe, "tree int, leaf int, qid long, v binary, draught int"), "probes")

    def meet(asked: DataFrame) -> DataFrame:
        return index.groupBy("tree", "leaf").cogroup(asked.groupBy("tree", "leaf")).applyInPandas(best, found_schema).groupBy("qid", "gid").agg(F.max("score").alias("score"))

    def top(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
        return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)

    one = stage(top(meet(probes.filter("draught = 0").withColumn("floor", F.lit(float("-inf"))))), "first")
    floors = one.filter(F.col("n") == keep).select("qid", F.col("score").alias("floor"))
    rest = probes.filter("draught = 1").join(floors, "qid", "left").fillna(float("-inf"), ["floor"])
    both = top(one.drop("n").unionByName(meet(rest)).groupBy("qid", "gid").agg(F.max("score").alias("score")))
    # from vectors back to rows: at most (k + 1) squared a query vector, and k a query after ranking
    ids = groups.select("gid", "ids")
    answers = both.join(ids, "gid").select("qid", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    listed = asked.join(answers, "qid").select("query_id", F.posexplode(others).alias("at", "f"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
