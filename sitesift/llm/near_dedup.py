"""Near duplicates by MinHash with tensored banding.

Two small collections of MinHash tuples are computed per document, A and B, of ``SIDE`` tuples each.  A table
key is a pair (A_i, B_j): SIDE x SIDE tables for the cost of 2 x SIDE tuples, a square root of what separate
tables would need.  A document whose tuples nobody shares on one side can be in no table with another, so
it leaves before any pair is formed.

Candidates: in each table entry the smallest document is the pivot and every other member is tried with it only,
never all with all.  Members unlike the pivot (by their signatures) find a new pivot among themselves.  Links
are confirmed on the full shingle sets.  What a pivot leaves open is settled exactly: components that came close
(a candidate pair between them was similar but not linked) form a cluster, and every document
outside the cluster's largest component is compared with all others of the cluster, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, smallest_label, stage, text_only, unequal_bytes
from .words import mix, shingle_sets

SIDE, ROWS = 16, 4  # tuples in a collection, MinHashes in a tuple
HASHES = 2 * SIDE * ROWS
CLOSE = 0.6  # signatures agreeing less than this are not worth a look at the text
BLOCK = 1024
_rng = np.random.default_rng(1729)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits of the set), keys (the tuples of A, then of B), lanes (a byte of each
    MinHash)."""
    place = np.repeat(np.arange(2 * SIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), ROWS).reshape(2 * SIDE, ROWS)
    weight = (np.arange(ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(3)) ** np.uint64(9)

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(as_bytes(b.column("text")))
            n = np.array([len(s) for s in sets])
            full = [s for s in sets if len(s)]
            low = np.zeros((len(full), HASHES), np.uint64)
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                flat, at = np.concatenate(full), np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
                for j in range(HASHES):
                    low[:, j] = np.minimum.reduceat(flat * _MULTIPLY[j] + _ADD[j], at)
                s1[n > 0], s2[n > 0] = np.add.reduceat(flat, at), np.add.reduceat(mix(flat ^ np.uint64(77)), at)
            tuples = low.reshape(len(full), 2 * SIDE, ROWS)
            keys = mix((mix(tuples ^ place) * weight).sum(axis=2))
            lanes = np.ascontiguousarray((low >> np.uint64(40)).astype(np.uint8)).view(np.int64)
            rows = iter(range(len(full)))
            which = [next(rows) if k else None for k in n]
            as_lists = lambda m: pa.array([None if r is None else m[r] for r in which], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), as_lists(keys.view(np.int64)), as_lists(lanes)],
                names=["doc_id", "n", "s1", "s2", "keys", "lanes"],
            )

    return text_only(docs, text=text).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, lanes array<long>")


def table_rows(reps: DataFrame) -> DataFrame:
    """(entry, doc): the table entries of each document, as far as someone else has both tuples."""
    single = reps.select("doc_id", F.posexplode("keys").alias("at", "key"))
    shared = single.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    kept = single.join(shared, "key")
    sides = kept.groupBy("doc_id").agg(  # at most SIDE keys each
        F.collect_set(F.when(F.col("at") < SIDE, F.col("key"))).alias("a"), F.collect_set(F.when(F.col("at") >= SIDE, F.col("key"))).alias("b")
    )
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return sides.select(F.col("doc_id").alias("doc"), F.explode(pairs).alias("entry"))


def pivot_pairs(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct (a, b) with a a pivot of b in some entry and signatures that agree, each with both set sizes.

    The first round tries every member of an entry with its smallest one.  Members unlike it go on to a round
    among themselves, with eight pivots, then 32 and so on, so that few rounds clear an entry; only members
    unlike each other ever meet more than a few pivots.
    """
    sign = reps.select("doc_id", "n", "lanes")
    left, found, turn = entries, None, 0
    while True:
        if turn:
            order = Window.partitionBy("entry").orderBy("doc")
            low = left.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * 4**turn).select("entry", F.col("doc").alias("a"))
        else:
            low = left.groupBy("entry").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select("entry", "a")
        tried = stage(left.join(low, "entry").filter("doc > a").select("entry", "a", F.col("doc").alias("b")), f"tried-{turn}")
        pairs = tried.select("a", "b").distinct()
        pairs = pairs.join(sign.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("lanes").alias("l_a")), "a")
        pairs = pairs.join(sign.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("lanes").alias("l_b")), "b")
        like = 1 - unequal_bytes(F.col("l_a"), F.col("l_b")) / F.lit(float(HASHES))
        pairs = stage(pairs.select("a", "b", "n_a", "n_b", (like >= CLOSE).alias("close")), f"pairs-{turn}")
        good = pairs.filter("close").drop("close")
        found = good if found is None else found.unionByName(good)
        alone = tried.join(pairs.select("a", "b", "close"), ["a", "b"]).groupBy("entry", "b").agg(F.max("close").alias("close")).filter("not close")
        pivots = tried.select("entry", F.col("a").alias("b")).distinct()
        left = stage(alone.join(pivots, ["entry", "b"], "left_anti").select("entry", F.col("b").alias("doc")), f"left-{turn}")
        turn += 1
        if not left.limit(1).count():
            return found.distinct()


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= ``percent`` * union on their full sets."""
    wanted = pairs.filter(F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100).select("a", "b")
    rows = wanted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for big in batches:
            for b in slices([big], "text_b"):
                one, two = as_bytes(b.column("text_a")), as_bytes(b.column("text_b"))
                known = list(dict.fromkeys(one + two))
                sets = dict(zip(known, shingle_sets(known), strict=True))
                ok = []
                for x, y in zip(one, two, strict=True):
                    s, t = sets[x], sets[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def settle(near: DataFrame, comp: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that a candidate pair brought near but did not link.

    ``near`` are the candidate pairs, ``comp`` (node, label) the components so far of the documents in them.
    """
    of = lambda side: comp.select(F.col("node").alias(side), F.col("label").alias(f"c_{side}"))
    between = near.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("c_a <> c_b")
    clusters = smallest_label(between.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "clusters")
    members = comp.join(clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").select("cluster", "label", "node")
    sizes = members.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    total = sizes.groupBy("cluster").agg(F.sum("size").alias("all"), F.max(F.struct("size", F.col("label").alias("l"))).alias("top"))
    total = total.select("cluster", F.ceil(F.col("all") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("sb"), F.col("top.l").alias("top"))
    rows = members.join(total, "cluster").join(texts, F.col("node") == texts.doc_id)
    mine = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["cluster", "label", "node", "text"]
    asked = rows.filter("label <> top").select(*cols, F.lit(True).alias("asks"), (mine % F.col("sb")).cast("int").alias("s"), F.explode(every("mb")).alias("m"))
    all_ = rows.select(*cols, F.lit(False).alias("asks"), (mine % F.col("mb")).cast("int").alias("m"), F.explode(every("sb")).alias("s"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["asks", "node", "text"]).reset_index(drop=True)
        sets = shingle_sets([t.encode() for t in pdf["text"]])
        here = np.flatnonzero(~pdf["asks"].to_numpy())
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        size = np.array([len(sets[i]) for i in here])
        flat, owner = np.concatenate([sets[i] for i in here]), np.repeat(np.arange(len(here)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = []
        for i in np.flatnonzero(pdf["asks"].to_numpy()):
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = high - low
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(here))
            linked = (both > 0) & (100 * both >= percent * (size + len(sets[i]) - both)) & (label[here] != label[i])
            _, once = np.unique(label[here][linked], return_index=True)  # one link to a component is enough
            out += [(node[i], x) for x in node[here][linked][once]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return asked.unionByName(all_).groupBy("cluster", "m", "s").applyInPandas(cell, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id) of each row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word shingles (words
    between white space, A-Z lower-cased; fewer than five words are one shingle).  Null, empty and blank texts
    have no shingle and are linked with nothing.  Rows without a doc_id are linked with nothing and kept, with
    a null component.  A doc_id that occurs with several texts stands for all of them; repeated rows get equal
    answers.  An empty table gives no row; other columns are not read.

    A pair at 85 percent meets in a table with a probability of 0.99998, one at 80 with 0.9996 (two collections
    of 16 tuples of 4).
    """
    texts = text_only(docs, text=text)
    signed = stage(signatures(docs, text), "signatures")
    # equal sets are one class, known by its smallest document
    known = signed.filter("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    of_doc = stage(signed.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    reps = stage(known.join(of_doc.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi"), "reps")
    near = stage(pivot_pairs(stage(table_rows(reps), "entries"), reps), "near")
    nodes = stage(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "nodes")
    # the text is shuffled once, to pick the documents that are in a pair; all later steps read those only
    some = stage(texts.join(nodes, F.col("doc_id") == F.col("node"), "left_semi"), "texts")
    links = stage(confirm(near, some, percent), "links")
    labels = smallest_label(links)
    comp = stage(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "components")
    more = stage(settle(near, comp, some, percent), "settled")
    labels = smallest_label(links.unionByName(more), "final")
    out = of_doc.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
