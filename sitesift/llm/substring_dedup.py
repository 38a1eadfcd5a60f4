"""Substring deduplication by matching statistics against suffix automata.

Words are the symbols.  A word is removed if it lies in a window of ``size`` words whose sequence also starts in a
document with a smaller doc_id.

1. Every window has an anchor: the smallest hash of the word runs inside it.  Equal windows have equal anchors.
   One pass over the text lists, per document, which windows in a row share an anchor.
2. Anchors of one document only are dropped: none of their windows can recur.
3. Of the windows left, hashes pick the reference: of each window that recurs, the place where it starts in the
   smallest document.  The reference thus holds each recurring passage once, however many documents share it.
4. Reference and documents are cut by anchor into shards of bounded size.  A shard's reference passages become
   a suffix automaton, in which each state knows the smallest document that reaches it; the document stretches
   of the shard stream through it.  The matching statistics (longest match ending at each word) say which
   windows occur, and the states which document has them first.  A shard that many documents need is sent to
   several tasks, each streaming a part of them; what is sent is the reference, whose size is bounded.
5. The spans found, merged by document, are cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, shuffle_parts, slices, stage, text_only
from .words import Words, run_hashes, sliding_min

GRAM = 8  # words in an anchor run
STREAM_ROWS = 4096  # stretches that one copy of a shard serves
SHARD_WINDOWS = 20_000  # reference windows in one shard


def anchor_runs(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, anchor, at, n): the n windows from word ``at`` on share the anchor."""

    def run(batches):
        for b in slices(batches, "text"):
            words = Words(as_bytes(b.column("text")))
            grams = words.runs(GRAM)
            ids = b.column("doc_id").to_pylist()
            out = []
            for key, a, z in zip(ids, words.first[:-1], words.first[1:], strict=True):
                if z - a < size or key is None:
                    continue
                anchor = sliding_min(grams[a : z - GRAM + 1], size - GRAM + 1)
                turn = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]))
                out.append((np.full(len(turn), key), anchor[turn].view(np.int64), turn, np.diff(turn, append=len(anchor))))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "anchor", "at", "n"])

    return docs.mapInArrow(run, "doc_id long, anchor long, at int, n int")


def recurring(texts: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """(doc_id, at, run) of the reference windows: of each that is in several documents, its place in the smallest
    and which of the document's runs that is in.

    ``ranges`` (doc_id, runs) lists what is left after step 2.  Windows are summed up by hash before they are
    shuffled; a hash only chooses the reference, equality is decided on words.
    """

    def run(batches):
        for big in batches:
            for b in slices([big], "text"):
                words = Words(as_bytes(b.column("text")))
                out = []
                for key, a, z, runs in zip(b.column("doc_id").to_pylist(), words.first[:-1], words.first[1:], b.column("runs").to_pylist(), strict=True):
                    windows = run_hashes(words.hashes[a:z], size).view(np.int64)
                    at = np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in runs])
                    run_no = np.repeat(np.arange(len(runs)), [r["n"] for r in runs])
                    fits = at < len(windows)  # rows that share a doc_id may differ
                    out.append((np.full(fits.sum(), key), at[fits], run_no[fits], windows[at[fits]]))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "at", "run", "window"])

    rows = texts.join(ranges, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, at int, run int, window long")
    first = rows.groupBy("window").agg(F.min(F.struct("doc_id", "at", "run")).alias("f"), F.max("doc_id").alias("last"))
    return first.filter("f.doc_id < last").select("f.doc_id", "f.at", "f.run")


def stretches(texts: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """(anchor, asks, doc_id, at, words): the words of the windows listed in ``cuts`` (doc_id, runs of asks, anchor, at, n)."""

    def run(batches):
        for big in batches:
            for b in slices([big], "text"):
                words = Words(as_bytes(b.column("text")))
                cols = [[], [], [], [], []]
                for key, a, z, runs in zip(b.column("doc_id").to_pylist(), words.first[:-1], words.first[1:], b.column("runs").to_pylist(), strict=True):
                    for r in runs:
                        lo, hi = a + r["at"], min(z, a + r["at"] + r["n"] + size - 1)
                        if hi - lo >= size:
                            for c, v in zip(cols, (r["anchor"], r["asks"], key, r["at"], words.raw[words.starts[lo] : words.ends[hi - 1]]), strict=True):
                                c.append(v)
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "asks", "doc_id", "at", "words"])

    return texts.join(cuts, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, "anchor long, asks boolean, doc_id long, at int, words binary")


class Automaton:
    """Suffix automaton of several word sequences; ``first[state]`` is the smallest document that reaches it."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        for doc, words in passages:
            last = 0
            for w in words:
                last = self._extend(last, w, doc)
        # a state is reached by whatever reaches the states it is the link of
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if p > 0 and self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def _new(self, length: int, link: int, following: dict, doc: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.link) - 1

    def _extend(self, last: int, w: bytes, doc: int) -> int:
        if w in self.next[last]:  # the sequence so far is in another passage
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                self.first[q] = min(self.first[q], doc)
                return q
            new = self._split(last, q, w)
            self.first[new] = min(self.first[new], doc)
            return new
        new, p = self._new(self.length[last] + 1, 0, {}, doc), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def earlier(self, doc: int, words: list[bytes], size: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of ``words`` covered by windows of ``size`` that a smaller document has."""
        state, n, out = 0, 0, []
        step, link, length, first = self.next, self.link, self.length, self.first
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                n = length[state]
            if w in step[state]:
                state, n = step[state][w], n + 1
            # the shortest match that still holds a whole window: more documents reach it than the longest
            while state and length[link[state]] >= size:
                state = link[state]
                n = length[state]
            if n >= size and first[state] < doc:
                if out and i + 1 - size <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i + 1 - size, i + 1))
        return out


def match(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, start, end) from shard rows, sorted by shard with each shard's reference rows before the others."""

    def run(batches):
        at, passages, automaton = None, [], None
        for b in batches:
            out = []
            shards = zip(b.column("anchor").to_pylist(), b.column("part").to_pylist(), b.column("salt").to_pylist(), strict=True)
            for key, asks, doc, start, words in zip(shards, b.column("asks").to_pylist(), b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("words").to_pylist(), strict=True):
                if key != at:
                    at, passages, automaton = key, [], None
                if not asks:
                    passages.append((doc, words.split()))
                elif passages:
                    automaton = automaton or Automaton(passages)
                    out += [(doc, start + s, start + e) for s, e in automaton.earlier(doc, words.split(), size)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "end"])

    return rows.mapInArrow(run, "doc_id long, start int, end int")


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, spans): the word spans of each document to be removed; only documents that have some."""
    spark = docs.sparkSession
    runs = stage(anchor_runs(docs, size), "anchors")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter("lo < hi")
    shared = stage(shared.select("anchor", "rows"), "shared")
    left = runs.join(shared.select("anchor"), "anchor")
    ranges = stage(left.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "at", "n")).alias("runs")), "ranges")
    reference = recurring(docs, ranges, size).groupBy("doc_id").agg(F.collect_set(F.struct("at", "run")).alias("w")).join(ranges, "doc_id")
    # windows in a row with one anchor are one passage
    windows = F.array_sort(F.transform("w", lambda x: F.struct(F.get("runs", x["run"])["anchor"].alias("anchor"), x["at"].alias("at"))))
    passages = reference.select("doc_id", windows.alias("w")).select("doc_id", F.explode(grouped_runs(F.col("w"))).alias("r"))
    passages = stage(passages.select("doc_id", F.lit(False).alias("asks"), "r.*"), "passages")
    # how many shards an anchor's reference fills, and how many copies of each its documents need
    shape = passages.groupBy("anchor").agg(F.sum("n").alias("windows")).join(shared, "anchor").select(
        "anchor", F.ceil(F.col("windows") / SHARD_WINDOWS).cast("int").alias("parts"), F.ceil(F.col("rows") / STREAM_ROWS).cast("int").alias("salts")
    )
    shape = stage(shape, "shape")
    asked = ranges.select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.lit(True).alias("asks"), "r.*").join(shape.select("anchor"), "anchor", "left_semi")
    cuts = passages.unionByName(asked).groupBy("doc_id").agg(F.collect_list(F.struct("asks", "anchor", "at", "n")).alias("runs"))
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a reference passage is in one part and every salt, a document stretch in one salt and every part
    one, many = F.when(F.col("asks"), F.col("salts")).otherwise(F.col("parts")), F.when(F.col("asks"), F.col("parts")).otherwise(F.col("salts"))
    rows = stretches(docs, cuts, size).join(shape, "anchor").select(
        "anchor", "asks", "doc_id", "at", "words", (mine % one).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), many - 1)).alias("copy")
    )
    rows = rows.withColumn("part", F.when(F.col("asks"), F.col("copy")).otherwise(F.col("own"))).withColumn("salt", F.when(F.col("asks"), F.col("own")).otherwise(F.col("copy")))
    rows = rows.drop("own", "copy").repartition(shuffle_parts(spark), "anchor", "part", "salt").sortWithinPartitions("anchor", "part", "salt", "asks")
    found = stage(match(rows, size), "found")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def grouped_runs(windows):
    """array<struct<anchor, at, n>> from sorted (anchor, at): neighbours with the same anchor as one."""
    none = F.expr("cast(array() as array<struct<anchor:bigint,at:int,n:int>>)")
    starts = F.filter(windows, lambda w, i: (i == 0) | (F.get(windows, i - 1)["anchor"] != w["anchor"]) | (F.get(windows, i - 1)["at"] + 1 != w["at"]))
    ends = F.filter(windows, lambda w, i: (i == F.size(windows) - 1) | (F.get(windows, i + 1)["anchor"] != w["anchor"]) | (F.get(windows, i + 1)["at"] - 1 != w["at"]))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s["anchor"].alias("anchor"), s["at"].alias("at"), (e["at"] - s["at"] + 1).alias("n")))
    return F.when(F.size(windows) > 0, runs).otherwise(none)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept: the words left joined by one space (null if none went)."""

    def run(batches):
        for big in batches:
            for b in slices([big], "text"):
                rows = []
                for text, cut in zip(as_bytes(b.column("text")), b.column("spans").to_pylist(), strict=True):
                    words, left, at, last = text.split(), [], 0, 0
                    for s in cut or []:
                        s, e = max(s["start"], last), min(s["end"], len(words))
                        if e > s:
                            left += words[at:s]
                            at = last = e
                    left = left + words[at:] if at else words
                    kept = b" ".join(left)
                    rows.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept if at else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:3], (pa.int64(), pa.int64(), pa.string()), strict=True)), pa.array(cols[3], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    both = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup_substrings(docs: DataFrame, size: int = 50, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of each row.

    Words are runs of anything but ASCII white space, unchanged.  Null, empty and short texts lose nothing.  Rows
    without a doc_id neither lose words nor take any from others.  Rows that share a doc_id never match each
    other (no doc_id is smaller), and a span found in one of them is cut from each as far as it is as long.  An
    empty table gives no row; other columns are not read.
    """
    rows = text_only(docs, text=text)
    return remove_spans(rows, repeated_spans(rows, size))
