"""Document quality: ridge regression on random Fourier features, calibrated isotonically.

Statistics of each text (never its labels, language, source or id) are standardised and sent through random
Fourier features, whose inner products approximate a Gaussian kernel.  The ridge solution needs only the sums
of z z' and z y: each task sums its rows into one matrix, and the matrices are added entry by entry in Spark,
so the driver sees one D x D matrix a fold whatever the input.  Two folds score each other; their scores, as a
histogram of bounded size, give the isotonic map from score to probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, stage, text_only

STATS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "top_pair", "upper", "upper_words",
    "digits", "marks", "odd_marks", "ending_marks", "lone_marks", "non_ascii", "lines", "line_length", "distinct_lines", "entropy",
    "distinct_pairs", "vowels", "long_words",
]
KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 mark, 4 space, 5 other
KIND[128:] = 5
for _b in range(128):
    _c = chr(_b)
    KIND[_b] = 1 if _c.isalpha() else 2 if _c.isdigit() else 4 if _c in " \t\n\r\x0b\x0c" else 3
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
VOWEL = np.zeros(256, bool)
VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True
PLAIN = np.zeros(256, bool)
PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True


def statistics(text: bytes) -> list[float]:
    """STATS of one text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    total = len(raw)
    kinds = np.bincount(KIND, weights=counts, minlength=6) / total
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen: dict[bytes, int] = {}
    pairs: dict[tuple, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    for p in zip(words, words[1:]):  # noqa: B905
        pairs[p] = pairs.get(p, 0) + 1
    ends = sum(KIND[w[-1]] == 3 for w in seen) / len(seen)
    share = counts[counts > 0] / total
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        math.log1p(total), math.log1p(n), lengths.mean(), lengths.std(), len(seen) / n, max(seen.values()) / n,
        max(pairs.values(), default=0) / n, counts[UPPER].sum() / total, sum(w.isupper() for w in words) / n, kinds[2], kinds[3],
        (counts[KIND == 3].sum() - counts[PLAIN & (KIND == 3)].sum()) / total, ends, sum(len(w) == 1 and KIND[w[0]] == 3 for w in words) / n,
        kinds[5], len(lines) / n, math.log1p(total / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()), len(pairs) / n, counts[VOWEL].sum() / total, float((lengths > 20).mean()),
    ]


def text_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x: the statistics of each row's whole text; and the long columns of ``carry``."""

    def run(batches):
        for b in slices(batches, "text"):
            x = [statistics(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64())), *map(b.column, carry)], names=["doc_id", "x", *carry])

    return text_only(docs, text=text, carry=carry).mapInArrow(run, ", ".join(["doc_id long, x array<double>", *(f"{c} long" for c in carry)]))


class Features:
    """Standardised statistics, as random Fourier features of a Gaussian kernel with the given width."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), n)) / width
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.hstack([np.ones((len(x), 1)), x * 0.1, z])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATS)))


def normal_equations(rows: DataFrame, features: Features) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold, the sums of z z' and z y over ``rows`` (fold, x, y).

    A task adds up its rows before it sends anything; the sums then are added by entry, which leaves one value
    for each entry of the matrix to collect.
    """
    d = len(features(np.zeros((1, len(STATS))))[0])

    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for fold, part in pdf.groupby("fold"):
                z, y = features(matrix(part["x"])), part["y"].to_numpy(float)
                sums[fold] = sums.get(fold, 0) + np.hstack([z.T @ z, (z.T @ y)[:, None]])
        for fold, s in sums.items():
            yield pd.DataFrame({"fold": [fold] * d, "i": range(d), "v": list(s)})

    parts = rows.mapInPandas(run, "fold int, i int, v array<double>")
    # a row of the matrix at a time; one task holds few of them, so partial sums stay small
    added = parts.select("fold", "i", F.posexplode("v").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in added.groupBy("fold", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect():
        a, b = out.setdefault(r["fold"], (np.zeros((d, d)), np.zeros(d)))
        v = [x["v"] for x in r["row"]]
        a[r["i"]], b[r["i"]] = v[:-1], v[-1]
    return out


def ridge(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(a + penalty * np.eye(len(b)), b)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[v] * n for v, _, n in blocks]) if blocks else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, fit_on, n_features: int = 192, width: float = 6.0, penalty: float = 1.0, bins: int = 2048, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, and the long columns of ``carry`` as they are, for each row of ``docs``.

    ``labels`` has doc_id and y (0 to 1); ``fit_on(doc_id column)`` gives fold 0 or 1 for the rows to learn
    from and null for the others.  All labelled rows of the two folds are used; there is no sample.

    Null text is empty and is scored by its (zero) statistics; rows with a null doc_id are scored, never learnt
    from; of several labels for one doc_id the mean counts; repeated rows are scored one by one; an empty table
    gives no row; without any label each score is 0.5.
    """
    stats = stage(text_statistics(docs, text, carry), "statistics")
    y = labels.filter("doc_id is not null and y is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("y").alias("y"))
    fit = stats.withColumn("fold", fit_on(F.col("doc_id"))).filter("fold is not null").join(y, "doc_id")
    fit = stage(fit.select("fold", "x", "y"), "learn-from")
    moments = fit.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    schema = ", ".join(["doc_id long, score double, predicted int", *(f"{c} long" for c in carry)])
    if not moments["n"]:
        return stats.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), *carry)
    features = Features(*(np.array([moments[f"{k}{i}"] for i in range(len(STATS))]) for k in "ms"), n_features, width)
    sums = normal_equations(fit, features)
    whole = ridge(sum(a for a, _ in sums.values()), sum(b for _, b in sums.values()), penalty)
    # each fold is scored by the other's solution (by the whole one if there is no other)
    other = {f: ridge(*sums[1 - f], penalty) if 1 - f in sums else whole for f in sums}

    def binned(frames):
        for pdf in frames:
            raw = np.zeros(len(pdf))
            for f, w in other.items():
                at = (pdf["fold"] == f).to_numpy()
                if at.any():
                    raw[at] = features(matrix(pdf["x"][at])) @ w
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype("int32"), "raw": raw, "y": pdf["y"].to_numpy(float)})

    held = fit.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n"))
    rows = sorted((r["raw"], r["y"], r["n"]) for r in held.collect())  # at most ``bins`` rows
    at, level, weight = (np.array(c) for c in zip(*rows, strict=True))
    level = isotonic(level, weight)
    # the tails go on a little, so that scores keep their order within a level
    order = np.clip((at - at.min()) / max(1e-9, at.max() - at.min()), 0, 1)
    level = np.clip(0.998 * level + 0.002 * order, 0, 1)

    def score(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            s = np.interp(features(x) @ whole, at, level)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype("int32")), *map(b.column, carry)], names=["doc_id", "score", "predicted", *carry])

    return stats.mapInArrow(score, schema)
