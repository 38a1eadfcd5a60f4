"""Filter audit, URL filter and hard negatives against plain Python versions."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sitesift.llm import filter_audit, hard_negatives, queries, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, mask int, part string, n int, cells string, prefix string, letter string, step int"


# --- filter audit ---------------------------------------------------------------
def brute_audit(docs, labels):
    """{(part, order, step): figures} by applying each order to each document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            key = text or ""
            least[key] = min(least.get(key, d), d)
    masks = {}
    for d, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if d is not None and least[text] < d:
            fails.add("E")
        masks.setdefault(source or "", []).append((d, fails))
    out = {}
    for part, rows in masks.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = list(rows)
            for k, x in enumerate(order):
                gone = [d for d, f in alive if x in f]
                earlier = [d for d, f in rows if x in f and f & set(order[:k])]
                alive = [r for r in alive if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(alive), len(gone), len(earlier), sum(f == {x} for _, f in rows), sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def odd_texts():
    r = random.Random(4)
    words = lambda n, v: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    long, copy = words(80, 4000), words(60, 4000)
    rows = [(0, long, "a"), (1, None, "a"), (2, "", None), (3, " \t\x0b\n ", "a"), (4, words(90, 20), "b"), (5, long.upper(), "b"), (6, long + " 5%", ""),
            (7, copy, "a"), (8, copy, "b"), (9, copy, "a"), (9, copy, "a"), (None, copy, "a"), (None, "x#", "b"), (7, copy, "b"), (10, "é" * 30 + "ABC", "a"),
            (11, "A" * 200_000, "b"), (12, words(40_000, 50_000), "long"), (-3, long, "b"), (13, "\u00a0".join(["nb"] * 60), "a"), (14, None, "b")]
    labels = [(0, 1, 0), (7, 1, 1), (7, 0, 0), (8, None, 1), (9, 1, None), (10, 0, 1), (None, 1, 1), (-3, 1, 1), (99, 1, 1), (12, 1, 0)]
    return rows, labels


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "p", 2, "c", "AB", "A", 3) for r in rows], DOC).repartition(3)
    marks = spark.createDataFrame([(*x, "b", 1) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    out = filter_audit.audit(docs, marks)
    assert dict(out.dtypes)["step"] == "int" and all(t == "bigint" for c, t in out.dtypes if c not in ("part", "filter_order", "step"))
    got = out.collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


def test_audit_odd_texts(spark):
    rows, labels = odd_texts()
    got = audited(spark, rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == brute_audit(rows, labels)


def test_audit_empty_and_many_copies(spark):
    assert audited(spark, [], []) == {}
    rows = [(i, "one text", "hot") for i in range(300)] + [(i, f"text {i}", f"s{i % 40}") for i in range(300, 400)]
    assert audited(spark, rows, []) == brute_audit(rows, [])


# --- URL filter -----------------------------------------------------------------
def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in queries.URL_RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


ODD_URLS = [
    None, "", "example.org/es/1", "https://example.org", "https://example.org/", "http://EXAMPLE.org/ES/", "https://a.example.org/es/1", "https://badexample.org/es/1",
    "https://example.org/en/12", "https://example.org/en/2", "ftp://x.com/fr/", "ftp://x.com/fr", "ftp://x.com/de/a?b", "http://com/de/", "http://a.com?x=/fr/",
    "http://a.com#/fr/", "http://u@a.org:80/p", "a://b://c.org/d", "http://ÄB.Org/é\nz?q", "://", "http:///fr/", "http://n.net/" + "ab" * 100_000,
]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate([*ODD_URLS, *ODD_URLS])], "page_id long, url string, host string, rule string, found int")
    weights = [0.0] * url_filter.BUCKETS + [-1.0]
    got = url_filter.judge(pages, queries.URL_RULES, weights).collect()
    assert len(got) == 2 * len(ODD_URLS)
    for r in got:
        host, path, rule = brute_url(ODD_URLS[r.page_id % len(ODD_URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == queries.URL_RULES.get(rule, "allow") and abs(r.p_block - sigmoid(-1)) < 1e-12
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, weights).count() == 0


def test_url_descent_equals_plain_python(spark):
    rows = [("http://casino.test/x", 1.0), ("http://news.test/y", 0.0), ("http://casino.news.test/", 1.0), (None, 1.0), ("http://z.test", None), ("http://news.test/y", 0.0)]
    labelled = spark.createDataFrame(rows, "url string, y double")
    got = url_filter.train(labelled, rounds=5, rate=2.0, ridge=1e-3)
    host, path = url_filter.host_and_path(F.col("url"))
    known = labelled.filter("url is not null and y is not null").select(url_filter.features(host, path).alias("f"), "y").collect()
    w, v = [0.0] * (url_filter.BUCKETS + 1), [0.0] * (url_filter.BUCKETS + 1)
    for _ in range(5):
        g = [0.0] * len(w)
        for r in known:
            e = (sigmoid(sum(w[b] for b in r.f) / math.sqrt(len(r.f)) + w[-1]) - r.y) * len(known) / (2 * sum(x.y == r.y for x in known))
            for b in r.f:
                g[b] += e / math.sqrt(len(r.f)) / len(known)
            g[-1] += e / len(known)
        for b in range(len(w)):
            v[b] = 0.9 * v[b] - 2.0 * (g[b] + (1e-3 * w[b] if b < url_filter.BUCKETS else 0))
            w[b] += v[b]
    assert max(abs(a - b) for a, b in zip(got, w, strict=True)) < 1e-6
    assert set(url_filter.train(labelled.limit(0), rounds=3)) == {0.0}


def test_url_features(spark):
    """Distinct n-grams of 3 and 4 characters, ends marked, fields told apart."""
    df = spark.createDataFrame([("abc", "/abc"), ("", "")], "h string, p string")
    a, b = (r.f for r in df.select(url_filter.features(F.col("h"), F.col("p")).alias("f")).collect())
    # ^abc$: 3 + 2; ^/abc$: 4 + 3; ^$: one of each length, equal ones once
    assert len(a) == 12 and len(b) == 2 and all(0 <= x < url_filter.BUCKETS for x in a)


def test_url_held_out_addresses(spark):
    """Learned on a half of the table, addresses of the other half are ranked: blocked ones above ordinary ones."""
    rows = [(u, 1.0) for u in url_filter.BLOCKED.split()] + [(u, 0.0) for u in url_filter.ALLOWED.split()]
    assert len(set(rows)) == len(rows)
    for half in range(2):
        fold = [int(hashlib.md5(u.encode()).hexdigest(), 16) % 2 == half for u, _ in rows]
        train = spark.createDataFrame([r for r, f in zip(rows, fold, strict=True) if f], "url string, y double")
        rest = [r for r, f in zip(rows, fold, strict=True) if not f]
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rest)], "page_id long, url string")
        p = {r.page_id: r.p_block for r in url_filter.judge(pages, {}, url_filter.train(train)).collect()}
        bad, good = ([p[i] for i, (_, y) in enumerate(rest) if y == label] for label in (1, 0))
        assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) >= 0.8


# --- hard negatives -------------------------------------------------------------
def brute_negatives(rows, anchor, relabel=lambda i, x: x, positives=5, negatives=5):
    points = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        p = (relabel(i, label), tuple(math.floor(256 * x) for x in v))
        points[i] = min(points.get(i, p), p)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, (label, v) in points.items():
        if not anchor(a):
            continue
        scored = sorted((-dot(v, w), i, x) for i, (x, w) in points.items() if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            hits = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(a, i, n + 1, h[1], -s, -h[0]) for n, h in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, score double, id string, slice int").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, lambda i: i % 10 == 0, lambda i, x: x, **options).collect())


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7, "slice_rows": 11, "directions": 3}, {"directions": 40, "sample": 8}])
def test_negatives_clustered(spark, options):
    r = random.Random(6)
    rows = []
    for i in range(400):
        c = i % 6
        rows.append((i, [(4.0 if k == c else 0.0) + r.gauss(0, 0.6 if i % 3 else 0.01) for k in range(12)], c if i % 5 else (c + 1) % 6))
    want = brute_negatives([(i, [struct_float(x) for x in v], y) for i, v, y in rows], lambda i: i % 10 == 0)
    assert want and mined(spark, rows, **options) == want


def struct_float(x):
    import numpy as np

    return float(np.float32(x))


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)], r.randrange(3)) for i in range(60)]  # many ties, zero vectors
    rows += [(100, None, 1), (110, [1.0, nan, 0.0], 1), (120, [1.0, None, 0.0], 1), (130, [inf, 0.0, 0.0], 1), (140, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1),
             (150, [], 0), (160, [1.0], 1), (170, [1.0, 1.0, 1.0, 1.0, 1.0], 2), (10, [9.0, 9.0, 9.0], 5), (180, [1.0, 2.0, 3.0], 77), (2, rows[2][1], rows[2][2])]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == [(0, 1, 1, 2, 0, 0)]
    # a group of equal vectors, larger than any number asked for
    rows = [(i, [0.5, 0.25], i % 3) for i in range(90)]
    assert mined(spark, rows, chunk_rows=2) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_bounds_hold():
    """No pair's integer score leaves the interval that the angles give, also for parallel and opposite vectors."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (80, 6))
    v[:10] = v[10:20] * 3
    v[20:30] = -v[10:20]
    f = v.astype(float)
    unit = f / np.linalg.norm(f, axis=1)[:, None]
    angles = np.arccos(np.clip(unit @ unit[:12].T, -1, 1))
    high, low = hard_negatives.gaps(angles, angles)
    norms = np.linalg.norm(f, axis=1)[:, None] * np.linalg.norm(f, axis=1)
    exact = v @ v.T
    assert (hard_negatives.most(norms, high) >= exact).all() and (-hard_negatives.most(norms, -low) <= exact).all()
    assert (hard_negatives.most(norms, high) < norms * 0.9).any()


def test_negatives_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_negatives(rows, lambda i: i % 100 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)
    out = queries.op13_hard_negatives(spark, SF)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in out.collect()) == want


def test_audit_query_and_url_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in queries.op11_filter_audit(spark, SF).collect()}
    assert got == brute_audit(docs, labels)
    for r, url in queries.op12_url_filter(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id").rdd.map(lambda r: (r, r.url)).collect():
        assert (r.host, r.path, r.rule) == brute_url(url) and r.verdict == queries.URL_RULES.get(r.rule, r.verdict)
