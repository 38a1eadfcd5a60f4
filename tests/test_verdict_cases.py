"""Values that once overflowed, were cut, or were counted wrongly."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitesift.functions.naming import fmt_seq, page_no
from sitesift.functions.urls import num_in, page_in_path
from sitesift.operators.batch import STATE_RULES, check_raw_states, completion_summary, recover_batch_states
from sitesift.operators.detail import extract_metadata
from sitesift.operators.numbering import number_within
from sitesift.operators.records import capture_as_of, normalization_report, one_detail
from sitesift.plans.jobs import gate_captures
from sitesift.streaming.stream import history_sink


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first()["r"]


def test_long_and_padded_numbers(spark):
    assert one(spark, "9999999999", page_no) == 9999999999
    assert one(spark, "123456789012", fmt_seq) == "123456789012"
    assert one(spark, "9" * 30, page_no) == 1
    assert one(spark, "Page 0000007", num_in) == 7 and one(spark, "123456789", num_in) is None
    assert one(spark, "/tenders-00000000012/", page_in_path) == 12


def test_recovery_survives_huge_numbers(spark):
    raw = ['{"processedCount":1e30,"pageNumber":1e300,"totalTenders":5}', "{", None]
    rows = recover_batch_states(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert len(rows) == 3 and rows[0]["total_tenders"] == 5


def test_recovery_of_every_field(spark):
    raw = [
        '{"createdAt":"2031-01-01","updatedAt":7,"totalTenders":1e30,"processedCount":1e30,"currentTenderIndex":1,"tenders":[{"a":[1,2]},"x"],'
        '"completionSummary":{"completedAt":"t","totalTenders":4.9,"durationMs":"5"},"retryConfig":{"maxRetries":2.9}}',
        '{"batchId":"q\\"uote","completionSummary":[],"pageNumber":0.5,"successCount":true}', '"text"', "[{}]", None,
    ]
    a, b, *rest = recover_batch_states(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    # a number beyond 64 bits is no number: the default, not null
    assert (a.created_at, a.updated_at, a.total_tenders, a.processed_count, a.current_index, a.max_retries) == ("2031-01-01", None, 2, 0, 1, 2)
    assert tuple(a.completion_summary) == ("t", 4, 0, 0, 0, 0)
    assert (b.batch_id, b.page_number, b.success_count) == ('q"uote', 0, 0) and tuple(b.completion_summary) == (None, 0, 0, 0, 0, 0)
    for r in rest:
        assert (r.batch_id, r.batch_status, r.total_tenders, r.completion_summary) == (None, "Idle", 0, None)


GOOD = ('{"batchId":null,"pageNumber":1,"pageUrl":null,"createdAt":"a","updatedAt":null,"currentTenderIndex":0,"totalTenders":0,"processedCount":0,'
        '"successCount":0,"failedCount":0,"skippedCount":0,"batchStatus":"Idle","tenders":[],"completionSummary":null}')


def test_seventeen_rules_of_stored_states(spark):
    from pyspark.sql import Observation

    change = lambda old, new: GOOD.replace(old, new)
    cases = {
        GOOD: [], change('"batchId":null', '"batchId":5'): [1], change('"pageNumber":1', '"pageNumber":0'): [2], change('"pageUrl":null,', ""): [3],
        change('"createdAt":"a"', '"createdAt":1'): [4], change('"updatedAt":null', '"updatedAt":{}'): [5], change('"currentTenderIndex":0', '"currentTenderIndex":-1'): [6],
        change('"totalTenders":0', '"totalTenders":"0"'): [7], change('"processedCount":0', '"processedCount":null'): [8], change('"successCount":0', '"successCount":-2'): [9],
        change('"failedCount":0', '"failedCount":true'): [10], change('"skippedCount":0', '"skippedCount":-0.5'): [11], change('"Idle"', '"Paused"'): [12],
        change('"tenders":[]', '"tenders":{}'): [13], change('"tenders":[]', '"tenders":[],"retryConfig":{"maxRetries":0}'): [14],
        change('"tenders":[]', '"tenders":[],"retryConfig":{"baseDelayMs":-1}'): [15], change('"tenders":[]', '"tenders":[],"retryConfig":0'): [16],
        change('"completionSummary":null', '"completionSummary":3'): [17], change('"tenders":[]', '"tenders":[],"retryConfig":null'): [],
    }
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*cases, "null", "not json", None])], "i int, raw string")
    seen = Observation("rules")
    got = {r.i: r for r in check_raw_states(df, observe=seen).collect()}
    for i, (raw, rules) in enumerate(cases.items()):
        assert got[i].errors == [STATE_RULES[n - 1][2] for n in rules], raw
        assert got[i].valid == (not rules)
    assert all(got[i].errors == ["State must be an object."] for i in range(len(cases), len(cases) + 3))
    assert seen.get["rows"] == len(cases) + 3 and seen.get["invalid"] == 20 and all(seen.get[f"rule_{n}"] == 1 for n in range(1, 18))


def test_duration_is_completion_minus_creation(spark):
    items = spark.createDataFrame([("a", "success", "2031-01-01 00:00:05"), ("b", "failed", "2031-01-01 00:00:09")], "batch_id string, outcome string, started_at string")
    items = items.withColumn("started_at", F.to_timestamp("started_at"))
    batches = spark.createDataFrame([("a", "2031-01-01 00:00:00", "2031-01-01 00:01:00"), ("b", None, "2031-01-01 00:01:00")], "batch_id string, created_at string, completed_at string")
    batches = batches.withColumns({c: F.to_timestamp(c) for c in ("created_at", "completed_at")})
    assert {r.batch_id: r.duration_ms for r in completion_summary(items, batches=batches).collect()} == {"a": 60_000, "b": 0}


def test_records_take_the_capture_of_their_time(spark):
    times = "captured_at timestamp"
    at = lambda h: dt.datetime(2031, 1, 1, h)
    records = spark.createDataFrame([(1, "x", at(1)), (2, "x", at(3)), (3, "x", at(9)), (4, None, at(9)), (5, "y", at(9)), (6, "x", at(3))], "n int, tender_id string, as_of timestamp")
    captures = spark.createDataFrame([("x", at(2)), ("x", at(3)), ("x", at(3)), ("x", at(8)), ("z", at(1)), (None, at(1))], f"tender_id string, {times}")
    got = {r.n: r.captured_at for r in capture_as_of(records, captures).collect()}
    assert got == {1: None, 2: at(3), 3: at(8), 4: None, 5: None, 6: at(3)}
    # recaptures never multiply records
    d = spark.createDataFrame([("x", i, at(i % 5)) for i in range(50)], f"tender_id string, v int, {times}")
    assert [tuple(r) for r in one_detail(d, ["tender_id"]).select("tender_id", "v", "captured_at").collect()] == [("x", 4, at(4))]


def test_gate_checks_the_url_and_derives_the_id(spark):
    from dataclasses import replace

    from sitesift.profile import DEFAULT_PROFILE

    h = "https://www.tenders.example"
    late = "<p>" + "a" * 3000 + " captcha</p>"
    rows = [(1, f"{h}/a_tenders-5.html", f"{h}/a_tenders-5.html", "<p>x</p>"), (2, f"{h}/a-5.html", f"{h}/a-5.html", "<p>x</p>"), (3, None, None, "<p>x</p>"),
            (4, f"{h}/a_tenders-5.html", f"{h}/a_tenders-6.html", "<p>x</p>"), (5, f"{h}/a_tenders-5.html", f"{h}/a_tenders-5.html", late)]
    df = spark.createDataFrame([(*r, 200, "text/html") for r in rows], "page_id long, url string, final_url string, html string, status int, content_type string")
    codes = lambda **x: {r.page_id: r.outcome_code for r in gate_captures(df, profile=replace(DEFAULT_PROFILE, **x)).collect()}
    want = {1: "OK", 2: "INVALID_TENDER_URL", 3: "INVALID_TENDER_URL", 4: "UNEXPECTED_REDIRECT", 5: "OK"}
    assert codes() == want and codes(block_scan_chars=None) == want | {5: "ACCESS_RESTRICTED"}


def test_missing_status_is_an_error(spark):
    df = spark.createDataFrame([(1, None, "<p>x</p>", "text/html", "u", "1")], "page_id long, status int, html string, content_type string, final_url string, expected_id string")
    assert gate_captures(df).first()["outcome_code"] == "HTTP_ERROR"


def test_blocking_not_available_yields_to_detail_rows_only(spark):
    rows = [(1, "category", "Not available", 1, 0, 0), (1, "category", "Goods", 2, 1, 0), (2, "category", "Not available", 1, 0, 0), (2, "category", "Works", 5, 1, 0), (3, "category", "Late", 5, 0, 0)]
    pairs = spark.createDataFrame(rows, "page_id long, label string, value string, strategy int, o1 int, o2 int")
    aliases = spark.createDataFrame([("category", "category")], "alias string, key string")
    got = {r["page_id"]: r["category"] for r in extract_metadata(pairs, aliases, keys=["category"]).collect()}
    assert got == {1: "Not available", 2: "Works", 3: "Late"}


def test_malformed_rows_are_not_invalid_urls(spark):
    rows = [(1, None, "https://example.org/x"), (1, "a title", "https://example.org/x"), (1, "a title", None)]
    r = normalization_report(spark.createDataFrame(rows, "page_id long, original_listing_title string, detail_url string")).first()
    assert (r["raw_count"], r["valid_count"], r["invalid_count"]) == (3, 0, 1)


def test_numbering_of_a_hot_group_with_other_columns(spark):
    df = spark.range(500_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.xxhash64("id").alias("o"), F.col("id").alias("extra"), F.sha2(F.col("id").cast("string"), 256).alias("more"),
    )
    out = number_within(df.groupBy("g", "o", "more").agg(F.max("extra").alias("extra")), "g", "o")
    r = out.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m"), F.count("more").alias("x"))
    assert r.filter("n <> d or n <> m").count() == 0 and r.agg(F.sum("n")).first()[0] == 500_000
    w = Window.partitionBy("g").orderBy("position")
    assert out.withColumn("p", F.lag("o").over(w)).filter("p >= o").count() == 0


def test_history_of_two_runs(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = lambda ids: spark.createDataFrame([(i, None) for i in ids], "tender_id string, processed_at timestamp")
    first = history_sink(path)
    first(rows(["1", "2"]), 0)
    first(rows(["2", "3"]), 1)
    first(rows(["2", "3"]), 1)  # a replayed micro-batch
    history_sink(path)(rows(["3", "9"]), 0)  # a new run with a new checkpoint
    assert sorted(r["tender_id"] for r in spark.read.parquet(path).collect()) == ["1", "2", "3", "9"]
