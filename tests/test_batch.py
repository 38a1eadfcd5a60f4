"""Batch bookkeeping: history, attempts, images, summaries, states, merge, documents."""

import datetime as dt

from pyspark.sql import functions as F

from sitesift.operators import batch as B
from sitesift.operators.records import merge_listing_detail, to_records
from sitesift.sources.sinks import append_history, image_manifest, render_documents

T0 = dt.datetime(2024, 1, 1)


def test_history_skip_and_repeats(spark):
    items = spark.createDataFrame([("1", 1), ("2", 2), (None, 3), ("1", 4)], "tender_id string, position int")
    hist = spark.createDataFrame([("2",), (None,)], "tender_id string")
    todo, skipped = B.split_by_history(items, hist)
    assert sorted(r["position"] for r in todo.collect()) == [1, 3, 4]
    assert [r["position"] for r in skipped.collect()] == [2]
    rep = B.mark_in_batch_repeats(items.withColumn("batch_id", F.lit("b")).withColumn("success", F.lit(True)))
    assert {r["position"]: r["repeat_skipped"] for r in rep.collect()} == {1: False, 2: False, 3: False, 4: True}


def test_attempt_outcomes(spark):
    rows = [("a", 1, False, "e1"), ("a", 2, True, None), ("b", 1, False, "x1"), ("b", 2, False, "x2"), ("b", 3, False, "x3"),
            ("c", 1, True, None)]
    att = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=n), n, ok, e) for i, n, ok, e in rows],
                                "item_id string, started_at timestamp, attempt_key int, ok boolean, error string")
    out = {r["item_id"]: r.asDict() for r in B.attempt_outcomes(B.number_attempts(att), max_retries=2).collect()}
    assert out["a"]["success"] and out["a"]["fetch_attempts"] == 2
    assert not out["b"]["success"] and out["b"]["fetch_attempts"] == 2 and out["b"]["failure_reason"] == "x2"
    img = {r["item_id"]: r.asDict() for r in B.attempt_outcomes(B.number_attempts(att), max_retries=2, kind="image").collect()}
    assert img["b"]["fetch_attempts"] == 3 and img["b"]["failure_reason"] == "x3"
    resumed = {r["item_id"]: r.asDict() for r in B.attempt_outcomes(B.number_attempts(att), max_retries=1, prior=2).collect()}
    assert resumed["b"]["fetch_attempts"] == 3


def test_resolve_attempts(spark):
    starts = spark.createDataFrame([(1, "i", T0), (2, "i", T0 + dt.timedelta(minutes=5))], "start_id int, item_id string, ts timestamp")
    changes = spark.createDataFrame(
        [(10, "i", T0 + dt.timedelta(seconds=10), "complete"), (11, "i", T0 + dt.timedelta(seconds=20), "interrupted"),
         (12, "i", T0 + dt.timedelta(minutes=5, seconds=31), "complete")],
        "change_id int, item_id string, ts timestamp, state string")
    got = {r["start_id"]: (r["change_id"], r["ok"]) for r in B.resolve_attempts(starts, changes, 30).collect()}
    assert got == {1: (10, True), 2: (None, False)}


def test_image_outcomes_and_summary(spark):
    im = spark.createDataFrame([("b", "t1", True), ("b", "t1", False), ("b", "t2", False), ("b", "t3", True)],
                               "batch_id string, tender_id string, ok boolean")
    out = {r["tender_id"]: r["failure_reason"] for r in B.image_outcomes(im).collect()}
    assert out == {"t1": "1 of 2 images failed", "t2": "All 1 images failed", "t3": None}
    items = spark.createDataFrame([("b", "success", T0), ("b", "failed", T0 + dt.timedelta(seconds=2)), ("b", "skipped", T0)],
                                  "batch_id string, outcome string, started_at timestamp")
    s = B.completion_summary(items, im).first().asDict()
    assert (s["total_tenders"], s["success_count"], s["failed_count"], s["skipped_count"], s["duration_ms"]) == (3, 1, 1, 1, 2000)
    assert (s["image_total"], s["image_downloaded"], s["image_failed"]) == (4, 2, 2)


def test_batch_state_recovery(spark):
    raws = ['{"batchId":"x","pageNumber":2.7,"currentTenderIndex":5,"tenders":[1,2],"successCount":3,"batchStatus":"Completed"}',
            "[1]", "garbage", '{"totalTenders":4,"retryConfig":{"maxRetries":0,"baseDelayMs":10}}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r["i"]: r.asDict() for r in B.recover_batch_states(df).collect()}
    assert (got[0]["batch_id"], got[0]["page_number"], got[0]["current_index"], got[0]["total_tenders"]) == ("x", 2, 0, 2)
    assert got[0]["batch_status"] == "Completed" and got[0]["success_count"] == 3
    assert got[1]["batch_status"] == "Idle" and got[2]["total_tenders"] == 0
    assert (got[3]["total_tenders"], got[3]["max_retries"], got[3]["base_delay_ms"]) == (4, 1, 10)


def test_records_merge_documents(spark):
    listing = spark.createDataFrame(
        [(1, "1", "Tender for the Supply of Pumps", "LAHORE", "1 Jan", "https://www.tenders.example/a_tenders-10.html", 2),
         (1, "2", "Bad", "X", "Y", "https://www.tenders.example/nope.html", 2)],
        "page_id long, listing_position string, original_listing_title string, city string, date_posted string, detail_url string, page_number int")
    recs = to_records(listing)
    assert recs.count() == 1
    det = spark.createDataFrame(
        [("10", "11", "3 Jan", "Not available", "Punjab", "Lahore", "Goods", "Health", "Daily", "9 Jan", "Desc",
          ["https://www.tenders.example/images/tenders/1.jpg", "https://www.tenders.example/images/tenders/1.jpg"], "k: v", [])],
        "tender_id string, parser_tender_id string, date_posted string, category string, province string, location string, "
        "subcategory string, sector string, newspaper string, last_date string, description string, image_urls array<string>, "
        "details_text string, warnings array<string>")
    m = merge_listing_detail(recs, det).withColumn("batch_folder", F.lit("Tender/2024-01-01_00-00-00_Page-2"))
    r = m.first().asDict()
    assert r["title"] == "Supply of Pumps" and r["folder_name"] == "001_Supply of Pumps"
    assert r["category"] == "Not available" and r["province"] == "Punjab" and r["download_status"] == "Parsed - Download Pending"
    assert r["image_urls"] == ["https://www.tenders.example/images/tenders/1.jpg"] and len(r["warnings"]) == 1
    doc = render_documents(m).first()
    assert doc["path"] == "Tender/2024-01-01_00-00-00_Page-2/001_Supply of Pumps/Tender.txt"
    lines = doc["content"].split("\r\n")
    assert lines[:4] == ["=== Tender Details ===", "", "Tender ID: 10", "Title: Supply of Pumps"]
    assert "Category: N/A" in lines and lines[-3:] == ["Images:", "  1. https://www.tenders.example/images/tenders/1.jpg", ""]
    man = image_manifest(m).first()
    assert man["path"].endswith("/001_Supply of Pumps/image_1.jpg") and man["image_no"] == 1
    h = spark.createDataFrame([("10", "b0", T0)], "tender_id string, first_batch_id string, processed_at timestamp")
    new = spark.createDataFrame([("10", "b1", T0 + dt.timedelta(days=1)), ("11", "b1", T0), (None, "b1", T0)],
                                "tender_id string, first_batch_id string, processed_at timestamp")
    assert sorted((r["tender_id"], r["first_batch_id"]) for r in append_history(h, new).collect()) == [("10", "b0"), ("11", "b1")]


def test_number_within_hot_group(spark):
    from pyspark.sql import Window

    from sitesift.operators.numbering import number_within

    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 100003).alias("o"),
    )
    got = number_within(df, "g", "o").select("g", "o", "position")
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_listing_level_checks(spark):
    from sitesift.operators.detail import collect_warnings
    from sitesift.operators.records import drop_stale, listing_counts, page_readiness

    insp = spark.createDataFrame(
        [(1, "u1", "u1", None, 3, []), (2, "u2", "other", None, 5, []),
         (3, "u3", "u3", None, 0, ["The tender listing section could not be found. x"])],
        "page_id int, page_url string, inspected_url string, reason string, tender_count int, warnings array<string>")
    r = {x["page_id"]: x.asDict() for x in page_readiness(drop_stale(insp)).collect()}
    assert r[1]["ready"] and not r[2]["ready"] and r[2]["tender_count"] == 0 and "page changed" in r[2]["reason"]
    assert r[3]["has_fatal"] and not r[3]["ready"]
    w = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a")], "page_id int, ord int, warning string")
    assert collect_warnings(w).first()["warnings"] == ["a", "b"]
    recs = spark.createDataFrame([(1,), (1,), (2,)], "page_id int")
    assert sorted((x["page_id"], x["tender_count"]) for x in listing_counts(recs).collect()) == [(1, 2), (2, 1)]
