"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the given tables (or pages Spark derives from them) in
full.  Modulo expressions below only vary the shape of the synthesized data
(layouts, missing details, invalid links); no query filters rows away to
stay cheap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.naming import batch_folder, folder_name
from ..functions.urls import normalize_url, url_parts, validate_detail_url
from ..operators import batch as B
from ..operators.records import merge_listing_detail, to_records
from ..session import configure, spread
from ..sources.files import read_files, write_files
from ..sources.sinks import document_text, image_manifest, render_documents
from ..streaming.stream import scratch_dir
from . import jobs, synth

HOST = synth.HOST


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------------------
# pages
# ---------------------------------------------------------------------------
def q_page_summary(spark, sf):
    return jobs.page_summary(_t(spark, sf, "pages")).drop("code")


def q_page_titles(spark, sf):
    return jobs.page_titles(_t(spark, sf, "pages")).drop("code")


def q_page_links(spark, sf):
    return jobs.page_links(_t(spark, sf, "pages"))


def q_main_content_stats(spark, sf):
    return jobs.main_content_stats(_t(spark, sf, "pages"))


def q_url_canonical(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", normalize_url(F.col("url")).alias("canonical_url"))


def q_url_dedup(spark, sf):
    """SC-10 + WIN-1/WIN-2: one row per URL key, numbered per host by first occurrence.

    Copies are combined by a partial aggregate per key; the per-host
    numbering is range-partitioned, so neither a hot URL nor a hot host is
    handled by a single task.
    """
    from ..operators.numbering import number_within

    p = _t(spark, sf, "pages")
    c = p.select(
        "page_id",
        url_parts(F.col("url"))["host"].alias("host"),
        F.regexp_replace(normalize_url(F.col("url")), "[?#].*$", "").alias("url_key"),
    )
    d = c.groupBy("host", "url_key").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("n_copies"))
    return number_within(d, "host", "first_page_id").select("host", "url_key", "first_page_id", "n_copies", "position")


def _gate_input(spark, sf):
    p = _t(spark, sf, "pages")
    pid = F.col("page_id")
    url = F.format_string(f"https://{HOST}/p_tenders-%d.html", pid + 1)
    return p.select(
        "page_id",
        url.alias("url"),
        F.when(pid % 13 == 0, F.format_string(f"https://{HOST}/p_tenders-%d.html", pid + 2)).otherwise(url).alias("final_url"),
        (pid + 1).cast("string").alias("expected_id"),
        F.when(pid % 11 == 0, 404).when(pid % 11 == 1, 403).when(pid % 11 == 2, 429).when(pid % 11 == 3, 500).otherwise(200).alias("status"),
        F.when(pid % 7 == 0, F.lit("application/json")).when(pid % 7 == 1, F.lit(None).cast("string"))
        .when(pid % 7 == 2, F.lit("TEXT/HTML; charset=utf-8")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(pid % 17 == 0, F.lit("  ")).otherwise(F.col("html")).alias("html"),
    )


def q_capture_gate(spark, sf):
    g = jobs.gate_captures(_gate_input(spark, sf))
    return g.select("page_id", "outcome_code", "message")


def q_detail_ids(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    m = k % 6
    url = (
        F.when(m == 0, F.format_string(f"https://{HOST}/item_tenders-%d.html", k))
        .when(m == 1, F.format_string("http://tenders.example/x_tenders-%d.html?ref=1#frag", k))
        .when(m == 2, F.format_string("/rel/y_tenders-%d.html", k))
        .when(m == 3, F.format_string("https://other.example/x_tenders-%d.html", k))
        .when(m == 4, F.format_string(f"https://{HOST}/z_tenders-00%d.html", k))
        .otherwise(F.format_string("javascript:void(%d)", k))
    )
    v = o.select("o_orderkey", validate_detail_url(url).alias("v"))
    return v.select("o_orderkey", "v.valid", "v.canonical_url", "v.tender_id")


# ---------------------------------------------------------------------------
# synthesized detail / listing pages
# ---------------------------------------------------------------------------
def q_metadata_roundtrip(spark, sf):
    configure(spark)
    d = synth.detail_pages(spark, sf)
    res = jobs.details_job(d.select("page_id", "url", "html"), spread=False)  # the pages are made in dealt tasks
    return res.select("page_id", *P.METADATA_KEYS, "title", "details_text")


def q_descriptions(spark, sf):
    configure(spark)
    d = synth.description_pages(spark, sf)
    return jobs.details_job(d).select("page_id", "description")


def q_images(spark, sf):
    configure(spark)
    d = synth.image_pages(spark, sf)
    res = jobs.details_job(d).select(F.col("page_id").alias("tender_id"), "image_urls")
    m = image_manifest(res.withColumn("batch_folder", F.lit("Tender/b")).withColumn("folder_name", F.lit("f")))
    return m.select(F.col("tender_id").alias("page_id"), "image_no", "image_url")


def q_listing_rows(spark, sf):
    configure(spark)
    rows, _ = jobs.listings_job(synth.listing_pages(spark, sf))
    return rows


def q_listing_pages(spark, sf):
    configure(spark)
    _, info = jobs.listings_job(synth.listing_pages(spark, sf))
    return info.select("page_id", "page_number", "detection_source", "tender_count")


def _merged(spark, sf) -> DataFrame:
    f = synth.order_facts(spark, sf)
    k = F.col("k")
    page = (k / synth.LISTING_PAGE_SIZE).cast("long")
    raw_title = (
        F.when(k % 3 == 0, F.concat(F.lit("Tender for the "), F.col("title")))
        .when(k % 4 == 1, F.concat(F.col("title"), F.lit(": lot "), k.cast("string")))
        .otherwise(F.col("title"))
    )
    listing = f.select(
        page.alias("page_id"),
        F.row_number().over(Window.partitionBy(page).orderBy(k)).alias("listing_position"),
        raw_title.alias("original_listing_title"),
        F.col("v_location").alias("city"),
        F.col("v_date_posted").alias("date_posted"),
        F.format_string(f"https://{HOST}/item_tenders-%d.html", k).alias("detail_url"),
        (page + 1).alias("page_number"),
    )
    records = to_records(listing)
    det = f.filter(k % 7 != 0).select(
        k.cast("string").alias("tender_id"),
        F.when(k % 11 == 0, (k + 1).cast("string")).otherwise(k.cast("string")).alias("parser_tender_id"),
        F.col("v_date_posted").alias("date_posted"),
        F.when(k % 5 == 0, F.lit(P.NOT_AVAILABLE)).otherwise(F.col("v_category")).alias("category"),
        F.col("v_province").alias("province"),
        F.col("v_location").alias("location"),
        F.col("v_subcategory").alias("subcategory"),
        F.col("v_sector").alias("sector"),
        F.col("v_newspaper").alias("newspaper"),
        F.col("v_last_date").alias("last_date"),
        F.when(k % 2 == 0, F.format_string("Description of order %d", k)).otherwise(F.lit(P.NOT_AVAILABLE)).alias("description"),
        F.when(k % 3 == 0, F.array(F.format_string(f"https://{HOST}/images/tenders/%d-1.jpg", k),
                                   F.format_string(f"https://{HOST}/images/tenders/%d-1.jpg", k)))
        .otherwise(F.array().cast("array<string>")).alias("image_urls"),
        F.lit("").alias("details_text"),
        F.array().cast("array<string>").alias("warnings"),
    )
    merged = merge_listing_detail(records, det)
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    return merged.withColumn("batch_folder", batch_folder(F.col("pagination_number"), created))


def q_merged_records(spark, sf):
    configure(spark)
    m = _merged(spark, sf)
    return m.select(
        "tender_id", "listing_position", "title", "folder_name", "category", "province", "location", "description",
        "download_status", "fetch_attempts", F.size("image_urls").alias("n_images"),
        F.array_join("warnings", "|").alias("warnings_text"),
    )


def q_pipeline_documents(spark, sf):
    """SRC-1 -> FLT-3 -> SRC-3 -> EXT-17 -> JN-1/JN-6 as of a time -> SNK-1: captures to documents, failures kept.

    ``content`` is the document of each record.  Even orders are listed half a day after the first capture, odd ones two days after, every 9th half a day before.
    """
    configure(spark)
    f = synth.order_facts(spark, sf)
    k = F.col("k")
    start = F.lit(1704110400)
    listing = f.select(
        k.alias("listing_position"), F.col("title").alias("original_listing_title"), F.col("v_location").alias("city"), F.col("v_date_posted").alias("date_posted"),
        F.format_string(f"https://{HOST}/order_tenders-%d.html", k).alias("detail_url"), F.lit(1).alias("page_number"),
        F.timestamp_seconds(F.when(k % 9 == 0, start - 43200).when(k % 2 == 0, start + 43200).otherwise(start + 172800)).alias("as_of"),
    )
    merged = jobs.process_captures(to_records(listing), synth.captured_pages(spark, sf), spread=False)  # made in dealt tasks
    documents = merged.withColumn("content", document_text())
    return documents.select("tender_id", "outcome_code", "download_status", "failure_reason", "fetch_attempts", "category", "newspaper", "last_date", "title",
                            F.col("content").isNotNull().alias("has_document"), "content")


def q_page_outcomes(spark, sf):
    """SRC-3 + EXT-17: one outcome row for every capture, whatever became of its parse."""
    p = _t(spark, sf, "pages")
    pid = F.col("page_id")
    html = F.when(pid % 17 == 0, F.lit(None).cast("string")).when(pid % 17 == 1, F.lit("")).when(pid % 17 == 2, F.lit(" \n ")).when(pid % 17 == 3, F.lit("<![x[ y ]]>z")).otherwise(F.col("html"))
    return jobs.parse_outcomes(p.select("page_id", html.alias("html"))).select("page_id", "code", (F.col("n_elements") > 0).alias("has_nodes"))


def q_documents_txt(spark, sf):
    configure(spark)
    return render_documents(_merged(spark, sf))


def q_document_files(spark, sf):
    """SNK-1: each document written as a file of its own, the files published and read back."""
    configure(spark)
    out = scratch_dir(spark, "documents")
    return read_files(write_files(render_documents(_merged(spark, sf)), out), out)


def q_folder_names(spark, sf):
    p = spread(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"))  # a compact file is one split
    k = F.col("p_partkey")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("Tender for the "), F.col("p_name")))
        .when(k % 5 == 1, F.concat(F.col("p_name"), F.lit(": lot/"), F.col("p_size").cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit(" *?<> .")))
        .when(k % 5 == 3, F.concat(F.lit("con."), F.col("p_name")))
        .otherwise(F.concat(F.col("p_name"), F.repeat(F.lit(" x"), 60)))
    )
    return p.select("p_partkey", folder_name(k, raw).alias("folder_name"))


# ---------------------------------------------------------------------------
# batches over events
# ---------------------------------------------------------------------------
def _history(ev: DataFrame) -> DataFrame:
    return ev.filter((F.dayofmonth("ts") <= 15) & (F.col("event_type") == "purchase")).select(
        F.col("user_id").cast("string").alias("tender_id"))


def q_history_skip(spark, sf):
    ev = _t(spark, sf, "events")
    items = ev.select("event_id", F.col("user_id").cast("string").alias("tender_id"))
    todo, skipped = B.split_by_history(items, _history(ev))
    return todo.withColumn("action", F.lit("todo")).unionByName(skipped.drop("status").withColumn("action", F.lit("skip")))


def q_in_batch_repeats(spark, sf):
    ev = _t(spark, sf, "events")
    items = ev.select(
        "event_id", F.to_date("ts").alias("batch_id"), F.col("event_id").alias("position"),
        F.col("user_id").cast("string").alias("tender_id"), (F.col("event_type") != "error").alias("success"),
    )
    return B.mark_in_batch_repeats(items).select("event_id", "repeat_skipped")


def q_page_done(spark, sf):
    ev = _t(spark, sf, "events")
    recs = ev.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("page_id"), F.col("user_id").cast("string").alias("tender_id"))
    return B.page_done(recs, _history(ev))


def _attempts(ev: DataFrame) -> DataFrame:
    a = ev.select(
        F.col("user_id").cast("string").alias("item_id"),
        F.col("ts").alias("started_at"),
        F.col("event_id").alias("attempt_key"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.format_string("HTTP_ERROR at event %d", F.col("event_id"))).alias("error"),
    )
    return B.number_attempts(a)


def q_attempt_outcomes(spark, sf):
    return B.attempt_outcomes(_attempts(_t(spark, sf, "events")), max_retries=3)


def q_attempt_timeouts(spark, sf):
    ev = _t(spark, sf, "events")
    starts = ev.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("start_id"), F.col("user_id").alias("item_id"), "ts")
    changes = ev.filter(F.col("event_type").isin("view", "purchase")).select(
        F.col("event_id").alias("change_id"), F.col("user_id").alias("item_id"), "ts",
        F.when(F.col("event_type") == "view", F.lit("complete")).otherwise(F.lit("interrupted")).alias("state"))
    return B.resolve_attempts(starts, changes, limit_s=1800).select("start_id", "change_id", "ok")


def _batch_items(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = ev.filter((F.dayofmonth("ts") <= 2) & (F.col("event_type") == "purchase")).select(
        F.col("user_id").cast("string").alias("tender_id")).distinct().withColumn("_h", F.lit(True))
    it = ev.withColumn("tender_id", F.col("user_id").cast("string"))
    it = it.join(h, "tender_id", "left")
    it = it.select(
        "event_id", F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("batch_id"), F.col("ts").alias("started_at"),
        F.when(F.col("_h"), F.lit("skipped")).when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("success")).alias("outcome"),
        (F.floor("value").cast("long") % 4).alias("n_img"), "event_type",
    )
    im = it.filter((F.col("n_img") > 0) & (F.col("outcome") == "success")).select(
        "batch_id", F.col("event_id").cast("string").alias("tender_id"), "event_type",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_img"))).alias("image_no"),
    ).withColumn("ok", ~((F.col("event_type") == "click") & (F.col("image_no") == 1)))
    return it, im


def q_batch_summary(spark, sf):
    it, im = _batch_items(_t(spark, sf, "events"))
    # created a minute before the first start, completed 30 s after the last; every 5th day has no creation time
    first, last = F.min("started_at").cast("timestamp"), F.max("started_at").cast("timestamp")
    batches = it.groupBy("batch_id").agg(
        F.when(F.dayofmonth(first) % 5 != 0, first - F.expr("INTERVAL 60 SECONDS")).alias("created_at"), (last + F.expr("INTERVAL 30 SECONDS")).alias("completed_at"))
    return B.completion_summary(it, im, batches=batches)


def q_image_outcomes(spark, sf):
    _, im = _batch_items(_t(spark, sf, "events"))
    return B.image_outcomes(im)


def q_batch_progress(spark, sf):
    ev = _t(spark, sf, "events")
    it = ev.select(
        F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("batch_id"), (F.hour("ts") < 12).alias("processed"))
    return B.batch_progress(it)


def _state_rows(ev: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return ev.select(
        "event_id",
        F.when(e % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("b"), u.cast("string"))).alias("batch_id"),
        F.when(e % 9 == 0, F.lit(None).cast("long")).otherwise(e % 7 - 1).alias("page_number"),
        F.lit(None).cast("string").alias("page_url"),
        (e % 5 - 1).alias("current_index"),
        (u % 50).alias("total_tenders"),
        (e % 11 - 2).alias("processed_count"),
        (e % 3).alias("success_count"),
        (u % 4 - 1).alias("failed_count"),
        F.lit(0).cast("long").alias("skipped_count"),
        F.when(F.col("event_type") == "view", "Idle").when(F.col("event_type") == "click", "Processing")
        .when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "error", "Failed")
        .otherwise("Unknown").alias("batch_status"),
        F.when(e % 13 == 0, F.lit(None).cast("long")).otherwise(e % 4).alias("max_retries"),
        (F.floor(F.col("value") * 10).cast("long") - 100).alias("base_delay_ms"),
    )


def q_batch_state_checks(spark, sf):
    c = B.check_batch_states(_state_rows(_t(spark, sf, "events")))
    return c.select("event_id", F.size("errors").alias("n_errors"), F.array_join("errors", "|").alias("errors_text"), "valid")


def _state_json(ev: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    m = e % 6
    raw = (
        F.when(m == 0, F.format_string(
            '{"batchId":"b%d","pageNumber":%d,"currentTenderIndex":1,"tenders":[{},{}],"processedCount":%d,'
            '"successCount":2,"failedCount":0,"skippedCount":1,"batchStatus":"Processing",'
            '"retryConfig":{"maxRetries":3,"baseDelayMs":1500}}', u, e % 9 + 1, e % 5))
        .when(m == 1, F.lit("null"))
        .when(m == 2, F.lit("[1,2,3]"))
        .when(m == 3, F.format_string(
            '{"batchId":%d,"pageNumber":"3","currentTenderIndex":7.9,"tenders":[{},{}],"successCount":-2,'
            '"batchStatus":"Running","retryConfig":{"maxRetries":0,"baseDelayMs":-5}}', u))
        .when(m == 4, F.format_string(
            '{"batchId":"b%d","processedCount":3.7,"tenders":[1,2,3],"currentTenderIndex":2.5,'
            '"batchStatus":"Completed","totalTenders":-1}', u))
        .otherwise(F.lit("not json {"))
    )
    return ev.select("event_id", raw.alias("raw"))


def q_batch_state_recovery(spark, sf):
    r = B.recover_batch_states(_state_json(_t(spark, sf, "events")))
    return r.select("event_id", "batch_id", "page_number", "current_index", "total_tenders", "processed_count",
                    "success_count", "failed_count", "skipped_count", "batch_status", "max_retries", "base_delay_ms")


def q_stream_history(spark, sf):
    from ..streaming.stream import stream_history_from_events

    return stream_history_from_events(spark, _t(spark, sf, "events"))


def q_stream_progress(spark, sf):
    from ..streaming.stream import stream_progress_from_events

    return stream_progress_from_events(spark, _t(spark, sf, "events"))


def q_stream_details(spark, sf):
    """STR-1 + STR-6: pages as a file stream through the extraction, outputs committed by micro-batch."""
    from ..streaming.stream import stream_details_from_pages

    out = stream_details_from_pages(spark, _t(spark, sf, "pages"))
    return out.select("page_id", "title", "code")


def q_stream_first_completion(spark, sf):
    """STR-5: the streaming form of attempt_timeouts: chained interval join and first completion per start."""
    from ..streaming.stream import first_completions_from_events

    return first_completions_from_events(spark, _t(spark, sf, "events"), 1800)


def _raw_listing(spark, sf) -> DataFrame:
    """Raw listing rows from orders, every 9th with an invalid link and every 13th without a title."""
    f = synth.order_facts(spark, sf)
    k = F.col("k")
    return f.select(
        (k / synth.LISTING_PAGE_SIZE).cast("long").alias("page_id"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("title")).alias("original_listing_title"),
        F.when(k % 9 == 0, F.format_string(f"https://{HOST}/item-%d.html", k))
        .otherwise(F.format_string(f"https://{HOST}/item_tenders-%d.html", k)).alias("detail_url"),
    )


def q_normalization_report(spark, sf):
    """AGG-5 + FLT-16 + AGG-4: per listing page counts and readiness."""
    from ..operators.records import normalization_report, page_readiness

    configure(spark)
    rep = normalization_report(_raw_listing(spark, sf))
    info = rep.withColumn("tender_count", F.col("valid_count")).withColumn(
        "warnings", F.when(F.col("valid_count") == 0, F.array(F.lit(P.WARN_NO_ROWS))).otherwise(F.array().cast("array<string>")))
    return page_readiness(info).select("page_id", "raw_count", "valid_count", "invalid_count", "has_fatal", "ready")


def _resume_items(ev: DataFrame) -> DataFrame:
    st = (
        F.when(F.col("event_type") == "view", F.lit(P.STATUS_DOWNLOADED))
        .when(F.col("event_type") == "error", F.lit(P.STATUS_PARSE_FAILED))
        .when(F.col("event_type") == "purchase", F.lit(P.STATUS_PARSED))
        .when(F.col("event_type") == "signup", F.lit(P.STATUS_DOWNLOAD_FAILED))
        .otherwise(F.lit(P.STATUS_PENDING))
    )
    return ev.select("event_id", F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("batch_id"),
                     F.col("event_id").alias("position"), st.alias("status"))


def q_plan_resume(spark, sf):
    """FLT-17: final items are passed over, parsed ones only need output."""
    return B.plan_resume(_resume_items(_t(spark, sf, "events"))).select("event_id", "status", "action")


def q_next_items(spark, sf):
    """SRT-3: per batch, the 5 lowest positions still to do (a top-k report)."""
    return B.next_items(_resume_items(_t(spark, sf, "events")), 5).select("batch_id", "position", "status")


QUERIES = {
    "page_summary": q_page_summary,
    "page_titles": q_page_titles,
    "page_links": q_page_links,
    "main_content_stats": q_main_content_stats,
    "url_canonical": q_url_canonical,
    "url_dedup": q_url_dedup,
    "capture_gate": q_capture_gate,
    "detail_ids": q_detail_ids,
    "metadata_roundtrip": q_metadata_roundtrip,
    "descriptions": q_descriptions,
    "images": q_images,
    "listing_rows": q_listing_rows,
    "listing_pages": q_listing_pages,
    "merged_records": q_merged_records,
    "documents_txt": q_documents_txt,
    "document_files": q_document_files,
    "pipeline_documents": q_pipeline_documents,
    "page_outcomes": q_page_outcomes,
    "folder_names": q_folder_names,
    "history_skip": q_history_skip,
    "in_batch_repeats": q_in_batch_repeats,
    "page_done": q_page_done,
    "attempt_outcomes": q_attempt_outcomes,
    "attempt_timeouts": q_attempt_timeouts,
    "batch_summary": q_batch_summary,
    "image_outcomes": q_image_outcomes,
    "batch_progress": q_batch_progress,
    "batch_state_checks": q_batch_state_checks,
    "batch_state_recovery": q_batch_state_recovery,
    "normalization_report": q_normalization_report,
    "plan_resume": q_plan_resume,
    "next_items": q_next_items,
    "stream_history": q_stream_history,
    "stream_progress": q_stream_progress,
    "stream_details": q_stream_details,
    "stream_first_completion": q_stream_first_completion,
}
