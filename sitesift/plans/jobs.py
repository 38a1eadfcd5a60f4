"""End-to-end jobs composed of the operators (what a user runs on a table of captures)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.text import VISIBLE
from ..functions.naming import status_code
from ..functions.urls import normalize_url, redirect_ok, validate_detail_url
from ..operators.detail import main_content, marked_nodes, page_details, page_title, parse_details, split_shared
from ..operators.listing import extract_listings
from ..operators.records import capture_as_of, merge_listing_detail
from ..operators.tree import inside, is_element, page_texts, subtree_stats, text_at, with_running_counts
from ..session import configure, materialize
from ..sources.html_nodes import CODE_FAILED, CODE_INVALID, explode_nodes


def gate_captures(captures: DataFrame, expected_id_col: str = "expected_id",
                  profile: P.SiteProfile = P.DEFAULT_PROFILE) -> DataFrame:
    """FLT-3 + JN-7: first failing rule wins; adds ``outcome_code`` and ``message``.

    The order of the rules: the URL is a detail URL (where there is a ``url`` column), the status, the body, the
    redirect, the content type, block phrases in the first ``profile.block_scan_chars`` characters.  Without the
    column ``expected_id_col`` the id expected after redirects is that of the URL.  Runs before any HTML parsing, so
    rejected captures never reach the Python step.  The message table has a fixed size (12 codes): broadcast.
    """
    html = F.col("html")
    added = []
    if "url" in captures.columns:
        captures, added = captures.withColumn("_url", validate_detail_url(F.col("url"), profile)), ["_url"]
    if expected_id_col not in captures.columns:
        captures = captures.withColumn(expected_id_col, F.col("_url.tender_id") if added else F.lit(None).cast("string"))
    start = F.substring(html, 1, profile.block_scan_chars) if profile.block_scan_chars else html
    blocked = F.lower(start).rlike("|".join(re.escape(ph) for ph in P.BLOCK_PHRASES))
    ctype = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    html_type = ctype.startswith(P.HTML_CONTENT_TYPES[0]) | ctype.startswith(P.HTML_CONTENT_TYPES[1])
    st = F.col("status")
    bad_url = ~F.coalesce(F.col("_url.valid"), F.lit(False)) if added else F.lit(False)
    code = (
        F.when(bad_url, F.lit("INVALID_TENDER_URL"))
        .when(~F.coalesce(st.between(200, 299), F.lit(False)), status_code(st))
        .when(html.isNull() | ~html.rlike(VISIBLE), F.lit("EMPTY_HTML"))
        .when(~redirect_ok(F.col("final_url"), F.col(expected_id_col), profile), F.lit("UNEXPECTED_REDIRECT"))
        .when(~html_type, F.lit("UNEXPECTED_CONTENT_TYPE"))
        .when(blocked, F.lit("ACCESS_RESTRICTED"))
        .otherwise(F.lit("OK"))
    )
    spark = captures.sparkSession
    msgs = spark.createDataFrame(P.ERROR_MESSAGES, "code string, message string")
    g = captures.withColumn("outcome_code", code).drop(*added)
    return g.join(F.broadcast(msgs), g.outcome_code == msgs.code, "left").drop("code")


def page_summary(pages: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE) -> DataFrame:
    """Flagship: (page_id, canonical_url, title, main_tag, n_links, code) for every page.

    pages -> nodes -> boilerplate strip -> main content -> title; links are
    the anchors with an href in the whole page.  A page that could not be parsed has its code, no title and no tag.
    """
    configure(pages.sparkSession)
    marked = materialize(marked_nodes(explode_nodes(pages)), "marked")
    main = main_content(marked, marked)
    at = F.struct("node_id", "t0", "t1")
    here = F.struct(F.col("main_id").alias("node_id"), F.col("main_end").alias("end_id"))
    alive = is_element() & ~F.col("removed")
    page = marked.join(main, "page_id", "left").groupBy("page_id").agg(
        page_texts(~F.col("removed")).alias("texts"),
        F.min(F.when(alive & (F.col("tag") == "h1") & inside(F.col("node_id"), here), at)).alias("h1_at"),
        F.min(F.when(alive & (F.col("tag") == "title"), at)).alias("title_at"),
        F.max(F.when(F.col("node_id") == F.col("main_id"), F.col("tag"))).alias("main_tag"),
        F.count_if((F.col("tag") == "a") & F.col("href").isNotNull()).alias("n_links"),
        F.max(F.when(F.col("kind") == "page", F.col("tag"))).alias("code"),
    )
    text = lambda c: text_at(F.col("texts"), F.col(f"{c}.t0"), F.col(f"{c}.t1"))
    page = page.withColumns({"h1": text("h1_at"), "head_title": text("title_at")})
    failed = F.col("code").isin(CODE_INVALID, CODE_FAILED)
    return pages.select("page_id", normalize_url(F.col("url")).alias("canonical_url")).join(page, "page_id", "left").select(
        "page_id", "canonical_url", F.when(~failed, page_title(profile)).alias("title"), "main_tag", "n_links", "code")


def page_titles(pages: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE) -> DataFrame:
    return page_summary(pages, profile).select("page_id", "title", "code")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, href): anchors with an href in document order."""
    configure(pages.sparkSession)
    nodes = explode_nodes(pages)
    a = nodes.filter((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
    w = Window.partitionBy("page_id").orderBy("node_id")
    return a.select("page_id", F.row_number().over(w).alias("link_no"), F.col("attrs").getItem("href").alias("href"))


def parse_outcomes(pages: DataFrame) -> DataFrame:
    """(page_id, code, why, n_elements, n_text): one row per capture, whatever became of its parse."""
    configure(pages.sparkSession)
    nodes = explode_nodes(pages)
    counts = nodes.groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "page", F.struct(F.col("tag").alias("code"), F.col("text").alias("why")))).alias("x"),
        F.count_if(is_element() & (F.col("node_id") > 0)).alias("n_elements"), F.count_if(F.col("kind") == "text").alias("n_text"),
    )
    return counts.select("page_id", "x.code", "x.why", "n_elements", "n_text")


def main_content_stats(pages: DataFrame) -> DataFrame:
    """EXT-7 + AGG-7: main container per page with its descendant and text size."""
    configure(pages.sparkSession)
    marked = materialize(marked_nodes(explode_nodes(pages)), "marked")
    main = main_content(marked, marked)
    counted = with_running_counts(marked.filter("kind <> 'page'"), ~F.col("removed"))
    cand = counted.join(main.select("page_id", F.col("main_id").alias("node_id"), "main_source"), ["page_id", "node_id"])
    st = subtree_stats(cand, counted)
    return st.select("page_id", F.col("tag").alias("main_tag"), "main_source", "n_desc")


def details_job(captures: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE,
                listing_title: str | None = None, spread: bool = True) -> DataFrame:
    """EXT-17: gate-free detail extraction of captures (page_id, url, html); ``spread``: see ``page_details``.

    Captures that share a page_id, or have none, are one page's nodes: they take the plan of ``parse_details``.
    """
    configure(captures.sparkSession)
    own, shared = split_shared(captures.select("page_id", "url", *([listing_title] if listing_title else []), "html"))
    out = page_details(own, profile, listing_title, spread)
    if shared is None:
        return out
    return out.unionByName(parse_details(explode_nodes(shared.select("page_id", "html")), shared.drop("html"), profile, listing_title))


def listings_job(captures: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE) -> tuple[DataFrame, DataFrame]:
    """EXT-5 on listing captures (page_id, url, html)."""
    configure(captures.sparkSession)
    nodes = explode_nodes(captures.select("page_id", "html"))
    return extract_listings(nodes, captures.select("page_id", "url"), profile)


def process_captures(records: DataFrame, captures: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE, at: str = "as_of", spread: bool = True) -> DataFrame:
    """The page pipeline: gate -> parse -> details -> merge as of a time, one row per record of ``to_records``.

    ``records`` also carry ``at``; ``captures``: page_id (one a capture), url, final_url, status, content_type, html,
    captured_at.  A record takes the newest capture of its URL's id not after ``at``: merged if it passed the gate and
    parsed, else 'Parse Failed' with the outcome's message as the reason and one attempt; without a capture it stays
    pending.  Adds ``outcome_code`` (null: no capture).  Rejected captures are never parsed.  ``spread``: see ``page_details``.

    What became of each capture is written once, as a table bucketed by ``tender_id``; all later steps read it.
    """
    configure(captures.sparkSession)
    own, shared = split_shared(captures)
    details = _capture_details(own, profile, spread)
    if shared is not None:
        details = details.unionByName(_shared_capture_details(shared, profile))
    details = materialize(details.filter("tender_id is not null"), "captures", "tender_id")
    # one outcome for each id and time: a good capture before a bad one of the same time
    rank = F.when(F.col("outcome_code") == "OK", 0).otherwise(1)
    outcome = F.struct(rank.alias("rank"), "page_id", "outcome_code", "reason")
    outcomes = details.groupBy("tender_id", "captured_at").agg(F.min(outcome).alias("o")).select("tender_id", "captured_at", "o.outcome_code", "o.reason")
    found = details.filter("outcome_code = 'OK'").withColumn("parser_tender_id", F.col("tender_id")).drop("page_id", "outcome_code", "reason")
    dated = capture_as_of(records, details, at).join(outcomes, ["tender_id", "captured_at"], "left")
    merged = merge_listing_detail(dated, found, on=["tender_id", "captured_at"])
    bad = F.coalesce(F.col("outcome_code") != "OK", F.lit(False))
    return merged.withColumns({
        "download_status": F.when(bad, F.lit(P.STATUS_PARSE_FAILED)).otherwise(F.col("download_status")),
        "failure_reason": F.when(bad, F.col("reason")).otherwise(F.col("failure_reason")),
        "fetch_attempts": F.when(bad, F.lit(1)).otherwise(F.col("fetch_attempts")),
    }).drop("reason")


CAPTURE_COLUMNS = ["page_id", "tender_id", "captured_at", "outcome_code", *P.METADATA_KEYS, "description", "image_urls", "details_text", "warnings", "reason"]


def _gated(captures: DataFrame, profile: P.SiteProfile) -> DataFrame:
    gated = gate_captures(captures, profile=profile).withColumnRenamed("outcome_code", "_gate").withColumnRenamed("message", "_said")
    return gated.withColumn("tender_id", validate_detail_url(F.col("url"), profile)["tender_id"])


def _outcome() -> dict:
    """The parse's outcome counts where the gate let the capture through."""
    passed = F.col("_gate") == "OK"
    return {"outcome_code": F.when(passed, F.col("code")).otherwise(F.col("_gate")), "reason": F.coalesce(F.when(passed, F.col("message")), "_said")}


def _capture_details(captures: DataFrame, profile: P.SiteProfile, spread: bool) -> DataFrame:
    """Gate and parse of captures that each have a page_id of their own, in one pass; rejected ones have no html to parse."""
    gated = _gated(captures, profile)
    html = F.when(F.col("_gate") == "OK", F.col("html"))
    good = gated.select("page_id", F.col("final_url").alias("url"), html.alias("html"), "tender_id", "captured_at", "_gate", "_said")
    return page_details(good, profile, spread=spread).withColumns(_outcome()).select(*CAPTURE_COLUMNS)


def _shared_capture_details(captures: DataFrame, profile: P.SiteProfile) -> DataFrame:
    """The same where captures share a page_id, or have none: what passed the gate under one id is one page's nodes."""
    gated = _gated(captures, profile)
    good = gated.filter("_gate = 'OK'").select("page_id", F.col("final_url").alias("url"), "html")
    parsed = parse_details(explode_nodes(good.select("page_id", "html")), good.select("page_id", "url"), profile)
    seen = gated.select("page_id", "tender_id", "captured_at", "_gate", "_said")
    return seen.join(parsed, "page_id", "left").withColumns(_outcome()).select(*CAPTURE_COLUMNS)
