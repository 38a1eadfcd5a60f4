"""Batch bookkeeping as relational operators.

History skip (JN-5, SET-3, WIN-7), attempts (WIN-8, AGG-13, JN-9, FLT-14,
SC-17), resume planning (FLT-17), summaries (AGG-1/2/3/6) and batch-state
validation and recovery (FLT-15, SC-21).  Items are processed in parallel;
the only visible sequential effect of the one-at-a-time original, an id
repeated inside one batch, is reproduced with an ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.naming import pct
from ..functions.urls import retryable


# --- history ---------------------------------------------------------------
def split_by_history(items: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-5: (todo, skipped).  NULL ids never match, so they are always to do.

    The history side is only the distinct id column; Spark broadcasts it
    when its size is under the broadcast threshold and shuffles by id
    otherwise.  A skipped item gets status 'Parsed - Download Pending'.
    """
    h = history.select("tender_id").distinct()
    todo = items.join(h, "tender_id", "left_anti")
    skipped = items.join(h, "tender_id", "left_semi").withColumn("status", F.lit(P.STATUS_PARSED))
    return todo, skipped


def mark_in_batch_repeats(items: DataFrame, batch_col: str = "batch_id", pos_col: str = "position",
                          ok_col: str = "success") -> DataFrame:
    """WIN-7: a later occurrence of an id in the same batch is skipped when an earlier one succeeded.

    Written as "position after the first successful position of the same
    id": a partial aggregate (``min``) per (batch, id) and a join back, so
    an id repeated millions of times is combined map-side instead of being
    sorted in one task.
    """
    first_ok = (
        items.filter(F.col(ok_col) & F.col("tender_id").isNotNull())
        .groupBy(batch_col, "tender_id")
        .agg(F.min(pos_col).alias("_first_ok"))
    )
    return (
        items.join(first_ok, [batch_col, "tender_id"], "left")
        .withColumn("repeat_skipped", F.coalesce(F.col(pos_col) > F.col("_first_ok"), F.lit(False)))
        .drop("_first_ok")
    )


def page_done(records: DataFrame, history: DataFrame, page_col: str = "page_id") -> DataFrame:
    """AGG-6: a page is done when it has an id and every non-null id is in the history."""
    h = history.select("tender_id").distinct().withColumn("_seen", F.lit(True))
    j = records.select(page_col, "tender_id").join(h, "tender_id", "left")
    valid = F.col("tender_id").isNotNull()
    return j.groupBy(page_col).agg(
        F.count_if(valid).alias("n_valid"),
        F.coalesce(F.bool_and(F.when(valid, F.coalesce(F.col("_seen"), F.lit(False)))), F.lit(False)).alias("_all"),
    ).select(page_col, "n_valid", ((F.col("n_valid") > 0) & F.col("_all")).alias("done"))


# --- attempts ----------------------------------------------------------------
def number_attempts(attempts: DataFrame, item_col: str = "item_id", prior_col: str | None = None) -> DataFrame:
    """WIN-8: attempt number per item in start order, continuing after ``prior_col`` earlier tries."""
    w = Window.partitionBy(item_col).orderBy("started_at", "attempt_key")
    n = F.row_number().over(w)
    if prior_col:
        n = n + F.coalesce(F.col(prior_col), F.lit(0))
    return attempts.withColumn("attempt_no", n.cast("int"))


def attempt_outcomes(attempts: DataFrame, max_retries: int = P.RETRY_MAX_DEFAULT, kind: str = "page",
                     item_col: str = "item_id", prior: int = 0) -> DataFrame:
    """AGG-13: final state per item from its numbered attempts.

    Tries allowed: ``max_retries`` in total for pages, ``max_retries + 1``
    for images, and at least one more than ``prior``.  Success iff some
    allowed try succeeded; attempts used = first success or the last
    allowed try seen; the failure reason is that try's error.
    Attempts are cut to the allowed number per item before the group-by
    (``row_number() <= k`` runs as a partial per-partition limit), so a hot
    item never moves more than k rows.
    """
    limit = max(max_retries + (1 if kind == "image" else 0), prior + 1)
    w = Window.partitionBy(item_col).orderBy("attempt_no")
    allowed = attempts.filter(F.col("attempt_no") <= limit)
    first_ok = allowed.filter("ok").groupBy(item_col).agg(F.min("attempt_no").alias("_ok_no"))
    agg = allowed.groupBy(item_col).agg(
        F.max("attempt_no").alias("_last"),
        F.max_by("error", "attempt_no").alias("_last_err"),
    )
    j = agg.join(first_ok, item_col, "left")
    ok = F.col("_ok_no").isNotNull()
    return j.select(
        item_col,
        ok.alias("success"),
        F.when(ok, F.lit(P.STATUS_PARSED)).otherwise(F.lit(P.STATUS_PARSE_FAILED)).alias("status"),
        F.when(ok, F.col("_ok_no")).otherwise(F.col("_last")).cast("int").alias("fetch_attempts"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.coalesce("_last_err", F.lit("Unknown error"))).alias("failure_reason"),
    )


def invalid_url_failures(items: DataFrame, url_col: str = "detail_url", prior_col: str = "fetch_attempts") -> DataFrame:
    """FLT-14: items whose URL can never be fetched fail at once, without a try."""
    return items.filter(~retryable(F.col(url_col))).select(
        "*",
        F.lit(P.STATUS_PARSE_FAILED).alias("status"),
        F.concat(F.lit("Invalid tender URL: "), F.coalesce(F.col(url_col).cast("string"), F.lit("undefined"))).alias("failure_reason_new"),
    )


def backoff_schedule(attempts: DataFrame, base_ms: int = P.RETRY_BASE_DELAY_MS, jitter_col: str | None = None) -> DataFrame:
    """SC-17: delay before the next try and its due time."""
    from ..functions.naming import backoff_ms

    j = F.col(jitter_col) if jitter_col else None
    d = backoff_ms(F.lit(float(base_ms)), F.col("attempt_no"), j)
    return attempts.withColumn("delay_ms", d.cast("long")).withColumn(
        "retry_at", F.col("started_at") + F.make_dt_interval(secs=d / 1000.0)
    )


def resolve_attempts(starts: DataFrame, changes: DataFrame, limit_s: int = P.IMAGE_WAIT_MS // 1000,
                     key: str = "item_id") -> DataFrame:
    """JN-9: pair each start with the first completion event of the same item within ``limit_s`` seconds.

    The range condition is turned into an equi-join on ``(key, time
    bucket)``: each change is tried against its own and the previous bucket
    of ``limit_s`` seconds, so a hot item is spread over its time buckets
    instead of comparing all its starts with all its changes.
    ok = the first change in time has state 'complete'; later ones are ignored.
    """
    b = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (limit_s * 1_000_000))
    s = starts.select(key, F.col("start_id"), F.col("ts").alias("s_ts"), b.alias("_b"))
    c = changes.select(key, "change_id", F.col("ts").alias("c_ts"), "state", F.explode(F.array(b, b - 1)).alias("_b"))
    j = s.join(c, [key, "_b"]).filter(
        (F.col("c_ts") >= F.col("s_ts")) & (F.col("c_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {limit_s} SECONDS"))
    )
    first = j.groupBy("start_id").agg(F.min_by(F.struct("change_id", "state"), F.struct("c_ts", "change_id")).alias("f"))
    return starts.join(first, "start_id", "left").select(
        *starts.columns,
        F.col("f.change_id").alias("change_id"),
        F.coalesce(F.col("f.state") == "complete", F.lit(False)).alias("ok"),
    )


# --- resume ------------------------------------------------------------------
def plan_resume(items: DataFrame, status_col: str = "status") -> DataFrame:
    """FLT-17: final items are passed over; parsed items only need the output step."""
    s = F.col(status_col)
    return items.withColumn(
        "action",
        F.when(s.isin(*P.FINAL_STATUSES), F.lit("skip")).when(s == P.STATUS_PARSED, F.lit("output")).otherwise(F.lit("process")),
    )


def next_items(items: DataFrame, n: int, batch_col: str = "batch_id", pos_col: str = "position") -> DataFrame:
    """SRT-3: per batch, the n lowest positions not yet final."""
    w = Window.partitionBy(batch_col).orderBy(pos_col)
    return (
        items.filter(~F.col("status").isin(*P.FINAL_STATUSES))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


# --- summaries -----------------------------------------------------------------
def completion_summary(items: DataFrame, images: DataFrame | None = None, batch_col: str = "batch_id",
                       batches: DataFrame | None = None) -> DataFrame:
    """AGG-1: total, success, failed, skipped, duration and image counts per batch.

    ``items``: batch_col, outcome ('success'|'failed'|'skipped'), started_at;
    ``images``: batch_col, ok; ``batches``: batch_col, created_at, completed_at, one row a batch.  The duration is completion
    minus creation, 0 for a batch without both; without ``batches`` it is estimated by the first and last start.
    Partial aggregation runs before the shuffle.
    """
    if batches is not None:
        spent = F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp"))
        spans = batches.groupBy(batch_col).agg(F.max(spent).alias("_spent"))
        out = completion_summary(items, images, batch_col)
        return out.join(spans, batch_col, "left").select(
            *[F.coalesce("_spent", F.lit(0)).cast("long").alias(c) if c == "duration_ms" else F.col(c) for c in out.columns])

    it = items.groupBy(batch_col).agg(
        F.count("*").alias("total_tenders"),
        F.count_if(F.col("outcome") == "success").alias("success_count"),
        F.count_if(F.col("outcome") == "failed").alias("failed_count"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_count"),
        F.coalesce(
            (F.unix_micros(F.max("started_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 1000,
            F.lit(0),
        ).cast("long").alias("duration_ms"),
    )
    if images is None:
        return it.select("*", F.lit(0).cast("long").alias("image_total"), F.lit(0).cast("long").alias("image_downloaded"),
                         F.lit(0).cast("long").alias("image_failed"))
    im = images.groupBy(batch_col).agg(
        F.count("*").alias("image_total"), F.count_if("ok").alias("image_downloaded"), F.count_if(~F.col("ok")).alias("image_failed")
    )
    return it.join(im, batch_col, "left").select(
        batch_col, "total_tenders", "success_count", "failed_count", "skipped_count", "duration_ms",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("image_total", "image_downloaded", "image_failed")],
    )


def batch_progress(items: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """AGG-2: processed, remaining = max(total - processed, 0), rounded percent."""
    g = items.groupBy(batch_col).agg(F.count("*").alias("total"), F.count_if("processed").alias("processed"))
    return g.select(
        batch_col, "total", "processed",
        F.greatest(F.col("total") - F.col("processed"), F.lit(0)).alias("remaining"),
        pct(F.col("processed"), F.col("total")).alias("percent"),
    )


def image_outcomes(images: DataFrame, key_cols=("batch_id", "tender_id")) -> DataFrame:
    """AGG-3: per item: Succeeded iff no image failed; reason text otherwise."""
    g = images.groupBy(*key_cols).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok_n"))
    failed = F.col("n") - F.col("ok_n")
    return g.select(
        *key_cols, "n", F.col("ok_n").alias("succeeded"), failed.alias("failed"),
        F.when(failed == 0, F.lit(P.IMAGE_SUCCEEDED)).otherwise(F.lit(P.IMAGE_FAILED)).alias("image_download_status"),
        F.when(failed == 0, F.lit(None).cast("string"))
        .when(F.col("ok_n") > 0, F.format_string("%d of %d images failed", failed, F.col("n")))
        .otherwise(F.format_string("All %d images failed", F.col("n")))
        .alias("failure_reason"),
    )


# --- batch states -------------------------------------------------------------
def check_batch_states(df: DataFrame) -> DataFrame:
    """FLT-15: ``errors`` (array of messages, rule order) and ``valid`` per batch-state row.

    Expects typed columns: batch_id, page_number, page_url, created_at,
    updated_at, current_index, total_tenders, processed_count,
    success_count, failed_count, skipped_count, batch_status, max_retries,
    base_delay_ms (NULL = absent where the rule allows it).
    """
    def nonneg(c: str, msg: str) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(msg))

    rules = [
        F.when(F.col("page_number").isNotNull() & (F.col("page_number") < 1), F.lit("pageNumber must be a positive integer or null.")),
        nonneg("current_index", "currentTenderIndex must be a non-negative integer."),
        nonneg("total_tenders", "totalTenders must be a non-negative integer."),
        nonneg("processed_count", "processedCount must be a non-negative integer."),
        nonneg("success_count", "successCount must be a non-negative integer."),
        nonneg("failed_count", "failedCount must be a non-negative integer."),
        nonneg("skipped_count", "skippedCount must be a non-negative integer."),
        F.when(~F.coalesce(F.col("batch_status").isin(*P.BATCH_STATUSES), F.lit(False)),
               F.lit("batchStatus must be one of: Idle, Processing, Completed, Failed.")),
        F.when(F.col("max_retries").isNotNull() & (F.col("max_retries") < 1), F.lit("retryConfig.maxRetries must be a positive integer.")),
        F.when(F.col("base_delay_ms").isNotNull() & (F.col("base_delay_ms") < 0), F.lit("retryConfig.baseDelayMs must be a non-negative integer.")),
    ]
    errs = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.withColumn("errors", errs).withColumn("valid", F.size("errors") == 0)


# The rules for a stored state as data: (path, what it must be, message).  Fixed values, in the order they are reported.
STATE_RULES: list[tuple[str, str, str]] = [
    ("batchId", "string?", "batchId must be a string or null."),
    ("pageNumber", "positive?", "pageNumber must be a positive integer or null."),
    ("pageUrl", "string?", "pageUrl must be a string or null."),
    ("createdAt", "string?", "createdAt must be a string or null."),
    ("updatedAt", "string?", "updatedAt must be a string or null."),
    ("currentTenderIndex", "count", "currentTenderIndex must be a non-negative integer."),
    ("totalTenders", "count", "totalTenders must be a non-negative integer."),
    ("processedCount", "count", "processedCount must be a non-negative integer."),
    ("successCount", "count", "successCount must be a non-negative integer."),
    ("failedCount", "count", "failedCount must be a non-negative integer."),
    ("skippedCount", "count", "skippedCount must be a non-negative integer."),
    ("batchStatus", "status", "batchStatus must be one of: Idle, Processing, Completed, Failed."),
    ("tenders", "array", "tenders must be an array."),
    ("retryConfig.maxRetries", "positive-if-there", "retryConfig.maxRetries must be a positive integer."),
    ("retryConfig.baseDelayMs", "count-if-there", "retryConfig.baseDelayMs must be a non-negative integer."),
    ("retryConfig", "object-if-there", "retryConfig must be an object or null."),
    ("completionSummary", "object?", "completionSummary must be an object or null."),
]
NOT_AN_OBJECT = "State must be an object."


def _fields(df: DataFrame, raw_col: str, paths: list[str]) -> DataFrame:
    """Add ``_root`` and ``_f``: the JSON text of the document and of each path, read once; null where there is none.

    The text tells the kind: it starts with a quote, a bracket, a brace, a digit or a sign, or is true, false, null.
    """
    df = df.withColumn("_json", F.try_parse_json(F.col(raw_col)))
    text = lambda p: F.to_json(F.try_variant_get("_json", p, "variant")).alias(p.replace("$.", "").replace(".", "__") or "root")
    return df.withColumn("_f", F.struct(F.to_json("_json").alias("root"), *[text(f"$.{p}") for p in paths])).drop("_json")


def _field(path: str) -> Column:
    return F.col("_f")[path.replace(".", "__")]


def _is_number(t: Column) -> Column:
    return t.rlike("^[-0-9]")


def check_raw_states(df: DataFrame, raw_col: str = "raw", observe: str | None = None) -> DataFrame:
    """FLT-15 on stored JSON: ``errors`` (messages in the order of STATE_RULES) and ``valid`` per row.

    Missing fields are errors where a value must be there, as are values of another kind.  With ``observe`` the number
    of rows, of invalid ones and of each rule's failures are reported as metrics of that name by the same pass.
    """
    df = _fields(df, raw_col, [p for p, _, _ in STATE_RULES])

    def broken(path: str, kind: str) -> Column:
        t = _field(path)
        absent, null, n = t.isNull(), t == "null", t.cast("double")
        statuses = [f'"{s}"' for s in P.BATCH_STATUSES]
        scalar = ~F.coalesce(_field("retryConfig").rlike("^[\\[{]"), F.lit(False))
        rules = {
            "string?": absent | ~(null | t.startswith('"')),
            "positive?": absent | ~(null | (_is_number(t) & (n >= 1))),
            "count": absent | ~(_is_number(t) & (n >= 0)),
            "status": absent | ~t.isin(*statuses),
            "array": absent | ~t.startswith("["),
            "object?": absent | ~(null | t.rlike("^[\\[{]")),
            "positive-if-there": ~scalar & t.isNotNull() & ~(_is_number(t) & (n >= 1)),
            "count-if-there": ~scalar & t.isNotNull() & ~(_is_number(t) & (n >= 0)),
            "object-if-there": scalar & t.isNotNull() & ~null,
        }
        return F.coalesce(rules[kind], F.lit(False))

    root = F.col("_f.root")
    is_obj = F.coalesce(root.startswith("{"), F.lit(False))
    is_list = F.coalesce(root.startswith("["), F.lit(False))  # a list is an object without any of the fields
    found = [F.when(broken(path, kind), F.lit(message)) for path, kind, message in STATE_RULES]
    errs = F.when(is_obj | is_list, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(F.array(F.lit(NOT_AN_OBJECT)))
    out = df.withColumn("errors", errs).drop("_f").withColumn("valid", F.size("errors") == 0)
    if observe:
        counts = [F.count_if(F.array_contains("errors", m)).alias(f"rule_{i}") for i, (_, _, m) in enumerate(STATE_RULES, start=1)]
        out = out.observe(observe, F.count("*").alias("rows"), F.count_if(~F.col("valid")).alias("invalid"), *counts)
    return out


def recover_batch_states(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """SC-21: lenient recovery of stored batch states from JSON text.

    Every field falls back to its default on its own; decimals are truncated; the item count comes from the
    ``tenders`` array and is overridden by a valid ``totalTenders``; an index past the item count becomes 0.  A number
    beyond 64 bits counts as no number.  Never fails on bad input.  Each field is read from the document once.
    """
    counts = ["totalTenders", "currentTenderIndex", "processedCount", "successCount", "failedCount", "skippedCount"]
    summary = ["totalTenders", "successCount", "failedCount", "skippedCount", "durationMs"]
    paths = ["batchId", "pageNumber", "pageUrl", "createdAt", "updatedAt", "batchStatus", "tenders", *counts, "retryConfig.maxRetries",
             "retryConfig.baseDelayMs", "completionSummary", "completionSummary.completedAt", *[f"completionSummary.{c}" for c in summary]]
    keep = df.columns
    df = _fields(df, raw_col, paths)
    is_obj = F.coalesce(F.col("_f.root").startswith("{"), F.lit(False))

    def number(path: str, least: int | None = 0) -> Column:
        """The number at ``path``, truncated; null if it is none, too small or too large."""
        t = _field(path)
        n = F.when(is_obj & _is_number(t), t.try_cast("double"))
        n = n if least is None else F.when(n >= least, n)
        return F.when(F.abs(n) < 2.0**63, n.cast("bigint"))

    def string(path: str) -> Column:
        t = _field(path)
        return F.when(is_obj & t.startswith('"'), F.try_variant_get(F.try_parse_json(t), "$", "string"))

    items = F.when(is_obj & _field("tenders").startswith("["), F.json_array_length(_field("tenders")))
    status = string("batchStatus")
    page = number("pageNumber", None)
    raw_page = F.when(is_obj & _is_number(_field("pageNumber")), _field("pageNumber").try_cast("double"))
    index = F.coalesce(number("currentTenderIndex"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    done = F.struct(string("completionSummary.completedAt").alias("completed_at"), *[
        F.coalesce(number(f"completionSummary.{c}", None), zero).alias(name)
        for c, name in zip(summary, ["total_tenders", "success_count", "failed_count", "skipped_count", "duration_ms"], strict=True)])
    return df.select(
        *keep,
        string("batchId").alias("batch_id"),
        F.when(raw_page > 0, page).alias("page_number"),
        string("pageUrl").alias("page_url"),
        F.when(index > F.coalesce(items, F.lit(0)), zero).otherwise(index).alias("current_index"),
        F.coalesce(number("totalTenders"), items.cast("long"), zero).alias("total_tenders"),
        *[F.coalesce(number(c), zero).alias(name) for c, name in (
            ("processedCount", "processed_count"), ("successCount", "success_count"), ("failedCount", "failed_count"), ("skippedCount", "skipped_count"))],
        F.when(status.isin(*P.BATCH_STATUSES), status).otherwise(F.lit("Idle")).alias("batch_status"),
        F.coalesce(number("retryConfig.maxRetries", 1), F.lit(P.RETRY_MAX_DEFAULT).cast("long")).alias("max_retries"),
        F.coalesce(number("retryConfig.baseDelayMs"), F.lit(P.RETRY_BASE_DELAY_MS).cast("long")).alias("base_delay_ms"),
        string("createdAt").alias("created_at"), string("updatedAt").alias("updated_at"),
        F.when(is_obj & _field("completionSummary").rlike("^[\\[{]"), done).alias("completion_summary"),
    )
