"""DuckDB oracle SQL for the registered queries (same column names and types)."""

from __future__ import annotations

HOST = "www.tenders.example"
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CRLF = "chr(13) || chr(10)"


def trimjs(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def spaces(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[\\t\\n\\r]+', ' ', 'g'), '[ ]+', ' ', 'g')"


def norm_ws(x: str) -> str:
    return f"coalesce({trimjs(spaces(x))}, '')"


def norm_cell(x: str) -> str:
    return f"coalesce({trimjs(f'regexp_replace({spaces(x)}, {chr(39)}:+${chr(39)}, {chr(39)}{chr(39)})')}, '')"


def unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def truncate(t: str, n: int = 50000) -> str:
    cut = f"substr({t}, 1, {n})"
    ls = f"(length({cut}) - length(regexp_extract({cut}, ' [^ ]*$')))"
    return (
        f"CASE WHEN length({t}) <= {n} THEN {t} ELSE "
        f"{trimjs(f'CASE WHEN {ls} > {n - 100} THEN left({cut}, {ls}) ELSE {cut} END')}"
        f" || chr(10) || chr(10) || 'The description was truncated.' END"
    )


FACTS = f"""
  SELECT o.o_orderkey AS k, strftime(o.o_orderdate, '%d %b %Y') AS v_date_posted, o.o_orderpriority AS v_category,
         c.c_mktsegment AS v_subcategory, r.r_name AS v_province, n.n_name AS v_location, o.o_orderstatus AS v_sector,
         c.c_name AS v_newspaper, strftime(o.o_orderdate + INTERVAL 14 DAY, '%d %b %Y') AS v_last_date,
         'Supply of ' || o.o_orderpriority || ' goods for ' || c.c_name AS title
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

SITE_SUFFIX = r"(?i)\s*[|-]\s*(Tenders|Free Classifieds).*$"


def _title_sql() -> str:
    h1 = norm_cell(unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
    tt = norm_cell(unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
    return (
        f"CASE WHEN {trimjs(f'regexp_replace({h1}, {chr(39)}{SITE_SUFFIX}{chr(39)}, {chr(39)}{chr(39)})')} <> '' "
        f"THEN {trimjs(f'regexp_replace({h1}, {chr(39)}{SITE_SUFFIX}{chr(39)}, {chr(39)}{chr(39)})')} "
        f"ELSE {trimjs(f'regexp_replace({tt}, {chr(39)}{SITE_SUFFIX}{chr(39)}, {chr(39)}{chr(39)})')} END"
    )


def _canon_page(url: str) -> str:
    return f"'https://' || regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"


def safe_component(x: str) -> list[str]:
    """CTE-able chain: returns the SELECT expressions s1..s12 and the final expression name."""
    reserved = ", ".join(f"'{r}'" for r in [
        "CON", "PRN", "AUX", "NUL", "CLOCK$", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
        "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"])
    return [
        f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[\\t\\n\\r]+', ' ', 'g'), '[<>:\"/\\\\|?*]', '-', 'g') AS s1",
        "regexp_replace(regexp_replace(regexp_replace(s1, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ ]+', ' ', 'g'), '-+', '-', 'g') AS s2",
        f"replace(regexp_replace(regexp_replace({trimjs('s2')}, '[-.]+$', ''), '^-+', ''), '..', '.') AS s3",
        f"CASE WHEN upper(split_part(s3, '.', 1)) IN ({reserved}) THEN '_' || s3 ELSE s3 END AS s4",
        f"CASE WHEN length(s4) > 100 THEN regexp_replace(regexp_replace({trimjs('substr(s4, 1, 100)')}, '[-.]+$', ''), '^-+', '') ELSE s4 END AS s5",
        "CASE WHEN s3 = '' OR s3 = '.' OR regexp_replace(s3, '[- .]', '', 'g') = '' OR s5 = '' OR s5 = '.' "
        "THEN 'Unknown Tender' ELSE s5 END AS safe",
    ]


def clean_title(x: str) -> str:
    inner = norm_ws(f"regexp_replace({norm_ws(x)}, '(?i)^\\s*tender\\s+for\\s+the\\s*', '')")
    return f"CASE WHEN {inner} = '' THEN 'Unknown Tender' ELSE {inner} END"


def _chain(src: str, key_cols: str, x: str, steps: list[str]) -> str:
    """Nest the step expressions as successive sub-selects."""
    sql = f"SELECT {key_cols}, {x} AS s0 FROM ({src})"
    prev_cols = key_cols
    for st in steps:
        sql = f"SELECT *, {st} FROM ({sql})"
    return sql


HIST = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS tender_id FROM events WHERE day(ts) <= 15 AND event_type = 'purchase'"


def merged_base() -> str:
    title_raw = ("CASE WHEN k % 3 = 0 THEN 'Tender for the ' || title "
                 "WHEN k % 4 = 1 THEN title || ': lot ' || k ELSE title END")
    return f"""
      SELECT f.*, k // 30 AS page_id,
             CAST(row_number() OVER (PARTITION BY k // 30 ORDER BY k) AS INTEGER) AS listing_position,
             {title_raw} AS title_raw
      FROM ({FACTS}) f
    """


def merged_sql() -> str:
    steps = safe_component("ct")
    chain = f"SELECT *, {clean_title('title_raw')} AS ct FROM ({merged_base()}) WHERE k >= 1"
    for st in steps:
        chain = f"SELECT *, {st} FROM ({chain})"
    has = "(k % 7 <> 0)"
    return f"""
      SELECT CAST(k AS VARCHAR) AS tender_id, listing_position, ct AS title,
             lpad(CAST(listing_position AS VARCHAR), 3, '0') || '_' || safe AS folder_name,
             CASE WHEN {has} AND k % 5 <> 0 THEN v_category ELSE 'Not available' END AS category,
             CASE WHEN {has} THEN v_province ELSE 'Not available' END AS province,
             CASE WHEN {has} THEN v_location ELSE 'Not available' END AS location,
             CASE WHEN {has} AND k % 2 = 0 THEN 'Description of order ' || k ELSE 'Not available' END AS description,
             CASE WHEN {has} THEN 'Parsed - Download Pending' ELSE 'Pending' END AS download_status,
             CASE WHEN {has} THEN 1 ELSE 0 END AS fetch_attempts,
             CASE WHEN {has} AND k % 3 = 0 THEN 1 ELSE 0 END AS n_images,
             CASE WHEN {has} AND k % 11 = 0 THEN 'Parser-reported ID "' || (k + 1) || '" differs from URL-derived ID "' || k || '". Using URL-derived ID.' ELSE '' END AS warnings_text,
             {has} AS has_detail, k, page_id,
             v_date_posted, v_subcategory, v_sector, v_newspaper, v_last_date
      FROM ({chain})
    """


def documents_sql() -> str:
    def na(expr):
        return f"CASE WHEN {expr} IS NOT NULL AND {expr} <> 'Not available' THEN {expr} ELSE 'N/A' END"

    has = "has_detail"
    lines = [
        "'=== Tender Details ==='", "''",
        "'Tender ID: ' || tender_id",
        f"'Title: ' || {na('title')}",
        f"'Category: ' || {na('category')}",
        f"'Province: ' || {na('province')}",
        f"'Location: ' || {na('location')}",
        f"'Subcategory: ' || CASE WHEN {has} THEN v_subcategory ELSE 'N/A' END",
        f"'Sector: ' || CASE WHEN {has} THEN v_sector ELSE 'N/A' END",
        f"'Newspaper: ' || CASE WHEN {has} THEN v_newspaper ELSE 'N/A' END",
        f"'Last Date: ' || CASE WHEN {has} THEN v_last_date ELSE 'N/A' END",
        f"'Date Posted: ' || CASE WHEN {has} THEN v_date_posted ELSE 'N/A' END",
        "''", "'Description:'", na("description"), "''",
        f"'URL: https://{HOST}/item_tenders-' || k || '.html'", "''",
    ]
    body = f" || {CRLF} || ".join(lines)
    imgs = (f"CASE WHEN n_images > 0 THEN {CRLF} || 'Images:' || {CRLF} || '  1. https://{HOST}/images/tenders/' || k || '-1.jpg' || {CRLF} ELSE '' END")
    folder = "'Tender/' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS BIGINT)), '%Y-%m-%d_%H-%M-%S') || '_Page-' || (page_id + 1)"
    return f"SELECT tender_id, {folder} || '/' || folder_name || '/Tender.txt' AS path, {body} || {imgs} AS content FROM ({merged_sql()})"


def folder_names_sql() -> str:
    raw = ("CASE p_partkey % 5 WHEN 0 THEN 'Tender for the ' || p_name "
           "WHEN 1 THEN p_name || ': lot/' || p_size WHEN 2 THEN '  ' || p_name || ' *?<> .' "
           "WHEN 3 THEN 'con.' || p_name ELSE p_name || repeat(' x', 60) END")
    chain = f"SELECT p_partkey, {clean_title(raw)} AS ct FROM part"
    for st in safe_component("ct"):
        chain = f"SELECT *, {st} FROM ({chain})"
    seq = "CASE WHEN p_partkey < 1 THEN '001' WHEN p_partkey < 100 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END"
    return f"SELECT p_partkey, {seq} || '_' || safe AS folder_name FROM ({chain})"


def descriptions_sql() -> str:
    paras = (f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trimjs('x')}), "
             f"lambda x: x <> ''), chr(10) || chr(10))")
    raw = f"CASE WHEN doc_id % 2 = 0 THEN text ELSE {paras} END"
    return (f"SELECT doc_id AS page_id, CASE WHEN length(t) > 20 THEN {truncate('t')} ELSE 'Not available' END AS description "
            f"FROM (SELECT doc_id, {norm_cell(raw)} AS t FROM documents)")


def batch_items_sql() -> str:
    return f"""
      SELECT e.event_id, CAST(CAST(e.ts AS DATE) AS VARCHAR) AS batch_id, e.ts AS started_at,
             CASE WHEN h.tender_id IS NOT NULL THEN 'skipped' WHEN e.event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome,
             CAST(floor(e.value) AS BIGINT) % 4 AS n_img, e.event_type
      FROM events e LEFT JOIN ({HIST.replace("day(ts) <= 15", "day(ts) <= 2")}) h ON CAST(e.user_id AS VARCHAR) = h.tender_id
    """


def images_sql() -> str:
    return f"""
      SELECT batch_id, CAST(event_id AS VARCHAR) AS tender_id, g AS image_no,
             NOT (event_type = 'click' AND g = 1) AS ok
      FROM (SELECT *, unnest(generate_series(1, n_img)) AS g FROM ({batch_items_sql()}) WHERE n_img > 0 AND outcome = 'success')
    """


def _pipeline_sql() -> str:
    """What each order's newest capture not after its listing gives: k % 13 names the first capture's fault."""
    codes = {0: "HTTP_ERROR", 1: "EMPTY_HTML", 2: "UNEXPECTED_REDIRECT", 3: "UNEXPECTED_CONTENT_TYPE", 4: "ACCESS_RESTRICTED", 5: "HTML_PARSE_FAILED", 6: "EMPTY_HTML"}
    said = {
        "HTTP_ERROR": "The server returned an error response.", "EMPTY_HTML": "The response contained no content.",
        "UNEXPECTED_REDIRECT": "The tender URL redirected to an unexpected page.", "UNEXPECTED_CONTENT_TYPE": "The response was not HTML.",
        "ACCESS_RESTRICTED": "The tender page could not be accessed normally.", "HTML_PARSE_FAILED": "Failed to parse the tender HTML.",
    }
    code = " ".join(f"WHEN {m} THEN '{c}'" for m, c in codes.items())
    reason = " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in said.items())
    newspaper = "CASE WHEN late THEN 'Late ' ELSE '' END || v_newspaper"
    shown = lambda label, value: f"'{label}: ' || CASE WHEN outcome_code = 'OK' THEN {value} ELSE 'N/A' END"
    lines = [
        "'=== Tender Details ==='", "''", "'Tender ID: ' || k", "'Title: ' || title", shown("Category", "v_category"), shown("Province", "v_province"),
        shown("Location", "v_location"), shown("Subcategory", "v_subcategory"), shown("Sector", "v_sector"), shown("Newspaper", newspaper),
        shown("Last Date", "v_last_date"), shown("Date Posted", "v_date_posted"), "''", "'Description:'", "'N/A'", "''",
        f"'URL: https://{HOST}/order_tenders-' || k || '.html'", "''",
    ]
    content = f" || {CRLF} || ".join(lines)
    return f"""
      WITH t AS (SELECT *, CASE WHEN k % 9 = 0 THEN 0 ELSE 1 END AS seen, k % 9 <> 0 AND k % 2 = 1 AND k % 3 = 0 AS late FROM ({FACTS}) WHERE k >= 1),
      o AS (SELECT *, CASE WHEN seen = 0 THEN NULL WHEN late THEN 'OK' WHEN k % 13 = 7 THEN NULL
                           ELSE coalesce(CASE k % 13 {code} END, 'OK') END AS outcome_code FROM t)
      SELECT CAST(k AS VARCHAR) AS tender_id, outcome_code,
        CASE WHEN outcome_code = 'OK' THEN 'Parsed - Download Pending' WHEN outcome_code IS NULL THEN 'Pending' ELSE 'Parse Failed' END AS download_status,
        CASE outcome_code {reason} END AS failure_reason, CASE WHEN outcome_code IS NULL THEN 0 ELSE 1 END AS fetch_attempts,
        CASE WHEN outcome_code = 'OK' THEN v_category ELSE 'Not available' END AS category,
        CASE WHEN outcome_code = 'OK' THEN {newspaper} ELSE 'Not available' END AS newspaper,
        CASE WHEN outcome_code = 'OK' THEN v_last_date ELSE 'Not available' END AS last_date, title, true AS has_document, {content} AS content
      FROM o
    """


def _state_checks_sql() -> str:
    rows = """
      SELECT event_id,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 7 - 1 END AS page_number,
        event_id % 5 - 1 AS current_index, user_id % 50 AS total_tenders, event_id % 11 - 2 AS processed_count,
        event_id % 3 AS success_count, user_id % 4 - 1 AS failed_count, 0 AS skipped_count,
        CASE event_type WHEN 'view' THEN 'Idle' WHEN 'click' THEN 'Processing' WHEN 'purchase' THEN 'Completed'
             WHEN 'error' THEN 'Failed' ELSE 'Unknown' END AS batch_status,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 4 END AS max_retries,
        CAST(floor(value * 10) AS BIGINT) - 100 AS base_delay_ms
      FROM events
    """
    conds = [
        ("page_number IS NOT NULL AND page_number < 1", "pageNumber must be a positive integer or null."),
        ("current_index < 0", "currentTenderIndex must be a non-negative integer."),
        ("total_tenders < 0", "totalTenders must be a non-negative integer."),
        ("processed_count < 0", "processedCount must be a non-negative integer."),
        ("success_count < 0", "successCount must be a non-negative integer."),
        ("failed_count < 0", "failedCount must be a non-negative integer."),
        ("skipped_count < 0", "skippedCount must be a non-negative integer."),
        ("batch_status NOT IN ('Idle', 'Processing', 'Completed', 'Failed')", "batchStatus must be one of: Idle, Processing, Completed, Failed."),
        ("max_retries IS NOT NULL AND max_retries < 1", "retryConfig.maxRetries must be a positive integer."),
        ("base_delay_ms IS NOT NULL AND base_delay_ms < 0", "retryConfig.baseDelayMs must be a non-negative integer."),
    ]
    n = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c, _ in conds)
    txt = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in conds)
    return (f"SELECT event_id, CAST({n} AS INTEGER) AS n_errors, concat_ws('|', {txt}) AS errors_text, ({n}) = 0 AS valid "
            f"FROM ({rows})")


def _recovery_sql() -> str:
    m = "event_id % 6"
    return f"""
      SELECT event_id,
        CASE WHEN {m} IN (0, 4) THEN 'b' || user_id END AS batch_id,
        CASE WHEN {m} = 0 THEN CAST(event_id % 9 + 1 AS BIGINT) END AS page_number,
        CAST(CASE WHEN {m} = 0 THEN 1 WHEN {m} = 4 THEN 2 ELSE 0 END AS BIGINT) AS current_index,
        CAST(CASE WHEN {m} IN (0, 3) THEN 2 WHEN {m} = 4 THEN 3 ELSE 0 END AS BIGINT) AS total_tenders,
        CAST(CASE WHEN {m} = 0 THEN event_id % 5 WHEN {m} = 4 THEN 3 ELSE 0 END AS BIGINT) AS processed_count,
        CAST(CASE WHEN {m} = 0 THEN 2 ELSE 0 END AS BIGINT) AS success_count,
        CAST(0 AS BIGINT) AS failed_count,
        CAST(CASE WHEN {m} = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped_count,
        CASE WHEN {m} = 0 THEN 'Processing' WHEN {m} = 4 THEN 'Completed' ELSE 'Idle' END AS batch_status,
        CAST(CASE WHEN {m} = 0 THEN 3 ELSE 1 END AS BIGINT) AS max_retries,
        CAST(CASE WHEN {m} = 0 THEN 1500 ELSE 2000 END AS BIGINT) AS base_delay_ms
      FROM events
    """


ART = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
ART_N = f"len(regexp_extract_all({ART}, '<[a-zA-Z]'))"
ART_TEXT = f"length(replace(replace(regexp_replace({ART}, '<[^>]*>', '', 'g'), '&amp;', '&'), '&quot;', '\"'))"
ART_OK = f"({ART_TEXT} >= 100 AND {ART_N} > 0)"


RESUME = """
  SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, event_id AS position,
         CASE event_type WHEN 'view' THEN 'Downloaded' WHEN 'error' THEN 'Parse Failed'
              WHEN 'purchase' THEN 'Parsed - Download Pending' WHEN 'signup' THEN 'Download Failed' ELSE 'Pending' END AS status
  FROM events
"""


def oracle_sql() -> dict[str, str]:
    title = _title_sql()
    detail_lines = f" || {CRLF} || ".join(
        f"'{lbl}: ' || {col}" for lbl, col in [
            ("Date Posted", "v_date_posted"), ("Tender Category", "v_category"), ("Subcategory", "v_subcategory"),
            ("Province", "v_province"), ("Location", "v_location"), ("Sector", "v_sector"),
            ("Newspaper", "v_newspaper"), ("Last Date", "v_last_date")])
    gate_in = f"""
      SELECT page_id,
        'https://{HOST}/p_tenders-' || (page_id + 1) || '.html' AS url,
        CASE WHEN page_id % 13 = 0 THEN 'https://{HOST}/p_tenders-' || (page_id + 2) || '.html'
             ELSE 'https://{HOST}/p_tenders-' || (page_id + 1) || '.html' END AS final_url,
        CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS status,
        CASE page_id % 7 WHEN 0 THEN 'application/json' WHEN 1 THEN NULL WHEN 2 THEN 'TEXT/HTML; charset=utf-8'
             ELSE 'text/html; charset=utf-8' END AS content_type,
        CASE WHEN page_id % 17 = 0 THEN '  ' ELSE html END AS html
      FROM pages
    """
    phrases = " OR ".join(f"contains(lower(substr(html, 1, 2000)), '{p}')" for p in [
        "captcha", "verify you are human", "access denied", "forbidden",
        "login required", "sign in to continue", "unusual traffic", "rate limit"])
    msgs = ", ".join(f"('{c}', '{m}')" for c, m in [
        ("INVALID_TENDER_URL", "The selected tender URL is invalid."),
        ("FETCH_TIMEOUT", "The request timed out. Please try again."),
        ("HTTP_ERROR", "The server returned an error response."),
        ("ACCESS_RESTRICTED", "The tender page could not be accessed normally."),
        ("UNEXPECTED_REDIRECT", "The tender URL redirected to an unexpected page."),
        ("NETWORK_ERROR", "Could not connect to the server. Please check your internet connection."),
        ("EMPTY_HTML", "The response contained no content."),
        ("UNEXPECTED_CONTENT_TYPE", "The response was not HTML."),
        ("HTML_PARSE_FAILED", "Failed to parse the tender HTML."),
        ("NO_TENDER_CONTENT", "The parsed tender page has no recognizable content."),
        ("INVALID_HTML", "The HTML input was invalid."),
        ("UNKNOWN_ERROR", "An unexpected error occurred.")])
    gate = f"""
      SELECT g.page_id, g.outcome_code, m.message FROM (
        SELECT page_id, CASE
          WHEN status NOT BETWEEN 200 AND 299 THEN CASE WHEN status IN (401, 403, 429) THEN 'ACCESS_RESTRICTED' ELSE 'HTTP_ERROR' END
          WHEN html IS NULL OR {trimjs('html')} = '' THEN 'EMPTY_HTML'
          WHEN final_url <> url THEN 'UNEXPECTED_REDIRECT'
          WHEN NOT (lower(coalesce(content_type, '')) LIKE 'text/html%' OR lower(coalesce(content_type, '')) LIKE 'application/xhtml+xml%')
            THEN 'UNEXPECTED_CONTENT_TYPE'
          WHEN {phrases} THEN 'ACCESS_RESTRICTED'
          ELSE 'OK' END AS outcome_code
        FROM ({gate_in})) g
      LEFT JOIN (VALUES {msgs}) m(code, message) ON g.outcome_code = m.code
    """
    k = "o_orderkey"
    detail_ids = f"""
      SELECT {k},
        CASE WHEN {k} % 6 IN (0, 1, 2, 4) THEN {k} >= 1 ELSE false END AS valid,
        CASE {k} % 6 WHEN 0 THEN 'https://{HOST}/item_tenders-' || {k} || '.html'
                     WHEN 1 THEN 'https://{HOST}/x_tenders-' || {k} || '.html'
                     WHEN 2 THEN 'https://{HOST}/rel/y_tenders-' || {k} || '.html'
                     WHEN 4 THEN 'https://{HOST}/z_tenders-00' || {k} || '.html' ELSE NULL END AS canonical_url,
        CASE WHEN {k} % 6 IN (0, 1, 2) AND {k} >= 1 THEN CAST({k} AS VARCHAR)
             WHEN {k} % 6 = 4 AND {k} >= 1 THEN '00' || {k} ELSE NULL END AS tender_id
      FROM orders
    """
    listing_rows = f"""
      SELECT k // 30 AS page_id,
        CAST(row_number() OVER (PARTITION BY k // 30 ORDER BY CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END, k) AS INTEGER) AS listing_position,
        title AS original_listing_title, v_location AS city, v_date_posted AS date_posted,
        'https://{HOST}/item_tenders-' || k || '.html' AS detail_url, CAST(k AS VARCHAR) AS tender_id
      FROM ({FACTS}) WHERE k >= 1
    """
    listing_pages = f"""
      SELECT k // 30 AS page_id, CAST(k // 30 + 1 AS INTEGER) AS page_number, 'pagination-element' AS detection_source,
             CAST(count(*) FILTER (WHERE k >= 1) AS INTEGER) AS tender_count
      FROM ({FACTS}) GROUP BY k // 30
    """
    attempts = """
      SELECT CAST(user_id AS VARCHAR) AS item_id, event_type <> 'error' AS ok,
             CASE WHEN event_type = 'error' THEN 'HTTP_ERROR at event ' || event_id END AS error,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_no
      FROM events
    """
    attempt_outcomes = f"""
      SELECT item_id, bool_or(ok) AS success,
             CASE WHEN bool_or(ok) THEN 'Parsed - Download Pending' ELSE 'Parse Failed' END AS status,
             CAST(CASE WHEN bool_or(ok) THEN min(attempt_no) FILTER (WHERE ok) ELSE max(attempt_no) END AS INTEGER) AS fetch_attempts,
             CASE WHEN bool_or(ok) THEN NULL ELSE coalesce(arg_max(error, attempt_no), 'Unknown error') END AS failure_reason
      FROM ({attempts}) WHERE attempt_no <= 3 GROUP BY item_id
    """
    timeouts = """
      WITH s AS (SELECT event_id AS start_id, user_id, ts FROM events WHERE event_type = 'click'),
      c AS (SELECT event_id AS change_id, user_id, ts,
                   CASE WHEN event_type = 'view' THEN 'complete' ELSE 'interrupted' END AS state
            FROM events WHERE event_type IN ('view', 'purchase')),
      j AS (SELECT s.start_id, arg_min(c.change_id, {'t': c.ts, 'c': c.change_id}) AS change_id,
                   arg_min(c.state, {'t': c.ts, 'c': c.change_id}) AS state
            FROM s JOIN c ON s.user_id = c.user_id AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 1800 SECOND
            GROUP BY s.start_id)
      SELECT s.start_id, j.change_id, coalesce(j.state = 'complete', false) AS ok FROM s LEFT JOIN j USING (start_id)
    """
    summary = f"""
      WITH i AS ({batch_items_sql()}), im AS ({images_sql()}),
      a AS (SELECT batch_id, count(*) AS total_tenders,
                   count(*) FILTER (WHERE outcome = 'success') AS success_count,
                   count(*) FILTER (WHERE outcome = 'failed') AS failed_count,
                   count(*) FILTER (WHERE outcome = 'skipped') AS skipped_count,
                   CAST(CASE WHEN day(min(started_at)) % 5 = 0 THEN 0
                        ELSE epoch_us(max(started_at)) // 1000 + 30000 - epoch_us(min(started_at)) // 1000 + 60000 END AS BIGINT) AS duration_ms
            FROM i GROUP BY batch_id),
      b AS (SELECT batch_id, count(*) AS image_total, count(*) FILTER (WHERE ok) AS image_downloaded,
                   count(*) FILTER (WHERE NOT ok) AS image_failed FROM im GROUP BY batch_id)
      SELECT a.*, CAST(coalesce(b.image_total, 0) AS BIGINT) AS image_total,
             CAST(coalesce(b.image_downloaded, 0) AS BIGINT) AS image_downloaded,
             CAST(coalesce(b.image_failed, 0) AS BIGINT) AS image_failed
      FROM a LEFT JOIN b USING (batch_id)
    """
    image_outcomes = f"""
      SELECT batch_id, tender_id, n, ok_n AS succeeded, n - ok_n AS failed,
             CASE WHEN n - ok_n = 0 THEN 'Succeeded' ELSE 'Failed' END AS image_download_status,
             CASE WHEN n - ok_n = 0 THEN NULL
                  WHEN ok_n > 0 THEN (n - ok_n) || ' of ' || n || ' images failed'
                  ELSE 'All ' || n || ' images failed' END AS failure_reason
      FROM (SELECT batch_id, tender_id, count(*) AS n, count(*) FILTER (WHERE ok) AS ok_n FROM ({images_sql()}) GROUP BY 1, 2)
    """
    progress = """
      SELECT batch_id, total, processed, greatest(total - processed, 0) AS remaining,
             CAST(CASE WHEN total > 0 THEN round(processed / total * 100) ELSE 0 END AS INTEGER) AS percent
      FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, count(*) AS total,
                   count(*) FILTER (WHERE hour(ts) < 12) AS processed
            FROM events GROUP BY 1)
    """
    return {
        "page_summary": f"""
          SELECT page_id, {_canon_page('url')} AS canonical_url, {title} AS title,
                 CASE WHEN {ART_OK} THEN 'article' ELSE 'body' END AS main_tag,
                 CAST(len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS BIGINT) AS n_links
          FROM pages""",
        "page_titles": f"SELECT page_id, {title} AS title FROM pages",
        "page_links": f"""
          SELECT page_id, CAST(i AS INTEGER) AS link_no, {unescape('hrefs[i]')} AS href FROM (
            SELECT page_id, hrefs, unnest(generate_series(1, len(hrefs))) AS i FROM (
              SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages) WHERE len(hrefs) > 0)""",
        "main_content_stats": f"""
          SELECT page_id, CASE WHEN {ART_OK} THEN 'article' ELSE 'body' END AS main_tag,
                 CASE WHEN {ART_OK} THEN 'largest' ELSE 'body' END AS main_source,
                 CAST(CASE WHEN {ART_OK} THEN {ART_N} ELSE {ART_N} + 2 END AS INTEGER) AS n_desc
          FROM pages""",
        "url_canonical": f"SELECT page_id, {_canon_page('url')} AS canonical_url FROM pages",
        "url_dedup": """
          WITH c AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
                            'https://' || regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS url_key
                     FROM pages),
          g AS (SELECT host, url_key, min(page_id) AS first_page_id, count(*) AS n_copies FROM c GROUP BY host, url_key)
          SELECT host, url_key, first_page_id, n_copies,
                 CAST(row_number() OVER (PARTITION BY host ORDER BY first_page_id) AS INTEGER) AS position FROM g""",
        "capture_gate": gate,
        "detail_ids": detail_ids,
        "metadata_roundtrip": f"""
          SELECT k AS page_id, v_date_posted AS date_posted, v_category AS category, v_province AS province,
                 v_location AS location, v_subcategory AS subcategory, v_sector AS sector, v_newspaper AS newspaper,
                 v_last_date AS last_date, title,
                 CASE WHEN k % 5 = 4 THEN {detail_lines} ELSE '' END AS details_text
          FROM ({FACTS})""",
        "descriptions": descriptions_sql(),
        "images": """
          SELECT p_partkey AS page_id, CAST(i AS INTEGER) AS image_no,
                 'https://www.tenders.example/images/tenders/' || p_partkey || '-' || i || '.jpg' AS image_url
          FROM (SELECT p_partkey, unnest(generate_series(1, p_size % 4)) AS i FROM part WHERE p_size % 4 > 0)""",
        "listing_rows": listing_rows,
        "listing_pages": listing_pages,
        "merged_records": f"""
          SELECT tender_id, listing_position, title, folder_name, category, province, location, description,
                 download_status, fetch_attempts, n_images, warnings_text FROM ({merged_sql()})""",
        "documents_txt": documents_sql(),
        "document_files": f"SELECT path, content FROM ({documents_sql()})",
        "pipeline_documents": _pipeline_sql(),
        "stream_details": f"SELECT page_id, {_title_sql()} AS title, 'OK' AS code FROM pages",
        "stream_first_completion": timeouts,
        "page_outcomes": """
          SELECT page_id, CASE page_id % 17 WHEN 0 THEN 'INVALID_HTML' WHEN 1 THEN 'HTML_PARSE_FAILED' WHEN 2 THEN 'NO_TENDER_CONTENT'
                   WHEN 3 THEN 'HTML_PARSE_FAILED' ELSE 'OK' END AS code, page_id % 17 > 3 AS has_nodes FROM pages""",
        "folder_names": folder_names_sql(),
        "history_skip": f"""
          SELECT i.event_id, i.tender_id, CASE WHEN h.tender_id IS NULL THEN 'todo' ELSE 'skip' END AS action
          FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS tender_id FROM events) i
          LEFT JOIN ({HIST}) h ON i.tender_id = h.tender_id""",
        "in_batch_repeats": """
          SELECT event_id, coalesce(bool_or(event_type <> 'error') OVER (
                   PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS repeat_skipped
          FROM events""",
        "page_done": f"""
          SELECT r.page_id, count(r.tender_id) AS n_valid,
                 count(r.tender_id) > 0 AND coalesce(bool_and(h.tender_id IS NOT NULL), false) AS done
          FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M') AS page_id, CAST(user_id AS VARCHAR) AS tender_id FROM events) r
          LEFT JOIN ({HIST}) h ON r.tender_id = h.tender_id GROUP BY r.page_id""",
        "attempt_outcomes": attempt_outcomes,
        "attempt_timeouts": timeouts,
        "batch_summary": summary,
        "image_outcomes": image_outcomes,
        "batch_progress": progress,
        "batch_state_checks": _state_checks_sql(),
        "batch_state_recovery": _recovery_sql(),
        "normalization_report": f"""
          SELECT page_id, count(*) AS raw_count, count(*) FILTER (WHERE ok) AS valid_count,
                 count(*) FILTER (WHERE NOT ok AND k % 13 <> 0) AS invalid_count,
                 count(*) FILTER (WHERE ok) = 0 AS has_fatal, count(*) FILTER (WHERE ok) > 0 AS ready
          FROM (SELECT k, k // 30 AS page_id, (k % 13 <> 0 AND k % 9 <> 0 AND k >= 1) AS ok FROM ({FACTS}))
          GROUP BY page_id""",
        "plan_resume": f"""
          SELECT event_id, status, CASE WHEN status IN ('Parse Failed', 'Downloaded', 'Download Failed') THEN 'skip'
                 WHEN status = 'Parsed - Download Pending' THEN 'output' ELSE 'process' END AS action FROM ({RESUME})""",
        "next_items": f"""
          SELECT batch_id, position, status FROM (
            SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY position) AS rn FROM ({RESUME})
            WHERE status NOT IN ('Parse Failed', 'Downloaded', 'Download Failed')) WHERE rn <= 5""",
        "stream_history": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS tender_id FROM events WHERE event_type = 'purchase'",
        "stream_progress": """
          SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, count(*) AS n_events,
                 count(*) FILTER (WHERE event_type = 'error') AS n_errors
          FROM events GROUP BY 1""",
    }
