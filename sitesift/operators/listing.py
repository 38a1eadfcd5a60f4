"""Listing-page extraction (EXT-1..5, FLT-5/6/7, WIN-1/2, WIN-4).

Works on the node table of listing pages (no boilerplate strip, like the
live page), in three steps that share its one shuffle by ``page_id``:

1. all selectors of the profile as bits of one column a group, and for each
   node running counts of rows by row selector, written once as a bucketed table;
2. one row per page: its texts, headings, section candidates with their row
   counts (the running counts at both ends of a subtree), pagination marks;
   section and page number are expressions on that row;
3. rows of the section: link, header mark, city and date cells of a row are
   the next flagged nodes in document order, if they lie inside the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.text import js_trim, norm_ws
from ..functions.urls import listing_link, num_in, page_in_path, page_in_text, url_parts
from ..session import materialize as _materialize
from .selectors import bit, with_rules
from .tree import inside, is_element, next_flagged, page_texts, text_at, w_upto

GROUPS = {
    "sec": P.SECTION_SIBLING_SELECTORS,
    "row": P.ROW_SELECTORS,
    "hdr": P.HEADER_ROW_SELECTORS,
    "city": P.CITY_SELECTORS,
    "date": P.DATE_SELECTORS,
    "pgc": P.PAGINATION_CONTAINERS,
    "pgi": P.PAGINATION_INDICATORS + P.PAGINATION_ITEMS,
}
N_ROW, N_SEC = len(P.ROW_SELECTORS), len(P.SECTION_SIBLING_SELECTORS)


def _bit_of(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i - 1).bitwiseAND(1) != 0


def listing_nodes(nodes: DataFrame, profile: P.SiteProfile) -> DataFrame:
    """Element rows and texts with rule masks, the next link, and running counts of rows (and of rows with a link)."""
    href = F.col("attrs").getItem("href")
    at = F.struct("node_id", "t0", "t1", href.alias("href"), F.col("attrs").getItem("title").alias("title"))
    df = with_rules(nodes.filter("kind <> 'page'"), GROUPS)
    df = df.withColumn("_a", F.when((F.col("tag") == "a") & F.coalesce(href.contains(profile.detail_link_marker), F.lit(False)), at))
    df = df.withColumn("link", next_flagged("_a"))
    has = F.coalesce(F.col("link.node_id") <= F.col("end_id"), F.lit(False))
    counts = {f"rows{i}": F.count(F.when(bit("row", i), 1)).over(w_upto()) for i in range(1, N_ROW + 1)}
    counts |= {f"links{i}": F.count(F.when(bit("row", i) & has, 1)).over(w_upto()) for i in range(1, N_ROW + 1)}
    return df.withColumns(counts).drop("attrs", "classes", "class_raw", "elem_id", "up", "child_index", "depth", "_a")


def container_rows(marked: DataFrame) -> DataFrame:
    """(page_id, containers): section candidates (selector matches and tables) in document order.

    ``row_sel``: the first row selector with a linked row inside (FLT-5, EXT-3); ``n_rows``: how many rows it finds.
    """
    names = [f"{x}{i}" for i in range(1, N_ROW + 1) for x in ("rows", "links")]
    end = marked.select("page_id", F.col("node_id").alias("end_id"), *[F.col(c).alias(f"e_{c}") for c in names])
    c = marked.filter((F.col("sec") != 0) | (F.col("tag") == "table")).join(end, ["page_id", "end_id"])
    n = lambda x: F.col(f"e_{x}") - F.col(x)
    found = [F.when(n(f"links{i}") >= 1, F.struct(F.lit(i).alias("row_sel"), n(f"rows{i}").alias("n_rows"))) for i in range(1, N_ROW + 1)]
    best = F.coalesce(*found)
    item = F.struct("node_id", "end_id", "sec", "hidden", (F.col("tag") == "table").alias("is_table"), best["row_sel"].alias("row_sel"), best["n_rows"].alias("n_rows"))
    return c.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("containers"))


def section_of() -> Column:
    """EXT-2 on a page row: (node_id, end_id, row_sel) of the listing section; null without one.

    The first visible heading with all keywords, then under its parent the first match of each section selector (last a
    table, unless the parent is the body), accepted if it has more than two rows; else the first visible match of the page.
    """
    h = F.col("heading")
    under = lambda c: F.coalesce((c["node_id"] > h["parent_id"]) & (c["node_id"] <= h["parent_end"]), F.lit(False))
    enough = lambda c: F.coalesce(c["n_rows"] > 2, F.lit(False))
    out = lambda c: F.struct(c["node_id"].alias("node_id"), c["end_id"].alias("end_id"), c["row_sel"].alias("row_sel"))

    def near(match, also=F.lit(True)) -> Column:
        c = F.get(F.filter("containers", lambda c: under(c) & match(c)), F.lit(0))
        return F.when(also & enough(c) & (c["node_id"] != h["node_id"]), out(c))

    def anywhere(i: int) -> Column:
        c = F.get(F.filter("containers", lambda c: _bit_of(c["sec"], F.lit(i)) & ~c["hidden"] & enough(c)), F.lit(0))
        return F.when(c.isNotNull(), out(c))

    not_body = F.col("body_id").isNull() | (h["parent_id"] != F.col("body_id"))
    steps = [near(lambda c, i=i: _bit_of(c["sec"], F.lit(i))) for i in range(1, N_SEC + 1)] + [near(lambda c: c["is_table"], not_body)]
    return F.coalesce(*steps, *[anywhere(i) for i in range(1, N_SEC + 1)])


def number_of(url: Column) -> tuple[Column, Column]:
    """EXT-1 on a page row: (page number, where it was found): pagination mark, heading, title, path, else 1."""
    text = lambda x: text_at(F.col("texts"), x["t0"], x["t1"])
    n_ind = len(GROUPS["pgi"])
    marks = F.filter(F.transform("marks", lambda m: F.struct(m["node_id"].alias("node_id"), m["pgi"].alias("pgi"), num_in(text(m)).alias("num"))), lambda m: m["num"].isNotNull())
    ranked = F.array_sort(F.flatten(F.transform("pagers", lambda c: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(len(GROUPS["pgc"]))), lambda r: _bit_of(c["pgc"], r)),
        lambda r: F.struct(r.alias("rank"), c["node_id"].alias("node_id"), c["end_id"].alias("end_id"))))))
    first_mark = lambda c: F.coalesce(*[
        F.get(F.filter(marks, lambda m: _bit_of(m["pgi"], F.lit(i)) & (m["node_id"] > c["node_id"]) & (m["node_id"] <= c["end_id"])), F.lit(0))["num"]
        for i in range(1, n_ind + 1)])
    n_pag = F.when((F.size("marks") > 0) & (F.size("pagers") > 0),
                   F.aggregate(ranked, F.lit(None).cast("int"), lambda acc, c: F.when(acc.isNotNull(), acc).otherwise(first_mark(c).cast("int"))))
    n_head = F.get(F.filter(F.transform(F.filter("heads", lambda h: h["level"] <= 3), lambda h: page_in_text(text(h))), lambda n: n.isNotNull()), F.lit(0))
    n_title = page_in_text(F.regexp_replace(js_trim(text(F.col("head_title"))), "[ \t\n\f\r]+", " "))
    n_path = page_in_path(url_parts(url)["path"])
    found = [(n_pag, "pagination-element"), (n_head, "heading"), (n_title, "document-title"), (n_path, "pathname")]
    number = F.coalesce(*[n for n, _ in found], F.lit(1))
    return number, reduce(lambda acc, x: F.when(x[0].isNotNull(), F.lit(x[1])).otherwise(acc), reversed(found), F.lit("fallback"))


def listing_page_rows(marked: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """One row per page: page_id, url, texts, section, page_number, detection_source."""
    tags = [*P.SECTION_HEADING_TAGS]
    level = reduce(lambda acc, x: F.when(F.col("tag") == x[1], F.lit(x[0])).otherwise(acc), enumerate(tags, start=1), F.lit(None).cast("int"))
    visible = is_element() & ~F.col("hidden")
    head = F.struct(level.alias("level"), "node_id", "parent_id", "parent_end", "t0", "t1")
    page = marked.groupBy("page_id").agg(
        page_texts().alias("texts"),
        F.sort_array(F.collect_list(F.when(visible & F.col("tag").isin(*tags), head))).alias("heads"),
        F.min(F.when(F.col("tag") == "body", F.col("node_id"))).alias("body_id"),
        F.min(F.when(F.col("tag") == "title", F.struct("node_id", "t0", "t1"))).alias("head_title"),
        F.sort_array(F.collect_list(F.when(F.col("pgc") != 0, F.struct("node_id", "end_id", "pgc")))).alias("pagers"),
        F.sort_array(F.collect_list(F.when(visible & (F.col("pgi") != 0), F.struct("node_id", "pgi", "t0", "t1")))).alias("marks"),
    )
    low = lambda h: F.lower(norm_ws(text_at(F.col("texts"), h["t0"], h["t1"])))
    keyed = F.filter("heads", lambda h: F.forall(F.array(*map(F.lit, P.SECTION_HEADING_KEYWORDS)), lambda k: low(h).contains(k)))
    page = page.withColumn("heading", F.get(keyed, F.lit(0)))
    none = F.array().cast("array<struct<node_id:int,end_id:int,sec:int,hidden:boolean,is_table:boolean,row_sel:int,n_rows:bigint>>")
    page = page.join(container_rows(marked), "page_id", "left").withColumn("containers", F.coalesce("containers", none))
    page = pages.select("page_id", F.col(url_col).alias("url")).join(page, "page_id", "left")
    number, source = number_of(F.col("url"))
    return page.select("page_id", "url", "texts", section_of().alias("section"), number.alias("page_number"), source.alias("detection_source"))


def section_rows(marked: DataFrame, page: DataFrame, profile: P.SiteProfile) -> DataFrame:
    """EXT-3/4 + FLT-5/6/7: rows of the sections with a valid link and a title; header rows left out."""
    flagged = marked.filter("row <> 0 or hdr <> 0 or city <> 0 or date <> 0")
    kinds = [(g, i) for g in ("city", "date") for i in range(1, len(GROUPS[g]) + 1)]
    at = F.struct("node_id", "t0", "t1")
    df = flagged.withColumns({f"_{g}{i}": F.when(bit(g, i), at) for g, i in kinds} | {"_hdr": F.when(F.col("hdr") != 0, F.col("node_id"))})
    df = df.withColumns({f"_{g}{i}": next_flagged(f"_{g}{i}") for g, i in kinds} | {"_hdr": next_flagged("_hdr")})
    df = df.filter("row <> 0").join(page.select("page_id", "url", "texts", "section"), "page_id")
    df = df.filter(inside(F.col("node_id"), F.col("section")) & _bit_of(F.col("row"), F.col("section.row_sel")) & (F.col("link.node_id") <= F.col("end_id")))
    text = lambda c: text_at(F.col("texts"), F.col(f"{c}.t0"), F.col(f"{c}.t1"))
    within = lambda c: F.when(F.col(f"{c}.node_id") <= F.col("end_id"), norm_ws(text(c)))
    df = df.select(
        "page_id", F.col("node_id").alias("r_id"), "hidden", (F.col("_hdr") <= F.col("end_id")).alias("has_hdr"), "url", "link.href", "link.title",
        F.lower(norm_ws(text_at(F.col("texts"), F.col("t0"), F.col("t1")))).alias("low"), norm_ws(text("link")).alias("t1"),
        *[F.array(*[within(f"_{g}{i}") for i in range(1, len(GROUPS[g]) + 1)]).alias(g) for g in ("city", "date")],
    )
    header = F.coalesce("has_hdr", F.lit(False)) & reduce(lambda a, b: a | b, [F.col("low").contains(w) for w in P.HEADER_WORDS])
    df = df.filter(~header).withColumn("link", listing_link(F.col("href"), F.col("url"), profile))
    df = df.withColumn("title", F.when(F.col("t1") != "", F.col("t1")).otherwise(norm_ws(F.coalesce("title", F.lit("")))))
    df = df.filter(F.col("link.valid") & (F.col("title") != ""))
    # WIN-4: the first selector whose first cell qualifies
    first = lambda cells, *other: F.coalesce(F.get(F.filter(cells, lambda v: reduce(lambda a, b: a & b, [v != o for o in other], v != "")), F.lit(0)), F.lit(P.NOT_AVAILABLE))
    df = df.withColumn("city", first("city", F.col("title")))
    df = df.withColumn("date", first("date", F.col("city"), F.col("title")))
    return df.select("page_id", "r_id", "hidden", "title", "city", "date", F.col("link.url").alias("detail_url"), F.col("link.id").alias("tender_id"))


def extract_listings(nodes: DataFrame, pages: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE,
                     url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """EXT-5: (rows, page_info).

    rows: page_id, listing_position, original_listing_title, city, date_posted, detail_url, tender_id
    page_info: page_id, page_number, detection_source, tender_count, warnings
    """
    marked = _materialize(listing_nodes(nodes, profile), "listing")
    page = _materialize(listing_page_rows(marked, pages, url_col), "listing_pages")
    cand = section_rows(marked, page, profile)

    # --- WIN-1 / WIN-2 dedup and numbering -----------------------------------
    wurl = Window.partitionBy("page_id", "detail_url")
    dedup = (
        cand.withColumn("slot", F.min("r_id").over(wurl))
        .withColumn("_k", F.row_number().over(wurl.orderBy(F.col("hidden").asc(), F.col("r_id").asc())))
        .filter(F.col("_k") == 1)
        .withColumn("listing_position", F.row_number().over(Window.partitionBy("page_id").orderBy("slot")))
    )
    out_rows = _materialize(dedup.select(
        "page_id", "listing_position", F.col("title").alias("original_listing_title"),
        "city", F.col("date").alias("date_posted"), "detail_url", "tender_id",
    ), "listing_rows")

    counts = out_rows.groupBy("page_id").agg(F.count("*").alias("tender_count"))
    info = page.join(counts, "page_id", "left").select(
        "page_id", "page_number", "detection_source",
        F.coalesce("tender_count", F.lit(0)).cast("int").alias("tender_count"),
        F.when(F.col("section").isNull(), F.array(F.lit(P.WARN_NO_SECTION)))
        .when(F.coalesce("tender_count", F.lit(0)) == 0, F.array(F.lit(P.WARN_NO_ROWS)))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return out_rows, info
