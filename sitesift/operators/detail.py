"""Detail-page extraction (FLT-10, EXT-7..17, JN-2, WIN-3, WIN-6, AGG-9..12, SRT-2).

The plan, for any number of pages:

1. ``marked_nodes``: the parse's rows, one shuffle by ``page_id``, flags and
   page windows, written once as a table bucketed by ``page_id``;
2. ``main_content``: the main container of each page;
3. ``page_rows``: two window passes (siblings, document order) name for each
   node the label/value pair it may stand for, then one aggregate gives one
   row per page: its text nodes as an array, and the ranges of everything
   whose text is wanted.  ``textContent`` is a slice of that array, so no text is joined;
4. ``parse_details``: pairs, images and page fields from these rows.

Steps 2 to 4 read bucketed tables and add no shuffle.

``page_details`` is the way for captures that each have a ``page_id`` of their own: the task that parses a page also does steps
1 to 3 for it (``page_step``) and step 4 works on the page's row, so nothing is shuffled.  Captures that share an id
have their nodes in one page and take the plan above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions.text import js_trim, norm_cell, norm_label, strip_site_suffix, truncate_text
from ..session import materialize as _materialize
from ..session import spread as deal
from ..functions.urls import image_host_allowed, image_resolve, valid_image
from ..sources.html_nodes import CODE_FAILED, CODE_INVALID
from .page_step import FIELDS, step
from .selectors import bit, first_bit, quoted, with_flags, with_rules
from .tree import (
    SIBLINGS,
    in_body,
    inside,
    inside_flag,
    is_element,
    next_flagged,
    page_texts,
    subtree_stats,
    text_at,
    w_doc,
    w_siblings,
    w_whole,
    with_running_counts,
)

NA = P.NOT_AVAILABLE


# ---------------------------------------------------------------------------
# FLT-10 boilerplate removal
# ---------------------------------------------------------------------------
def strip_boilerplate(nodes: DataFrame, selectors=None) -> DataFrame:
    """Remove every body subtree whose root matches a strip selector.

    Two ordered window passes (body bounds, then a running max of the
    flagged subtree ends); no join.  Keeps column ``in_body``.
    """
    return mark_boilerplate(nodes, selectors).filter(~F.col("removed")).drop("removed")


def mark_boilerplate(nodes: DataFrame, selectors=None) -> DataFrame:
    """Like ``strip_boilerplate`` but keeps every row with a ``removed`` flag.

    One window operator: the body's bounds and the running end of flagged subtrees.  The body itself and what holds
    it are never flagged.
    """
    sels = selectors if selectors is not None else P.STRIP_SELECTORS
    df = with_flags(nodes, {"_strip": sels})
    flagged = F.col("_strip") & ~F.col("tag").isin("html", "body", "#document")
    df = df.withColumns({"in_body": in_body(), "_covered": inside_flag(flagged, strict=False)})
    return df.withColumn("removed", F.col("in_body") & F.col("_covered")).drop("_strip", "_covered")


def marked_nodes(nodes: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE) -> DataFrame:
    """Boilerplate flags and the rules a node matches as bits: ``main_rules``, ``desc``, ``roles``.

    ``roles`` has the bits of PARTS, ``desc`` those of the description selectors.  Attributes no later step asks for
    are dropped, so the written table is narrow.
    """
    parts = [f".{profile.details_row_class}", f".{profile.details_key_class}", f".{profile.details_value_class}", f".{profile.details_block_class}"]
    groups = {"main_rules": P.MAIN_CONTENT_SELECTORS, "desc": P.DESCRIPTION_SELECTORS, "_parts": parts}
    df = with_flags(with_rules(mark_boilerplate(nodes), groups), {"_span": P.LABEL_SPAN_SELECTORS})
    cls = F.coalesce("class_raw", F.lit(""))
    any_of = lambda words: reduce(lambda a, b: a | b, [cls.contains(w) for w in words])
    flags = [bit("_parts", i) for i in range(1, 5)] + [
        F.col("_span"), any_of(P.PAIR_DIV_CLASS_WORDS), any_of(["label", "title"]) | F.col("tag").isin("label", "span", "strong"), any_of(["value", "content"])]
    roles = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)])
    # classes and ids with one of these words are no main content (SRT-2)
    low = F.lower(F.concat_ws(" ", "elem_id", "class_raw"))
    side = low.contains("nav") | low.contains("footer") | low.contains("sidebar")
    return df.select(
        "page_id", "node_id", "end_id", "parent_id", "kind", "tag", "elem_id", "text", "t0", "t1", "in_body", "removed", "desc", roles.alias("roles"),
        side.alias("side"), F.col("attrs").getItem("href").alias("href"), F.col("attrs").getItem("src").alias("src"),
        F.array_contains("classes", profile.image_container_class).alias("image_box"), "main_rules")


PARTS = ["row", "key", "value", "block", "span", "pair", "like_label", "like_value"]


def role(name: str) -> Column:
    return bit("roles", PARTS.index(name) + 1)


# ---------------------------------------------------------------------------
# EXT-7 / SRT-2 main content
# ---------------------------------------------------------------------------
def main_content(nodes: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(page_id, main_id, main_end, main_source) for each page.

    ``marked`` comes from ``marked_nodes``; ``nodes`` alone are taken as they are, nothing removed.

    First match of the prioritized selectors; else the div/section/article
    with most descendant elements (text >= 100 chars, no nav/footer/sidebar
    in id or class; first on ties); else the body.  Subtree sizes are
    computed for pages without a selector match only.
    """
    if marked is None:
        marked = marked_nodes(nodes).withColumn("removed", F.lit(False))
    alive = ~F.col("removed")
    rank = F.when((F.col("main_rules") != 0) & alive, F.struct(first_bit("main_rules").alias("rank"), "node_id", "end_id"))
    page = marked.groupBy("page_id").agg(
        F.min(rank).alias("sel"),
        F.min(F.when(F.col("tag") == "body", F.struct("node_id", "end_id"))).alias("first_body"),
        F.min(F.when(F.col("node_id") == 0, F.struct("node_id", "end_id"))).alias("document"),
    ).filter("document is not null").withColumn("body", F.coalesce("first_body", "document"))
    narrow = marked.filter(F.col("kind") != "page").select("page_id", "node_id", "end_id", "kind", "tag", "text", "in_body", "removed", "side")
    counted = with_running_counts(narrow.join(page.filter("sel is null").select("page_id"), "page_id", "left_semi"), alive)
    cand = counted.filter(F.col("tag").isin("div", "section", "article") & F.col("in_body") & ~F.col("side") & alive)
    cand = cand.select("page_id", "node_id", "end_id", "elem_cum", "text_cum")
    stats = subtree_stats(cand, counted).filter((F.col("text_len") >= 100) & (F.col("n_desc") > 0))
    best = stats.groupBy("page_id").agg(
        F.max(F.struct("n_desc", (-F.col("node_id")).alias("neg"), "node_id", "end_id")).alias("b")
    )
    out = page.join(best, "page_id", "left")
    pick = lambda c: F.coalesce(f"sel.{c}", f"b.{c}", f"body.{c}")
    source = F.when(F.col("sel").isNotNull(), "selector").when(F.col("b").isNotNull(), "largest").otherwise("body")
    return out.select("page_id", pick("node_id").alias("main_id"), pick("end_id").alias("main_end"), source.alias("main_source"))


# ---------------------------------------------------------------------------
# Label/value pairs (SET-1, EXT-8..12)
# ---------------------------------------------------------------------------
def _range(node: str) -> Column:
    return F.struct(F.col(f"{node}.t0").alias("t0"), F.col(f"{node}.t1").alias("t1"))


def with_pairs(alive: DataFrame) -> DataFrame:
    """Add ``pairs``: array of the label/value pairs an element stands for (SET-1), as text ranges.

    ``alive``: elements of ``with_siblings``, with ``main`` (struct node_id, end_id).  Each pair has
    ``ord`` (strategy, then document order), the ranges of label and value, and ``short``: whether the label must have a
    colon or under 50 characters.  No join: children, next siblings and first cells are the next flagged rows of an
    ordered window, and only numbers ride along.
    """
    at = F.struct("node_id", "t0", "t1")
    df = alive.withColumns({
        "_kid": F.struct("parent_id", "t0", "t1", role("like_label").alias("like_label"), F.col("next").alias("_next")),
        "_cell": F.when(F.col("tag").isin("td", "th"), F.struct("node_id", "t0", "t1", (F.col("tag") == "td").alias("td"))),
        "_key_at": F.when(role("key"), at), "_value_at": F.when(role("value"), at),
        "_in_main": inside(F.col("node_id"), F.col("main")),
    })
    df = df.withColumns({
        "_kid": F.lead("_kid").over(w_doc()), "_c1": next_flagged("_cell"), "_c2": next_flagged("_cell", 2),
        "_key": next_flagged("_key_at"), "_value": next_flagged("_value_at"),
        "_block": F.min(F.when(role("block"), F.struct("node_id", "end_id"))).over(w_whole()),
        "_in_table": inside_flag(F.col("_in_main") & (F.col("tag") == "table")),
        "_in_dl": inside_flag(F.col("_in_main") & (F.col("tag") == "dl")),
    }).withColumnRenamed("next", "_next")
    within = lambda c: F.coalesce(F.col(f"{c}.node_id") <= F.col("end_id"), F.lit(False))

    def pair(strategy: int, cond: Column, label: Column, value: Column, short: Column) -> Column:
        order = (F.lit(strategy).cast("long") * (1 << 32) + F.col("node_id")).alias("ord")
        return F.when(cond, F.struct(order, label.alias("label"), value.alias("value"), short.alias("short")))

    this = F.struct("t0", "t1")
    found = [
        # EXT-8: rows of tables; the first two cells, th/td or td/td
        pair(1, (F.col("tag") == "tr") & F.col("_in_table") & within("_c2") & F.col("_c2.td"), _range("_c1"), _range("_c2"), F.col("_c1.td")),
        # EXT-9: dt whose next element sibling is a dd
        pair(2, (F.col("tag") == "dt") & F.col("_in_dl") & F.col("_next.dd"), this, _range("_next"), F.lit(False)),
        # EXT-10: the first two element children of a div whose class says so
        pair(3, (F.col("tag") == "div") & F.col("_in_main") & role("pair") & (F.col("_kid.parent_id") == F.col("node_id")) & F.col("_kid._next").isNotNull()
             & (F.col("_kid.like_label") | F.col("_kid._next.like_value")), _range("_kid"), _range("_kid._next"), F.lit(True)),
        # EXT-11: label spans and their next element sibling
        pair(4, role("span") & F.col("_in_main") & F.col("_next").isNotNull(), this, _range("_next"), F.lit(False)),
        # EXT-12: rows of the first details block, anywhere in the document
        pair(5, role("row") & inside(F.col("node_id"), F.col("_block")) & within("_key") & within("_value"), _range("_key"), _range("_value"), F.lit(False)),
    ]
    pairs = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.withColumn("pairs", F.when(F.size(pairs) > 0, pairs)).drop(
        "_kid", "_next", "_cell", "_c1", "_c2", "_key", "_value", "_key_at", "_value_at", "_block", "_in_table", "_in_dl", "main", "roles", "parent_id")


def alias_table(spark, profile: P.SiteProfile = P.DEFAULT_PROFILE) -> DataFrame:
    """(key, key_rank, alias) of the profile, aliases normalized like labels."""
    rows = [(key, rank, a) for rank, (key, aliases) in enumerate(profile.label_aliases, start=1) for a in aliases]
    df = spark.createDataFrame(rows, "key string, key_rank int, alias string")
    return df.withColumn("alias", norm_label("alias")).filter(F.col("alias") != "")


def label_matches(aliases: DataFrame, keys, mode: str = "contains") -> dict[str, Column]:
    """JN-2: for each key the predicate "``label`` fits one of its aliases": equal, or either contains the other.

    The alias table is a profile's (tens of rows), so it is read once and compiled into an expression; pairs are
    neither shuffled nor joined, and a label that all pages share is no hot key.
    """
    return {k: F.expr(c) for k, c in label_conditions(aliases, keys, mode).items()}


def label_conditions(aliases: DataFrame, keys, mode: str = "contains", label: str = "label") -> dict[str, str]:
    """``label_matches`` as SQL on the expression ``label``."""
    rows = aliases.select("key", "alias").collect()

    def fits(key: str) -> str:
        own = [quoted(r.alias) for r in rows if r.key == key]
        conds = [f"{label} = {a}" if mode == "exact" else f"contains({label}, {a}) OR contains({a}, {label})" for a in own]
        return f"coalesce({' OR '.join(conds) or 'false'}, false)"

    return {k: fits(k) for k in keys}


def extract_metadata(pairs: DataFrame, aliases: DataFrame, mode: str = "contains", keys=None, also: dict[str, Column] | None = None) -> DataFrame:
    """EXT-13 / WIN-3 / AGG-9: first matching value per key, one column per key (NULL = none).

    ``pairs``: page_id, label, value and either ``ord`` and ``strategy`` or strategy, o1, o2.  Order: strategy (table, dl,
    div, span, detail rows), then document order.  The first value of strategies 1-4 counts, even 'Not available';
    detail rows (strategy 5) fill in where there is none or that one.  ``also``: more aggregates over all pairs, by name.
    """
    keys = keys or P.METADATA_KEYS
    m = pairs if "ord" in pairs.columns else pairs.withColumn("ord", F.struct("strategy", "o1", "o2"))
    fits = label_matches(aliases, keys, mode)
    # each label is matched once, into the bits of the keys it fits
    bits = reduce(lambda a, b: a + b, [F.when(fits[k], 1 << i).otherwise(0) for i, k in enumerate(keys)])
    m = m.withColumn("fits", bits)
    m = m if also else m.filter("fits <> 0")
    early, late = F.col("strategy") < 5, F.col("strategy") >= 5
    first = lambda i, own: F.min_by(F.col("value"), F.when(bit("fits", i) & own, F.col("ord")))
    aggs = [f for i, k in enumerate(keys, start=1) for f in (first(i, early).alias(f"_{k}"), first(i, late).alias(f"_{k}_late"))]
    open_ = lambda k: F.coalesce(F.col(f"_{k}") == NA, F.lit(True))
    chosen = [F.when(open_(k), F.coalesce(f"_{k}_late", f"_{k}")).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    return m.groupBy("page_id").agg(*aggs, *[c.alias(n) for n, c in (also or {}).items()]).select("page_id", *chosen, *(also or {}))


# ---------------------------------------------------------------------------
# One row per page
# ---------------------------------------------------------------------------
def with_siblings(alive: DataFrame) -> DataFrame:
    """WIN-5 and WIN-6 in one window operator, for elements that are not removed.

    ``next``: the next element sibling (node_id, range, whether it is a dd, whether its class is a value's).
    ``kid``: for children of a parent that has a description heading among its children: parent, place among
    the children, how many follow, the node_id of the next heading among them (null: none), whether it is a heading that
    may open a section, whether a section takes its text, its range.
    """
    w = w_siblings()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens = F.col("tag").isin(*P.DESCRIPTION_HEADING_TAGS)
    df = alive.withColumns({
        "_e": F.struct("node_id", "t0", "t1", (F.col("tag") == "dd").alias("dd"), role("like_value").alias("like_value")),
        "_h": F.when(F.col("tag").isin("h1", "h2", "h3", "h4", "h5"), F.col("node_id")),
    })
    df = df.withColumns({
        "next": F.lead("_e").over(w), "_no": F.row_number().over(w), "_n": F.count("*").over(whole),
        "_next_h": next_flagged("_h", window=SIBLINGS), "_any": F.max(opens).over(whole),
    })
    kid = F.struct(
        "parent_id", F.col("_no").alias("no"), (F.col("_n") - F.col("_no")).cast("int").alias("after"), F.col("_next_h").alias("next_h"),
        opens.alias("opens"), (~F.col("tag").isin("table", "dl")).alias("taken"), "node_id", "t0", "t1",
    )
    return df.withColumn("kid", F.when(F.col("_any") & F.col("parent_id").isNotNull(), kid)).drop("_e", "_h", "_no", "_n", "_next_h", "_any")


def page_rows(marked: DataFrame, main: DataFrame, profile: P.SiteProfile) -> DataFrame:
    """One row per page with the texts and candidates of all fields; see the module's plan, step 3."""
    texts = marked.filter("kind = 'text'").groupBy("page_id").agg(page_texts(~F.col("removed")).alias("texts"))
    df = marked.filter(is_element() & ~F.col("removed")).drop("kind", "text", "removed", "in_body", "href", "side", "main_rules")
    df = df.join(main.select("page_id", F.struct(F.col("main_id").alias("node_id"), F.col("main_end").alias("end_id")).alias("main")), "page_id", "left")
    df = with_pairs(with_siblings(df))
    at, span = F.struct("node_id", "t0", "t1"), F.struct("node_id", "end_id")
    first = lambda cond, what=at: F.min(F.when(cond, what))
    n_desc = len(P.DESCRIPTION_SELECTORS)
    page = df.groupBy("page_id").agg(
        F.flatten(F.collect_list("pairs")).alias("pairs"),
        first((F.col("tag") == "h1") & F.col("_in_main")).alias("h1"),
        first(F.col("tag") == "title").alias("head_title"),
        *[first(bit("desc", i)).alias(f"desc{i}") for i in range(1, n_desc + 1)],
        F.sort_array(F.collect_list("kid")).alias("kids"),
        F.collect_list(F.when(F.col("tag") == "img", F.struct("node_id", F.coalesce("src", F.lit("")).alias("src"), F.col("_in_main").alias("in_main")))).alias("imgs"),
        first(F.col("elem_id") == profile.image_container_id, span).alias("box1"),
        first(F.coalesce("image_box", F.lit(False)), span).alias("box2"),
    ).join(texts, "page_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    texts = F.col("texts")
    text = lambda x: text_at(texts, x["t0"], x["t1"])
    heads = F.filter(
        F.transform("kids", lambda k, i: F.struct(k.alias("k"), i.alias("i"))),
        lambda x: x["k"]["opens"] & F.exists(F.array(*map(F.lit, P.DESCRIPTION_HEADING_WORDS)), lambda w: F.lower(js_trim(text(x["k"]))).contains(w)),
    )
    # the siblings after heading i, up to the next heading
    run = lambda x: F.filter(F.slice("kids", x["i"] + 2, x["k"]["after"]), lambda k: x["k"]["next_h"].isNull() | (k["node_id"] < x["k"]["next_h"]))
    section = lambda x: F.array_join(F.filter(F.transform(F.filter(run(x), lambda k: k["taken"]), lambda k: js_trim(text(k))), lambda t: t != ""), "\n\n")
    long_enough = lambda t: F.when(F.length(t) > 20, t)
    heading = F.aggregate(
        F.sort_array(F.transform(heads, lambda x: F.struct(x["k"]["node_id"].alias("node_id"), x["k"].alias("k"), x["i"].alias("i")))),
        F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNotNull(), acc).otherwise(long_enough(norm_cell(section(x)))),
    )
    in_box = lambda box: F.filter("imgs", lambda x: F.coalesce((x["node_id"] > F.col(box)["node_id"]) & (x["node_id"] <= F.col(box)["end_id"]), F.lit(False)))
    numbered = lambda images, rank: F.transform(images, lambda x: F.struct(x["node_id"].alias("node_id"), x["src"].alias("src"), F.lit(rank).alias("rank")))
    images = (
        F.when(F.size(in_box("box1")) > 0, numbered(in_box("box1"), 1)).when(F.size(in_box("box2")) > 0, numbered(in_box("box2"), 2))
        .otherwise(numbered(F.filter("imgs", lambda x: x["in_main"]), 3))
    )
    described = [long_enough(norm_cell(text_at(texts, F.col(f"desc{i}.t0"), F.col(f"desc{i}.t1")))) for i in range(1, n_desc + 1)]
    return page.select(
        "page_id",
        F.transform("pairs", lambda p: F.struct(
            p["ord"].alias("ord"), text(p["label"]).alias("label"), text(p["value"]).alias("value"), p["short"].alias("short"))).alias("pairs"),
        text_at(texts, F.col("h1.t0"), F.col("h1.t1")).alias("h1"),
        text_at(texts, F.col("head_title.t0"), F.col("head_title.t1")).alias("head_title"),
        F.coalesce(*described, heading).alias("description"),
        images.alias("images"),
    )


def page_pairs(rows: DataFrame) -> DataFrame:
    """SET-1: (page_id, ord, strategy, label, value) of all strategies, normalized, blank ones dropped."""
    p = rows.select("page_id", F.explode("pairs").alias("p")).select("page_id", "p.*")
    ok = ~F.col("short") | (F.instr("label", ":") > 0) | (F.length(js_trim("label")) < 50)
    p = p.filter(ok).select(
        "page_id", "ord", F.shiftright("ord", 32).cast("int").alias("strategy"), norm_label("label").alias("label"),
        norm_cell("value").alias("value"),
        F.when(F.shiftright("ord", 32) == 5, norm_cell("label")).alias("key"))
    return p.filter((F.col("label") != "") & (F.col("value") != ""))


# ---------------------------------------------------------------------------
# EXT-14 titles, EXT-16 images, AGG-12 details text
# ---------------------------------------------------------------------------
def page_title(profile: P.SiteProfile, listing_title: str | None = None) -> Column:
    """EXT-14 on columns h1 and head_title: h1 in main content -> document title -> listing title -> 'Unknown Tender'."""
    h = strip_site_suffix(norm_cell(F.coalesce("h1", F.lit(""))), profile.site_names)
    d = strip_site_suffix(norm_cell(F.regexp_replace(js_trim(F.coalesce("head_title", F.lit(""))), "[ \t\n\f\r]+", " ")), profile.site_names)
    lt = norm_cell(F.col(listing_title)) if listing_title else F.lit("")
    return F.when(F.col("h1").isNotNull() & (h != ""), h).when(d != "", d).when(lt != "", lt).otherwise(F.lit(P.UNKNOWN_TITLE))


def page_images(rows: DataFrame, pages: DataFrame, profile: P.SiteProfile, url_col: str = "url") -> DataFrame:
    """EXT-16 + FLT-12/13 + AGG-11: (page_id, image_urls) distinct, in document order.

    The first source with any image is final: #id container, class container, then images of the main content whose
    resolved URL has the path marker.
    """
    imgs = rows.select("page_id", F.explode("images").alias("x")).select("page_id", "x.*").filter((js_trim("src") != "") & valid_image("src"))
    imgs = imgs.join(pages.select("page_id", F.col(url_col).alias("_purl")), "page_id", "left")
    imgs = imgs.withColumn("canon", image_resolve(F.col("src"), F.col("_purl"))).filter(F.col("canon").isNotNull())
    imgs = imgs.filter(((F.col("rank") < 3) | F.col("canon").contains(profile.image_path_marker)) & image_host_allowed("canon", profile))
    return imgs.groupBy("page_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "canon"))), lambda x: x["canon"])).alias("image_urls")
    )


def details_text() -> Column:
    """AGG-12, an aggregate over ``page_pairs``: 'key: value' lines of the detail block joined by CRLF."""
    line = F.struct("ord", F.concat_ws(": ", "key", "value").alias("line"))
    lines = F.array_sort(F.collect_list(F.when((F.col("strategy") == 5) & (F.col("key") != ""), line)))
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n")


# ---------------------------------------------------------------------------
# EXT-17 end to end
# ---------------------------------------------------------------------------
# Messages and warnings of failed pages.
FAILURES = {
    CODE_INVALID: ("The HTML input must be a string.", "Invalid HTML input type."),
    CODE_FAILED: ("Failed to parse the tender HTML.", "DOMParser threw an exception."),
    "NO_TENDER_CONTENT": ("The parsed document has no content.", "Parsed document has no document element."),
}


def parse_details(nodes: DataFrame, pages: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE,
                  listing_title: str | None = None, url_col: str = "url") -> DataFrame:
    """Parser result per page from its (unstripped) node table.

    ``pages`` carries ``page_id``, ``url_col`` and optionally the listing
    title column.  Output: page_id, 8 metadata columns (defaults applied),
    title, description, image_urls, details_text, warnings, code (``OK`` or the failure), message.

    A page without html, with empty html or that breaks the parser has its code, a message and a warning, no fields
    and no images.  A page that holds neither an element nor text has the code NO_TENDER_CONTENT and default fields.

    The marked nodes and the page rows are written as tables bucketed by ``page_id``: each later
    plan stays small and a lost executor never replays the HTML parsing.
    """
    spark = nodes.sparkSession
    marked = _materialize(marked_nodes(nodes, profile), "marked")
    rows = _materialize(page_rows(marked, main_content(marked, marked), profile), "pages")
    pairs = page_pairs(rows)
    outcome = marked.filter(F.col("kind") == "page").select("page_id", F.col("tag").alias("code"))
    out = (
        pages.select("page_id", *([listing_title] if listing_title else []))
        .join(outcome, "page_id", "left")
        .join(rows.select("page_id", "h1", "head_title", "description"), "page_id", "left")
        .join(extract_metadata(pairs, alias_table(spark, profile), profile.alias_match, also={"details_text": details_text()}), "page_id", "left")
        .join(page_images(rows, pages, profile, url_col), "page_id", "left")
    )
    return out.select(*detail_columns(profile, listing_title))


def detail_columns(profile: P.SiteProfile, listing_title: str | None = None) -> list[Column]:
    """EXT-17: the columns of ``parse_details``, defaults applied, on what was found in a page and its code."""
    failed = F.col("code").isin(CODE_INVALID, CODE_FAILED)
    field = lambda c: F.when(~failed, c)
    blank = lambda k: F.coalesce(js_trim(F.col(k)), F.lit("")) == ""
    said = lambda i: F.coalesce(*[F.when(F.col("code") == c, F.lit(v[i])) for c, v in FAILURES.items()])
    return [
        F.col("page_id"),
        *[field(F.when(blank(k), F.lit(NA)).otherwise(F.col(k))).alias(k) for k in P.METADATA_KEYS],
        field(page_title(profile, listing_title)).alias("title"),
        field(F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.lit(NA)).otherwise(truncate_text(F.col("description"), profile.description_max_chars))).alias("description"),
        F.coalesce(F.col("image_urls"), F.array().cast("array<string>")).alias("image_urls"),
        F.coalesce(F.col("details_text"), F.lit("")).alias("details_text"),
        F.filter(F.array(said(1)), lambda w: w.isNotNull()).alias("warnings"),
        F.col("code"), said(0).alias("message"),
        F.coalesce(F.length("description") > (profile.description_max_chars or (1 << 30)), F.lit(False)).alias("truncated"),
    ]


def page_details(captures: DataFrame, profile: P.SiteProfile = P.DEFAULT_PROFILE, listing_title: str | None = None, spread: bool = True) -> DataFrame:
    """EXT-17 of captures (page_id, url, html, optionally the listing title) that each have a page_id of their own.

    The columns of ``parse_details``, and after them the other columns of ``captures``.  One pass: the captures are dealt
    over all tasks (``spread``; False where they are dealt already), each task parses its pages and finds their fields
    (``page_step``), column functions judge them.  A page costs the same whatever else the table holds.
    """
    spark = captures.sparkSession
    kept = [f for f in captures.schema.fields if f.name != "html"]
    schema = T.StructType([*kept, *T.StructType.fromDDL(FIELDS).fields])
    found = (deal(captures) if spread else captures).mapInArrow(step(profile), schema)
    keys = P.METADATA_KEYS
    fits = label_conditions(alias_table(spark, profile), keys, profile.alias_match, "p.label")
    bits = " + ".join(f"if({fits[k]}, {1 << i}, 0)" for i, k in enumerate(keys))
    # the pairs of page_pairs, in order, each with the bits of the keys its label fits
    strategy = lambda p: F.shiftright(p["ord"], 32)
    asked = F.filter("pairs", lambda p: ~p["short"] | (F.instr(p["label"], ":") > 0) | (F.length(js_trim(p["label"])) < 50))
    pairs = F.transform(asked, lambda p: F.struct(
        strategy(p).cast("int").alias("strategy"), norm_label(p["label"]).alias("label"), norm_cell(p["value"]).alias("value"),
        F.when(strategy(p) == 5, norm_cell(p["label"])).alias("key")))
    found = found.withColumn("pairs", pairs)
    found = found.withColumn("pairs", F.expr(
        "transform(filter(pairs, p -> p.label <> '' AND p.value <> ''), "
        f"p -> named_struct('strategy', p.strategy, 'key', p.key, 'value', p.value, 'fits', {bits}))"))
    # extract_metadata: the first value of strategies 1-4, where there is none or 'Not available' the first of strategy 5
    first = lambda i, own: f"get(filter(pairs, p -> p.strategy {own} 5 AND (p.fits & {1 << i}) <> 0), 0).value"
    meta = {k: F.expr(f"if(coalesce({first(i, '<')} = {quoted(NA)}, true), coalesce({first(i, '>=')}, {first(i, '<')}), {first(i, '<')})") for i, k in enumerate(keys)}
    lines = F.expr("array_join(transform(filter(pairs, p -> p.strategy = 5 AND p.key <> ''), p -> concat_ws(': ', p.key, p.value)), '\\r\\n')")
    found = found.withColumns(meta | {"details_text": lines, "image_urls": image_urls(profile)})
    others = [f.name for f in kept if f.name not in ("page_id", "url", listing_title)]
    return found.select(*detail_columns(profile, listing_title), *others)


def image_urls(profile: P.SiteProfile) -> Column:
    """``page_images`` on columns ``images`` (in document order) and ``url``."""
    asked = F.filter("images", lambda x: (js_trim(x["src"]) != "") & valid_image(x["src"]))
    resolved = F.transform(asked, lambda x: F.struct(x["rank"].alias("rank"), image_resolve(x["src"], F.col("url")).alias("canon")))
    taken = F.filter(resolved, lambda x: x["canon"].isNotNull() & ((x["rank"] < 3) | x["canon"].contains(profile.image_path_marker)) & image_host_allowed(x["canon"], profile))
    return F.when(F.size("images") > 0, F.array_distinct(F.transform(taken, lambda x: x["canon"])))


def split_shared(captures: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(captures with a page_id of their own, the others or None if there are none); only ids are read to find out."""
    key = F.col("page_id").cast("long")
    shared = captures.groupBy(key.alias("_shared")).agg(F.count("*").alias("n")).filter("_shared is null or n > 1").select("_shared")
    if not shared.limit(1).count():
        return captures, None
    same = key.eqNullSafe(F.col("_shared"))
    return captures.join(shared, same, "left_anti"), captures.join(shared, same, "left_semi")


def collect_warnings(warnings: DataFrame, key: str = "page_id") -> DataFrame:
    """AGG-10: distinct warnings per key in first-seen order (``warnings``: key, ord, warning)."""
    return warnings.groupBy(key).agg(
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda x: x["warning"])
        ).alias("warnings")
    )
