"""Tree operators over the node table (JN-3, JN-4, WIN-5, AGG-7, AGG-8).

Every operator here is keyed by ``page_id`` first, so on a node table that
is hash-partitioned by ``page_id`` they run without a new shuffle.  Ancestry
is interval numbering used as a data structure:

* "inside a flagged subtree" is one running ``max(end_id)`` window in
  document order (intervals nest in pre-order);
* "the first flagged node inside" is the next flagged row in document order
  (``lead ... IGNORE NULLS``), if it lies before ``end_id``;
* "the next element sibling" is the next element row of the same parent;
* ``textContent`` is a slice ``[t0, t1)`` of the page's array of text nodes;
* subtree sizes use running counts joined at ``end_id``.

All of them are linear in the nodes of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = "(PARTITION BY page_id ORDER BY node_id)"
SIBLINGS = "(PARTITION BY page_id, parent_id ORDER BY node_id)"


def w_page():
    return Window.partitionBy("page_id")


def w_doc():
    return Window.partitionBy("page_id").orderBy("node_id")


def w_siblings():
    return Window.partitionBy("page_id", "parent_id").orderBy("node_id")


def w_before():
    return w_doc().rowsBetween(Window.unboundedPreceding, -1)


def w_upto():
    return w_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_element() -> Column:
    return F.col("kind") == "element"


def is_text() -> Column:
    return F.col("kind") == "text"


def inside_flag(flag: Column, strict: bool = True) -> Column:
    """True when a node lies in the subtree of some node where ``flag`` holds.

    ``strict`` excludes the flagged node itself.  One ordered window pass.
    """
    run = F.max(F.when(flag, F.col("end_id"))).over(w_before() if strict else w_upto())
    return F.coalesce(run >= F.col("node_id"), F.lit(False))


def inside(node: Column, root: Column) -> Column:
    """Whether ``node`` (an id) is a strict descendant of ``root`` (struct with node_id, end_id); false without a root."""
    return F.coalesce((node > root["node_id"]) & (node <= root["end_id"]), F.lit(False))


def next_flagged(column: str, offset: int = 1, window: str = DOC) -> Column:
    """The ``offset``-th following non-null value of ``column`` in document order (or among siblings)."""
    return F.expr(f"lead({column}, {offset}) IGNORE NULLS OVER {window}")


def w_whole():
    """The whole page on every row, in the window operator of the document-order functions."""
    return w_doc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def in_body() -> Column:
    """Strict descendant of the page's first ``body`` (whole document if none)."""
    b = F.min(F.when(F.col("tag") == "body", F.struct("node_id", "end_id"))).over(w_whole())
    return F.when(b.isNull(), F.col("node_id") > 0).otherwise((F.col("node_id") > b["node_id"]) & (F.col("node_id") <= b["end_id"]))


def page_texts(kept: Column | None = None) -> Column:
    """Aggregate: the page's text nodes in document order as array<string>, so that ``text_at`` can slice it.

    Text nodes where ``kept`` does not hold are empty strings: ranges stay valid, their text is gone.
    """
    value = F.col("text") if kept is None else F.when(kept, F.col("text")).otherwise(F.lit(""))
    rows = F.collect_list(F.when(is_text(), F.struct(F.col("t0").alias("at"), value.alias("text"))))
    return F.transform(F.array_sort(rows), lambda x: x["text"])


def text_at(texts: Column, t0: Column, t1: Column) -> Column:
    """AGG-8: ``textContent`` of the node with the range [t0, t1); null without a node."""
    return F.when(t0.isNotNull(), F.array_join(F.slice(texts, t0 + 1, F.greatest(t1 - t0, F.lit(0))), ""))


def text_of(roots: DataFrame, nodes: DataFrame, root_col: str = "node_id", out: str = "text") -> DataFrame:
    """AGG-8 as a relation: (page_id, root_col, out) of each distinct root; roots without text get ''."""
    ranges = nodes.select("page_id", F.col("node_id").alias(root_col), "t0", "t1")
    r = roots.select("page_id", root_col).distinct().join(ranges, ["page_id", root_col], "left")
    texts = nodes.groupBy("page_id").agg(page_texts().alias("_texts"))
    return r.join(texts, "page_id", "left").select(
        "page_id", root_col, F.coalesce(text_at(F.col("_texts"), F.col("t0"), F.col("t1")), F.lit("")).alias(out)
    )


def children(parents: DataFrame, nodes: DataFrame, parent_col: str = "root_id") -> DataFrame:
    """JN-4: element children of each parent (``parents``: page_id, parent_col)."""
    p = parents.select("page_id", F.col(parent_col).alias("parent_id"))
    return nodes.filter(is_element()).join(p, ["page_id", "parent_id"]).withColumn(parent_col, F.col("parent_id"))


def next_element_sibling(nodes: DataFrame) -> DataFrame:
    """WIN-5: element rows with ``next_id`` / ``next_tag`` of the next element sibling."""
    e = nodes.filter(is_element() & F.col("parent_id").isNotNull())
    nxt = F.lead(F.struct(F.col("node_id").alias("id"), F.col("tag").alias("tag"))).over(w_siblings())
    return e.withColumn("_n", nxt).withColumn("next_id", F.col("_n.id")).withColumn("next_tag", F.col("_n.tag")).drop("_n")


def with_running_counts(nodes: DataFrame, kept: Column | None = None) -> DataFrame:
    """Running element count and text length (inclusive) in document order.

    With ``kept``, only rows where it holds are counted but every row gets
    its running values, so lookups at any ``end_id`` succeed even when the
    node there was removed.
    """
    k = F.lit(True) if kept is None else kept
    return nodes.withColumn("elem_cum", F.count(F.when(is_element() & k, 1)).over(w_upto())).withColumn(
        "text_cum", F.sum(F.when(is_text() & k, F.length("text")).otherwise(0)).over(w_upto())
    )


def subtree_stats(candidates: DataFrame, counted: DataFrame) -> DataFrame:
    """AGG-7: descendant element count and text length for each candidate element.

    ``counted`` is ``with_running_counts(nodes)``; candidates must carry
    ``node_id, end_id`` and the running counts of their own row.
    """
    at_end = counted.select(
        "page_id", F.col("node_id").alias("end_id"), F.col("elem_cum").alias("_e_end"), F.col("text_cum").alias("_t_end")
    )
    return (
        candidates.join(at_end, ["page_id", "end_id"])
        .withColumn("n_desc", (F.col("_e_end") - F.col("elem_cum")).cast("int"))
        .withColumn("text_len", (F.col("_t_end") - F.col("text_cum")).cast("bigint"))
        .drop("_e_end", "_t_end")
    )
