"""Plan shape: after the node table is written, page-level steps add no shuffle, no nested loop and few scans."""

import re

from pyspark.sql import functions as F

from sitesift.operators import detail as D
from sitesift.operators import listing as L
from sitesift.operators.selectors import compound_sql, with_flags, with_rules
from sitesift.operators.tree import text_of
from sitesift.plans import synth
from sitesift.plans.jobs import details_job, listings_job
from sitesift.session import materialize
from sitesift.sources.html_nodes import explode_nodes

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def scans(df):
    return len(re.findall(r"FileScan", plan(df)))


def test_page_steps_reuse_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force sort-merge joins
    try:
        d = synth.detail_pages(spark, SF)
        marked = materialize(D.marked_nodes(explode_nodes(d.select("page_id", "html"))), "test_marked")
        main = D.main_content(marked, marked)
        assert exchanges(main) == 0
        rows = D.page_rows(marked, main, D.P.DEFAULT_PROFILE)
        assert exchanges(rows) == 0
        meta = D.extract_metadata(D.page_pairs(materialize(rows, "test_rows")), D.alias_table(spark))
        assert exchanges(meta) == 0
        roots = marked.filter("tag = 'h1'").select("page_id", "node_id")
        assert exchanges(text_of(roots, marked)) == 0
        listing = materialize(L.listing_nodes(explode_nodes(synth.listing_pages(spark, SF)), D.P.DEFAULT_PROFILE), "test_listing")
        assert exchanges(L.container_rows(listing)) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_final_plans_are_small(spark):
    """The plan of each result, after its tables were written: scans counted, no nested loop, no cross product."""
    d = synth.detail_pages(spark, SF)
    details = details_job(d.select("page_id", "url", "html"))
    rows, info = listings_job(synth.listing_pages(spark, SF))
    for df, most in ((details, 12), (rows, 1), (info, 3)):
        df.collect()
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
        assert scans(df) <= most


def test_compiled_rules(spark):
    html = """<body><table><tr class="a"><td id="i">x</td></tr></table><div class="b c"><p title="Big Sale">y</p></div>
    <table><thead><tr><td>h</td></tr></thead></table></body>"""
    nodes = explode_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    sels = ["table > tbody > tr", "thead tr", "div.b.c p", '[title*="sale" i]', "#i", "td:first-child", "tr > td"]
    got = with_rules(nodes, {"m": sels}).filter("m <> 0").select("tag", "m").collect()
    assert sorted((r.tag, tuple(i for i in range(len(sels)) if r.m >> i & 1)) for r in got) == [
        ("p", (2, 3)), ("td", (4, 5, 6)), ("td", (5, 6)), ("tr", (0,)), ("tr", (1,))]
    assert with_flags(nodes, {"f": ["p", "#i"]}).filter("f").count() == 2
    assert "\\'" in compound_sql('[title="it\'s"]')
    for bad in ("a:hover", "div.x > p", "a ~ b"):
        try:
            with_rules(nodes, {"m": [bad]})
        except ValueError:
            continue
        raise AssertionError(bad)


def test_time_bucket_join_is_equi(spark):
    from sitesift.operators.batch import resolve_attempts

    s = spark.createDataFrame([(1, "i", "2024-01-01 00:00:00")], "start_id int, item_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    c = spark.createDataFrame([(2, "i", "2024-01-01 00:00:05", "complete")], "change_id int, item_id string, ts string, state string").withColumn("ts", F.to_timestamp("ts"))
    plan = resolve_attempts(s, c)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
