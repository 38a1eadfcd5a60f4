"""Cost a row: work done once, spread over the tasks, and little left on disk."""

import os

from pyspark.sql import functions as F

from sitesift.functions.naming import safe_component
from sitesift.functions.urls import validate_detail_url
from sitesift.operators.records import to_records
from sitesift.plans.catalog import QUERIES
from sitesift.sources import files


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folder_names_spread_over_tasks(spark, tmp_path):
    parts = spark.range(40).select(F.col("id").alias("p_partkey"), F.format_string("part %d", "id").alias("p_name"), F.lit(3).alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["folder_names"](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_safe_component_is_not_copied(spark):
    df = spark.range(1).select(safe_component(F.format_string("part of the name %d", "id")).alias("x"))
    assert plan_of(df).count("part of the name") == 1


def test_records_judge_each_url_once(spark):
    url = F.format_string("https://www.tenders.example/x_tenders-%d.html", "id").alias("detail_url")
    base = spark.range(3).select(url)
    listing = base.select("*", *[F.lit("a").alias(c) for c in ("listing_position", "original_listing_title", "city", "date_posted", "page_number")])
    rule = r"_tenders-(\d"
    once = plan_of(base.select(validate_detail_url("detail_url").alias("v"))).count(rule)
    assert plan_of(to_records(listing).select("tender_id", "detail_url")).count(rule) == once > 0
    assert [r.tender_id for r in to_records(listing).orderBy("tender_id").collect()] == ["1", "2"]  # 0 is no id


def test_plain_and_odd_urls(spark):
    urls = {
        "http://tenders.example/a/x_tenders-07.html": ("https://www.tenders.example/a/x_tenders-07.html", "07"),
        "https://www.tenders.example/a/../x_tenders-7.html?q#f": ("https://www.tenders.example/x_tenders-7.html", "7"),
        "/x_tenders-0.html": ("https://www.tenders.example/x_tenders-0.html", None),
        "https://other.example/x_tenders-7.html": (None, None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", validate_detail_url("u").alias("v"))
    assert {r.u: (r.v.canonical_url, r.v.tender_id) for r in df.collect()} == urls


def test_staging_makes_no_folder_a_document(spark, tmp_path):
    rows = [{"path": f"b/{i:03d}/Tender.txt", "content": f"text {i}"} for i in range(50)]
    job = f"file://{tmp_path}/_jobs/j"
    assert files.write_attempt(iter(rows), job, "a") == 50
    assert sum(len(d) for _, d, _ in os.walk(tmp_path / "_jobs" / "j" / "a")) <= 2
    assert sorted(files.publish_attempt(f"file://{tmp_path}", job, "a")) == [(r["path"], len(r["content"])) for r in rows]
    assert (tmp_path / "b" / "007" / "Tender.txt").read_text() == "text 7"


def test_long_methods_are_not_interpreted(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
