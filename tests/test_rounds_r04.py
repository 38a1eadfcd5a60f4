"""Findings of round 4; every test builds its own rows."""

import datetime
import random
from dataclasses import replace

from pyspark.sql import functions as F

from sitesift import profile as P
from sitesift.functions import text
from sitesift.operators import detail, page_step
from sitesift.operators.records import to_records
from sitesift.plans import catalog, jobs
from sitesift.sources import html_nodes


def facts(spark, folder, keys):
    """Tables of which ``order_facts`` makes one order a key."""
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(5, "NATION_5", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "Cust & Co", 5, "HOUSEHOLD")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(k, 1, "F", datetime.date(1995, 3, 22), "2-HIGH") for k in keys],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_documents_returns_the_documents(spark, tmp_path):
    """the document of each record is rendered and returned, with what the pages held."""
    sf = facts(spark, tmp_path, [3, 8, 9, 13])  # a late page, a good one, none captured yet, status 404
    got = {r.tender_id: r for r in catalog.q_pipeline_documents(spark, sf).collect()}
    assert set(got) == {"3", "8", "9", "13"} and all(r.has_document for r in got.values())
    lines = {k: r.content.split("\r\n") for k, r in got.items()}
    assert lines["8"] == [
        "=== Tender Details ===", "", "Tender ID: 8", "Title: Supply of 2-HIGH goods for Cust & Co", "Category: 2-HIGH", "Province: ASIA", "Location: NATION_5",
        "Subcategory: HOUSEHOLD", "Sector: F", "Newspaper: Cust & Co", "Last Date: 05 Apr 1995", "Date Posted: 22 Mar 1995", "", "Description:", "N/A", "",
        "URL: https://www.tenders.example/order_tenders-8.html", ""]
    assert "Newspaper: Late Cust & Co" in lines["3"]
    for k in ("9", "13"):
        assert "Category: N/A" in lines[k] and "Newspaper: N/A" in lines[k] and f"Tender ID: {k}" in lines[k]
    assert [got[k].outcome_code for k in ("3", "8", "9", "13")] == ["OK", "OK", None, "HTTP_ERROR"]


WORDS = ["Category", "Date Posted:", "Sector", "City", "Not available", "x" * 30, "Description", "Tender Details", "more text that is long enough to count", "a", " ", "\u0130stanbul",
         "Newspaper (daily):*", "Province / Area", "\u00e9", "&amp;", "\u0085", "text: ", "Late date"]
CLASSES = ["row", "field", "label", "value", "item", "job_detail", "row_job_detail", "job_detail_cell1", "job_detail_cell2", "description", "main-content", "navbar", "hidden", "footer",
           "sidebar", "ad-pic-cont", "field-label", "full-description", "k1 row", "detail-page label"]
TAGS = ["div"] * 4 + "span strong p table tr tr td td th dl dt dd h1 h2 h3 section article main nav footer ul li a label body script title img aside svg".split()
IMAGES = ["https://www.tenders.example/images/tenders/1.jpg", "/images/tenders/2.jpg", "", "logo.png", "//www.tenders.example/images/tenders/z.webp", "https://other.example/images/tenders/1.jpg"]
BLOCKS = [
    '<table><tr><td>Category:</td><td> Goods </td></tr><tr><th>Sector</th><td>IT</td></tr></table>', "<dl><dt>City</dt><dd>Lahore</dd></dl>",
    '<div class="job_detail"><div class="row_job_detail"><div class="job_detail_cell1">Last Date:</div><div class="job_detail_cell2"> 1 May </div></div></div>',
    '<div class="field-row"><span class="label">Newspaper:</span><span class="value">Daily</span></div>', "<h3>Details</h3><p>One long passage of text</p><p>two</p><h3>Next</h3>",
]


def random_page(rnd):
    def attrs():
        return (f' class="{rnd.choice(CLASSES)}"' if rnd.random() < 0.5 else "") + (f' id="{rnd.choice(["content", "main", "description", "ad-pic-cont", "x"])}"' if rnd.random() < 0.15 else "") + (
            rnd.choice([" hidden", ' style="display:none"', ' style="color:red"']) if rnd.random() < 0.05 else "")

    def node(depth):
        if rnd.random() < 0.12:
            return rnd.choice(BLOCKS)
        tag = rnd.choice(TAGS)
        if tag == "img":
            return f'<img src="{rnd.choice(IMAGES)}">'
        inner = "".join(node(depth - 1) if depth > 0 and rnd.random() < 0.6 else rnd.choice(WORDS) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 5)))
        return f"<{tag}{attrs()}>{inner}" + ("" if rnd.random() < 0.08 else f"</{tag}>")

    if rnd.random() < 0.04:
        return rnd.choice([None, "", " \n ", "<![x[ y ]]>z", "plain text", "<!-- c -->"])
    body = "".join(node(rnd.randint(1, 5)) for _ in range(rnd.randint(1, 7)))
    return f"<!doctype html><html><head><title>{rnd.choice(WORDS)} | Tenders</title></head><body{attrs()}>{body}</body></html>" if rnd.random() < 0.8 else body


def random_captures(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(i, f"https://www.tenders.example/x_tenders-{i}.html", f"Listing {i}", random_page(rnd)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, listed string, html string")


def by_id(df):
    return sorted(map(str, df.collect()))


def test_a_page_in_one_pass_gives_what_its_node_table_gives(spark):
    """each field of random pages, by the step on whole pages and by the plan on node rows."""
    captures = random_captures(spark, 4, 500).repartition(4).localCheckpoint()
    for profile in (P.DEFAULT_PROFILE, replace(P.DEFAULT_PROFILE, alias_match="exact", description_max_chars=60)):
        want = detail.parse_details(html_nodes.explode_nodes(captures.select("page_id", "html")), captures.drop("html"), profile, "listed")
        got = detail.page_details(captures, profile, "listed")
        assert got.columns == want.columns and by_id(got) == by_id(want)
    for some in ("details_text <> ''", "category <> 'Not available'", "size(image_urls) > 0", "truncated"):
        assert got.filter(some).count() > 3, some


def test_details_of_pages_with_their_own_id_shuffle_and_write_no_nodes(spark):
    """captures are dealt once; no table is written, nothing is hashed, sorted, joined or windowed."""
    captures = random_captures(spark, 5, 20)
    before = len(spark.catalog.listTables())
    plan = jobs.details_job(captures)._jdf.queryExecution().executedPlan().toString()
    assert len(spark.catalog.listTables()) == before and "MapInArrow" in plan
    for costly in ("hashpartitioning", "Sort", "Join", "Window", "Aggregate"):
        assert costly not in plan


def test_captures_that_share_an_id_are_still_one_page(spark):
    captures = random_captures(spark, 6, 30).withColumn("page_id", F.expr("case when page_id < 4 then 1 when page_id = 9 then null else page_id end")).localCheckpoint()
    got = jobs.details_job(captures, listing_title="listed")
    want = detail.parse_details(html_nodes.explode_nodes(captures.select("page_id", "html")), captures.drop("html"), listing_title="listed")
    assert by_id(got) == by_id(want)


def test_plain_markup_is_cut_as_the_tokenizer_cuts_it():
    rnd = random.Random(1)
    bits = ["<p>", "</p>", '<div class="a b">', "</div>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<script>", "</script>", "x<y", "&amp;", "&lt", "&", "text ", "<br/>", "<br>",
            '<img src="a&amp;b" hidden>', "<title>", "</title>", "<li>", "<!-- c -->", "<!--a-b-->", "<!doctype html>", "<![x", "<a href=x>", "<a HREF='q\"' a=\"1\" a='2'>", "<dt>", "<dd>", "<h2>",
            "<style>a<b</style>", '<script>if(a<b)"<td>x</td>"</script>', "</br>", "<x-y:z>", "<P\n class=\"k\"\t>", "</P >", "<span />", "\x00", "< b>", '<div a="1"b="2">', "</ script>", '<div a = "1">']
    plain = 0
    for _ in range(4000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))
        tree = html_nodes._TreeBuilder()
        try:
            tree.feed(page)
            want = tree.finish()
        except Exception:
            continue
        assert html_nodes.parse_html(page) == want, page
        plain += html_nodes.plain_tokens(page) is not None
    assert plain > 400


def test_text_helpers_of_the_page_step_equal_the_columns(spark):
    rnd = random.Random(3)
    letters = " a:\x85\u2028\u2029\n\r\t\xa0\x0b\x1c\u200b\u3000\u00e9\ufeff"
    rows = [("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 7))),) for _ in range(5000)]
    for r in spark.createDataFrame(rows, "x string").select("x", text.js_trim("x").alias("t"), text.norm_cell("x").alias("n")).collect():
        assert (text.trim_str(r.x), text.norm_cell_str(r.x)) == (r.t, r.n)


def test_the_page_step_yields_bounded_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(10)), "html": ["<h1>t</h1>"] * 9 + [None]})
    pieces = list(page_step.step(P.DEFAULT_PROFILE, most_rows=4)([batch]))
    assert [p.num_rows for p in pieces] == [4, 4, 2] and [x for p in pieces for x in p.column(0).to_pylist()] == list(range(10))
    assert len(list(page_step.step(P.DEFAULT_PROFILE, most_chars=25)([batch]))) == 4
    assert pieces[-1].column(1).to_pylist() == ["OK", "INVALID_HTML"]


def test_captures_are_gated_parsed_and_written_once(spark):
    """one table of captures; the rejected are not parsed, shared page ids are told apart by what the gate let through."""
    url = "https://www.tenders.example/x_tenders-%d.html"
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    page = '<body><div id="content"><table><tr><td>Category</td><td>%s</td></tr></table></div></body>'
    html = "text/html"
    rows = [
        (1, url % 1, url % 1, 200, html, page % "one", at[0]), (2, url % 1, url % 1, 404, html, page % "gone", at[1]),
        (3, url % 2, url % 2, 200, html, page % "two", at[0]), (4, url % 2, url % 2, 200, html, page % "again", at[1]),
        (5, url % 3, url % 3, 200, html, "<![x[ y ]]>z", at[0]), (6, "https://www.tenders.example/none", url % 4, 200, html, page % "no", at[0]),
        (7, url % 5, url % 5, 200, html, page % "five", at[0]), (7, url % 6, url % 6, 500, html, page % "six", at[0]),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, final_url string, status int, content_type string, html string, captured_at timestamp")
    listing = spark.createDataFrame([(i, f"Title {i}", url % i, at[2] if i != 2 else at[0]) for i in range(1, 7)],
                                    "listing_position int, original_listing_title string, detail_url string, as_of timestamp")
    listing = listing.withColumns({"city": F.lit("c"), "date_posted": F.lit("d"), "page_number": F.lit(1)})
    own = captures.filter("page_id < 7")
    before = len(spark.catalog.listTables())
    jobs.process_captures(to_records(listing), own)
    assert len(spark.catalog.listTables()) == before + 1
    got = {r.tender_id: (r.outcome_code, r.category, r.fetch_attempts) for r in jobs.process_captures(to_records(listing), captures).collect()}
    assert got == {
        "1": ("HTTP_ERROR", "Not available", 1), "2": ("OK", "two", 1), "3": ("HTML_PARSE_FAILED", "Not available", 1), "4": (None, "Not available", 0),
        "5": ("OK", "five", 1), "6": ("HTTP_ERROR", "Not available", 1)}
