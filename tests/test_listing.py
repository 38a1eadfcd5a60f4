"""Listing page: section discovery, header/hidden/invalid rows, dedup, numbering, page number."""

from sitesift.plans.jobs import listings_job

H = "https://www.tenders.example"

LISTING = f"""<html><head><title>Tenders</title></head><body>
<h1>Latest Tenders in Pakistan</h1>
<div class="pagination"><a href="/tenders-1">1</a><li class="active"><span>3</span></li></div>
<table>
<tr><th>Title</th><th>City</th><th>Date</th></tr>
<tr style="display:none"><td><a href="{H}/x_tenders-20.html?ref=1">Hidden copy</a></td><td>HCity</td><td>1 Jan</td></tr>
<tr><td><a href="/a_tenders-10.html">Supply of Pumps</a></td><td>LAHORE</td><td>1 Jan 2026</td></tr>
<tr><td><a href="/x_tenders-20.html">Road Works</a></td><td>KARACHI</td><td>2 Jan 2026</td></tr>
<tr><td><a href="/bad_tenders-0.html">Broken</a></td><td>X</td><td>Y</td></tr>
<tr><td><a href="/c_tenders-30.html" title="From attribute"></a></td><td></td><td>3 Jan 2026</td></tr>
</table></body></html>"""

EMPTY = "<html><body><h2>Nothing here</h2><p>no table</p></body></html>"


def test_listing_rows(spark):
    caps = spark.createDataFrame([(1, f"{H}/tenders-3", LISTING), (2, f"{H}/tenders-7/", EMPTY)], "page_id long, url string, html string")
    rows, info = listings_job(caps)
    got = [r.asDict() for r in rows.orderBy("page_id", "listing_position").collect()]
    assert [(g["listing_position"], g["original_listing_title"], g["city"], g["date_posted"], g["tender_id"]) for g in got] == [
        (1, "Road Works", "KARACHI", "2 Jan 2026", "20"),  # slot of the hidden first copy, content of the visible one
        (2, "Supply of Pumps", "LAHORE", "1 Jan 2026", "10"),
        # empty 2nd cell: the 3rd cell is the first city candidate, so no date is left
        (3, "From attribute", "3 Jan 2026", "Not available", "30"),
    ]
    assert got[0]["detail_url"] == f"{H}/x_tenders-20.html"
    pages = {r["page_id"]: r.asDict() for r in info.collect()}
    assert pages[1]["page_number"] == 3 and pages[1]["detection_source"] == "pagination-element"
    assert pages[1]["tender_count"] == 3 and pages[1]["warnings"] == []
    assert pages[2]["page_number"] == 7 and pages[2]["detection_source"] == "pathname"
    assert pages[2]["tender_count"] == 0 and "could not be found" in pages[2]["warnings"][0]
