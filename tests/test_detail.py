"""Detail pages of several layouts through the full extraction (greedy alias semantics)."""

import pytest

from sitesift.plans.jobs import details_job

HOST = "https://www.tenders.example"
NONE = "Not available"


def wrap(inner):
    return f"<html><head><title>Notice | Tenders</title></head><body><nav><a href='/all'>All notices</a></nav>{inner}<footer>imprint</footer></body></html>"


def table(rows, head="th"):
    return "<table>" + "".join(f"<tr><{head}>{k}</{head}><td>{v}</td></tr>" for k, v in rows) + "</table>"


HARBOUR = [("Last Date", "3 Feb 2031"), ("Newspaper", "Evening Courier"), ("Sector", "Shipping"), ("Location", "Westhaven"),
           ("Province", "Northmark"), ("Category", "Printing"), ("Date Posted", "17 Jan 2031")]
BRIDGE = [("Sub Category", "Footbridges"), ("Category", "Civil"), ("Closing Date", "1 Mar 2031"), ("Sector", "Transport"), ("Province / Area", "Eastfold")]

PAGES = {
    10: wrap(f"<div class='tender-detail'><h1>Printing of Harbour Maps</h1>{table(HARBOUR)}</div>"),
    11: wrap("<div id='content'><h1>Bridge over the Mill Stream</h1><dl>" + "".join(f"<dt>{k}</dt><dd>{v}</dd>" for k, v in BRIDGE) + "</dl></div>"),
    12: wrap("<div class='main-content'><h1>Two fields only</h1>" + table([("Newspaper:", "Morning Post"), ("Category:", "Catering")], "td")
             + "<div class='description'>Meals for forty guests on three evenings in spring.</div></div>"),
    13: wrap("""<div id="main"><h1>Mixed layout</h1><script>document.write('<td>Sector</td><td>Scripted</td>')</script>
        <div class="sidebar"><table><tr><th>Sector</th><td>Sidebar</td></tr></table></div>
        <div class="field-item"><strong>Sector</strong><span>Forestry</span></div>
        <div class="field-row"><span class="label">Date Posted:</span><span class="value">8 May 2031</span></div>
        <span class="field-label">Province</span><span>Southmoor</span>
        <div class="job_detail"><div class="row_job_detail"><div class="job_detail_cell1">City</div><div class="job_detail_cell2">Oakham</div></div>
        <div class="row_job_detail"><div class="job_detail_cell1">Last Date</div><div class="job_detail_cell2">30 May 2031</div></div></div>
        <h3>Tender Details</h3><p>Felling and replanting along the ridge path.</p><table><tr><td>left out</td></tr></table><p>Access by lorry.</p><h2>Contact</h2><p>after the end</p>
        <div id="ad-pic-cont"><img src="https://www.tenders.example/images/tenders/ridge.jpg#x"><img src="http://www.tenders.example/images/tenders/ridge.jpg">
        <img src="/images/tenders/relative.jpg"><img src="https://www.tenders.example/images/logo.jpg"><img src="https://elsewhere.example/images/tenders/y.jpg"></div></div>"""),
    14: " \n ",
    15: None,
    16: "",
    17: "<![x[ a section no browser knows ]]><h1>Never seen</h1>",
    18: "<p>No body tag, no container</p>",
    19: wrap("<div id='main'><h1>Nested</h1><table><tr><th>Sector</th><td><table><tr><th>Category</th><td>Inner</td></tr></table></td></tr></table></div>"),
    20: wrap("<div id='main'><h1>Spans</h1><p><strong class='label'>Newspaper</strong><em class='hidden'>no</em> <i>Gazette</i></p></div>"),
    21: wrap("<div id='main'><h1>Container</h1><div class='ad-pic-cont'><img src='https://www.tenders.example/images/tenders/c.png'></div></div>"),
    22: wrap("<div id='main'><h1>Plain images</h1><img src='https://www.tenders.example/images/tenders/d.png'><img src='https://www.tenders.example/other/e.png'></div>"),
}


@pytest.fixture(scope="module")
def result(spark):
    caps = spark.createDataFrame([(k, f"{HOST}/n_tenders-{k}.html", v) for k, v in PAGES.items()], "page_id long, url string, html string")
    return {r["page_id"]: r.asDict(recursive=True) for r in details_job(caps).collect()}


def test_table_with_header_cells(result):
    r, want = result[10], dict(HARBOUR)
    assert r["title"] == "Printing of Harbour Maps"
    got = {"Last Date": r["last_date"], "Newspaper": r["newspaper"], "Sector": r["sector"], "Location": r["location"],
           "Province": r["province"], "Category": r["category"], "Date Posted": r["date_posted"]}
    # the label 'last date' contains the alias 'date' and comes first; 'subcategory' contains the label 'category'
    assert got == want | {"Date Posted": want["Last Date"]}
    assert r["subcategory"] == want["Category"]
    assert r["description"] == NONE and r["image_urls"] == []


def test_definition_list_takes_the_first_label_that_matches(result):
    r = result[11]
    # the label 'sub category' contains the alias 'category' and comes first
    assert r["category"] == r["subcategory"] == "Footbridges"
    assert r["province"] == r["location"] == "Eastfold"
    assert (r["last_date"], r["sector"], r["newspaper"]) == ("1 Mar 2031", "Transport", NONE)


def test_missing_fields_and_description(result):
    r = result[12]
    assert (r["category"], r["newspaper"]) == ("Catering", "Morning Post")
    assert {r[k] for k in ("date_posted", "province", "location", "sector", "last_date")} == {NONE}
    assert r["description"] == "Meals for forty guests on three evenings in spring."


def test_mixed_layout(result):
    r = result[13]
    assert (r["date_posted"], r["sector"], r["province"], r["location"], r["last_date"]) == ("8 May 2031", "Forestry", "Southmoor", "Oakham", "30 May 2031")
    assert r["details_text"] == "City: Oakham\r\nLast Date: 30 May 2031"
    assert r["description"] == "Felling and replanting along the ridge path. Access by lorry."
    assert r["image_urls"] == [f"{HOST}/images/tenders/ridge.jpg"]


def test_blank_page_has_defaults(result):
    r = result.get(14)
    assert r is not None and r["title"] == "Unknown Tender" and r["date_posted"] == NONE
    assert r["code"] == "NO_TENDER_CONTENT"


def test_pages_that_could_not_be_parsed(result):
    """EXT-17: no page vanishes, and none of these looks like a record."""
    assert {k: result[k]["code"] for k in (15, 16, 17, 18)} == {15: "INVALID_HTML", 16: "HTML_PARSE_FAILED", 17: "HTML_PARSE_FAILED", 18: "OK"}
    for k in (15, 16, 17):
        r = result[k]
        assert r["title"] is None and r["category"] is None and r["description"] is None and r["image_urls"] == []
        assert r["message"] and len(r["warnings"]) == 1
    assert result[18]["title"] == "Unknown Tender" and result[18]["warnings"] == [] and result[18]["message"] is None
    assert result[10]["code"] == "OK"


def test_nested_tables_span_labels_and_other_image_sources(result):
    # the outer row's first two cells come first: a cell's text holds the inner table's
    assert result[19]["sector"] == "CategoryInner" and result[19]["category"] == "Inner"
    assert result[20]["newspaper"] == "Gazette"  # the hidden sibling was stripped
    assert result[21]["image_urls"] == [f"{HOST}/images/tenders/c.png"]
    assert result[22]["image_urls"] == [f"{HOST}/images/tenders/d.png"]


def test_description_limit_is_a_profile_field(spark):
    from dataclasses import replace

    from sitesift.profile import DEFAULT_PROFILE

    text = "word " * 30
    caps = spark.createDataFrame([(1, f"{HOST}/n_tenders-1.html", wrap(f"<div id='main'><div class='description'>{text}</div></div>"))], "page_id long, url string, html string")
    cut = details_job(caps, replace(DEFAULT_PROFILE, description_max_chars=60)).first()
    whole = details_job(caps, replace(DEFAULT_PROFILE, description_max_chars=None)).first()
    assert cut.truncated and cut.description.endswith("The description was truncated.")
    assert not whole.truncated and whole.description == text.strip()
