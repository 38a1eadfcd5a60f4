"""Column functions, table-driven (cases mirror the behaviour being reproduced)."""

from pyspark.sql import functions as F

from sitesift.functions import naming as N
from sitesift.functions import text as X
from sitesift.functions import urls as U

H = "www.tenders.example"


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("r")).first()["r"]


def many(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_whitespace_and_cells(spark):
    assert many(spark, X.norm_ws, ["  a\u00a0\t\nb   c  ", None, "\u3000x\u3000"]) == ["a b c", "", "x"]
    assert many(spark, X.norm_cell, ["Date Posted::", "Label: ", " v "]) == ["Date Posted", "Label:", "v"]
    assert many(spark, X.norm_label, ["Date Posted (PKT)*:", "  LAST\tDATE :", "Category*"]) == ["date posted", "last date", "category"]


def test_titles(spark):
    got = many(spark, X.clean_title, ["Tender for the Supply of Pumps", "  TENDER   FOR  THE  ", "Repair", None])
    assert got == ["Supply of Pumps", "Unknown Tender", "Repair", "Unknown Tender"]
    got = many(spark, lambda c: X.strip_site_suffix(c, ("Tenders", "Free Classifieds")), ["Pumps | Tenders", "Pumps - free classifieds x", "A-B"])
    assert got == ["Pumps", "Pumps", "A-B"]


def test_truncate(spark):
    long = ("word " * 20000).strip()
    r = one(spark, lambda c: X.truncate_text(c, 50000), long)
    assert r.endswith("\n\nThe description was truncated.")
    body = r[: -len("\n\nThe description was truncated.")]
    assert len(body) <= 50000 and not body.endswith(" ")
    assert one(spark, lambda c: X.truncate_text(c, 50000), "short") == "short"
    nospace = "x" * 50010
    assert one(spark, lambda c: X.truncate_text(c, 50000), nospace) == "x" * 50000 + "\n\nThe description was truncated."


def test_safe_component(spark):
    cases = {
        "a/b\\c:d": "a-b-c-d",
        "  name  ..  ": "name ",
        "con": "_con",
        "CON.txt": "_CON.txt",
        "...": "Unknown Tender",
        "- - -": "Unknown Tender",
        "trail.-": "trail",
        "-lead": "lead",
        "x" * 120 + "-": "x" * 100,
    }
    got = many(spark, N.safe_component, list(cases))
    assert got == list(cases.values())
    assert one(spark, N.safe_component, None) == "Unknown Tender"


def test_paths_and_numbers(spark):
    assert many(spark, N.safe_path, ["C:\\a\\..\\b", "/x/./y//z", "../../etc"]) == ["a/b", "x/y/z", "etc"]
    assert many(spark, N.fmt_seq, ["1", "1000", "0", "-5", "12abc", "7.9"]) == ["001", "1000", "001", "001", "012", "007"]
    assert many(spark, N.page_no, ["3", "0", "x", " 12abc", None]) == [3, 1, 1, 12, 1]
    df = spark.createDataFrame([(1,)], "n int")
    r = df.select(N.folder_name(F.lit(5), F.lit("Tender for the Supply: Pumps/Valves")).alias("f")).first()["f"]
    assert r == "005_Supply- Pumps-Valves"


def test_backoff_pct_status(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (10,)], "n int")
    got = [r["d"] for r in df.select(N.backoff_ms(F.lit(2000.0), F.col("n")).alias("d")).orderBy("n").collect()]
    assert got == [2000.0, 4000.0, 30000.0, 30000.0]
    df = spark.createDataFrame([(1, 3), (0, 0), (2, 3)], "a int, b int")
    assert [r["p"] for r in df.select(N.pct("a", "b").alias("p")).collect()] == [33, 0, 67]
    assert many(spark, N.status_code, [401, 403, 404, 429, 500], "int") == [
        "ACCESS_RESTRICTED", "ACCESS_RESTRICTED", "HTTP_ERROR", "ACCESS_RESTRICTED", "HTTP_ERROR"]


def test_resolve_and_canonical(spark):
    df = spark.createDataFrame(
        [("../c/d?q#f", "https://A.Example/x/y/z"), ("//cdn.example/i.jpg", "http://a.example/"), ("/p", "https://a.example:443/q")],
        "r string, b string",
    )
    got = [x["u"] for x in df.select(U.resolve_url(F.col("r"), F.col("b")).alias("u")).collect()]
    assert got == ["https://a.example/x/c/d?q#f", "http://cdn.example/i.jpg", "https://a.example/p"]
    canon = many(spark, lambda c: U.canonical_url(c), [
        f"http://{H}:8080/a_tenders-1.html?x=1#f", "javascript:alert(1)", "/rel_tenders-2.html", "https://evil.example/a_tenders-3.html"])
    assert canon == [f"https://{H}/a_tenders-1.html?x=1", None, f"https://{H}/rel_tenders-2.html", None]


def test_detail_url_validation(spark):
    vals = [f"https://{H}/a_tenders-0012.html?x#y", f"https://{H}/a_tenders-0.html", f"https://{H}/other.html", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r.asDict(recursive=True)["x"] for r in df.select("i", U.validate_detail_url(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got[0] == {"valid": True, "canonical_url": f"https://{H}/a_tenders-0012.html", "tender_id": "0012"}
    assert got[1]["valid"] is False and got[1]["canonical_url"] == f"https://{H}/a_tenders-0.html"
    assert got[2]["valid"] is False and got[3]["valid"] is False


def test_listing_link_reasons(spark):
    vals = ["", "#", "javascript:x()", "mailto:a@b", "https://other.example/a_tenders-1.html", "/nope.html", "/a_tenders-0.html", "/a_tenders-7.html?x=1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r["x"] for r in df.select("i", U.listing_link(F.col("v"), F.lit(f"https://{H}/tenders-2")).alias("x")).orderBy("i").collect()]
    assert [g["reason"] for g in got[:7]] == [
        "Empty or missing URL.", "Empty or hash-only URL.", "JavaScript URL rejected.", "Mailto URL rejected.",
        "Hostname is not a supported site domain.", "Pathname does not match a tender-detail pattern.",
        "Tender ID is not a positive integer."]
    assert got[7]["valid"] and got[7]["url"] == f"https://{H}/a_tenders-7.html" and got[7]["id"] == "7"


def test_listing_url_classification(spark):
    vals = [f"https://{H}/tenders", f"https://{H}/tenders-4/", f"https://{H}/jobs", "not a url"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r["x"] for r in df.select("i", U.classify_listing_url(F.col("v")).alias("x")).orderBy("i").collect()]
    assert (got[0]["supported"], got[0]["page_number"]) == (True, None)
    assert (got[1]["supported"], got[1]["page_number"]) == (True, 4)
    assert got[2]["supported"] is False and got[3]["supported"] is False


def test_images(spark):
    srcs = [f"https://{H}/images/tenders/a.JPG?x=1", f"https://{H}/images/logo.png", "/images/tenders/b.jpg",
            f"https://{H}/x.gif", f"https://{H}/images/tenders/thumbnail_1.jpg"]
    assert many(spark, U.valid_image, srcs) == [True, False, False, False, False]
    assert many(spark, U.image_ext, ["a.PNG?x", "b", "c.jpeg#y", None]) == [".png", ".jpg", ".jpeg", ".jpg"]
    assert many(spark, U.image_host_allowed, [f"https://{H}/a.jpg", "https://x.example/a.jpg"]) == [True, False]
    assert many(spark, U.retryable, ["https://a.example/x", "ftp://a.example/x", "", "nonsense"]) == [True, False, False, False]
