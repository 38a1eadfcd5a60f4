"""HTML -> node rows: tree invariants and browser-like repairs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sitesift.sources.html_nodes import explode_nodes, parse_html, parse_outcome

TAGS = ["div", "p", "b", "span", "li", "ul", "table", "tr", "td", "a", "br", "h1", "dl", "dt", "dd"]


def tree(html):
    rows = parse_html(html)
    return [dict(id=r[0], end=r[1], depth=r[2], parent=r[3], ci=r[4], kind=r[5], tag=r[6], text=r[9], hidden=r[10], t0=r[11], t1=r[12], up=r[13]) for r in rows]


def test_script_text_and_comments():
    t = tree('<html><head><script>var t="</p>";</script></head><body><!-- c --><p>x</p></body></html>')
    script = [n for n in t if n["tag"] == "script"][0]
    kids = [n for n in t if n["parent"] == script["id"]]
    assert [k["text"] for k in kids] == ['var t="</p>";']
    assert not any(n["kind"] == "comment" for n in t)


def test_implied_end_tags_and_tbody():
    t = tree("<body><p><b>one<br><p>two</p><table><tr><td>a<td>b</table><ul><li>x<li>y</ul></body>")
    tags = [(n["tag"], n["depth"]) for n in t if n["kind"] == "element"]
    assert ("tbody", 3) in tags
    ps = [n for n in t if n["tag"] == "p"]
    assert ps[0]["parent"] == ps[1]["parent"]  # second <p> closed the first one
    lis = [n for n in t if n["tag"] == "li"]
    assert lis[0]["parent"] == lis[1]["parent"] and lis[1]["ci"] == 2
    tds = [n for n in t if n["tag"] == "td"]
    assert tds[0]["parent"] == tds[1]["parent"]


def test_hidden_is_inherited():
    t = tree('<body><div style="display: none"><span>a</span></div><div hidden><i>b</i></div><p>c</p></body>')
    hid = {n["tag"]: n["hidden"] for n in t if n["kind"] == "element"}
    assert hid["span"] and hid["i"] and not hid["p"]


def test_stray_end_tags_ignored():
    t = tree("<div></span><p>x</div></div>y")
    assert [n["text"] for n in t if n["kind"] == "text"] == ["x", "y"]


fragments = st.lists(
    st.one_of(
        st.sampled_from(TAGS).map(lambda t: f"<{t}>"),
        st.sampled_from(TAGS).map(lambda t: f"</{t}>"),
        st.text(alphabet="ab <&;", max_size=5),
    ),
    max_size=40,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(fragments)
def test_tree_invariants(html):
    t = tree(html)
    by_id = {n["id"]: n for n in t}
    assert [n["id"] for n in t] == list(range(len(t)))
    for n in t:
        assert n["id"] <= n["end"] < len(t)
        if n["parent"] is not None:
            p = by_id[n["parent"]]
            assert p["id"] < n["id"] <= p["end"]  # parents precede and enclose children
            assert n["up"][0] == p["tag"] and n["up"][1] == (by_id[p["parent"]]["tag"] if p["parent"] is not None else None)
            assert n["depth"] == p["depth"] + 1
        # the range of text nodes is that of the interval
        inside = [m["text"] for m in t[n["id"] : n["end"] + 1] if m["kind"] == "text"]
        assert inside == [m["text"] for m in t if m["kind"] == "text"][n["t0"] : n["t1"]]
        for m in t:  # intervals nest or are disjoint
            if n["id"] < m["id"] <= n["end"]:
                assert m["end"] <= n["end"]


def test_outcomes_of_odd_captures(spark):
    pages = [(1, None), (2, ""), (3, " \n "), (4, "<!-- only a comment -->"), (5, "<![x[ broken ]]>text"), (6, "<p>fine</p>"), (7, "just text")]
    codes = {1: "INVALID_HTML", 2: "HTML_PARSE_FAILED", 3: "NO_TENDER_CONTENT", 4: "NO_TENDER_CONTENT", 5: "HTML_PARSE_FAILED", 6: "OK", 7: "OK"}
    assert {i: parse_outcome(h)[1] for i, h in pages} == codes
    nodes = explode_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    got = {r.page_id: r.tag for r in nodes.filter("kind = 'page'").collect()}
    assert got == codes and nodes.filter("kind = 'page' and node_id <> -1").count() == 0


def test_unclosed_tags_cost_a_fixed_number_of_integers():
    """No list of ancestors: 2,000 unclosed tags are 2,000 rows of the same size."""
    rows = parse_html("<div>" * 2000 + "x")
    assert len(rows) == 2002 and max(len(r[13]) for r in rows) == 2
    assert not any(isinstance(v, list) for r in rows for v in r)
