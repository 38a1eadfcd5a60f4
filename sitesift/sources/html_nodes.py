"""SRC-3: page HTML -> node rows (the DOM as a relation).

One Python step per page, run by ``mapInArrow`` on Arrow batches; every
later DOM question is a DataFrame filter, join, window or aggregate over the
rows produced here.

Node numbering is pre-order (document order).  Each element carries the
interval ``[node_id, end_id]`` of its subtree and the range ``[t0, t1)`` of
the page's text nodes inside it, so ancestry and ``textContent`` are number
comparisons and slices; a row has a fixed number of integers, however deep
the page is nested.  Text is kept in separate rows.

Next to its nodes each capture has one row of kind ``page`` (node_id -1)
whose ``tag`` is the outcome: ``OK``, ``INVALID_HTML`` (no html),
``HTML_PARSE_FAILED`` (empty html, or the tokenizer gave up; ``text`` says
why) or ``NO_TENDER_CONTENT`` (neither an element nor text).  So no capture
vanishes in this step.

The tree builder is a small browser-like layer over the standard library
tokenizer: stray end tags are ignored, unclosed elements close with their
parent, the usual implied end tags (``p li dt dd tr td th option``) and an
implied ``tbody`` are applied, comments are dropped and script/style keep
their raw text.
"""

from __future__ import annotations

import html.parser
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_ROW = -1  # node_id of the outcome row
CODE_OK, CODE_INVALID, CODE_FAILED, CODE_EMPTY = "OK", "INVALID_HTML", "HTML_PARSE_FAILED", "NO_TENDER_CONTENT"

NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType(), True),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("end_id", T.IntegerType(), False),
        T.StructField("parent_id", T.IntegerType(), True),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("child_index", T.IntegerType(), True),
        T.StructField("kind", T.StringType(), False),
        T.StructField("tag", T.StringType(), True),
        T.StructField("elem_id", T.StringType(), True),
        T.StructField("classes", T.ArrayType(T.StringType()), True),
        T.StructField("class_raw", T.StringType(), True),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("hidden", T.BooleanType(), False),
        T.StructField("t0", T.IntegerType(), False),
        T.StructField("t1", T.IntegerType(), False),
        T.StructField("parent_end", T.IntegerType(), True),
        T.StructField("up", T.ArrayType(T.StringType()), True),  # tags of parent and grandparent
    ]
)

VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
# Start tags that close an open <p> (HTML "closes a p element in button scope").
P_CLOSERS = frozenset(
    (
        "address article aside blockquote center details dialog dir div dl fieldset "
        "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main "
        "menu nav ol p pre section table ul"
    ).split()
)
SCOPE_BOUNDARY = frozenset("applet caption html table td th marquee object template button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_SECTIONS = frozenset(("tbody", "thead", "tfoot"))
TABLE_SECTIONS_AND_TABLE = TABLE_SECTIONS | {"table"}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CELL_OR_ROW = ("tr", "td", "th")
# A start tag ends the nearest open element of the first tags, unless one of the second set lies between.
IMPLIED_ENDS = {
    "li": (("li",), SCOPE_BOUNDARY | {"ul", "ol"}), "dt": (("dt", "dd"), SCOPE_BOUNDARY | {"dl"}), "dd": (("dt", "dd"), SCOPE_BOUNDARY | {"dl"}),
    "a": (("a",), SCOPE_BOUNDARY), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (_CELL_OR_ROW, TABLE_SECTIONS_AND_TABLE), **{t: ((*TABLE_SECTIONS, *_CELL_OR_ROW), frozenset(("table",))) for t in TABLE_SECTIONS},
}

# Plain markup, which the tokenizer takes the same way in all its versions: tags with quoted or no values, text,
# doctypes, comments without dashes or angles, scripts and styles without "<!" and without a second end tag of theirs.
_SP = r"[ \t\n\r\f]"
_ATTRS = rf"""(?:{_SP}++[a-zA-Z_][-a-zA-Z0-9_:.]*+(?:=(?:"[^"]*+"|'[^']*+'))?)*+"""
_PLAIN = re.compile(
    rf"(<(script|style)({_ATTRS}){_SP}*+>((?:[^<]++|<(?!!|/\s*(?:script|style)))*+)</(script|style)>"
    rf"|<([a-zA-Z][-a-zA-Z0-9_:]*+)({_ATTRS}){_SP}*+(/?)>|</([a-zA-Z][-a-zA-Z0-9_:]*+)>|([^<]++)|<!doctype[ ][^<>]*+>|<!--[^-<>]*+-->)", re.I)
_ATTR = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*+)(?:="([^"]*+)"|='([^']*+)')?""")
_TEXT_ONLY = frozenset(("textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"))  # tags are text in them, in some versions
_unescape_value = getattr(html.parser, "_unescape_attrvalue", unescape)


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # parallel lists, one entry per node
        self.rows: list[list] = []
        # stack of (tag, node_index)
        self.stack: list[tuple[str, int]] = []
        self.child_count: dict[int, int] = {}
        self.n_text = 0
        self.open: dict[str, int] = {}  # how many elements of a tag are open: no walk up the stack for a tag that is not
        self.push(("#document", self._new("element", "#document", {}, None)))

    # -- node creation ---------------------------------------------------
    def _new(self, kind: str, tag: str | None, attrs: dict, text: str | None) -> int:
        rows = self.rows
        nid = len(rows)
        child_index = None
        element = kind == "element"
        if self.stack:
            parent = self.stack[-1][1]
            prow = rows[parent]
            depth = prow[2] + 1
            hidden = prow[10]
            above = prow[13]
            up = (prow[6], above[0] if above else None)
            if element:
                child_index = self.child_count.get(parent, 0) + 1
                self.child_count[parent] = child_index
        else:
            parent, depth, hidden, up = None, 0, False, ()
        t0 = self.n_text
        if not element:
            self.n_text = t0 + 1
            rows.append([nid, nid, depth, parent, None, kind, None, None, None, text, hidden, t0, t0 + 1, up, attrs])
            return nid
        if not attrs:
            rows.append([nid, nid, depth, parent, child_index, kind, tag, None, None, text, hidden, t0, t0, up, attrs])
            return nid
        # FLT-11: hidden attribute or inline display:none / visibility:hidden, inherited
        if not hidden:
            hidden = "hidden" in attrs or "style" in attrs and bool(_HIDDEN_STYLE.search(attrs["style"]))
        # [node_id, end_id, depth, parent, child_index, kind, tag, id, class_raw, text, hidden, t0, t1, up, attrs]
        rows.append([nid, nid, depth, parent, child_index, kind, tag, attrs.get("id"), attrs.get("class"), text, hidden, t0, t0, up, attrs])
        return nid

    def _close_to(self, idx: int) -> None:
        """Pop the stack down to and including position ``idx``."""
        rows, stack, n_text = self.rows, self.stack, self.n_text
        last = len(rows) - 1
        while len(stack) > idx:
            tag, nid = stack.pop()
            self.open[tag] -= 1
            row = rows[nid]
            row[1] = last
            row[12] = n_text

    def push(self, item: tuple[str, int]) -> None:
        self.stack.append(item)
        self.open[item[0]] = self.open.get(item[0], 0) + 1

    def _find(self, tags, boundary) -> int:
        is_open = self.open
        for t in tags:
            if is_open.get(t):
                break
        else:
            return -1
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i][0]
            if t in tags:
                return i
            if t in boundary:
                return -1
        return -1

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not wanted

    # -- tokenizer callbacks ---------------------------------------------
    def handle_starttag(self, tag, attrs_list):
        attrs: dict = {}
        for k, v in attrs_list:
            if k not in attrs:
                attrs[k] = "" if v is None else v
        self.start(tag, attrs)

    def start(self, tag: str, attrs: dict) -> None:
        stack = self.stack
        if tag in P_CLOSERS and self.open.get("p"):
            i = self._find(("p",), SCOPE_BOUNDARY)
            if i > 0:
                self._close_to(i)
        if tag in IMPLIED_ENDS:
            i = self._find(*IMPLIED_ENDS[tag])
            if i > 0:
                self._close_to(i)
            if tag == "tr" and stack[-1][0] == "table":
                self.push(("tbody", self._new("element", "tbody", {}, None)))
        elif tag in HEADINGS:
            if stack[-1][0] in HEADINGS:
                self._close_to(len(stack) - 1)
        elif tag == "option":
            if stack[-1][0] == "option":
                self._close_to(len(stack) - 1)
        nid = self._new("element", tag, attrs, None)
        if tag not in VOID_TAGS:
            self.push((tag, nid))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack and self.stack[-1][0] == tag:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if not self.open.get(tag):
            return  # stray end tag: ignored
        if self.stack[-1][0] == tag:
            if len(self.stack) > 1:
                self._close_to(len(self.stack) - 1)
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._close_to(i)
                return

    def handle_data(self, data):
        if not data:
            return
        top = self.stack[-1][1]
        last = self.rows[-1]
        # merge with an immediately preceding text sibling
        if last[5] == "text" and last[3] == top:
            last[9] += data
            return
        self._new("text", None, {}, data)

    def finish(self) -> list[list]:
        self.close()
        self._close_to(0)
        return self.rows


def plain_tokens(page: str) -> list[tuple] | None:
    """The tokens of a page of plain markup (groups of ``_PLAIN``); None: the tokenizer has to look at it."""
    tokens = _PLAIN.findall(page)
    if sum([len(t[0]) for t in tokens]) != len(page):
        return None
    for i, t in enumerate(tokens):
        tag = t[5] or t[1]
        if not tag or len(tag) < 3:  # no name in these rules is shorter
            continue
        tag = t[5].lower()
        if t[1] and t[1].lower() != t[4].lower() or tag in ("script", "style") and not t[7]:
            return None
        if tag in _TEXT_ONLY:
            # the element's end has to come next, or after one text
            ends = [x[8].lower() == tag for x in tokens[i + 1:i + 3]]
            if t[7] or not (ends[:1] == [True] or ends[1:] == [True] and tokens[i + 1][9]):
                return None
    return tokens


def _attrs(source: str) -> dict:
    attrs: dict = {}
    for name, double, single in _ATTR.findall(source):
        name = name.lower()
        if name not in attrs:
            value = double or single
            attrs[name] = _unescape_value(value) if "&" in value else value
    return attrs


def parse_html(page: str) -> list[list]:
    """Rows of one page (see ``_TreeBuilder._new`` for the field order).

    Pages of plain markup are cut by one expression, others by the tokenizer; the tree builder is the same.
    """
    b = _TreeBuilder()
    tokens = plain_tokens(page)
    if tokens is None:
        b.feed(page)
        return b.finish()
    start, end, data = b.start, b.handle_endtag, b.handle_data
    for _, raw, raw_attrs, raw_text, _, tag, attrs, empty, ended, text in tokens:
        if text:
            data(unescape(text) if "&" in text else text)
        elif ended:
            end(ended.lower())
        elif tag:
            tag = tag.lower()
            if empty:
                b.handle_startendtag(tag, list(_attrs(attrs).items()))
            else:
                start(tag, _attrs(attrs) if attrs else {})
        elif raw:
            raw = raw.lower()
            start(raw, _attrs(raw_attrs) if raw_attrs else {})
            data(raw_text)
            end(raw)
    return b.finish()


def parse_outcome(html) -> tuple[list[list], str, str | None]:
    """(node rows, outcome code, why) of one capture; never raises."""
    if not isinstance(html, str):
        return [], CODE_INVALID, "no html"
    if not html:
        return [], CODE_FAILED, "empty html"
    try:
        rows = parse_html(html)
    except Exception as e:  # one page never fails the job; its outcome row says so
        return [], CODE_FAILED, f"{type(e).__name__}: {e}"[:200]
    if not any(r[5] == "element" and r[0] or r[5] == "text" and r[9].strip() for r in rows):
        return rows, CODE_EMPTY, None
    return rows, CODE_OK, None


class _Columns:
    """Node rows gathered as Arrow columns."""

    PLAIN = 13  # leading fields of a row that are columns as they are

    def __init__(self) -> None:
        self.page_id: list = []
        self.plain: list[list] = [[] for _ in range(self.PLAIN)]
        self.class_at, self.class_values = [0], []
        self.attr_at, self.attr_keys, self.attr_values = [0], [], []
        self.parent_end: list = []
        self.up: list = []

    def add(self, page_id, rows: list[list], code: str, why: str | None) -> None:
        page = [PAGE_ROW, PAGE_ROW, -1, None, None, "page", code, None, None, why, False, 0, 0, (), {}]
        self.parent_end.append(None)
        self.parent_end += [None if r[3] is None else rows[r[3]][1] for r in rows]
        rows = [page, *rows]
        self.page_id += [page_id] * len(rows)
        *plain, up, attrs = zip(*rows, strict=True)
        for column, values in zip(self.plain, plain, strict=True):
            column += values
        self.up += up
        for cls in plain[8]:
            if cls:
                self.class_values += cls.split()
            self.class_at.append(len(self.class_values))
        for a in attrs:
            if a:
                self.attr_keys += a.keys()
                self.attr_values += a.values()
            self.attr_at.append(len(self.attr_keys))

    def batch(self):
        import pyarrow as pa

        ints, strings = pa.int32(), pa.string()
        types = [ints, ints, ints, ints, ints, strings, strings, strings, strings, strings, pa.bool_(), ints, ints]
        node, end, depth, parent, child, kind, tag, elem_id, cls, text, hidden, t0, t1 = [pa.array(c, t) for c, t in zip(self.plain, types, strict=True)]
        offsets = lambda x: pa.array(x, ints)
        classes = pa.ListArray.from_arrays(offsets(self.class_at), pa.array(self.class_values, strings))
        attrs = pa.MapArray.from_arrays(offsets(self.attr_at), pa.array(self.attr_keys, strings), pa.array(self.attr_values, strings))
        columns = [pa.array(self.page_id, pa.int64()), node, end, parent, depth, child, kind, tag, elem_id, classes, cls, attrs, text, hidden, t0, t1,
                   pa.array(self.parent_end, ints), pa.array(self.up, pa.list_(strings))]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in NODE_SCHEMA])


def _explode_batches(batches, chunk: int = 20000):
    """Arrow batches of (page_id, html) -> Arrow batches of node rows."""
    out = _Columns()
    for rb in batches:
        ids = rb.column(rb.schema.get_field_index("page_id")).to_pylist()
        htmls = rb.column(rb.schema.get_field_index("html"))
        for page_id, html in zip(ids, htmls, strict=True):
            out.add(page_id, *parse_outcome(html.as_py()))
            if len(out.up) >= chunk:
                yield out.batch()
                out = _Columns()
    if out.up:
        yield out.batch()


def explode_nodes(captures: DataFrame, num_partitions: int | None = None, spread: bool = True) -> DataFrame:
    """SRC-3: one row per element/text node and an outcome row per capture, hash-partitioned by ``page_id``.

    Only ``(page_id, html)`` enter the Python step; the html never travels
    past it.  The result is partitioned by ``page_id`` and sorted by
    ``(page_id, node_id)`` inside each partition, so every later per-page
    join, window and aggregate reuses this single shuffle.

    The parse is the costly step: with ``spread`` its input is dealt
    round-robin over ``num_partitions`` tasks, so one large file or a few
    join partitions keep all cores busy.  Pass False where the input has
    many splits of its own.
    """
    spark = captures.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("html"))
    if spread:
        src = src.repartition(n)
    nodes = src.mapInArrow(_explode_batches, NODE_SCHEMA)
    return nodes.repartition(n, "page_id").sortWithinPartitions("page_id", "node_id")


def page_outcomes(nodes: DataFrame) -> DataFrame:
    """(page_id, code, why): the outcome of each capture's parse."""
    return nodes.filter(F.col("kind") == "page").select("page_id", F.col("tag").alias("code"), F.col("text").alias("why"))
