"""EXT-17, the part that looks at the tree of one page: what ``page_rows`` of ``detail`` finds, for a page at a time.

A page is parsed and looked through by the task that holds its capture, so no node row is shuffled, sorted or written.
The step only finds places in the tree; labels, values, titles and URLs are judged by column functions afterwards.
Rules are the compound selectors of the profile, the same lists that ``selectors`` compiles for the node table.
"""

from __future__ import annotations

from .. import profile as P
from ..functions.text import norm_cell_str, trim_str
from ..sources.html_nodes import parse_outcome
from .selectors import _ATTR, _COMPOUND, _PART

PAIR = "struct<ord:bigint,label:string,value:string,short:boolean>"
FIELDS = f"code string, h1 string, head_title string, description string, pairs array<{PAIR}>, images array<struct<src:string,rank:int>>"
# fields of a row of ``html_nodes.parse_html``
NODE, END, PARENT, KIND, TAG, ELEM_ID, CLASS, TEXT, T0, T1, ATTRS = 0, 1, 3, 5, 6, 7, 8, 9, 11, 12, 14
_TESTS = {"=": lambda a, v: a == v, "*=": lambda a, v: v != "" and v in a, "^=": lambda a, v: v != "" and a.startswith(v), "$=": lambda a, v: v != "" and a.endswith(v)}
_OPENS = frozenset(P.DESCRIPTION_HEADING_TAGS)
_ENDS_SECTION = frozenset(("h1", "h2", "h3", "h4", "h5"))
_PLACES = frozenset(("tr", "dt", "table", "dl", "h1", "img"))
_MEMO = 20_000


def compound(selector: str) -> list[tuple]:
    """A compound selector as (kind, name, operator, value, any case) conditions."""
    m = _COMPOUND.fullmatch(selector.strip())
    if not m:
        raise ValueError(f"not a compound selector: {selector!r}")
    conds = [("tag", m["tag"].lower(), "=", "", False)] if m["tag"] and m["tag"] != "*" else []
    for part in _PART.findall(m["rest"] or ""):
        if part[0] in "#.":
            conds.append(("id" if part[0] == "#" else "class", part[1:], "=", "", False))
            continue
        a = _ATTR.match(part)
        if not a:
            raise ValueError(f"not a rule on an element alone: {selector!r}")
        name, op, value, any_case = a[1].lower(), a[2], a[3], bool(a[4])
        conds.append(("attr", name, op, value.lower() if any_case else value, any_case))
    return conds


class Rules:
    """The rules of a profile; ``of`` gives the marks of an element, remembered by tag, id, class and the attributes asked for."""

    def __init__(self, profile: P.SiteProfile) -> None:
        own = [f".{c}" for c in (profile.details_row_class, profile.details_key_class, profile.details_value_class, profile.details_block_class)]
        self.strip, self.main, self.desc, self.span, self.parts = (
            [compound(s) for s in sels] for sels in (P.STRIP_SELECTORS, P.MAIN_CONTENT_SELECTORS, P.DESCRIPTION_SELECTORS, P.LABEL_SPAN_SELECTORS, own))
        every = [c for rules in (self.strip, self.main, self.desc, self.span, self.parts) for r in rules for c in r]
        self.box_id, self.box_class = profile.image_container_id, profile.image_container_class
        self.ids = {c[1] for c in every if c[0] == "id"} | {self.box_id}
        self.attrs = sorted({c[1] for c in every if c[0] == "attr"})
        self.memo: dict = {}

    def of(self, row: list) -> tuple:
        """(strip, first main rule or 0, description bits, row, key, value, block, span, pair, like_label, like_value, in box 1, in box 2)"""
        attrs, elem_id = row[ATTRS], row[ELEM_ID]
        if attrs:
            key = (row[TAG], elem_id if elem_id in self.ids else None, row[CLASS], *[attrs.get(a) for a in self.attrs])
        else:
            key = row[TAG]
        marks = self.memo.get(key)
        if marks is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            marks = self.memo[key] = self._marks(row[TAG], elem_id, row[CLASS] or "", attrs)
        return marks

    def _marks(self, tag: str, elem_id: str | None, cls: str, attrs: dict) -> tuple:
        classes = cls.split()

        def holds(cond: tuple) -> bool:
            kind, name, op, value, any_case = cond
            if kind == "tag":
                return tag == name
            if kind == "id":
                return elem_id == name
            if kind == "class":
                return name in classes
            a = attrs.get(name)
            return a is not None and (op is None or _TESTS[op](a.lower() if any_case else a, value))

        fit = lambda rules: [all(map(holds, r)) for r in rules]
        any_of = lambda words: any(w in cls for w in words)
        main = fit(self.main)
        return (
            any(fit(self.strip)) and tag not in ("html", "body", "#document"), main.index(True) + 1 if True in main else 0,
            sum(1 << i for i, f in enumerate(fit(self.desc)) if f), *fit(self.parts), any(fit(self.span)), any_of(P.PAIR_DIV_CLASS_WORDS),
            any_of(("label", "title")) or tag in ("label", "span", "strong"), any_of(("value", "content")), elem_id == self.box_id, self.box_class in classes)


def largest_block(rows: list[list], alive: list[tuple], kept: set, lo: int, hi: int) -> list | None:
    """SRT-2: the div, section or article of the body with most elements, text >= 100 characters, no side part by id or class."""
    n_elements, n_chars, counts = 0, 0, [(0, 0)] * len(rows)
    for r in rows:
        if r[NODE] in kept:
            if r[KIND] == "text":
                n_chars += len(r[TEXT])
            else:
                n_elements += 1
        counts[r[NODE]] = (n_elements, n_chars)
    best, most = None, 0
    for r, _ in alive:
        if r[TAG] in ("div", "section", "article") and lo < r[NODE] <= hi:
            (e0, c0), (e1, c1) = counts[r[NODE]], counts[r[END]]
            if e1 - e0 > most and c1 - c0 >= 100:
                low = " ".join(x for x in (r[ELEM_ID], r[CLASS]) if x is not None).lower()
                if not ("nav" in low or "footer" in low or "sidebar" in low):
                    best, most = r, e1 - e0
    return best


def page_fields(rows: list[list], rules: Rules) -> tuple:
    """(h1, head_title, description, pairs, images) of a parsed page; rows as ``parse_html`` gives them."""
    if not rows:
        return None, None, None, [], []
    body = next((r for r in rows if r[TAG] == "body"), None)
    lo, hi = (body[NODE], body[END]) if body else (0, len(rows))
    covered, texts, alive, kept, main_at, n_kept = -1, [], [], set(), None, 0
    desc: dict[int, list] = {}
    block = head_title = box1 = box2 = None
    places, opens = [], []
    for r in rows:
        node, tag = r[NODE], r[TAG]
        if r[KIND] == "text":
            gone = node <= covered and lo < node <= hi
            texts.append("" if gone else r[TEXT])
            if not gone:
                kept.add(node)
            continue
        marks = rules.of(r)
        strip, main_rule, bits = marks[:3]
        if strip and r[END] > covered:
            covered = r[END]
        if node <= covered and lo < node <= hi:
            continue
        kept.add(node)
        alive.append((r, marks))
        if main_rule and (main_at is None or main_rule < main_at[0]):
            main_at = (main_rule, node, r[END])
        if bits:
            for i in range(len(rules.desc)):
                if bits >> i & 1:
                    desc.setdefault(i, r)
        if marks[6] and block is None:
            block = r
        if marks[11] and box1 is None:
            box1 = r
        if marks[12] and box2 is None:
            box2 = r
        if tag in _PLACES:
            places.append(r)
        elif tag == "title" and head_title is None:
            head_title = r
        if tag in _OPENS:
            opens.append(r)
    if main_at:
        main_id, main_end = main_at[1:]
    else:
        main = largest_block(rows, alive, kept, lo, hi) or body or rows[0]
        main_id, main_end = main[NODE], main[END]
    text = lambda r: "".join(texts[r[T0]:r[T1]])

    in_table, in_dl, table_end, dl_end, h1, imgs = set(), set(), -1, -1, None, []
    for r in places:
        node, tag = r[NODE], r[TAG]
        in_main = main_id < node <= main_end
        if tag == "tr":
            if node <= table_end:
                in_table.add(node)
        elif tag == "dt":
            if node <= dl_end:
                in_dl.add(node)
        elif tag == "img":
            imgs.append((node, r[ATTRS].get("src") or "", in_main))
        elif in_main:
            if tag == "table":
                table_end = max(table_end, r[END])
            elif tag == "dl":
                dl_end = max(dl_end, r[END])
            elif h1 is None:
                h1 = r

    # SET-1, from the last element to the first: what follows each one is known
    pairs: list[tuple] = []
    siblings: dict = {}
    after = cell1 = cell2 = key = value = None
    for r, marks in reversed(alive):
        node, end, tag, parent = r[NODE], r[END], r[TAG], r[PARENT]
        _, _, _, is_row, is_key, is_value, _, is_span, is_pair, _, _, _, _ = marks
        following = siblings.get(parent)
        if tag == "tr":
            if node in in_table and cell2 is not None and cell2[NODE] <= end and cell2[TAG] == "td":
                pairs.append((1, node, cell1, cell2, cell1[TAG] == "td"))
        elif tag == "dt":
            if node in in_dl and following is not None and following[0][TAG] == "dd":
                pairs.append((2, node, r, following[0], False))
        elif tag == "div" and is_pair and after is not None and after[0][PARENT] == node and main_id < node <= main_end:
            second = after[2]  # the next sibling of the first child
            if second is not None and (after[1][9] or second[1][10]):
                pairs.append((3, node, after[0], second[0], True))
        if is_span and following is not None and main_id < node <= main_end:
            pairs.append((4, node, r, following[0], False))
        if is_row and block is not None and block[NODE] < node <= block[END] and key is not None and key[NODE] <= end and value is not None and value[NODE] <= end:
            pairs.append((5, node, key, value, False))
        siblings[parent] = after = (r, marks, following and following[:2])
        if tag in ("td", "th"):
            cell1, cell2 = r, cell1
        if is_key:
            key = r
        if is_value:
            value = r
    pairs.sort(key=lambda p: p[:2])

    in_box = lambda box: [src for node, src, _ in imgs if box[NODE] < node <= box[END]] if box else []
    first, second = in_box(box1), in_box(box2)
    images = [(src, 1) for src in first] or [(src, 2) for src in second] or [(src, 3) for _, src, in_main in imgs if in_main]
    described = (norm_cell_str(text(desc[i])) for i in sorted(desc))
    description = next((t for t in described if len(t) > 20), None) or section(alive, opens, text)
    return (
        text(h1) if h1 else None, text(head_title) if head_title else None, description,
        [(s << 32 | node, text(a), text(b), short) for s, node, a, b, short in pairs], images)


def section(alive: list[tuple], opens: list[list], text) -> str | None:
    """EXT-15: the siblings after the first heading of a description, up to the next heading, if they hold over 20 characters."""
    heads = [r for r in opens if any(w in trim_str(text(r)).lower() for w in P.DESCRIPTION_HEADING_WORDS)]
    if not heads:
        return None
    children: dict = {}
    place: dict = {}
    for r, _ in alive:
        siblings = children.setdefault(r[PARENT], [])
        place[r[NODE]] = len(siblings)
        siblings.append(r)
    for head in heads:
        parts = []
        siblings = children[head[PARENT]]
        for i in range(place[head[NODE]] + 1, len(siblings)):
            r = siblings[i]
            if r[TAG] in _ENDS_SECTION:
                break
            if r[TAG] not in ("table", "dl"):
                parts.append(trim_str(text(r)))
        found = norm_cell_str("\n\n".join(p for p in parts if p))
        if len(found) > 20:
            return found
    return None


def step(profile: P.SiteProfile, html: str = "html", most_rows: int = 2_000, most_chars: int = 8_000_000):
    """The function for ``mapInArrow``: batches with a column ``html`` -> the other columns and FIELDS, in pieces of bounded size."""

    def run(batches):
        import pyarrow as pa

        rules = Rules(profile)
        for b in batches:
            pages = b.column(b.schema.get_field_index(html))
            rest = b.select([n for n in b.schema.names if n != html])
            out, begun, chars = Found(), 0, 0
            for i, page in enumerate(pages):
                page = page.as_py()
                nodes, code, _ = parse_outcome(page)
                out.add(code, *page_fields(nodes, rules))
                chars += len(page or "")
                if chars >= most_chars or i + 1 - begun >= most_rows or i + 1 == len(pages):
                    done = rest.slice(begun, i + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*done.columns, *out.columns()], [*done.schema.names, *out.NAMES])
                    out, begun, chars = Found(), i + 1, 0

    return run


class Found:
    """Fields of pages gathered as Arrow columns."""

    NAMES = ("code", "h1", "head_title", "description", "pairs", "images")

    def __init__(self) -> None:
        self.plain: list[tuple] = []
        self.pairs, self.pairs_at, self.images, self.images_at = [], [0], [], [0]

    def add(self, code: str, h1, head_title, description, pairs: list, images: list) -> None:
        self.plain.append((code, h1, head_title, description))
        self.pairs += pairs
        self.pairs_at.append(len(self.pairs))
        self.images += images
        self.images_at.append(len(self.images))

    def columns(self) -> list:
        import pyarrow as pa

        def structs(rows: list, at: list, fields: list):
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(arrays, [n for n, _ in fields]))

        pairs = structs(self.pairs, self.pairs_at, [("ord", pa.int64()), ("label", pa.string()), ("value", pa.string()), ("short", pa.bool_())])
        images = structs(self.images, self.images_at, [("src", pa.string()), ("rank", pa.int32())])
        return [*[pa.array(c, pa.string()) for c in zip(*self.plain, strict=True)], pairs, images]
