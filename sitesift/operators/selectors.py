"""JN-8 / WIN-4: the selector rules of a profile, compiled against the node table.

All selectors of a set of rule groups become the bits of one integer column
(``with_rules``); "which rules match this node" is a bit test, and "the first
match of a prioritized list" is one aggregate of ``min(when(bit, ...))``.

* a compound (``tag``, ``.c``, ``#i``, ``[a]``, ``[a="v"]``, ``[a*="v" i]``,
  ``:first-child``, ``:nth-child(k)``) is a predicate on one row;
* the descendant combinator ``A B`` is ``B`` and "inside a node matching A":
  one running ``max(end_id)`` for each distinct left side, all in one window pass;
* the child combinator ``A > B`` compares the tags of parent and grandparent,
  which each row carries; A is a tag, or a tag under a tag.

Only the selector subset used by site profiles is accepted; anything else
raises, so a bad rule fails at plan time, never silently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import inside_flag

_COMPOUND = re.compile(
    r"(?P<tag>[a-zA-Z][a-zA-Z0-9-]*|\*)?(?P<rest>(?:#[\w-]+|\.[\w-]+|\[[^\]]+\]|:first-child|:nth-child\(\d+\))*)"
)
_PART = re.compile(r"#[\w-]+|\.[\w-]+|\[[^\]]+\]|:first-child|:nth-child\(\d+\)")
_ATTR = re.compile(r'^\[\s*([\w-]+)\s*(?:([*^$]?=)\s*"([^"]*)"\s*(i)?)?\s*\]$')


@dataclass(frozen=True)
class Step:
    combinator: str  # '' for the first, ' ' descendant, '>' child
    compound: str


def parse_selector(sel: str) -> list[Step]:
    s = re.sub(r"\s*>\s*", ">", sel.strip())
    steps: list[Step] = []
    pos, comb = 0, ""
    while pos < len(s):
        m = _COMPOUND.match(s, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector: {sel!r}")
        steps.append(Step(comb, m.group(0)))
        pos = m.end()
        if pos < len(s):
            if s[pos] == ">":
                comb, pos = ">", pos + 1
            elif s[pos] == " ":
                comb = " "
                while pos < len(s) and s[pos] == " ":
                    pos += 1
            else:
                raise ValueError(f"unsupported selector: {sel!r}")
    return steps


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compound_sql(compound: str) -> str:
    """SQL condition of one compound selector on a node row."""
    m = _COMPOUND.fullmatch(compound)
    if not m:
        raise ValueError(f"unsupported compound: {compound!r}")
    conds = ["kind = 'element'"]
    tag = m.group("tag")
    if tag and tag != "*":
        conds.append(f"tag = {quoted(tag.lower())}")
    for part in _PART.findall(m.group("rest") or ""):
        if part.startswith("#"):
            conds.append(f"elem_id = {quoted(part[1:])}")
        elif part.startswith("."):
            conds.append(f"array_contains(classes, {quoted(part[1:])})")
        elif part == ":first-child":
            conds.append("child_index = 1")
        elif part.startswith(":nth-child("):
            conds.append(f"child_index = {int(part[len(':nth-child('):-1])}")
        else:
            a = _ATTR.match(part)
            if not a:
                raise ValueError(f"unsupported attribute selector: {part!r}")
            name, op, val, ci = a.group(1).lower(), a.group(2), a.group(3), a.group(4)
            v = f"attrs[{quoted(name)}]"
            if op is None:
                conds.append(f"{v} IS NOT NULL")
                continue
            if ci:
                v, val = f"lower({v})", val.lower()
            test = {"=": f"{v} = {quoted(val)}", "*=": f"contains({v}, {quoted(val)})", "^=": f"startswith({v}, {quoted(val)})", "$=": f"endswith({v}, {quoted(val)})"}
            conds.append(test[op] if val or op == "=" else "false")
    return "(" + " AND ".join(conds) + ")"


def compound_predicate(compound: str) -> Column:
    """Boolean column for one compound selector on a node row."""
    return F.expr(f"coalesce({compound_sql(compound)}, false)")


def split_list(selectors) -> list[str]:
    if isinstance(selectors, str):
        return [s.strip() for s in selectors.split(",") if s.strip()]
    return list(selectors)


def _own_sql(steps: list[Step]) -> tuple[str, list[Step]]:
    """Condition of the last step and the child steps before it, and the steps further left."""
    conds, at, level = [compound_sql(steps[-1].compound)], len(steps) - 1, 0
    while at > 0 and steps[at].combinator == ">":
        tag = steps[at - 1].compound
        if level > 1 or not re.fullmatch(r"[a-zA-Z][a-zA-Z0-9-]*", tag):
            raise ValueError(f"unsupported left side of '>': {tag!r}")
        conds.append(f"get(up, {level}) = {quoted(tag.lower())}")
        at, level = at - 1, level + 1
    if level and at:
        raise ValueError("a descendant combinator left of '>' is not supported")
    return " AND ".join(conds), steps[:at]


def _compiled(nodes: DataFrame, groups: dict[str, list]) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    """(nodes with helper columns, the SQL conditions of each group's selectors, the helper columns).

    Left sides of descendant combinators are shared by all selectors that have them.
    """
    left: dict[tuple, str] = {}
    df = nodes

    def condition(steps: list[Step]) -> str:
        nonlocal df
        own, before = _own_sql(steps)
        if not before:
            return f"coalesce({own}, false)"
        key = tuple(before)
        if key not in left:
            inner = condition(before)
            left[key] = f"_inside{len(left)}"
            df = df.withColumn(left[key], inside_flag(F.expr(inner)))
        return f"(coalesce({own}, false) AND {left[key]})"

    sql = {name: [condition(parse_selector(s)) for s in split_list(sels)] for name, sels in groups.items()}
    return df, sql, list(left.values())


def with_flags(nodes: DataFrame, flags: dict[str, list]) -> DataFrame:
    """Add a boolean column for each name: the node matches any selector of its list."""
    df, sql, helpers = _compiled(nodes, flags)
    return df.withColumns({name: F.expr(" OR ".join(conds) or "false") for name, conds in sql.items()}).drop(*helpers)


def with_rules(nodes: DataFrame, groups: dict[str, list]) -> DataFrame:
    """Add for each group one int column whose bit i is its i-th selector."""
    df, sql, helpers = _compiled(nodes, groups)
    mask = lambda conds: " + ".join(f"if({c}, {1 << i}, 0)" for i, c in enumerate(conds)) or "0"
    return df.withColumns({name: F.expr(mask(conds)) for name, conds in sql.items()}).drop(*helpers)


def bit(name: str, i: int) -> Column:
    """Whether a node matches the ``i``-th selector (1-based) of group ``name``, on a table of ``with_rules``."""
    return F.col(name).bitwiseAND(F.lit(1 << (i - 1))) != 0


def first_bit(name: str) -> Column:
    """1-based index of the first selector of a group that the node matches; null if none."""
    m = F.col(name)
    return F.when(m != 0, F.bit_count(m.bitwiseAND(-m) - 1) + 1)


def with_match(nodes: DataFrame, selectors, name: str) -> DataFrame:
    """Add boolean column ``name``: node matches any selector of the list."""
    return with_flags(nodes, {name: split_list(selectors)})


def with_priority(nodes: DataFrame, selectors, name: str = "priority") -> DataFrame:
    """Add ``name``: 1-based index of the first selector the node matches (null if none)."""
    return with_rules(nodes, {"_rules": selectors}).withColumn(name, first_bit("_rules")).drop("_rules")
