"""Text column functions (SC-1, SC-2, SC-3, SC-14, SC-19).

All are Catalyst expressions (``regexp_replace``/``substring``/``when``), so
they run inside whole-stage code generation over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import DESCRIPTION_MAX_CHARS, TRUNCATION_NOTE, UNKNOWN_TITLE

# Characters a JavaScript-style trim removes (Java's \s is ASCII only).
_WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_ANY_WS = f"[[^!-~]&&[{_WS}]]"  # printable ASCII is ruled out first: the class is asked at every character
_TRIM = f"^{_ANY_WS}+|{_ANY_WS}+$"
VISIBLE = f"[^{_WS}]"  # a character that such a trim keeps


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim every Unicode white space character at both ends."""
    return F.regexp_replace(_c(c), _TRIM, "")


def _spaces(c: Column) -> Column:
    # runs of space, NBSP, tab, LF and CR -> one space; a single space is no match, so ordinary text is not rebuilt
    return F.regexp_replace(c, "[\u00a0\t\n\r][ \u00a0\t\n\r]*| [ \u00a0\t\n\r]+", " ")


def if_empty(x: Column, default: str) -> Column:
    """``default`` for the empty string, without a second copy of ``x`` in the expression."""
    return F.regexp_replace(x, r"\A\z", default.replace("\\", "\\\\").replace("$", "\\$"))


def norm_ws(c) -> Column:
    """SC-1: NBSP -> space, tab/LF/CR runs -> one space, spaces collapsed, trimmed; null -> ''."""
    return F.coalesce(js_trim(_spaces(_c(c))), F.lit(""))


def norm_cell(c) -> Column:
    """SC-1 cell variant: as ``norm_ws`` but trailing colons dropped before the trim."""
    return F.coalesce(js_trim(F.regexp_replace(_spaces(_c(c)), ":+$", "")), F.lit(""))


_WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile("[\u00a0\t\n\r][ \u00a0\t\n\r]*| [ \u00a0\t\n\r]+")
_COLONS = re.compile(":+(?=[\u0085\u2028\u2029]?\\Z)")


def trim_str(s: str) -> str:
    """``js_trim`` of a Python string, for the step that looks at one page."""
    if s.endswith("\x85"):  # to a Java pattern the end is also the place before a last NEL
        return s[:-1].strip(_WS_CHARS) + "\x85"
    return s.strip(_WS_CHARS)


def norm_cell_str(s: str) -> str:
    """``norm_cell`` of a Python string."""
    return trim_str(_COLONS.sub("", _RUN.sub(" ", s), count=1))


def norm_label(c) -> Column:
    """SC-2: lower case, spaces normalized, trailing ':' then '*' dropped, '(...)' removed, trimmed."""
    x = _spaces(F.lower(_c(c)))
    x = F.regexp_replace(x, ":+$", "")
    x = F.regexp_replace(x, "\\*+$", "")
    x = F.regexp_replace(x, "\\([^)]*\\)", "")
    return F.coalesce(js_trim(x), F.lit(""))


def clean_title(c) -> Column:
    """SC-3: drop a leading 'tender for the' (any case/spacing); blank -> 'Unknown Tender'."""
    return if_empty(norm_ws(F.regexp_replace(norm_ws(c), "(?i)^\\s*tender\\s+for\\s+the\\s*", "")), UNKNOWN_TITLE)


def title_or_default(c) -> Column:
    """SC-3 fallback: normalized text or 'Unknown Tender' when blank."""
    return if_empty(norm_ws(c), UNKNOWN_TITLE)


def truncate_text(c, max_chars: int | None = DESCRIPTION_MAX_CHARS) -> Column:
    """SC-14: cut at ``max_chars`` code points (None: never), back up to a space within the last 100, add a note."""
    c = _c(c)
    if max_chars is None:
        return c
    cut = F.substring(c, 1, max_chars)
    rpos = F.instr(F.reverse(cut), " ")
    last_space0 = F.when(rpos == 0, F.lit(-1)).otherwise(F.length(cut) - rpos)  # 0-based
    shortened = F.when(
        last_space0 > max_chars - 100,
        F.left(cut, last_space0),
    ).otherwise(cut)
    return F.when(F.length(c) <= max_chars, c).otherwise(F.concat(js_trim(shortened), F.lit(TRUNCATION_NOTE)))


def strip_site_suffix(c, site_names) -> Column:
    """SC-19: remove ' | Site' / ' - Site' and everything after it (case-insensitive)."""
    alts = "|".join(re.escape(n).replace("\\ ", " ") for n in site_names)
    return js_trim(F.regexp_replace(_c(c), f"(?i)\\s*[|-]\\s*({alts}).*$", ""))
