"""URL column functions (SC-10..13, SC-16, FLT-1/2/4/12/13/14).

URL resolution is done with native expressions: a split into scheme,
authority, path, query and fragment by one regular expression, resolution of
the reference against a base, and dot-segment removal with the higher-order
``aggregate`` function.  No Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import DEFAULT_PROFILE, IMAGE_EXTENSIONS, IMAGE_STOP_PATTERNS, REJECTED_SCHEMES, SiteProfile
from ._let import let
from .text import js_trim

_URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Absolute paths and http(s) URLs that resolution leaves as they are: lower-case host, no port, no user, no empty segment,
# none that starts with a dot, no query, no fragment, nothing to escape.  They need none of the steps below.
_PLAIN_PATH = r"(?:/[A-Za-z0-9_\-][A-Za-z0-9_.~\-]*)+/?"
_PLAIN_HOST = r"[a-z0-9\-]+(?:\.[a-z0-9\-]+)*"
_SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(c) -> Column:
    # URL parsers drop leading/trailing blanks and every tab or newline.
    return F.regexp_replace(js_trim(_c(c)), "[\t\n\r]", "")


def url_parts(c) -> Column:
    """Struct of scheme (lower), authority, host (lower), port, path, query ('?...'), fragment ('#...')."""

    def build(u: Column) -> Column:
        auth = F.regexp_extract(u, _URL_RE, 3)

        def with_auth(hp: Column) -> Column:
            return F.when(
                u.rlike(_URL_RE),
                F.struct(
                    F.lower(F.regexp_extract(u, _URL_RE, 1)).alias("scheme"),
                    F.regexp_extract(u, _URL_RE, 3).alias("authority"),
                    F.lower(F.regexp_extract(hp, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
                    F.regexp_extract(hp, r"^(?:\[[^\]]*\]|[^:]*):(\d*)$", 1).alias("port"),
                    F.regexp_extract(u, _URL_RE, 4).alias("path"),
                    F.regexp_extract(u, _URL_RE, 5).alias("query"),
                    F.regexp_extract(u, _URL_RE, 6).alias("fragment"),
                ),
            )

        return let(F.regexp_replace(auth, "^.*@", ""), with_auth)

    return let(F.regexp_replace(_c(c), r"\\", "/"), build)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal on an absolute path, '' -> '/'."""

    def build(segs: Column) -> Column:
        kept = F.aggregate(
            F.slice(segs, F.lit(2), F.size(segs)),
            F.array(F.lit("")),
            lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segs, -1)
        kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return let(F.array_join(kept, "/"), lambda out: F.when(out == "", F.lit("/")).otherwise(out))

    return let(path, lambda p: F.when((p == "") | p.isNull(), F.lit("/")).otherwise(build(F.split(p, "/"))))


def _absolute(r: Column, bp: Column) -> Column:
    base_noquery = F.concat(bp["scheme"], F.lit("://"), bp["authority"], bp["path"])
    base_dir = F.regexp_replace(bp["path"], "[^/]*$", "")
    a = (
        F.when(r.rlike(_SCHEME_RE), r)
        .when(r.startswith("//"), F.concat(bp["scheme"], F.lit(":"), r))
        .when(r.startswith("/"), F.concat(bp["scheme"], F.lit("://"), bp["authority"], r))
        .when(r.startswith("?"), F.concat(base_noquery, r))
        .when(r.startswith("#"), F.concat(base_noquery, bp["query"], r))
        .when(r == "", F.concat(base_noquery, bp["query"]))
        .otherwise(
            F.concat(bp["scheme"], F.lit("://"), bp["authority"], F.when(base_dir == "", F.lit("/")).otherwise(base_dir), r)
        )
    )
    return F.when(r.rlike(_SCHEME_RE) | bp.isNotNull(), a)


def _rebuild(a: Column, p: Column) -> Column:
    special = p["scheme"].isin("http", "https", "ftp", "ws", "wss", "file")
    path = F.when(special, remove_dot_segments(F.regexp_replace(p["path"], " ", "%20"))).otherwise(p["path"])
    port = F.when(
        ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443")),
        F.lit(""),
    ).otherwise(p["port"])
    hostport = F.concat(p["host"], F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))
    rebuilt = F.concat(p["scheme"], F.lit("://"), hostport, path, p["query"], p["fragment"])
    ok_special = p.isNotNull() & special & (p["host"] != "")
    ok_other = p.isNotNull() & ~special
    return F.when(ok_special, rebuilt).when(ok_other, a)


def resolve_url(ref, base) -> Column:
    """SC-11 core: absolute URL of ``ref`` against ``base`` (either may be a column); null if impossible.

    Scheme and host are lower-cased, dot segments removed, an empty path
    becomes '/', spaces in the path become %20.
    """
    bcol = F.lit(base) if isinstance(base, str) and "://" in base else _c(base)
    any_of = lambda r: let(
        url_parts(_clean(bcol)),
        lambda bp: let(_absolute(r, bp), lambda a: let(url_parts(a), lambda p: _rebuild(a, p))),
    )
    plain_root = F.regexp_extract(bcol, rf"\A(https?://{_PLAIN_HOST})(?:{_PLAIN_PATH}|/)?\z", 1)
    return let(
        _clean(ref),
        lambda r: F.when(r.rlike(rf"\Ahttps?://{_PLAIN_HOST}{_PLAIN_PATH}\z"), r).otherwise(let(
            F.when(r.rlike(rf"\A{_PLAIN_PATH}\z"), plain_root),
            lambda root: F.when(root != "", F.concat(root, r)).otherwise(any_of(r)),
        )),
    )


def _host_in(host: Column, hosts) -> Column:
    return host.isin(*[h.lower() for h in hosts])


def canonical_url(c, base=None, profile: SiteProfile = DEFAULT_PROFILE, keep_query: bool = True) -> Column:
    """SC-10: canonical site URL or null.

    Rejects the non-web schemes, resolves against ``base`` (a page URL of the
    site, else the site root), accepts only http(s) on the profile's hosts,
    forces https and the main host, drops port and fragment; keeps the query.
    """
    site_root = F.lit(profile.base_url)
    if base is None:
        b = site_root
    else:
        dom = profile.main_host.split(".", 1)[-1] if profile.main_host.count(".") > 1 else profile.main_host
        b = let(_c(base), lambda bc: F.when(F.coalesce(url_parts(bc)["host"].contains(dom), F.lit(False)), bc).otherwise(site_root))

    def build(t: Column) -> Column:
        low = F.lower(t)
        rejected = F.lit(False)
        for s in REJECTED_SCHEMES:
            rejected = rejected | low.startswith(s)

        def fin(p: Column) -> Column:
            ok = p["scheme"].isin("http", "https") & _host_in(p["host"], profile.hosts)
            out = F.concat(F.lit("https://" + profile.main_host), p["path"], p["query"] if keep_query else F.lit(""))
            return F.when((t != "") & ~rejected & F.coalesce(ok, F.lit(False)), out)

        return let(url_parts(resolve_url(t, b)), fin)

    return let(js_trim(_c(c)), build)


def detail_id(c, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """SC-12: item id (string, leading zeros kept) from a detail URL on the site, else null."""

    def fin(p: Column) -> Column:
        return let(
            F.regexp_extract(p["path"], profile.detail_path_regex, 1),
            lambda m: F.when(F.coalesce(_host_in(p["host"], profile.hosts) & (m != "") & m.rlike("[1-9]"), F.lit(False)), m),
        )

    return let(url_parts(_c(c)), fin)


def validate_detail_url(c, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """FLT-2: struct(valid, canonical_url, tender_id); canonical URL without query and fragment."""

    def result(canon: Column, tid: Column) -> Column:
        return let(tid, lambda t: F.struct(t.isNotNull().alias("valid"), canon.alias("canonical_url"), t.alias("tender_id")))

    any_url = let(canonical_url(c, None, profile, keep_query=False), lambda canon: result(canon, detail_id(canon, profile)))
    hosts = [h.lower() for h in profile.hosts]
    if profile.main_host not in hosts:
        return any_url
    # a plain URL of the site: its path is the canonical one
    plain = rf"\Ahttps?://(?:{'|'.join(map(re.escape, hosts))})({_PLAIN_PATH})\z"

    def by_path(path: Column) -> Column:
        tid = let(F.regexp_extract(path, profile.detail_path_regex, 1), lambda m: F.when((m != "") & m.rlike("[1-9]"), m))
        return F.when(path != "", result(F.concat(F.lit("https://" + profile.main_host), path), tid)).otherwise(any_url)

    return let(F.regexp_extract(_c(c), plain, 1), by_path)


def listing_link(href, page_url, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """FLT-2 listing variant: struct(valid, url, id, reason) for a link found on a listing page."""

    def build(h: Column, t: Column, res: Column, p: Column) -> Column:
        low = F.lower(t)
        m = F.regexp_extract(p["path"], profile.detail_path_regex, 1)
        port = F.when((p["port"] == "443") | ((p["scheme"] == "http") & (p["port"] == "80")), F.lit("")).otherwise(p["port"])
        url = F.concat(
            F.lit("https://" + profile.main_host), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")), p["path"]
        )
        reason = (
            F.when(h.isNull() | (t == ""), F.lit("Empty or missing URL."))
            .when(t == "#", F.lit("Empty or hash-only URL."))
            .when(low.startswith("javascript:"), F.lit("JavaScript URL rejected."))
            .when(low.startswith("mailto:"), F.lit("Mailto URL rejected."))
            .when(low.startswith("tel:"), F.lit("Tel URL rejected."))
            .when(res.isNull(), F.lit("URL could not be parsed."))
            .when(~p["scheme"].isin("http", "https"), F.lit("Only HTTP and HTTPS URLs are accepted."))
            .when(~_host_in(p["host"], profile.hosts), F.lit("Hostname is not a supported site domain."))
            .when(m == "", F.lit("Pathname does not match a tender-detail pattern."))
            .when(~m.rlike("[1-9]"), F.lit("Tender ID is not a positive integer."))
        )
        return let(
            reason,
            lambda rs: F.struct(
                rs.isNull().alias("valid"),
                F.when(rs.isNull(), url).alias("url"),
                F.when(rs.isNull(), m).alias("id"),
                rs.alias("reason"),
            ),
        )

    base = F.coalesce(_c(page_url), F.lit(profile.base_url))
    return let(
        _c(href),
        lambda h: let(
            js_trim(h),
            lambda t: let(resolve_url(t, base), lambda res: let(url_parts(res), lambda p: build(h, t, res, p))),
        ),
    )


def classify_listing_url(c, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """FLT-1: struct(supported, page_number, reason) for a page URL."""

    def fin(p: Column) -> Column:
        parsed = F.coalesce(p.isNotNull() & p["scheme"].isin("http", "https") & (p["host"] != ""), F.lit(False))
        num = F.regexp_extract(p["path"], profile.listing_path_regex, 1)
        n = num.try_cast("bigint")
        supported = F.coalesce(parsed & (p["host"] == profile.main_host) & p["path"].rlike(profile.listing_path_regex), F.lit(False))
        reason = F.when(~parsed, F.lit("The current browser tab cannot be inspected.")).when(
            ~supported, F.lit("Please open a tender listing page of the site.")
        )
        return F.struct(
            supported.alias("supported"),
            F.when(supported & (n >= 1), n).alias("page_number"),
            reason.alias("reason"),
        )

    return let(url_parts(_clean(c)), fin)


def redirect_ok(final_url, expected_id, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """FLT-4: the final URL is a valid detail URL with the expected id."""
    return let(
        validate_detail_url(final_url, profile),
        lambda v: F.coalesce(v["valid"] & (v["tender_id"] == _c(expected_id)), F.lit(False)),
    )


def image_resolve(src, page_url) -> Column:
    """SC-11 image variant: absolute URL (http -> https, no fragment) or null."""
    return let(
        F.regexp_replace(resolve_url(src, page_url), "#.*$", ""),
        lambda r: F.when(r.startswith("http://"), F.concat(F.lit("https://"), F.substring(r, 8, 1 << 30))).otherwise(r),
    )


def valid_image(src) -> Column:
    """FLT-12 on the raw src: absolute http(s), allowed extension, no stop pattern in the file name."""
    stop = "|".join(re.escape(p) for p in IMAGE_STOP_PATTERNS)

    def fin(t: Column) -> Column:
        def on_path(pp: Column) -> Column:
            ext = F.lower(F.regexp_extract(pp, r"(\.[^.]*)$", 1))
            fname = F.lower(F.substring_index(pp, "/", -1))
            return (
                (t.startswith("http:") | t.startswith("https:"))
                & (F.instr(pp, ".") > 0)
                & ext.isin(*IMAGE_EXTENSIONS)
                & ~fname.rlike(stop)
            )

        return let(F.regexp_replace(t, "[?#].*$", ""), on_path)

    return F.coalesce(let(js_trim(_c(src)), fin), F.lit(False))


def image_host_allowed(url, profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """FLT-13: host of an absolute URL in the profile's image hosts."""
    return F.coalesce(_host_in(url_parts(_c(url))["host"], profile.image_hosts), F.lit(False))


def retryable(url) -> Column:
    """FLT-14: false for blank, unparsable or non-http(s) URLs (never retried)."""
    return let(url_parts(_clean(url)), lambda p: F.coalesce(p["scheme"].isin("http", "https") & (p["host"] != ""), F.lit(False)))


def normalize_url(c) -> Column:
    """Any-host canonical form of an absolute page URL: https, lower host, no default port, no fragment."""
    return let(
        resolve_url(c, c),
        lambda r: let(
            F.regexp_replace(r, "#.*$", ""),
            lambda x: F.when(x.startswith("http://"), F.concat(F.lit("https://"), F.substring(x, 8, 1 << 30))).otherwise(x),
        ),
    )


def image_ext(c) -> Column:
    """SC-16: '.ext' of an image URL (jpg/jpeg/png/gif/webp/bmp/svg), default '.jpg'."""
    m = F.regexp_extract(_c(c), r"(?i)\.(jpg|jpeg|png|gif|webp|bmp|svg)(\?|#|$)", 1)
    return F.when(F.coalesce(m, F.lit("")) == "", F.lit(".jpg")).otherwise(F.concat(F.lit("."), F.lower(m)))


def num_in(c) -> Column:
    """SC-13: first integer in the text, 1..100000, else null."""
    d = F.regexp_extract(js_trim(_c(c)), r"(\d+)", 1)
    n = d.try_cast("bigint")
    return F.when(n.between(1, 100000), n)


def page_in_text(c) -> Column:
    """SC-13: number after 'Page'/'page', 1..100000, else null."""
    d = F.regexp_extract(_c(c), r"[Pp]age\s*(\d+)", 1)
    n = d.try_cast("bigint")
    return F.when(n.between(1, 100000), n)


def page_in_path(c) -> Column:
    """SC-13: N from a '/tenders-N/' path, else null."""
    d = F.regexp_extract(_c(c), r"^/tenders-(\d+)/?$", 1)
    n = d.try_cast("bigint")
    return F.when(n >= 1, n)
