"""URL columns.

``parse_url`` raises under ANSI mode and refuses some hosts, so the parts are
taken with patterns that also run in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.config import NON_PRODUCT_SEGMENTS
from shelfspark.functions.binding import let
from shelfspark.functions.text import slug

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_TAIL = r"^[^?#]*((?s:.*))$"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
#: Addresses and references that need no rewriting unless they hold a dot segment.
_CANONICAL = r"^https?://[a-z0-9.-]+/[!#-;=?-_a-z|~]*\z"
_ROOTED = r"^/([!-.0-~][!-~]*)?\z"
_BLANKS = "".join(map(chr, range(33)))
_MUST_ENCODE = "[^\\x21-\\x7e]|[\"<>`{}]"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def host_of(url: Column) -> Column:
    """Lower-case host without user or port; NULL when there is none."""
    bare = F.regexp_replace(netloc_of(url), r"^.*@|:[0-9]*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def origin_of(url: Column) -> Column:
    """``scheme://host[:port]`` in lower case."""
    return F.nullif(F.lower(F.regexp_extract(url, _ORIGIN, 1)), F.lit(""))


def product_key(url: Column) -> Column:
    """Identity of a page: host and path, no trailing slash."""
    return F.concat(host_of(url), F.rtrim(path_of(url), F.lit("/")))


def is_http(url: Column) -> Column:
    return F.coalesce(scheme_of(url).isin("http", "https") & (netloc_of(url) != ""), F.lit(False))


def bare_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[#?](?s:.*)$", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#(?s:.*)$", "")


def _encode(c: Column) -> Column:
    """Percent-encode what may not stand in a URL; already encoded text stays."""
    def one(ch: Column) -> Column:
        return (
            F.when(ch == " ", F.lit("%20"))
            .when(ch.rlike(_MUST_ENCODE), F.url_encode(ch))
            .otherwise(ch)
        )
    return F.when(
        c.rlike(_MUST_ENCODE), F.array_join(F.transform(F.split(c, ""), one), "")
    ).otherwise(c)


def _without_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments; the result starts with a slash."""
    parts = F.split(path, "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    open_end = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.ltrim(F.array_join(walked, "/"), F.lit("/"))
    joined = F.concat(F.lit("/"), joined, F.when(joined == "", F.lit("")).otherwise(open_end))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), joined).otherwise(path)


def _forward(url: Column) -> Column:
    """Backslashes before the query count as slashes."""
    slashed = F.concat(F.replace(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")), F.regexp_extract(url, _TAIL, 1))
    return F.when(F.contains(url, F.lit("\\")), slashed).otherwise(url)


def _ascii_host(netloc: Column) -> Column:
    """The host's labels in their ASCII form (IDNA); a host that has none stays as it is."""
    user, host, port = (F.regexp_extract(netloc, r"^(.*@)?([^@]*?)(:[0-9]*)?$", i) for i in (1, 2, 3))
    plain = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(netloc.rlike("[^\\x00-\\x7f]"), F.concat(user, F.coalesce(plain, host), port)).otherwise(netloc)


def canonical_url(url: Column) -> Column:
    """The one spelling used for keys and joins; NULL unless http(s) with a host.

    Lower-case scheme and host, international hosts in their ASCII form, no default or
    empty port, a path of at least ``/``, backslashes before the query as slashes, no dot
    segments, percent-encoding applied.
    """
    def spelled(given: Column) -> Column:
        u = _forward(given)
        netloc = F.regexp_replace(
            F.concat_ws("://", scheme_of(u), _ascii_host(F.lower(netloc_of(u)))), "^(http://.*):(?:80)?$|^(https://.*):(?:443)?$", "$1$2"
        )
        path = F.coalesce(F.nullif(path_of(u), F.lit("")), F.lit("/"))
        path = let(let(path, _encode), _without_dots)
        tail = let(F.regexp_extract(u, _TAIL, 1), _encode)
        return F.when(is_http(u) & host_of(u).isNotNull(), F.concat(netloc, path, tail))
    plain = url.rlike(_CANONICAL) & ~F.contains(url, F.lit("/."))
    return F.when(plain, url).otherwise(let(F.trim(url), spelled))


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against the address of its page."""
    def against(b: Column, r: Column) -> Column:
        origin = F.regexp_extract(b, _ORIGIN, 1)
        # the base's folder, "/" for a bare host, then the reference
        joined = F.concat(F.lit("/"), F.regexp_replace(path_of(b), r"[^/]*$", ""), path_of(r))
        path = F.when(r.startswith("/"), path_of(r)).otherwise(F.regexp_replace(joined, "/{2,}", "/"))
        return (
            F.when(r == "", b)
            .when(r.rlike(_SCHEME), r)
            .when(r.startswith("//"), F.concat(scheme_of(b), F.lit(":"), r))
            .when(r.startswith("?"), F.concat(bare_url(b), r))
            .when(r.startswith("#"), F.concat(without_fragment(b), r))
            .otherwise(F.concat(origin, let(path, _without_dots), F.regexp_extract(r, _TAIL, 1)))
        )
    tidy = F.regexp_replace(F.ltrim(ref, F.lit(_BLANKS)), r"[\t\r\n]", "")
    plain = ref.rlike(_ROOTED) & ~F.contains(ref, F.lit("/."))
    return F.when(plain, F.concat(F.regexp_extract(base, _ORIGIN, 1), ref)).otherwise(
        let(F.struct(base.alias("b"), tidy.alias("r")), lambda s: against(s["b"], s["r"]))
    )


def absolute_url(base: Column, ref: Column) -> Column:
    """Resolved and canonical: the address a browser would report for a link."""
    return let(let(F.trim(ref), lambda r: resolve_url(base, r)), canonical_url)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, most specific first, never a bare TLD."""
    parts = F.split(host, r"\.")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def segments_of(url: Column) -> Column:
    """Path segments; NULL when there are none or one of them is never a product."""
    def allowed(segs: Column) -> Column:
        blocked = F.exists(segs, lambda s: F.lower(s).isin(*NON_PRODUCT_SEGMENTS))
        return F.when((F.size(segs) > 0) & ~blocked, segs)
    return let(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), allowed)


def bucket_of(segments: Column) -> Column:
    """URL shape: depth and, below the top level, the first segment."""
    depth = F.size(segments)
    first = F.when(depth > 1, F.get(segments, F.lit(0))).otherwise(F.lit(""))
    return F.when(segments.isNotNull(), F.struct(depth.alias("depth"), first.alias("first_segment")))


def matches_template(url: Column, template: Column) -> Column:
    """Does the path fit a pattern such as ``/catalogue/*/index.html``?"""
    # zip_with pads the shorter side with NULL, which never fits
    pairs = F.zip_with(
        F.split(F.trim(template, F.lit("/")), "/"), segments_of(url),
        lambda p, s: F.coalesce((s.isNotNull() & (p == "*")) | (p == s), F.lit(False)),
    )
    return F.coalesce(F.forall(pairs, lambda fits: fits), F.lit(False))


def flow_id(url: Column) -> Column:
    """Listing id of a URL, read from its path only."""
    return F.nullif(F.regexp_extract(path_of(url), "/activity/([0-9]+)", 1), F.lit(""))


def detail_url(base_url: Column, name: Column, goods_id: Column) -> Column:
    """Product address made of slug and id."""
    s = slug(F.coalesce(name, F.lit("")))
    gid = goods_id.cast("string")
    path = F.when(s == "", F.concat(F.lit("/details/"), gid)).otherwise(
        F.concat(F.lit("/details/"), s, F.lit("-"), gid)
    )
    return resolve_url(base_url, path)
