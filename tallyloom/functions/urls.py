"""URL canonical forms and checks. The five forms disagree on purpose; none calls another's rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, by canonical form.
TRACKING_A = ("fbclid", "gclid")
TRACKING_B = ("cooper", "plink")
TRACKING_C = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


#: The same as a replacement that leaves the four parts between number signs, which none of them can hold; nothing but those where it isn't one.
_APART = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$(?s:.*)|(?s:.*))\z"


def part(u: Column, i: int) -> Column:
    """Scheme, authority, path or query of an absolute URL (1 to 4)."""
    return F.regexp_extract(u, _PARTS, i)


def host(u: Column) -> Column:
    """Lower-case host without user information and port."""
    return _host(part(u, 2))


def _host(authority: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _key(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def _rebuilt(scheme: Column, authority: Column, path: Column, pairs: Column) -> Column:
    query = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _with_equals(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))


def _taken_apart(u: Column, made: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """What is made of the four parts of a URL that :func:`part` gives, which is taken apart once for all of them."""
    parts = F.split(F.regexp_replace(u, _APART, "$1#$2#$3#$4"), "#")
    return F.get(F.transform(F.array(parts), lambda p: made(*(F.get(p, F.lit(i)) for i in range(4)))), F.lit(0))


def _public(u: Column, scheme: Column, authority: Column) -> Column:
    """:func:`is_public` of a URL that was taken apart. Without user information, the host is the authority without its port."""
    h = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    named = F.contains(authority, F.lit(".")) & ~F.contains(authority, F.lit("@")) & ~F.contains(authority, F.lit("["))
    return (u == F.trim(u)) & F.lower(scheme).isin("http", "https") & named & ~h.rlike(r"(\.|\.local|\.localhost)$|^\d{1,3}(\.\d{1,3}){3}$")


def canonical_sorted(u: Column) -> Column:
    """Form A: lower scheme and authority, no final slash, no tracking keys, sorted query with blanks, no fragment."""

    def made(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
        pairs = F.filter(_with_equals(_pairs(query)), lambda p: ~_key(p).startswith("utm_") & ~_key(p).isin(*TRACKING_A))
        return F.when(_public(u, scheme, authority), _rebuilt(F.lower(scheme), F.lower(authority), F.rtrim(path, F.lit("/")), F.array_sort(pairs)))

    return _taken_apart(u, made)


def canonical_ordered(u: Column) -> Column:
    """Form B: lower authority, query in order without blank values and tracking keys; path parameters dropped."""

    def made(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
        pairs = F.filter(_pairs(query), lambda p: p.rlike("=.") & ~_key(p).startswith("utm_") & ~_key(p).isin(*TRACKING_B))
        bare = F.rtrim(F.regexp_replace(path, r";[^/]*$", ""), F.lit("/"))
        named = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "") != ""
        ok = F.lower(scheme).isin("http", "https") & named & ~F.contains(authority, F.lit("@"))
        return F.when(ok, _rebuilt(F.lower(scheme), F.lower(authority), bare, pairs))

    return _taken_apart(u, made)


def canonical_plain(u: Column) -> Column:
    """Form C: default ports dropped, six tracking keys dropped, sorted query, ``/`` for an empty path; entities in ``&amp;`` decoded."""
    v = F.regexp_replace(F.trim(u), "&amp;", "&")
    pairs = F.filter(_with_equals(_pairs(part(v, 4))), lambda p: ~F.lower(_key(p)).startswith("utm_") & ~F.lower(_key(p)).isin(*TRACKING_C))
    scheme = F.lower(part(v, 1))
    port = F.regexp_extract(part(v, 2), r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.rtrim(part(v, 3), F.lit("/"))
    authority = F.concat(host(v), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    known = post_number(v)
    plain = _rebuilt(scheme, authority, F.when(path == "", F.lit("/")).otherwise(path), F.array_sort(pairs))
    return F.when(scheme.isin("http", "https") & (host(v) != ""), F.when(known.isNotNull(), F.concat(F.lit("https://aagag.com/issue/?idx="), known)).otherwise(plain))


def without_fragment(u: Column) -> Column:
    """Form D: only the fragment is dropped."""
    return F.regexp_replace(u, "#.*$", "")


def image_key(u: Column) -> Column:
    """Form E: lower scheme and authority, no fragment; the rest as it is."""
    rest = F.concat(part(u, 3), F.when(F.contains(without_fragment(u), F.lit("?")), F.concat(F.lit("?"), part(u, 4))).otherwise(F.lit("")))
    return F.concat(F.lower(part(u, 1)), F.lit("://"), F.lower(part(u, 2)), rest)


def is_public(u: Column) -> Column:
    """http(s), a dotted host that is no address and not local, no user information, no blanks around."""
    return F.coalesce(_taken_apart(u, lambda scheme, authority, path, query: _public(u, scheme, authority)), F.lit(False))


def is_safe(u: Column) -> Column:
    """http(s) without user information."""
    return F.coalesce(F.lower(part(u, 1)).isin("http", "https") & (host(u) != "") & ~F.contains(part(u, 2), F.lit("@")), F.lit(False))


def query_value(u: Column, key: str) -> Column:
    """Values of a key in the query, as an array."""
    return F.transform(F.filter(_pairs(part(u, 4)), lambda p: _key(p) == key), lambda p: F.substring_index(p, "=", -1))


def post_number(value: Column) -> Column:
    """The canonical number of a post from its id or its URL on the aggregator; null elsewhere."""
    is_url = F.contains(value, F.lit("://"))
    own = F.regexp_replace(host(value), r"^www\.", "") == "aagag.com"
    raw = F.when(is_url, F.when(own, F.try_element_at(query_value(value, "idx"), F.lit(-1)))).otherwise(F.trim(value))
    return F.nullif(F.regexp_extract(raw, r"^(?:aagag[-_])?(\d+)(?:[_-]\d+)?$", 1), F.lit(""))


def post_identity(u: Column) -> Column:
    """``aagag-<n>`` for a strict https issue URL with one ``idx`` of digits and an optional revision."""

    def made(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
        values = F.transform(F.filter(_pairs(query), lambda p: _key(p) == "idx"), lambda p: F.substring_index(p, "=", -1))
        here = (scheme == "https") & (_host(authority) == "aagag.com") & (F.rtrim(path, F.lit("/")) == "/issue")
        one = lambda v: F.when((F.size(v) == 1) & F.get(v, F.lit(0)).rlike(r"^\d+(_\d+)?$"), F.concat(F.lit("aagag-"), F.split_part(F.get(v, F.lit(0)), F.lit("_"), F.lit(1))))
        return F.when(here, F.get(F.transform(F.array(values), one), F.lit(0)))

    return _taken_apart(u, made)


def strip_revision(value: Column) -> Column:
    """Drop a numeric suffix ``_n`` or ``-n``."""
    return F.regexp_replace(value, r"[_-]\d+$", "")


def bare_identity(value: Column) -> Column:
    """Drop the ``aagag-`` prefix and a numeric suffix."""
    return F.regexp_replace(F.regexp_replace(value, r"^aagag[-_]", ""), r"[_-]\d+$", "")
