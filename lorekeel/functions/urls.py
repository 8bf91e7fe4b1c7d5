"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visitor.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
#: Suffixes under which names are registered one level deeper.
DEEP_SUFFIXES = ["gov.uk", "ac.uk", "co.uk", "org.uk", "gov.au", "edu.au", "com.au", "org.au", "co.jp", "co.nz", "com.br"]


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def host(url: Column) -> Column:
    """Host in lower case, without user and port; null if the URL has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path of an absolute URL, "" if it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """Query string without its question mark, "" if there is none."""
    return F.regexp_extract(without_fragment(url), r"\?(.*)$", 1)


def public_suffix(name: Column) -> Column:
    """The registry suffix of a domain: two labels for known deep suffixes, else the last."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(DEEP_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def root_domain(name: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(DEEP_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def _kept_query(url: Column, drop) -> Column:
    parts = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~drop(F.lower(F.substring_index(p, "=", 1))))
    return F.array_join(parts, "&")


def _rebuilt(url: Column, kept: Column, trim_slash: bool = False) -> Column:
    base = F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)), F.when(path(url) == "", F.lit("/")).otherwise(path(url)))
    return F.when(host(url).isNull(), url).otherwise(F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def canonical(url: Column) -> Column:
    """URL without fragment and tracking parameters, its host in lower case; what is no URL stays as it is."""
    return _rebuilt(url, _kept_query(url, lambda key: key.isin(TRACKING)))


def sanitised(url: Column) -> Column:
    """URL without fragment and without any utm_* parameter, fbclid, gclid, ref and source."""
    return _rebuilt(url, _kept_query(url, lambda key: key.startswith("utm_") | key.isin("fbclid", "gclid", "ref", "source")))


def aggregation_key(url: Column) -> Column:
    """Domain and first path segment; the domain alone for a home page."""
    first = F.element_at(F.split(F.ltrim(path(url), F.lit("/")), "/"), 1)
    return F.when(host(url).isNull(), url).when(first == "", domain(url)).otherwise(F.concat(domain(url), F.lit("/"), first))


def url_id(url: Column) -> Column:
    """32 hex characters that name a URL."""
    return F.substring(F.sha2(url, 256), 1, 32)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_depth(url: Column) -> Column:
    return F.size(segments(url))


def cache_key(url: Column) -> Column:
    """URL in lower case without fragment, end slashes and default port."""
    bare = F.rtrim(without_fragment(F.lower(F.trim(url))), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(bare, r"^(http://[^/?#]*):80(?=[/?#]|$)", "$1"), r"^(https://[^/?#]*):443(?=[/?#]|$)", "$1")


def title_from_url(url: Column) -> Column:
    """Last path segment in words; the domain for a home page."""
    last = F.element_at(segments(url), -1)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(last), last), r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_+\s]+", " "))
    return F.when(path_depth(url) == 0, domain(url)).otherwise(words)


def query_value(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; null if absent."""
    found = F.regexp_extract(F.concat(F.lit("&"), query(url)), rf"&{name}=([^&]*)", 1)
    return F.when(found != "", F.try_url_decode(found))


def redirect_target(url: Column) -> Column:
    """Where a search engine's redirect leads: /l/?uddg= holds it encoded, /ck/a?u= in URL-safe base64 after two characters."""
    plain = query_value(url, "uddg")
    coded = F.substring(query_value(url, "u"), 3, 100000)
    padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), "=")
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    absolute = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(path(absolute).startswith("/l/") & plain.isNotNull(), plain).when((path(absolute) == "/ck/a") & decoded.startswith("http"), decoded).otherwise(url)


def is_private_ipv4(name: Column) -> Column:
    """Whether a host is an IPv4 address that is loopback, private, link-local, broadcast or unspecified."""
    shaped = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inner = name.rlike(r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|255\.255\.255\.255$)")
    return shaped & inner


def is_safe(url: Column) -> Column:
    """http or https, with a host that is not local."""
    name = host(url)
    return F.coalesce(url.rlike(r"^(?i)https?://") & name.isNotNull() & ~is_private_ipv4(name) & ~name.isin("localhost", "[") & ~name.endswith(".localhost"), F.lit(False))
