"""URLs as Column functions: canonical form, classes, hosts, scopes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments of listings and machinery, endings of assets, query keys that name a post.
SKIP_SEGMENTS = "tag|tags|category|categories|author|authors|page|search|feed|about|contact|privacy|terms|archive|archives|index|sitemap|login|subscribe|wp-content|wp-admin|wp-includes|cdn-cgi|cart|checkout|shop|products"
ASSETS = "jpe?g|png|gif|webp|svg|ico|pdf|zip|gz|mp[34]|mov|avi|xml|json|css|js|txt|woff2?|ttf|eot|rss|atom|opml|m4a|ogg|wav|epub"
POST_KEYS = ("p", "page_id", "post", "post_id")
#: Query keys that begin so are tracking.
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "ref")

_GRAMMAR = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, name: str) -> Column:
    """scheme, netloc, path or query; empty if there is none."""
    return F.regexp_extract(F.trim(url), _GRAMMAR, {"scheme": 1, "netloc": 2, "path": 3, "query": 4}[name])


def host(url: Column) -> Column:
    """Lower case, without www. and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, "netloc")), r"^www\.", ""), r":\d+$", "")


def _pairs(query: Column) -> Column:
    """key=value pairs of a query; those with blank values are left out."""
    return F.filter(F.split(query, "&"), lambda x: F.instr(x, "=").between(2, F.length(x) - 1) | (x.rlike("^=.+")))


def _recoded(text: Column) -> Column:
    return F.replace(F.url_encode(F.url_decode(text)), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """For comparing: https, lower host without www. and default port, no fragment, tracking or blank parameters, no last slash."""
    scheme, netloc, path, query = (part(url, x) for x in ("scheme", "netloc", "path", "query"))
    scheme = F.when(F.lower(scheme).isin("http", "https", ""), "https").otherwise(F.lower(scheme))
    netloc = F.regexp_replace(F.regexp_replace(F.lower(netloc), r"^www\.", ""), r":(80|443)$", "")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    key = lambda x: F.substring_index(x, "=", 1)
    kept = F.filter(_pairs(query), lambda x: ~F.lower(F.url_decode(key(x))).rlike("^(" + "|".join(TRACKING) + ")"))
    coded = F.transform(kept, lambda x: F.concat(_recoded(key(x)), F.lit("="), _recoded(F.regexp_replace(x, "^[^=]*=", ""))))
    query = F.array_join(coded, "&")
    return F.concat(scheme, F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_asset(url: Column) -> Column:
    return F.lower(part(url, "path")).rlike(rf"\.({ASSETS})$")


def classify_url(url: Column, now: datetime) -> Column:
    """``skip`` if it can't be a post, else ``maybe``."""
    from .dates import parse_from_url

    path = F.coalesce(F.nullif(part(url, "path"), F.lit("")), F.lit("/"))
    keys = F.transform(_pairs(part(url, "query")), lambda x: F.substring_index(x, "=", 1))
    root = (path == "/") & ~F.arrays_overlap(keys, F.array(*map(F.lit, POST_KEYS)))
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    listing = F.lower(path).rlike(rf"/({SKIP_SEGMENTS})(/|$)")
    rescued = parse_from_url(url, now)["iso"].isNotNull() & ~last.rlike(r"^\d+$")
    return F.when(root | is_asset(url) | path.rlike(r"^/\d{4}(/\d{1,2})?(/\d{1,2})?/?$"), "skip").when(listing & ~rescued, "skip").otherwise("maybe")


def junk_feed_link(url: Column) -> Column:
    return part(url, "path").isin("", "/") | is_asset(url)


def same_site(a: Column, b: Column) -> Column:
    x, y = host(a), host(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def in_section(url: Column, prefix: str) -> Column:
    prefix = "/" + prefix.strip("/")
    path = part(url, "path")
    return F.lit(True) if prefix == "/" else (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def with_query_param(url: Column, key: str, value: Column) -> Column:
    kept = F.filter(F.split(part(url, "query"), "&"), lambda x: (x != "") & (F.substring_index(x, "=", 1) != key))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.concat(base, F.lit("?"), F.array_join(F.array_append(kept, F.concat(F.lit(f"{key}="), value.cast("string"))), "&"))


def posts_url(root: Column, query: Column) -> Column:
    return F.concat(root, F.when(F.contains(root, F.lit("?")), "&").otherwise("?"), query)


def unwrap_archived(url: Column) -> Column:
    """The page that a web archive's link stands for."""
    return F.regexp_replace(url, r"^https?://web\.archive\.org/web/\d+[a-z_]*/", "")


def slug_title(url: Column) -> Column:
    segment = F.regexp_extract(F.regexp_replace(part(url, "path"), "/+$", ""), r"([^/]*)$", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", ""), "[-_]+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000))


def recipe_for(url: Column, recipes: dict[str, str]) -> Column:
    """The recipe of a host or of one above it; the table is code, so it is small."""
    h, out = host(url), None
    for name, recipe in recipes.items():
        hit = (h == name) | F.endswith(h, F.lit("." + name))
        out = F.when(hit, recipe) if out is None else out.when(hit, recipe)
    return F.lit(None).cast("string") if out is None else out


def elide(url: Column, most: int = 96) -> Column:
    cut = F.regexp_replace(F.substring(url, 1, most - 1), "%[0-9A-Fa-f]?$", "")
    return F.when(F.length(url) <= most, url).otherwise(F.concat(cut, F.lit("…")))


def ascii_safe(url: Column) -> Column:
    """Path and query with every non-ASCII character percent-encoded; the rest as it is."""
    head = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    coded = F.array_join(F.transform(F.split(rest, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)), "")
    return F.when(url.rlike(r"[^\x00-\x7F]"), F.concat(head, coded)).otherwise(url)


def absolutise(base: str | None, link: str | None) -> str | None:
    """A link as seen from a page; as it is if that can't be told."""
    from urllib.parse import urljoin

    try:
        return urljoin(base or "", link or "")
    except ValueError:
        return link
