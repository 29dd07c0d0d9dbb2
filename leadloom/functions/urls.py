"""Domains, addresses and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, fold, strip, text


def site_domain(url: Column | str) -> Column:
    """A contact's site: schemes removed anywhere, one leading www. dropped, up to the first slash."""
    bare = F.replace(F.replace(fold(url), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.split_part(F.regexp_replace(bare, r"^www\.", ""), F.lit("/"), F.lit(1))


def url_domain(url: Column | str) -> Column:
    """A link's network location, lower-case, without a leading www.; '' for a relative link."""
    location = F.regexp_extract(F.lower(text(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(location, r"^www\.", "")


def display_host(url: Column | str) -> Column:
    return F.substring_index(F.substring_index(text(url), "://", -1), "/", 1)


def email_domain(email: Column | str) -> Column:
    return F.when(F.contains(text(email), F.lit("@")), F.substring_index(fold(email), "@", -1)).otherwise("")


def domains_related(a: Column, b: Column) -> Column:
    """Equal, or one a subdomain of the other; '' is related to nothing."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "#", 1), "/+$", "")


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    step = lambda out, x: F.when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    kept = F.reduce(parts, F.array().cast("array<string>"), step)
    # a path that ends in such a segment is a folder
    last = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), last)).otherwise(path)


def absolute(link: Column, page: Column) -> Column:
    """A link made absolute by its page's address. Links with a scheme stay as they are; the others' . and .. segments are resolved, and none leads above the root."""
    root = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?", 0)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.substr(page, F.length(root) + 1), r"^([^?#]*/)?", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(link, F.lit("/")), path).otherwise(F.concat(folder, path))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.substring_index(page, "#", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(page, r"^[^?#]*", 0), link))
        .otherwise(F.concat(root, _without_dots(joined), rest))
    )


def contact_name(first: Column | str, last: Column | str) -> Column:
    return strip(F.concat_ws(" ", F.nullif(col(first), F.lit("")), F.nullif(col(last), F.lit(""))))
