"""URL functions and keys by hash, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def host(url: Column) -> Column:
    """Host part as written, with port; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path part; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """Query part; empty if there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def bare_host(url: Column) -> Column:
    """Host without its first ``www.``."""
    return F.regexp_replace(host(url), r"^(.*?)www\.", "$1")


def with_scheme(url: Column) -> Column:
    """``https://`` put before addresses without a scheme, trailing slashes dropped."""
    trimmed = F.regexp_replace(url, "/+$", "")
    return F.when(url.startswith("http://") | url.startswith("https://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def without_fragment(url: Column) -> Column:
    """The address up to the first ``#``."""
    return F.regexp_replace(url, "#.*$", "")


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a root-relative, absolute or same-folder link."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def is_page(url: Column) -> Column:
    """Whether an address can be a page: http, a host, no file ending or technical path, a query of at most 200."""
    p = F.lower(path(url))
    ok = url.startswith("http") & (host(url) != "") & ~p.rlike(rf"\.({'|'.join(fixed.EXCLUDED_ENDINGS)})$") & (F.length(query(url)) <= 200)
    for part in fixed.EXCLUDED_PARTS:
        ok = ok & ~p.contains(part)
    return F.coalesce(ok, F.lit(False))


def keeps_link(href: Column) -> Column:
    """Whether a link is worth following: not empty, no fragment, mail, phone or script."""
    return F.coalesce((href != "") & ~href.rlike("^(#|mailto:|tel:|javascript:)"), F.lit(False))


def keeps_image(src: Column) -> Column:
    """Whether an image source is an address: longer than 4, no inline data."""
    return F.coalesce((F.length(src) > 4) & ~src.startswith("data:image"), F.lit(False))


def file_name_of(url: Column) -> Column:
    """Name for a page's file: scheme dropped, other signs as ``_``, at most 100 characters."""
    return F.substring(F.regexp_replace(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "[^a-zA-Z0-9_-]", "_"), 1, 100)


def safe_file_name(name: Column, most: int = 255) -> Column:
    """A legal file name; the ending survives the cut."""
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x{00}-\x{1f}\x{7f}-\x{9f}]", "")
    out = F.regexp_replace(out, r"^[ .]+|[ .]+$", "")
    out = F.when(out == "", F.lit("untitled")).otherwise(out)
    ending = F.regexp_extract(out, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(out, F.lit(1), F.length(out) - F.length(ending))
    return F.when(F.length(out) > most, F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.length(ending)), ending)).otherwise(out)


def content_id(url: Column, title: Column, as_of: str) -> Column:
    """First 12 hex digits of the MD5 of address, title and date; nulls count as empty."""
    return F.substring(F.md5(F.concat_ws("_", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.lit(as_of))), 1, 12)


def question_key(text: Column) -> Column:
    """Cache key of a question."""
    return F.concat(F.lit("question_analysis:"), F.sha2(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), 256))


def search_key(topics: Column, keywords: Column) -> Column:
    """Cache key of a search: MD5 of the sorted terms laid end to end."""
    none = F.array().cast("array<string>")
    return F.md5(F.array_join(F.array_sort(F.concat(F.coalesce(topics, none), F.coalesce(keywords, none))), ""))


def response_key(message: Column, prompt: Column) -> Column:
    """Cache key of an answer."""
    return F.md5(F.concat_ws("|", message, prompt))


def generic_key(category: Column, *parts: Column) -> Column:
    """Cache key of anything: SHA-256 of the category and the parts between bars."""
    return F.sha2(F.concat_ws("|", F.concat(F.lit("cat:"), category), *parts), 256)


def hashed(data: Column, algorithm: str) -> Column:
    """Hex digest by name: md5, sha1, sha256 or sha512."""
    known = {"md5": lambda: F.md5(data), "sha1": lambda: F.sha1(data), "sha256": lambda: F.sha2(data, 256), "sha512": lambda: F.sha2(data, 512)}
    if algorithm not in known:
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    return known[algorithm]()
