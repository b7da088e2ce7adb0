"""URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Path segments that name a category; the first that a URL contains decides.
CATEGORIES = ("programs", "specialisations", "courses")
HEAD = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)"


def slug(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(url), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")


def file_stem(url: Column) -> Column:
    """The other file name: without scheme, / ? = as _, 100 characters."""
    return F.substring(F.translate(F.regexp_replace(url, r"^https?://", ""), "/?=", "___"), 1, 100)


def normalized(url: Column) -> Column:
    """Scheme, host and path."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, HEAD + r"([^?#]*)", 3)


def host(url: Column) -> Column:
    return F.regexp_extract(url, HEAD, 2)


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(HEAD), F.lit(False))


def is_content_link(url: Column, segments: Sequence[str] = CATEGORIES) -> Column:
    return F.coalesce(F.exists(F.array(*(F.lit(f"/{s}/") for s in segments)), lambda s: F.contains(path(url), s)), F.lit(False))


def category(url: Column, segments: Sequence[str] = CATEGORIES) -> Column:
    out = F.lit("other")
    for s in reversed(segments):
        out = F.when(F.contains(url, F.lit(f"/{s}/")), s).otherwise(out)
    return out


def last_step(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def link_title(url: Column, kind: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" "), last_step(F.regexp_replace(url, "/+$", "")))


def display_name(url: Column) -> Column:
    steps = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(~is_valid(url), F.concat(F.substring(url, 1, 30), F.lit("..."))).when(F.size(steps) > 0, F.translate(F.element_at(steps, F.greatest(F.size(steps), F.lit(1))), "-_", "  ")).otherwise(host(url))


def links_in(html: Column) -> Column:
    """href values of anchors, in double or single quotes or bare."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def absolute(base: Column, link: Column) -> Column:
    """A link of a page as a whole URL; paths from the root, whole URLs, or paths beside the page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(link.rlike(HEAD), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))
