"""URL columns: hosts, canonical links, page numbers, link predicates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions.text import strip

_HOST = r"://(?:[^/?#]*@)?([^/:?#\s]+)(?:[/:?#]|$)"


def domain(url: Column) -> Column:
    """Lower-case host; `https://` is put in front where no http scheme is; '' if invalid."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.coalesce(F.lower(F.regexp_extract(full, "^https?" + _HOST, 1)), F.lit(""))


def strict_domain(url: Column) -> Column:
    """Lower-case host of a trimmed full URL; NULL when it has no scheme or host."""
    host = F.regexp_extract(strip(url), "^[A-Za-z][A-Za-z0-9+.-]*" + _HOST, 1)
    return F.nullif(F.lower(host), F.lit(""))


def looks_like_url(url: Column) -> Column:
    return url.startswith("http")


def is_product_link(href: Column) -> Column:
    """The case-sensitive product test used for page facts."""
    return href.contains("/products/")


def canonical(url: Column) -> Column:
    """Cut at the first `?`, drop trailing slashes; a fragment stays."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def canonical_for(platform: Column, url: Column, strict: bool = False) -> Column:
    """`canonical`, but shops that name the product in the query keep that parameter.

    With `strict` the query is always cut, which folds all such links into one.
    """
    if strict:
        return canonical(url)
    product = F.regexp_extract(url, r"[?&](product=[^&#]+)", 1)
    keep = (platform == "woocommerce") & (product != "")
    return F.when(
        keep, F.concat(F.substring_index(url, "?", 1), F.lit("?"), product)
    ).otherwise(canonical(url))


def page_url(base: Column, page_no: Column, platform: Column) -> Column:
    """Address of a numbered listing page."""
    name = F.when(platform == "woocommerce", rules.PAGE_PARAM_WOOCOMMERCE).otherwise(
        rules.PAGE_PARAM
    )
    glue = F.when(base.contains("?"), "&").otherwise("?")
    return F.concat(base, glue, name, F.lit("="), page_no.cast("string"))


def detect_platform(url: Column, html: Column) -> Column:
    """Shop platform of a page; the first matching rule wins, html ignores case."""
    page = F.lower(html)
    out = F
    for name, markers, url_part in rules.PLATFORM_MARKERS:
        tests = [page.contains(m) for m in markers]
        if url_part:
            tests.append(url.contains(url_part))
        out = out.when(reduce(or_, tests), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def platform_link(platform: Column, href: Column) -> Column:
    """Does the raw href count as a product link on this platform?"""
    out = F
    for name, parts in rules.HREF_PARTS.items():
        test = reduce(or_, [href.contains(p) for p in parts])
        if name == "odoo":
            test = test & (F.regexp_replace(href, "/+$", "") != "/shop")
        out = out.when(platform == name, test)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))
