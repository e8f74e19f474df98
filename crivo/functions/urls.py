"""URL expressions. `parse_url` is avoided: it drops the port and returns NULL for a space in the path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from crivo.functions.text import strip_space

# Optional scheme, optional //authority, then the path up to the query or fragment.
URL_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"

# Hosts of pages that are not articles.
SUSPICIOUS_PREFIXES = ("assinaturas.", "conta.")
SUSPICIOUS_HOSTS = ("bsky.app",)


def _clean(url: Column) -> Column:
    return F.regexp_replace(strip_space(url), r"[\t\r\n]", "")


def url_host(url: Column) -> Column:
    """Lower-case authority, port kept; empty when the url has no `//`."""
    return F.lower(F.regexp_extract(_clean(url), URL_PARTS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), URL_PARTS, 2)


def canonical_url(url: Column, drop_suffix: bool = False) -> Column:
    """Host without a leading `www.` plus lower-case path without trailing slashes.

    `drop_suffix` also removes a final `-N` or `-NN` of the path (ASCII digits only).
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.lower(F.regexp_replace(url_path(url), r"/+$", ""))
    if drop_suffix:
        path = F.regexp_replace(path, r"-[0-9]{1,2}$", "")
    return F.concat(host, path)


def is_suspicious_page(
    url: Column, prefixes: Sequence[str] = SUSPICIOUS_PREFIXES, hosts: Sequence[str] = SUSPICIOUS_HOSTS
) -> Column:
    """Subscription or account host, a listed host, or a home page. The query string is ignored."""
    host, path = url_host(url), url_path(url)
    hit = path.isin("", "/")
    for p in prefixes:
        hit = hit | host.startswith(p)
    return hit | host.isin(*hosts) if hosts else hit


def display_host(host: Column) -> Column:
    """Host for reports: the first `www.` removed."""
    return F.regexp_replace(host, r"^(.*?)www\.", "$1")
