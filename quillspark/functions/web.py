"""Hosts and domain suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host; null for what is no url."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffixes(host: Column) -> Column:
    """The host and each shorter tail of its labels: the domains that it equals or ends in."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under(host: Column, domain: Column) -> Column:
    """The host is the domain or lies below it."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))
