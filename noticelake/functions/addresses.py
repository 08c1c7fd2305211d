"""Verdicts on addresses: whether a fetch of one would leave the public network."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKED_HOSTS = ("localhost", "metadata.google.internal")


def _private(host: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((host or "").strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


def unsafe_reason(url: str | Column) -> Column:
    """scheme, host, blocked or address; null for an address that is fine by its letters (names are not resolved)."""

    @F.pandas_udf(T.BooleanType())
    def private(hosts: pd.Series) -> pd.Series:
        return hosts.map(_private).astype(bool)

    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    literal = host.rlike("^\\[|^[0-9.]+$|:")
    return (
        F.when(~F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)), "scheme")
        .when(F.coalesce(host, F.lit("")) == "", "host")
        .when(host.isin(*BLOCKED_HOSTS), "blocked")
        .when(literal & private(host), "address")
    )
