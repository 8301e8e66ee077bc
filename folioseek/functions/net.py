"""Would a request to this URL leave the private network?"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
HOST = r"^(?i)[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?\[?([^\]/:?#]+)\]?"
LOOPBACK = ("localhost", "127.0.0.1", "::1")
PRIVATE_V4 = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.)"
PRIVATE_NAME = r"\.(?:local|lan|internal)\z"
# --- end of fixed values ---


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def is_private_host(url: Column) -> Column:
    """Loopback, private or link-local IPv4, a local suffix, or a bare machine name; unparsable is public."""
    h = url_host(url)
    private = (
        h.isin(*LOOPBACK) | h.rlike(PRIVATE_V4) | h.rlike(PRIVATE_NAME) | ~F.contains(h, F.lit("."))
    )
    return (h != "") & private
