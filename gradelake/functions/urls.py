"""URLs and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWED_HOSTS = ("github.com", "raw.githubusercontent.com")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?([^?#]*)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def validate_url(url: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """null for an https URL on an allowed host without credentials or a port of its own; else the error's code."""
    host = F.lower(_part(url, 3))
    bad = (_part(url, 1) == "") | (host == "") | (F.lower(_part(url, 1)) != "https") | (_part(url, 2) != "") | ~_part(url, 4).isin("", "443")
    return F.when(url.isNull() | bad, "invalid_url").when(~host.isin(*hosts), "host_not_allowed")


def to_raw_url(url: Column) -> Column:
    """A file's page to its raw text, a repository's root to its README, anything else unchanged."""
    blob = r"^https?://github\.com/([^/?#]+)/([^/?#]+)/blob/([^/?#]+/[^?#]+?)/?(?:[?#].*)?$"
    root = r"^https?://github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$"
    return F.when(url.rlike(blob), F.regexp_replace(url, blob, "https://raw.githubusercontent.com/$1/$2/$3")).when(url.rlike(root), F.regexp_replace(url, root, "https://raw.githubusercontent.com/$1/$2/HEAD/README.md")).otherwise(url)


def is_private_address(ip: Column) -> Column:
    """Loopback, private, link-local, shared, benchmark, multicast and reserved ranges; what is no address counts as private."""
    ip = F.regexp_replace(F.lower(ip), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")
    v4 = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    a, b = (F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int") for i in (0, 1))
    own = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(168, 0)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    )
    v6 = ip.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$")
    return F.coalesce(F.when(v4, own).when(v6, ip.isin("::", "::1") | ip.rlike(r"^(?:fc|fd|fe[89ab]|ff)")).otherwise(True), F.lit(True))
