"""URL functions as Column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Query parameters that only track the visitor.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ["fbclid", "gclid", "dclid", "msclkid", "twclid", "mc_eid", "igshid", "_hsenc", "_hsmi", "vero_id", "wbraid", "gbraid", "yclid"]
#: File endings that are assets, not pages.
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|json|xml|pdf|zip|gz|tar|mp4|mp3|woff2?|ttf|eot)$"

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host in lower case, null where the URL has none."""
    found = F.lower(_part(F.trim(url), 2))
    return F.when(found != "", found)


def strip_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def domain(url: Column) -> Column:
    return strip_www(host(url))


def path(url: Column) -> Column:
    return _part(url, 4)


def query_string(url: Column) -> Column:
    return _part(url, 5)


def canonical_url(url: Column) -> Column:
    """The key under which equal pages meet: no tracking parameters, sorted parameters, no fragment, trailing slash, www, user or port."""
    u = F.trim(url)
    web = scheme(u).isin("http", "https") & host(u).isNotNull()
    name = F.lower
    pairs = F.filter(F.split(query_string(u), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~name(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING_NAMES) & ~name(p).startswith(TRACKING_PREFIX))
    # sorted by name; parameters of one name keep their order
    keyed = F.transform(kept, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), i.alias("i"), F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.replace(s["p"], F.lit("%20"), F.lit("+")))
    search = F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise("")
    trimmed = F.regexp_replace(path(u), "/+$", "")
    key = F.concat(scheme(u), F.lit("://"), domain(u), F.when(trimmed == "", "/").otherwise(trimmed), search)
    return F.when(web, key).otherwise(u)


def cache_key(url: Column) -> Column:
    """https for http; the root's slash goes, other paths keep theirs."""
    secure = F.regexp_replace(F.trim(url), "^http://", "https://")
    return F.regexp_replace(F.regexp_replace(secure, "#.*$", ""), "^(https://[^/?#]+)/$", "$1")


def queue_key(url: Column) -> Column:
    """Without query and fragment; the root is its origin."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "^([a-z]+://[^/]+)/$", "$1")


def page_path(url: Column) -> Column:
    """Where a page is stored: ``host/path.md``; ``/a/`` and ``/a/index.html`` are one."""
    p = F.regexp_replace(F.regexp_replace(path(F.trim(url)), "^/+|/+$", ""), r"(^|/)index\.html?$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\.html?$", ""), "[^a-zA-Z0-9/_.-]", "_")
    return F.concat(host(url), F.lit("/"), F.when(p == "", "index").otherwise(p), F.lit(".md"))


def normalize_input(text: Column) -> Column:
    """What a user typed, as a URL: a scheme is kept, ``host:port`` and bare hosts get https."""
    t = F.trim(text)
    return F.when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).when(t.rlike(r"^[^\s/:]+(:\d+)?([/?#].*)?$"), F.concat(F.lit("https://"), t))


def is_google_redirect(url: Column) -> Column:
    h = host(url)
    return F.coalesce(((h == "google.com") | h.endswith(".google.com")) & path(F.trim(url)).isin("/goto", "/url"), F.lit(False))


def redirect_target(url: Column) -> Column:
    """The page behind a result page's link: the ``uddg`` , ``url`` or ``RU`` part, decoded; else the link."""
    inner = F.coalesce(
        F.nullif(F.regexp_extract(url, "[?&]uddg=([^&#]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, "/RU=([^/]+)/", 1), F.lit("")),
        F.when(is_google_redirect(url), F.nullif(F.regexp_extract(url, "[?&](?:url|q)=(https?[^&#]+)", 1), F.lit(""))),
    )
    return F.coalesce(F.try_url_decode(inner), url)


def in_scope(url: Column, origin: str, prefix: str = "/") -> Column:
    """Same origin and under the path, at a segment's border."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    base = prefix.rstrip("/")
    return (F.concat(scheme(url), F.lit("://"), host(url)) == origin) & ((p == (base or "/")) | p.startswith(base + "/"))


def is_asset(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "").rlike(ASSET)


#: IPv4 blocks that are not publicly reachable, first and last address.
PRIVATE_BLOCKS = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.88.99.0", "192.88.99.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]
PUBLIC_ANYCAST = ["192.0.0.9", "192.0.0.10"]


def ipv4_number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_ipv4(ip: Column) -> Column:
    """True for addresses that are not public, and for what is no IPv4 address."""
    octets = F.transform(F.split(ip, r"\."), lambda x: F.when(x.rlike(r"^\d{1,3}$"), x.cast("long")))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    valid = (F.size(octets) == 4) & F.forall(octets, lambda x: x.isNotNull() & (x < 256))
    private = F.lit(False)
    for first, last in PRIVATE_BLOCKS:
        private |= number.between(ipv4_number(first), ipv4_number(last))
    return F.coalesce(~valid, F.lit(True)) | (private & ~number.isin([ipv4_number(x) for x in PUBLIC_ANYCAST]))


#: Prefixes of addresses whose last four bytes are an IPv4 address.
_NAT64 = (ipaddress.IPv6Address("64:ff9b::").packed[:12], ipaddress.IPv6Address("::").packed[:12])


@F.pandas_udf(BooleanType())
def _is_private_ipv6(ips: pd.Series) -> pd.Series:
    """An address that carries an IPv4 address is as private as that one; addresses that are not global are private."""

    def one(text: str | None) -> bool:
        try:
            ip = ipaddress.IPv6Address((text or "").strip("[]").split("%")[0])
        except ValueError:
            return True
        inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo or (None, None))[1]
        if inner is None and ip.packed[:12] in _NAT64:
            inner = ipaddress.IPv4Address(ip.packed[12:])
        return not ip.is_global or ip.is_multicast or (inner is not None and (not inner.is_global or inner.is_multicast))

    return ips.map(one)


def is_private_ip(ip: Column) -> Column:
    """True for IPv4 and IPv6 addresses that are not public, and for what is no address; only IPv6 goes through Python."""
    six = ip.contains(":")
    return F.when(six, _is_private_ipv6(F.when(six, ip))).otherwise(is_private_ipv4(ip))


#: Addresses that give credentials to whoever asks, prefixes that are never public, and ports of services that are not for the web.
METADATA_IPS, NEVER_PUBLIC = ["169.254.169.254", "fd00:ec2::254"], ["100::/64"]
DANGEROUS_PORTS = [22, 23, 25, 135, 139, 445, 1099, 1433, 1521, 2049, 3306, 3389, 5432, 5900, 5984, 6379, 9200, 9300, 11211, 27017, 50000]


def allowed_ranges(text: str) -> list[str]:
    """The address ranges of a list with commas; what is none is left out, and so is a range of everything."""
    found = []
    for part in text.split(","):
        try:
            net = ipaddress.ip_network(part.strip(), strict=False)
        except ValueError:
            continue
        if "/" in part and net.prefixlen >= 1:
            found.append(str(net))
    return found


def embedded_ipv4(ip: ipaddress.IPv6Address) -> list[ipaddress.IPv4Address]:
    """The IPv4 addresses that an IPv6 address may stand for: mapped, compatible, NAT64 (with each length of its local prefix), 6to4 and Teredo."""
    b = ip.packed
    places = []
    if b[:12] in (ipaddress.IPv6Address("::ffff:0:0").packed[:12], *_NAT64):
        places.append((12, 13, 14, 15))
    if b[:6] == bytes.fromhex("0064ff9b0001"):
        places += [(6, 7, 9, 10), (7, 9, 10, 11), (9, 10, 11, 12), (12, 13, 14, 15)]
    if b[:2] == b"\x20\x02":
        places.append((2, 3, 4, 5))
    found = [ipaddress.IPv4Address(bytes(b[i] for i in p)) for p in places]
    if b[:4] == b"\x20\x01\x00\x00":
        found.append(ipaddress.IPv4Address(bytes(x ^ 255 for x in b[12:])))
    return found


def _private_ipv4(ip: ipaddress.IPv4Address) -> bool:
    return str(ip) not in PUBLIC_ANYCAST and any(ipv4_number(a) <= int(ip) <= ipv4_number(z) for a, z in PRIVATE_BLOCKS)


def _ipv6_policy(text: str | None, ranges: list) -> str:
    try:
        ip = ipaddress.IPv6Address((text or "").strip("[]").split("%")[0])
    except ValueError:
        return "private-range"
    inner = embedded_ipv4(ip)
    if str(ip) in METADATA_IPS or any(str(x) in METADATA_IPS for x in inner):
        return "cloud-metadata"
    if any(ip in ipaddress.ip_network(n) for n in NEVER_PUBLIC):
        return "reserved-range"
    if ip.is_global and not ip.is_multicast and not any(map(_private_ipv4, inner)):
        return "public"
    return "allowed" if any(x in n for n in ranges for x in [ip, *inner]) else "private-range"


def address_policy(ip: Column, port: Column, allowed: list[str] | None = None) -> Column:
    """What becomes of a request to an address, as decision (cloud-metadata, reserved-range, private-range, dangerous-port, allowed, public) and dangerous.

    In this order: metadata and reserved addresses are refused whatever is allowed; private ones unless a range in ``allowed`` holds them;
    then ports of other services, unless the address was allowed. What is no address is private. IPv4 is arithmetic, IPv6 goes
    through Python.
    """
    ranges = [ipaddress.ip_network(r) for r in allowed or []]
    six = ip.contains(":")
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    number = F.when(F.size(octets) == 4, F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
    opted = F.lit(False)
    for r in ranges:
        if r.version == 4:
            opted |= number.between(int(r.network_address), int(r.broadcast_address))
    four = F.when(ip.isin(METADATA_IPS), "cloud-metadata").when(~is_private_ipv4(ip), "public").when(F.coalesce(opted, F.lit(False)), "allowed").otherwise("private-range")
    by_python = F.pandas_udf(lambda texts: texts.map(lambda t: _ipv6_policy(t, ranges)), StringType())
    decision = F.when(six, by_python(F.when(six, ip))).otherwise(four)
    decision = F.when((decision == "public") & port.isin(DANGEROUS_PORTS), "dangerous-port").otherwise(decision)
    return F.struct(decision.alias("decision"), (~decision.isin("public", "allowed")).alias("dangerous"))


def is_private_host(name: Column) -> Column:
    h = F.lower(name)
    local = h.isin("localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal")
    return local | (h.rlike(r"^\d+(\.\d+){3}$") & is_private_ipv4(h))
