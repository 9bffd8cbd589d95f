"""Which addresses an endpoint may have: 128-bit addresses as two longs, networks as sorted ranges, a verdict for all addresses of a host.

All of it is column expressions. IPv4 addresses are their mapped form (``::ffff:a.b.c.d``), so that both kinds meet in one order.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import bound

#: Kinds of networks; others are public. Fixed values.
NETWORKS = {
    "127.0.0.0/8": "loopback", "::1/128": "loopback", "10.0.0.0/8": "private", "172.16.0.0/12": "private", "192.168.0.0/16": "private", "100.64.0.0/10": "shared", "fc00::/7": "private", "fe80::/10": "private",
}
MODES = ("local", "private-network", "custom")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_SIGN = -(1 << 63)


def _number(text: Column, base: int) -> Column:
    return F.conv(text, base, 10).cast("long")


def _folded(parts: Column, base: int, bits: int) -> Column:
    return F.aggregate(F.transform(parts, lambda p: _number(p, base)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, bits).bitwiseOR(x))


def address(text: Column) -> Column:
    """``struct<hi: long, lo: long>``: the upper and lower 64 bits of an IPv4 or IPv6 address; null for any other text.

    Zones (``%eth0``) are left out. IPv4 numbers have no leading zeros. ``::`` stands for one group of zeros or more.
    """
    none = F.array().cast("array<string>")

    def groups(side: Column) -> Column:
        return F.when(side == "", none).otherwise(F.split(side, ":", -1))

    def quad_number(bare: Column) -> Column:
        return _folded(F.split(F.nullif(F.regexp_extract(bare, rf"({_QUAD})$", 1), F.lit("")), r"\."), 10, 8)

    def hex_groups(number: Column) -> Column:
        return bound(F.lower(F.lpad(F.conv(number.cast("string"), 10, 16), 8, "0")), lambda x: F.concat(F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))

    def whole(bare: Column) -> Column:
        # a dotted end is two groups more
        return F.when(bare.contains("."), F.concat(F.regexp_replace(bare, rf"{_QUAD}$", ""), hex_groups(quad_number(bare)))).otherwise(bare)

    def filled(sides: Column) -> Column:
        def between(two: Column) -> Column:
            missing = 8 - F.size(two["l"]) - F.size(two["r"])
            right_form = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
            return F.when(right_form, F.concat(two["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), two["r"]))

        return bound(F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("r")), between)

    def v6(full: Column) -> Column:
        both = F.struct(_folded(F.slice(full, 1, 4), 16, 16).alias("hi"), _folded(F.slice(full, 5, 4), 16, 16).alias("lo"))
        return F.when(F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")), both)

    def parsed(bare: Column) -> Column:
        mapped = F.struct(F.lit(0).cast("long").alias("hi"), quad_number(bare).bitwiseOR(F.lit(0xFFFF << 32)).alias("lo"))
        return F.when(bare.rlike(rf"^{_QUAD}$"), mapped).when(bare.contains(":"), bound(bound(F.split(whole(bare), "::", -1), filled), v6))

    return bound(F.lower(F.substring_index(F.btrim(text), "%", 1)), parsed)


def ranges(networks: dict[str, str] = NETWORKS) -> list[tuple[int, int, str]]:
    """Disjoint (first, last, kind) in order; within a network a narrower one wins. Numbers are 128-bit."""
    found = []
    for text, kind in networks.items():
        net = ipaddress.ip_network(text)
        shift = 0xFFFF << 32 if net.version == 4 else 0
        found.append((int(net.network_address) + shift, int(net.broadcast_address) + shift, kind))
    edges = sorted({x for a, b, _ in found for x in (a, b + 1)})
    out: list[tuple[int, int, str]] = []
    for a, b in zip(edges, edges[1:]):
        inside = [(last - first, kind) for first, last, kind in found if first <= a and b - 1 <= last]
        if inside:
            out.append((a, b - 1, min(inside)[1]))
    return out


def _ordered(hi: Column, lo: Column) -> Column:
    """Two longs whose signed order is the unsigned order of the bits."""
    return F.struct(hi.bitwiseXOR(F.lit(_SIGN)).alias("h"), lo.bitwiseXOR(F.lit(_SIGN)).alias("l"))


def _literal(value: int) -> Column:
    def half(x: int) -> Column:
        return F.lit(x + _SIGN).cast("long")

    return F.struct(half(value >> 64).alias("h"), half(value & ((1 << 64) - 1)).alias("l"))


def kind(found: Column, networks: dict[str, str] = NETWORKS) -> Column:
    """``loopback``, ``private``, ``shared``, ``public`` or what ``networks`` name, for an address of ``address``; null for null.

    A binary search over the networks' sorted ranges, laid out as an expression: an address passes as many comparisons as the
    number of ranges has bits.
    """
    rows = ranges(networks)

    def search(own: Column, a: int, b: int) -> Column:
        if b - a == 1:
            return F.when((own >= _literal(rows[a][0])) & (own <= _literal(rows[a][1])), rows[a][2]).otherwise("public")
        middle = (a + b) // 2
        return F.when(own < _literal(rows[middle][0]), search(own, a, middle)).otherwise(search(own, middle, b))

    def of(x: Column) -> Column:
        return F.when(x.isNotNull(), bound(_ordered(x["hi"], x["lo"]), lambda own: search(own, 0, len(rows)) if rows else F.lit("public")))

    return bound(found, of)


def url_error(url: Column) -> Column:
    """Why a URL is no endpoint: ``invalid_url``, ``parameters``, ``white_space``; null for those that are."""
    form = url.rlike(r"(?i)^\s*https?://(?:[^/?#@\s]*@)?(?:\[[0-9a-f:.%]+\]|[^/?#:@\[\]\s]+)(?::\d{1,5})?(?:[/?#].*)?\s*$")
    port = F.regexp_extract(url, r"^\s*[A-Za-z]+://[^/?#]*:(\d{1,5})(?:[/?#]|\s*$)", 1)
    right_port = (port == "") | (port.cast("int") <= 65535)
    return F.when(~F.coalesce(form & right_port, F.lit(False)), "invalid_url").when(url.rlike("[?#]."), "parameters").when(url.rlike(r"(?U)\s"), "white_space")


def verdicts(hosts: DataFrame, mode: str, allow_public: bool = False, allow_insecure: bool = False) -> DataFrame:
    """(``url``, ``addresses``, ``kind``, ``refused``), a row for each URL of ``hosts`` (``url``, ``address``: one of those it resolves to).

    Every address counts: public ones beside others are refused (``mixed``), as are public ones alone (``public``), whatever ``mode`` says,
    unless they are allowed. ``local`` wants loopback only (``not_local``), ``private-network`` private and shared ones only
    (``not_private``), and anything but loopback wants https (``insecure``) unless that is allowed. Texts that are no addresses are
    ``invalid_address``, URLs without any ``no_addresses``. ``kind`` is the most exposed one. Addresses are counted by kind
    before the shuffle, so a host may have any number of rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    known = hosts.select("url", "address", kind(address(F.col("address"))).alias("_kind"))
    of = {k: F.count_if(F.col("_kind") == k).alias(f"_{k}") for k in ("loopback", "private", "shared", "public")}
    sums = known.groupBy("url").agg(F.count("address").alias("addresses"), F.count_if(F.col("address").isNotNull() & F.col("_kind").isNull()).alias("_invalid"), *of.values())
    some = {k: F.col(f"_{k}") > 0 for k in of}
    inner = some["loopback"] | some["private"] | some["shared"]
    refused = F.coalesce(
        url_error(F.col("url")),
        F.when(F.col("_invalid") > 0, "invalid_address").when(F.col("addresses") == 0, "no_addresses").when(some["public"] & inner, "mixed"),
        F.lit(None) if allow_public else F.when(some["public"], "public"),
        F.when(F.lit(mode == "local") & (some["private"] | some["shared"] | some["public"]), "not_local"),
        F.when(F.lit(mode == "private-network") & (some["loopback"] | some["public"]), "not_private"),
        F.lit(None) if allow_insecure else F.when((some["private"] | some["shared"] | some["public"]) & F.col("url").rlike(r"(?i)^\s*http:"), "insecure"),
    )
    exposed = F.when(some["public"], "public").when(some["shared"], "shared").when(some["private"], "private").when(some["loopback"], "loopback")
    return sums.select("url", "addresses", exposed.alias("kind"), refused.alias("refused"))


def redirect_target(url: Column, location: Column) -> Column:
    """Where a redirect leads: absolute URLs as they are, ``//host``, ``/path`` and relative paths from ``url``, which counts as a folder."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/*$", "/")
    return (
        F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme, F.lit(":"), location))
        .when(location.startswith("/"), F.concat(origin, location))
        .otherwise(F.concat(base, location))
    )
