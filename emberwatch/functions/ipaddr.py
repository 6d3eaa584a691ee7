"""Address classes from dotted and colon text, by pattern tables built from CIDR ranges."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-use ranges (IANA registries) that count as private, and the holes in them.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4",
]
PUBLIC_HOLES_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
]
PUBLIC_HOLES_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
]

# Text prefixes of internal servers.
INTERNAL_PREFIXES = ["10.0.0.", "192.168.1.1"]

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"
_HEXTET = "[0-9a-f]{1,4}"


def _any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _colon_shape() -> str:
    """Valid colon text: eight groups, or fewer with one gap; a dotted tail stands for two."""

    def groups(low: int, high: int) -> str:
        return rf"(?:{_HEXTET}:){{{low},{high}}}"

    tails = []
    for tail, width in ((_HEXTET, 1), (DOTTED, 2)):
        tails.append(groups(8 - width, 8 - width) + tail)
        # A gap stands for at least one group.
        for before in range(0, 8 - width):
            left = groups(before - 1, before - 1) + _HEXTET if before else ""
            tails.append(left + "::" + groups(0, 7 - width - before) + tail)
    for before in range(0, 8):
        left = groups(before - 1, before - 1) + _HEXTET if before else ""
        tails.append(left + "::")
    return _any_of(tails)


def _dotted_pattern(cidr: str) -> str:
    """A pattern for the dotted text of every address in the range."""
    net = ipaddress.IPv4Network(cidr)
    whole, bits = divmod(net.prefixlen, 8)
    first = net.network_address.packed
    parts = [str(octet) for octet in first[:whole]]
    if bits:
        span = range(first[whole], first[whole] + (1 << (8 - bits)))
        parts.append("(?:" + "|".join(map(str, span)) + ")")
    return r"\.".join(parts + [OCTET] * (4 - len(parts)))


def _hex_pattern(cidr: str) -> str:
    """A pattern for the leading hex digits of every address in the range."""
    net = ipaddress.ip_network(cidr)
    whole, bits = divmod(net.prefixlen, 4)
    digits = net.network_address.packed.hex()
    head = digits[:whole]
    if bits:
        first = int(digits[whole], 16)
        head += "[" + "".join(f"{d:x}" for d in range(first, first + (1 << (4 - bits)))) + "]"
    return head


def _private_dotted() -> str:
    holes = _any_of([_dotted_pattern(c) for c in PUBLIC_HOLES_V4])
    return rf"(?!{holes}\z){_any_of([_dotted_pattern(c) for c in PRIVATE_V4])}"


def _colon_range(cidr: str) -> str:
    """A pattern for keys of ``_colon_key``: hex digits, a slash, and a dotted tail if any."""
    net = ipaddress.IPv6Network(cidr)
    if net.prefixlen <= 96:
        return _hex_pattern(cidr) + "[0-9a-f]*/.*"
    digits = net.network_address.packed.hex()
    tail = ipaddress.IPv4Address(int(digits[24:], 16))
    return rf"(?:{digits}/|{digits[:24]}0{{8}}/{re.escape(str(tail))})\z"


def _private_key() -> str:
    mapped = "0" * 20 + "ffff"
    holes = _any_of([_hex_pattern(c) for c in PUBLIC_HOLES_V4])
    mapped_hex = rf"(?!{holes}){_any_of([_hex_pattern(c) for c in PRIVATE_V4])}[0-9a-f]*/\z"
    mapped_ranges = rf"{mapped}(?:0{{8}}/{_private_dotted()}|{mapped_hex})\z"
    holes = _any_of([_colon_range(c) for c in PUBLIC_HOLES_V6])
    ranges = _any_of([_colon_range(c) for c in PRIVATE_V6])
    return rf"\A(?:{mapped_ranges}|(?!{holes}){ranges})"


_PRIVATE_DOTTED = rf"\A{_private_dotted()}\z"
_COLON_SHAPE = rf"\A{_colon_shape()}(?:%[^%/]+)?\z"
_PRIVATE_KEY = _private_key()


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(rf"\A{DOTTED}\z"), F.lit(False))


def _colon_key(ip: Column) -> Column:
    """Valid colon text as 32 hex digits, a slash, and its dotted tail if it has one.

    The tail's own digits read zero. Text is referred to few times, since each reference is
    evaluated, and compiled, on its own.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(ip), "%.*", ""), DOTTED, "0:0")
    padded = F.regexp_replace(plain, "([0-9a-f]+)", "000$1")
    padded = F.regexp_replace(padded, "[0-9a-f]*([0-9a-f]{4})", "$1")
    packed = F.replace(F.replace(padded, F.lit("::"), F.lit("*")), F.lit(":"))
    right = F.substring_index(packed, "*", -1)
    left = F.rpad(F.substring_index(packed, "*", 1), 32, "0")
    tail = F.regexp_extract(ip, DOTTED, 0)
    return F.concat(F.overlay(left, right, 33 - F.char_length(right)), F.lit("/"), tail)


def _dotted_digits(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = sum(
        F.get(octets, F.lit(i)).try_cast("bigint") * (1 << (8 * (3 - i))) for i in range(4)
    )
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def address_key(ip: Column) -> Column:
    """A valid address as text that sorts like its number: 4 and 8 hex digits, or 6 and 32.

    Any other text has none. The zone of an address does not count.
    """
    def whole(key: Column) -> Column:
        digits, tail = F.substring_index(key, "/", 1), F.substring_index(key, "/", -1)
        return F.when(tail == "", digits).otherwise(
            F.concat(F.substring(digits, 1, 24), _dotted_digits(tail))
        )

    # A lambda's argument is evaluated once, however often it is named.
    digits = F.get(F.transform(F.array(_colon_key(ip)), whole), F.lit(0))
    colon = F.when(F.lower(ip).rlike(_COLON_SHAPE), F.concat(F.lit("6"), digits))
    return F.when(is_ipv4(ip), F.concat(F.lit("4"), _dotted_digits(ip))).when(
        ip.contains(":"), colon
    )


def is_private(ip: Column) -> Column:
    """True for special-use addresses; text that is no address is not private."""
    colon = F.lower(ip).rlike(_COLON_SHAPE) & _colon_key(ip).rlike(_PRIVATE_KEY)
    return F.coalesce(
        F.when(ip.contains(":"), colon).otherwise(ip.rlike(_PRIVATE_DOTTED)), F.lit(False)
    )


def is_internal_server(ip: Column) -> Column:
    """A text prefix test: ``192.168.1.1`` also covers .10-.19 and .100-.199."""
    hit = F.lit(False)
    for prefix in INTERNAL_PREFIXES:
        hit = hit | ip.startswith(prefix)
    return F.coalesce(hit, F.lit(False))
