"""IP address checks and normal forms as native expressions (no Python workers)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hawkgrid.functions.bind import let

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_V4_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_MAX_TEXT = 45

# IPv4 blocks that are never looked up (first address, prefix length),
# and the two addresses inside 192.0.0.0/24 that are public.
NON_PUBLIC_V4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
]
PUBLIC_EXCEPTIONS_V4 = ["192.0.0.9", "192.0.0.10"]
# The subset treated as internal (private, loopback, link-local, unspecified).
INTERNAL_V4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_V4)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad to its 32-bit value; null when the text is not IPv4."""
    part = F.split(ip, r"\.")
    value = sum((part.getItem(i).cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
                part.getItem(0).cast("bigint") * 256**3)
    return F.when(is_ipv4(ip), value)


def _block_range(first: str, prefix: int) -> tuple[int, int]:
    base = 0
    for octet in first.split("."):
        base = base * 256 + int(octet)
    return base, base + 2 ** (32 - prefix) - 1


def in_blocks(number: Column, blocks: list[tuple[str, int]]) -> Column:
    hit = F.lit(False)
    for first, prefix in blocks:
        hit = hit | number.between(*_block_range(first, prefix))
    return hit


def is_public_ipv4(ip: Column) -> Column:
    """True for routable IPv4 only; anything else (v6, garbage, null) is false."""
    blocked = let(ipv4_number(ip), lambda n: in_blocks(n, NON_PUBLIC_V4))
    return F.when(is_ipv4(ip), ip.isin(PUBLIC_EXCEPTIONS_V4) | ~blocked).otherwise(F.lit(False))


def _internal_v6(v6: Column) -> Column:
    reserved = v6.rlike(r"^2001:(:|[0-9a-f]{1,2}:|1[0-9a-f]{2}:)") & ~v6.rlike(
        r"^2001:(1::[12]$|3:|4:112:|[23][0-9a-f]:)")
    plain = reserved | v6.rlike(
        r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:|2002:|100::[^:]*(:[^:]*){0,3}$)")
    mapped = F.regexp_extract(v6, r"^::ffff:([0-9.]+)$", 1)
    inner = let(mapped, lambda m: in_blocks(ipv4_number(m), INTERNAL_V4))
    # An address that does not parse is treated as internal: it is never looked up.
    return F.when(v6.isNull(), True).when(mapped != "", inner).otherwise(plain)


def is_internal(ip: str) -> Column:
    """Private, loopback, link-local or unspecified; unparsable text counts as internal."""
    text = F.col(ip)
    v4 = let(ipv4_number(text), lambda n: in_blocks(n, INTERNAL_V4)) & ~text.isin(PUBLIC_EXCEPTIONS_V4)
    v6 = let(normalise_ip(ip), _internal_v6)
    return F.when(is_ipv4(text), v4).when(text.contains(":"), v6).otherwise(F.lit(True))


def _hex(group: Column) -> Column:
    return F.lower(F.hex(F.conv(group, 16, 10).cast("bigint")))


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))


def _expand_tail(base: Column) -> Column:
    """Rewrite a dotted IPv4 ending as two hexadecimal groups."""

    def rewrite(parts: Column) -> Column:
        n = [parts.getItem(i).cast("bigint") for i in range(4)]
        return F.concat(
            F.regexp_extract(base, _V4_TAIL, 1),
            F.lower(F.hex(n[0] * 256 + n[1])), F.lit(":"), F.lower(F.hex(n[2] * 256 + n[3])),
        )

    dotted = F.split(F.regexp_extract(base, "([^:]*)$", 1), r"\.")
    return F.when(base.rlike(_V4_TAIL), let(dotted, rewrite)).otherwise(base)


def _fill(text: Column) -> Column:
    """The eight groups of an address without zone, or null when it is malformed."""

    def from_halves(halves: Column) -> Column:
        n = F.size(halves)
        sides = F.struct(
            _groups(halves.getItem(0)).alias("l"),
            F.when(n == 2, _groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("r"),
        )

        def check(side: Column) -> Column:
            left, right = side.getField("l"), side.getField("r")
            given = F.size(left) + F.size(right)
            filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
            sized = ((n == 1) & (given == 8)) | ((n == 2) & (given <= 7))
            hexes = F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
            return F.when(sized & hexes, filled)

        return let(sides, check)

    return let(F.split(text, "::", -1), from_halves)


def _compress(joined: Column) -> Column:
    """Replace the first longest run of zero groups by '::'."""
    out = joined
    for run in range(2, 9):
        pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?:$|:)(.*)$"
        out = F.when(joined.rlike(pattern), F.regexp_replace(joined, pattern, "$1::$2")).otherwise(out)
    return out


def _render(groups: Column) -> Column:
    def show(short: Column) -> Column:
        high = F.conv(groups.getItem(6), 16, 10).cast("bigint")
        low = F.conv(groups.getItem(7), 16, 10).cast("bigint")
        octets = [F.shiftright(high, 8), high % 256, F.shiftright(low, 8), low % 256]
        mapped = short.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$")
        return F.when(mapped, F.concat(
            F.lit("::ffff:"), F.concat_ws(".", *[o.cast("string") for o in octets]))).otherwise(short)

    joined = F.array_join(F.transform(groups, _hex), ":")
    return let(let(joined, _compress), show)


def _normalise_v6(ip: Column) -> Column:
    def build(parts: Column) -> Column:
        base, zone = F.lower(parts.getItem(0)), F.get(parts, F.lit(1))
        zone_ok = (F.size(parts) == 1) | ((F.size(parts) == 2) & (zone != ""))
        suffix = F.when(F.size(parts) == 2, F.concat(F.lit("%"), zone)).otherwise(F.lit(""))
        return F.when(zone_ok, F.concat(let(_fill(let(base, _expand_tail)), _render), suffix))

    return let(F.split(ip, "%", -1), build)


@lru_cache(maxsize=64)
def _normalised_column(name: str) -> Column:
    return _normalise(F.col(name))


def normalise_ip(ip: str | Column) -> Column:
    """Canonical text of a valid IPv4 or IPv6 address, else null.

    IPv4 rows stop at one regular expression; the IPv6 branch runs only for rows
    that contain a colon. Expressions of plain column names are built once.
    """
    return _normalised_column(ip) if isinstance(ip, str) else _normalise(ip)


def _normalise(ip: Column) -> Column:
    text = F.trim(ip)
    v6 = let(_normalise_v6(text), lambda v: F.when(F.length(v) <= _MAX_TEXT, v))
    return F.when(is_ipv4(text), text).when(text.contains(":"), v6)


def address_hex(ip: Column) -> Column:
    """The 128 bits of an address as 32 hexadecimal digits, IPv4 as the mapped address; null if malformed. A zone is ignored."""
    text = F.trim(ip)
    four = F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0")))
    base = F.lower(F.split(text, "%", 2).getItem(0))
    six = let(_fill(let(base, _expand_tail)), lambda groups: F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(is_ipv4(text), four).when(text.contains(":"), six)
