"""Big-endian reads and addresses over BinaryType columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(data: Column, at: Column | int, n: int) -> Column:
    """The ``n``-byte big-endian unsigned integer at a 0-based offset, as a long.

    Short input gives null: the caller's length test decides, but an
    undecodable read never turns into 0.
    """
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def u8(data: Column, at: Column | int) -> Column:
    return be(data, at, 1)


def u16(data: Column, at: Column | int) -> Column:
    return be(data, at, 2)


def u24(data: Column, at: Column | int) -> Column:
    return be(data, at, 3)


def u32(data: Column, at: Column | int) -> Column:
    return be(data, at, 4)


def cut(data: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` bytes at a 0-based offset."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, at + 1, F.lit(n) if isinstance(n, int) else n)


def bits(value: Column, shift: int, mask: int) -> Column:
    """``(value >> shift) & mask``."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def mac_text(mac: Column) -> Column:
    """Lower-case hex with colons."""
    return F.lower(F.regexp_replace(F.hex(mac), "(..)(?=.)", "$1:"))


def ipv4_text(ip: Column) -> Column:
    """Dotted quad of four bytes."""
    return F.concat_ws(".", *[u8(ip, i).cast("string") for i in range(4)])


def ipv6_text(ip: Column) -> Column:
    """RFC 5952 text of sixteen bytes: the longest run of zero groups (of two or more; the
    first such) becomes ``::``, and a mapped address ends in a dotted quad (X2)."""
    groups = F.concat(*[F.concat(F.lit(":"), F.lower(F.conv(F.hex(cut(ip, 2 * i, 2)), 16, 16))) for i in range(8)])

    def shown(g: Column) -> Column:
        text = F.substring(g, 2, 100)
        for n in range(2, 9):
            run = rf"^((?::[0-9a-f]+)*?)(?::0){{{n}}}((?::[0-9a-f]+)*)$"
            left = F.regexp_replace(F.regexp_extract(g, run, 1), "^:", "")
            right = F.regexp_replace(F.regexp_extract(g, run, 2), "^:", "")
            text = F.when(g.rlike(run), F.concat(left, F.lit("::"), right)).otherwise(text)
        return text

    mapped = F.concat(F.lit("::ffff:"), ipv4_text(F.substring(ip, 13, 4)))
    return F.when(F.hex(F.substring(ip, 1, 12)) == "00000000000000000000FFFF", mapped).otherwise(let(groups, shown))


def ip_text(ip: Column) -> Column:
    """Text of a 4- or 16-byte address; null for any other length."""
    return F.when(F.length(ip) == 4, let(ip, ipv4_text)).when(F.length(ip) == 16, let(ip, ipv6_text))


def ip_order(ip: Column) -> Column:
    """A binary that sorts like addresses do: version 4 first, then by octets."""
    return F.concat(F.when(F.length(ip) == 4, F.unhex(F.lit("04"))).otherwise(F.unhex(F.lit("06"))), ip)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row.

    A variable of a lambda function is a thing that the optimizer can't put the expression
    in place of, so a body that reads it many times stays small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_bytes(text: Column) -> Column:
    """Four bytes of a dotted quad; null if it isn't one."""
    octet = lambda p, i: F.lpad(F.hex(F.get(p, F.lit(i)).cast("int")), 2, "0")
    good = text.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(good, let(F.split(text, r"\."), lambda p: F.unhex(F.concat(*[octet(p, i) for i in range(4)]))))


def serial_less(a: Column, b: Column) -> Column:
    """``a`` before ``b`` in 32-bit serial arithmetic."""
    return F.pmod(a - b, F.lit(1 << 32)) >= (1 << 31)


# Version 4 addresses that belong to no place, as first and last number.
_NOWHERE = (
    (0x0A000000, 0x0AFFFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0A80000, 0xC0A8FFFF), (0x7F000000, 0x7FFFFFFF), (0xA9FE0000, 0xA9FEFFFF), (0xFFFFFFFF, 0xFFFFFFFF),
    (0xC0000200, 0xC00002FF), (0xC6336400, 0xC63364FF), (0xCB007100, 0xCB0071FF), (0x00000000, 0x00000000), (0xE0000000, 0xEFFFFFFF),
)


def is_global(ip: Column) -> Column:
    """Whether an address is worth looking up where it is.

    Version 4: not private, loopback, link-local, broadcast, documentation,
    unspecified or multicast.  Version 6: not loopback, unspecified, multicast,
    link-local or unique-local.  A null address is not global.
    """

    def four(n: Column) -> Column:
        return ~reduce(or_, [n.between(lo, hi) for lo, hi in _NOWHERE])

    def six(h: Column) -> Column:
        return ~(h.isin("0" * 31 + "1", "0" * 32) | F.substring(h, 1, 2).isin("FC", "FD", "FF") | F.substring(h, 1, 3).isin("FE8", "FE9", "FEA", "FEB"))

    test = lambda h: F.when(F.length(h) == 8, let(F.conv(h, 16, 10).cast("long"), four)).when(F.length(h) == 32, six(h))
    return F.coalesce(let(F.hex(ip), test), F.lit(False))
