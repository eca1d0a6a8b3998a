"""Names, sizes, dumps and other text of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label suffixes under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
# IP protocol numbers and DNS record types that have a name.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 15: "MX", 16: "TXT", 28: "AAAA", 255: "ANY"}


def _named(value: Column, names: dict[int, str], other: Column) -> Column:
    out = other
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def protocol_name(number: Column, narrow: bool = False) -> Column:
    """Name of an IP protocol, else ``Unknown``; ``narrow`` leaves out ICMPv6 and says ``?``."""
    names = {k: v for k, v in PROTOCOLS.items() if not (narrow and k == 58)}
    return _named(number, names, F.lit("?" if narrow else "Unknown"))


def dns_type_name(number: Column) -> Column:
    """Name of a DNS record type, else ``?``."""
    return _named(number, DNS_TYPES, F.lit("?"))


def registrable_domain(name: Column) -> Column:
    """The last two labels of a name, or three under a known two-label suffix."""
    labels = F.split(F.regexp_replace(name, r"\.+$", ""), r"\.", -1)
    n = F.size(labels)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def byte_size(n: Column) -> Column:
    """Bytes as text in steps of 1024: whole below, else one decimal, ties to even."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for k, unit in enumerate("KMG", 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f{unit}", F.bround(n.cast("double") / 1024**k, 1))).otherwise(out)
    return out


def clock(ts: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    return F.date_format(ts, "HH:mm:ss.SSS")


def day_and_time(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of milliseconds since 1970."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def printable(data: Column) -> Column:
    """Bytes as text: newline and tab stay, carriage return is a blank, others a dot."""
    return F.regexp_replace(F.replace(F.decode(data, "ISO-8859-1"), F.lit("\r"), F.lit(" ")), r"[^\x20-\x7E\n\t]", ".")


def hex_dump(data: Column) -> Column:
    """Lines of 16 bytes: offset, hex with a gap after eight, and the printable text."""
    empty = F.array().cast("array<string>")
    lines = F.sequence(F.lit(0), F.length(data) - 1, F.lit(16))

    def line(at: Column) -> Column:
        part = F.substring(data, at + 1, F.lit(16))
        pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")
        split = F.concat(F.substring(pairs, 1, 24), F.when(F.length(pairs) >= 24, " ").otherwise(""), F.substring(pairs, 25, 24))
        # a line of just eight bytes is one column wider
        wide = F.rpad(split, F.when(F.length(pairs) == 24, 50).otherwise(49), " ")
        text = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        return F.concat(F.lower(F.lpad(F.hex(at), 4, "0")), F.lit("   "), wide, F.lit("  "), text)

    return F.when(F.length(data) > 0, F.transform(lines, line)).otherwise(empty)


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def severity_rank(severity: Column) -> Column:
    """info < notice < warning < critical as 0 to 3; unknown text counts as info."""
    return _named_text(severity, {"notice": 1, "warning": 2, "critical": 3})


def _named_text(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out
