"""JA3 and JA4 of a ClientHello's fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How JA4 writes TLS and DTLS versions.
VERSION_CODES = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0xFEFF: "d1", 0xFEFD: "d2"}


def is_grease(v: Column) -> Column:
    """RFC 8701 values: both bytes alike, the low nibble 0xA."""
    return (F.shiftright(v, 8) == v.bitwiseAND(F.lit(255))) & (v.bitwiseAND(F.lit(15)) == 10)


def real(values: Column) -> Column:
    """A list without its GREASE values; a null list is an empty one."""
    return F.filter(F.coalesce(values, F.array().cast("array<int>")), lambda v: ~is_grease(v))


def _join(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "-")


def _hex4(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), ",")


def ja3_string(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    """``version,ciphers,extensions,groups,formats`` without GREASE (formats stay as they are)."""
    points = F.coalesce(formats, F.array().cast("array<int>"))
    return F.concat_ws(",", version.cast("string"), _join(real(ciphers)), _join(real(extensions)), _join(real(groups)), _join(points))


def ja3(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    """MD5 of the JA3 string, in hex."""
    return F.md5(ja3_string(version, ciphers, extensions, groups, formats).cast("binary"))


def _sha12(text: Column, empty: Column) -> Column:
    return F.when(empty, "000000000000").otherwise(F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def ja4(version: Column, sni: Column, ciphers: Column, extensions: Column, signatures: Column, alpn: Column, quic: bool = False) -> Column:
    """The JA4 text (D11); ``sni`` says whether there is one, ``alpn`` is the first protocol or null.

    Signature algorithms keep their order and their GREASE; the underscore
    before them stands even if there are none.
    """
    c, e = real(ciphers), real(extensions)
    code = F.lit("00")
    for k, v in VERSION_CODES.items():
        code = F.when(version == k, v).otherwise(code)
    two = lambda n: F.format_string("%02d", F.least(n, F.lit(99)))
    raw = alpn.cast("binary")
    ends = F.concat(F.decode(F.substring(raw, 1, 1), "ISO-8859-1"), F.decode(F.substring(raw, F.length(raw), F.lit(1)), "ISO-8859-1"))
    first = F.when(alpn.isNull() | (F.length(raw) == 0), "00").otherwise(ends)
    head = F.concat(F.lit("q" if quic else "t"), code, F.when(sni, "d").otherwise("i"), two(F.size(c)), two(F.size(e)), first)
    rest = F.filter(e, lambda v: (v != 0) & (v != 16))
    sigs = F.coalesce(signatures, F.array().cast("array<int>"))
    b = _sha12(_hex4(F.array_sort(c)), F.size(c) == 0)
    tail = _sha12(F.concat(_hex4(F.array_sort(rest)), F.lit("_"), _hex4(sigs)), (F.size(rest) == 0) & (F.size(sigs) == 0))
    return F.concat_ws("_", head, b, tail)
