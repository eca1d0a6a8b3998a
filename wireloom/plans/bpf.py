"""A subset of capture-filter syntax as a Column over undecoded frames.

Served: ``tcp``, ``udp``, ``icmp``, ``icmp6``, ``arp``, ``ip``, ``ip6``; ``[ip|arp|ip6] [src|dst] host ADDRESS``;
``[tcp|udp] [src|dst] port N`` and ``portrange N-M``; ``less N``, ``greater N`` (lengths on the wire, N itself
included); ``and``/``&&``, ``or``/``||``, ``not``/``!`` and parentheses.
``not`` binds tightest; ``and`` and ``or`` bind alike, from the left.
Anything else is refused, never ignored.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decode import headers

_TOKENS = re.compile(r"\s*(\(|\)|&&|\|\||!|[A-Za-z0-9_.:-]+)")
_LAYER = {"tcp": "tcp", "udp": "udp", "icmp": "icmp", "icmp6": "icmpv6", "arp": "arp", "ip": "ipv4", "ip6": "ipv6"}
# Where a layer holds the addresses of its two ends.
_ENDS = {"ip": ("ipv4.src_ip", "ipv4.dst_ip"), "arp": ("arp.sender_ip", "arp.target_ip"), "ip6": ("ipv6.src_ip", "ipv6.dst_ip")}


class CaptureFilterError(ValueError):
    """Text outside the subset."""


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKENS.match(text, at)
        if not m:
            raise CaptureFilterError(f"not served: {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


class _Parser:
    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def expression(self) -> Column:
        left = self.factor()
        while self.peek() in ("and", "&&", "or", "||"):
            both = self.next() in ("and", "&&")
            right = self.factor()
            left = left & right if both else left | right
        return left

    def factor(self) -> Column:
        if self.peek() in ("not", "!"):
            self.next()
            return ~self.factor()
        if self.peek() == "(":
            self.next()
            inside = self.expression()
            if self.next() != ")":
                raise CaptureFilterError("a parenthesis isn't closed")
            return inside
        return self.primitive()

    def primitive(self) -> Column:
        word = self.next()
        if word in ("less", "greater"):
            size = self.next()
            if not size.isdigit():
                raise CaptureFilterError(f"not a length: {size!r}")
            return F.coalesce(F.col("wire_len") <= int(size) if word == "less" else F.col("wire_len") >= int(size), F.lit(False))
        layer = word if word in _LAYER else None
        if layer and self.peek() not in ("src", "dst", "port", "portrange", "host"):
            return F.col(_LAYER[layer]).isNotNull()
        word = self.next() if layer else word
        ends = [0, 1]
        if word in ("src", "dst"):
            ends, word = [("src", "dst").index(word)], self.next()
        value = self.next()
        if word in ("port", "portrange") and layer in (None, "tcp", "udp"):
            return self.ports(word, value, [layer] if layer else ["tcp", "udp"], ends)
        if word == "host" and (layer is None or layer in _ENDS):
            return self.host(value, layer, ends)
        raise CaptureFilterError(f"not served: {layer or ''} {word} {value}".strip())

    def ports(self, word: str, value: str, layers: list[str], ends: list[int]) -> Column:
        first, dash, last = value.partition("-")
        last = last if dash else first
        if bool(dash) != (word == "portrange") or not (first.isdigit() and last.isdigit()):
            raise CaptureFilterError(f"not served: {word} {value}")
        low, high = sorted((int(first), int(last)))
        names = [f"{x}.{('src_port', 'dst_port')[e]}" for x in layers for e in ends]
        return _any([F.coalesce(F.col(c).between(low, high), F.lit(False)) for c in names])

    def host(self, value: str, layer: str | None, ends: list[int]) -> Column:
        try:
            ip = ipaddress.ip_address(value)
        except ValueError as e:
            raise CaptureFilterError(f"not an address: {value!r}") from e
        can = ("ip", "arp") if ip.version == 4 else ("ip6",)
        if layer not in (None, *can):
            raise CaptureFilterError(f"{layer} has no address {value}")
        lit = F.lit(bytearray(ip.packed))
        return _any([F.coalesce(F.col(_ENDS[x][e]) == lit, F.lit(False)) for x in can if layer in (None, x) for e in ends])


def compile_bpf(text: str) -> Column:
    """The filter as a Column over :func:`wireloom.operators.decode.headers`; empty text lets all through."""
    p = _Parser(_tokens(text))
    if not p.tokens:
        return F.lit(True)
    out = p.expression()
    if p.at < len(p.tokens):
        raise CaptureFilterError(f"not served: {' '.join(p.tokens[p.at :])}")
    return out


def captured(raw: DataFrame, text: str) -> DataFrame:
    """The frames that a capture filter lets through, undecoded as before."""
    names = raw.columns
    return headers(raw).filter(compile_bpf(text)).select(*names)
