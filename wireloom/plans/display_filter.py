"""The display-filter language: text to a syntax tree to one boolean Column.

Grammar (keywords have no word boundary, so ``nottcp`` is *not tcp*)::

    or     = and { ("||" | "or") and }
    and    = unary { ("&&" | "and") unary }
    unary  = ("not" | "!") unary | atom
    atom   = "(" or ")" | field "contains" word | field ("!=" | "==") value | protocol
    value  = dotted quad | digits | word            (the first that matches stays)

Evaluation knows two values: a comparison over a field that a packet hasn't is
false, and ``not`` of it true.  So every leaf is coalesced to false before the
connectives see it.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocol words, longest first where one starts another, and the layers they ask for.
PROTOCOLS = {
    "icmpv6": ("icmpv6",), "icmp": ("icmp",), "ipv6": ("ipv6",), "ipv4": ("ipv4",), "eth": ("eth",), "tcp": ("tcp",), "udp": ("udp",), "arp": ("arp",), "dns": ("dns",),
    "tls": ("tls_client_hello", "tls_handshake"), "ip": ("ipv4", "ipv6"),
}
# Comparable fields: kind of value and where it stands.
FIELDS = {
    "ip.src": ("ip", ("ipv4.src_ip", "ipv6.src_ip")), "ip.dst": ("ip", ("ipv4.dst_ip", "ipv6.dst_ip")),
    "tcp.srcport": ("int", ("tcp.src_port",)), "tcp.dstport": ("int", ("tcp.dst_port",)), "udp.srcport": ("int", ("udp.src_port",)), "udp.dstport": ("int", ("udp.dst_port",)),
    "dns.qname": ("str", ("dns.questions[0].qname",)), "tls.sni": ("str", ("tls_client_hello.sni",)),
    "icmp.type": ("int", ("icmp.icmp_type",)), "icmp.code": ("int", ("icmp.code",)), "arp.sender.ip": ("ip", ("arp.sender_ip",)), "arp.target.ip": ("ip", ("arp.target_ip",)),
}


class FilterError(ValueError):
    """A filter text that isn't one."""


@dataclass(frozen=True)
class Present:
    protocol: str


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: int | str | ipaddress.IPv4Address


@dataclass(frozen=True)
class Contains:
    field: str
    word: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


_BLANK = re.compile(r"[ \t\r\n]*")
_FIELD = re.compile(r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+")
_WORD = re.compile(r"[^ \t\n\r)]+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class _Parser:
    """Recursive descent; a method returns None, with the place unchanged, where its rule doesn't fit."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()

    def token(self, *options: str) -> str | None:
        """One of ``options``, with blanks around it."""
        start = self.at
        self.blank()
        for o in options:
            if self.text.startswith(o, self.at):
                self.at += len(o)
                self.blank()
                return o
        self.at = start
        return None

    def pattern(self, p: re.Pattern) -> str | None:
        start = self.at
        self.blank()
        m = p.match(self.text, self.at)
        if not m:
            self.at = start
            return None
        self.at = m.end()
        return m[0]

    def _chain(self, part, make, *words: str):
        left = part()
        while left is not None:
            start = self.at
            right = part() if self.token(*words) else None
            if right is None:
                self.at = start
                break
            left = make(left, right)
        return left

    def either(self):
        return self._chain(self.both, Or, "||", "or")

    def both(self):
        return self._chain(self.unary, And, "&&", "and")

    def unary(self):
        start = self.at
        if self.token("not", "!"):
            of = self.unary()
            if of is not None:
                return Not(of)
            self.at = start
        return self.atom()

    def atom(self):
        start = self.at
        for rule in (self.group, self.leaf):
            found = rule()
            if found is not None:
                return found
            self.at = start
        word = self.token(*PROTOCOLS)
        return Present(word) if word else None

    def group(self):
        if not self.token("("):
            return None
        inside = self.either()
        return inside if inside is not None and self.token(")") else None

    def leaf(self):
        field = self.pattern(_FIELD)
        if field is None:
            return None
        after = self.at
        if self.token("contains"):
            word = self.pattern(_WORD)
            if word is not None:
                self.blank()
                return Contains(field, word)
            self.at = after
        op = self.token("!=", "==")
        value = self.value() if op else None
        return None if value is None else Compare(field, op, value)

    def value(self):
        quad = self.pattern(_QUAD)
        if quad is not None:
            try:
                found: int | str | ipaddress.IPv4Address = ipaddress.IPv4Address(quad)
                self.blank()
                return found
            except ValueError:
                self.at -= len(quad)
        digits = self.pattern(_DIGITS)
        if digits is not None and int(digits) < 1 << 63:
            self.blank()
            return int(digits)
        if digits is not None:
            self.at -= len(digits)
        word = self.pattern(_WORD)
        if word is not None:
            self.blank()
        return word


def parse(text: str):
    """The syntax tree of a filter text; :class:`FilterError` if it isn't one."""
    text = text.strip()
    if not text:
        raise FilterError("empty filter")
    p = _Parser(text)
    tree = p.either()
    if tree is None:
        raise FilterError(f"not a filter: {text!r}")
    if p.at != len(text):
        raise FilterError(f"unexpected input after the filter: {text[p.at :]!r}")
    return tree


def _kind(value) -> str:
    return {int: "int", str: "str"}.get(type(value), "ip")


def _field(path: str) -> Column:
    return F.get(F.col("dns.questions"), F.lit(0))["qname"] if path.startswith("dns.") else F.col(path)


def _compare(at: Column, kind: str, op: str, value) -> Column:
    """Typed equality: values of different kinds are unequal, so ``!=`` holds wherever the field is."""
    if kind != _kind(value):
        return at.isNotNull() & F.lit(op == "!=")
    other = F.lit(bytearray(value.packed)) if kind == "ip" else F.lit(value)
    return (at == other) if op == "==" else (at != other)


def compile_filter(tree) -> Column:
    """The tree as one boolean Column over decoded packets; never null.

    Unknown fields are absent, so their comparisons are false.
    """
    false = F.lit(False)
    if isinstance(tree, Present):
        there = [F.col(c).isNotNull() for c in PROTOCOLS[tree.protocol]]
        return there[0] if len(there) == 1 else there[0] | there[1]
    if isinstance(tree, Not):
        return ~compile_filter(tree.of)
    if isinstance(tree, And):
        return compile_filter(tree.left) & compile_filter(tree.right)
    if isinstance(tree, Or):
        return compile_filter(tree.left) | compile_filter(tree.right)
    if isinstance(tree, Compare) and tree.field in ("tcp.port", "udp.port"):
        layer = tree.field[:3]
        ends = [_compare(F.col(f"{layer}.{x}_port"), "int", tree.op, tree.value) for x in ("src", "dst")]
        return F.coalesce(ends[0] | ends[1], false)
    if tree.field not in FIELDS:
        return false
    kind, places = FIELDS[tree.field]
    at = F.coalesce(*map(_field, places))
    if isinstance(tree, Contains):
        return F.coalesce(at.contains(tree.word), false) if kind == "str" else false
    return F.coalesce(_compare(at, kind, tree.op, tree.value), false)


def layers(text: str) -> set[str]:
    """The layers that a filter text reads: what ``decode`` has to make for it."""

    def of(tree) -> set[str]:
        if isinstance(tree, Present):
            return set(PROTOCOLS[tree.protocol])
        if isinstance(tree, Not):
            return of(tree.of)
        if isinstance(tree, And | Or):
            return of(tree.left) | of(tree.right)
        if tree.field in ("tcp.port", "udp.port"):
            return {tree.field[:3]}
        return {place.split(".")[0] for place in FIELDS.get(tree.field, ("", ()))[1]}

    return of(parse(text))


def matching(packets: DataFrame, text: str, saved: dict[str, str] | None = None) -> DataFrame:
    """The packets that a filter text lets through; ``:name`` recalls a saved one."""
    if text.strip().startswith(":"):
        name = text.strip()[1:].strip()
        if name not in (saved or {}):
            raise FilterError(f"no saved filter named {name!r}")
        text = saved[name]
    return packets.filter(compile_filter(parse(text)))


def searched(packets: DataFrame, pattern: str) -> DataFrame:
    """Packets whose info, source or destination matches a (Java) regular expression."""
    s = F.col("summary")
    return packets.filter(s["info"].rlike(pattern) | s["source"].rlike(pattern) | s["destination"].rlike(pattern))


def next_match(packets: DataFrame, pattern: str, after: int) -> DataFrame:
    """(number): the first match after packet ``after``, else the first of all."""
    n = F.col("number")
    return searched(packets, pattern).agg(F.coalesce(F.min(F.when(n > after, n)), F.min(n)).alias("number"))
