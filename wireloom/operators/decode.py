"""Frames to typed layers.

``decode`` adds one nullable struct per layer (a packet has at most one of
each), so a present protocol is ``isNotNull``.  Headers at fixed offsets are read
by numpy over the bytes of a whole Arrow batch at once; the parsers of
:mod:`.app` run only over the few rows that can be theirs.  The same rules as
nested Columns make a plan that the optimizer multiplies out beyond memory, and
reads each number through hex text; layers that aren't wanted are not made.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.bytes import cut, mac_text
from ..session import ship, spread
from . import app

RAW = "number long, ts timestamp, wire_len long, data binary, linktype int"
LAYERS = ("eth", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6", "dns", "tls_client_hello", "tls_handshake", "http", "http2", "quic", "payload")

# Link types whose frames start with an IP header, and the one with Ethernet headers.
ETHERNET, RAW_IP = 1, (101, 228)
# Flags in the order in which they are shown.
FLAG_ORDER = ("syn", "ack", "fin", "rst", "psh", "urg", "ece", "cwr")
_FLAG_BITS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
_QUIC_KINDS = ("Initial", "ZeroRtt", "Handshake", "Retry")
QUIC = pa.struct([("long_header", pa.bool_()), ("version", pa.int64()), ("packet_type", pa.string()), ("dcid", pa.binary()), ("scid", pa.binary()), ("sni", pa.string()), ("header_range", app.RANGE)])


def link_name(linktype: Column) -> Column:
    """``ethernet``, ``raw_ip`` or ``other``."""
    return F.when(linktype == ETHERNET, "ethernet").when(linktype.isin(*RAW_IP), "raw_ip").otherwise("other")


class Frames:
    """The bytes of a batch of frames, read by offset arrays."""

    def __init__(self, data: pa.Array) -> None:
        data = data.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = data.buffers()[2]
        self.bytes = np.concatenate([np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), np.zeros(64, np.uint8)])
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.n = len(data)

    def num(self, at: np.ndarray | int, n: int) -> np.ndarray:
        """Big-endian numbers of ``n`` bytes at offsets into each frame; garbage where a frame is shorter."""
        where = np.clip(self.start + at, 0, len(self.bytes) - 64)
        out = self.bytes[where].astype(np.int64)
        for i in range(1, n):
            out = out << 8 | self.bytes[where + i]
        return out

    def cut(self, at: np.ndarray | int, n: int) -> pa.Array:
        """``n`` bytes at offsets into each frame."""
        where = np.clip(self.start + at, 0, len(self.bytes) - 64)
        flat = np.ascontiguousarray(self.bytes[where[:, None] + np.arange(n)])
        ends = np.arange(self.n + 1, dtype=np.int32) * n
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _struct(there: np.ndarray, **fields) -> pa.StructArray:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, pa.bool_() if v.dtype == bool else pa.int32()) for v in fields.values()]
    return pa.StructArray.from_arrays(arrays, names=list(fields), mask=pa.array(~there))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _span(start: np.ndarray | int, end: np.ndarray | int, n: int) -> pa.Array:
    full = lambda x: pa.array(np.broadcast_to(np.asarray(x), n).astype(np.int32))
    return pa.StructArray.from_arrays([full(start), full(end)], names=["start", "end"])


def quic(data: bytes, at: int) -> dict | None:
    """A QUIC long header (D14): the top bit, a version, and two connection ids of at most 20 bytes."""
    c = app.Cursor(data, at)
    if c.rest() < 6:
        return None
    first, version = c.num(1), c.num(4)
    if first < 0x80:
        return None
    ids = []
    try:
        for _ in range(2):
            size = c.num(1)
            if size > 20:
                return None
            ids.append(c.take(size))
    except app.Short:
        return None
    kind = _QUIC_KINDS[first >> 4 & 3] if version else "VersionNegotiation"
    return {"long_header": True, "version": version, "packet_type": kind, "dcid": ids[0], "scid": ids[1], "sni": None, "header_range": {"start": at, "end": c.at}}


def _texts(there: np.ndarray, values: pa.Array, text) -> list[str | None]:
    known: dict[bytes, str] = {}
    out: list[str | None] = []
    for ok, v in zip(there.tolist(), values.to_pylist()):
        if not ok:
            out.append(None)
            continue
        if v not in known:
            known[v] = text(v)
        out.append(known[v])
    return out


def _address(raw: bytes) -> str:
    return str(ipaddress.ip_address(raw))


def layers_of(data: pa.Array, linktype: np.ndarray, want: frozenset[str]) -> dict[str, pa.Array]:
    """The wanted layers of a batch, and ``source`` and ``destination`` texts if wanted."""
    f = Frames(data)
    n = f.n
    out: dict[str, pa.Array] = {}
    eth = (linktype == ETHERNET) & (f.size >= 14)
    kind = f.num(12, 2)
    if "eth" in want:
        out["eth"] = _struct(eth, src_mac=f.cut(6, 6), dst_mac=f.cut(0, 6), ethertype=kind, header_range=_span(0, 14, n))
    raw_ip = np.isin(linktype, RAW_IP) & (f.size > 0)
    at = np.where(eth, 14, 0)
    left = f.size - at
    first = f.num(at, 1)
    ip4 = np.where(eth, kind == 0x0800, raw_ip & (f.num(0, 1) >> 4 == 4))
    ip6 = np.where(eth, kind == 0x86DD, raw_ip & (f.num(0, 1) >> 4 == 6))
    arp = eth & (kind == 0x0806) & (left >= 28)
    if "arp" in want:
        out["arp"] = _struct(
            arp, hw_type=f.num(at, 2), proto_type=f.num(at + 2, 2), operation=f.num(at + 6, 2), sender_mac=f.cut(at + 8, 6), sender_ip=f.cut(at + 14, 4), target_mac=f.cut(at + 18, 6), target_ip=f.cut(at + 24, 4), header_range=_span(at, at + 28, n)
        )
    head = (first & 15) * 4
    ip4 = ip4 & (left >= 20) & (first >> 4 == 4) & (head >= 20) & (left >= head)
    ip6 = ip6 & (left >= 40) & (first >> 4 == 6)
    proto = np.where(ip4, f.num(at + 9, 1), np.where(ip6, f.num(at + 6, 1), -1))
    if "ipv4" in want:
        word = f.num(at + 6, 2)
        out["ipv4"] = _struct(
            ip4, version=first >> 4, ihl=first & 15, dscp=f.num(at + 1, 1) >> 2, ecn=f.num(at + 1, 1) & 3, total_length=f.num(at + 2, 2), identification=f.num(at + 4, 2), flags=word >> 13, fragment_offset=word & 0x1FFF,
            ttl=f.num(at + 8, 1), protocol=f.num(at + 9, 1), checksum=f.num(at + 10, 2), src_ip=f.cut(at + 12, 4), dst_ip=f.cut(at + 16, 4), header_range=_span(at, at + head, n),
        )
    if "ipv6" in want:
        word = f.num(at, 4)
        out["ipv6"] = _struct(
            ip6, version=word >> 28, traffic_class=word >> 20 & 255, flow_label=word & 0xFFFFF, payload_length=f.num(at + 4, 2), next_header=f.num(at + 6, 1), hop_limit=f.num(at + 7, 1), src_ip=f.cut(at + 8, 16), dst_ip=f.cut(at + 24, 16), header_range=_span(at, at + 40, n)
        )
    t = at + np.where(ip4, head, 40)
    rest = np.where(ip4 | ip6, f.size - t, -1)
    words = f.num(t + 12, 1) >> 4
    tcp = (proto == 6) & (rest >= 20) & (words >= 5) & (rest >= words * 4)
    udp = (proto == 17) & (rest >= 8)
    if "tcp" in want:
        bits = f.num(t + 13, 1)
        flags = pa.StructArray.from_arrays([pa.array((bits >> i & 1).astype(bool)) for i in range(8)], names=list(_FLAG_BITS))
        out["tcp"] = _struct(
            tcp, src_port=f.num(t, 2), dst_port=f.num(t + 2, 2), seq_num=_long(f.num(t + 4, 4)), ack_num=_long(f.num(t + 8, 4)), data_offset=words, flags=flags, window_size=f.num(t + 14, 2), checksum=f.num(t + 16, 2),
            urgent_pointer=f.num(t + 18, 2), payload_len=_long(rest - words * 4), header_range=_span(t, t + words * 4, n),
        )
    if "udp" in want:
        out["udp"] = _struct(udp, src_port=f.num(t, 2), dst_port=f.num(t + 2, 2), length=f.num(t + 4, 2), checksum=f.num(t + 6, 2), header_range=_span(t, t + 8, n))
    for name, ok in (("icmp", ip4 & (proto == 1)), ("icmpv6", ip6 & (proto == 58))):
        if name in want:
            out[name] = _struct(ok & (rest >= 8), icmp_type=f.num(t, 1), code=f.num(t + 1, 1), checksum=f.num(t + 2, 2), rest=f.cut(t + 4, 4), header_range=_span(t, t + 8, n))
    begin = np.where(tcp, t + words * 4, t + 8)
    has = (tcp | udp) & (begin < f.size)
    if "payload" in want:
        out["payload"] = _struct(has, offset=begin, len=f.size - begin)
    out |= _applications(f, data, has, begin, tcp, (f.num(t, 2) == 53) | (f.num(t + 2, 2) == 53), want)
    if "source" in want:
        for name, mac, v4, v6, a in (("source", 6, 12, 8, 14), ("destination", 0, 16, 24, 24)):
            macs = _texts(eth & ~(ip4 | ip6 | arp), f.cut(mac, 6), lambda b: b.hex(":"))
            fours = _texts(ip4 | arp, f.cut(at + np.where(arp, a, v4), 4), _address)
            sixes = _texts(ip6, f.cut(at + v6, 16), _address)
            out[name] = pa.array([x or y or z or "" for x, y, z in zip(fours, sixes, macs)], pa.string())
    return out


_APP = {"dns": app.DNS, "tls_client_hello": app.HELLO, "tls_handshake": app.HANDSHAKE, "http": app.HTTP, "http2": app.HTTP2, "quic": QUIC}


def _applications(f: Frames, data: pa.Array, has: np.ndarray, begin: np.ndarray, tcp: np.ndarray, dns: np.ndarray, want: frozenset[str]) -> dict[str, pa.Array]:
    """Port 53 on either side is only DNS, other UDP only QUIC, other TCP the four in turn."""
    rows: dict[str, list] = {k: [None] * f.n for k in _APP if k in want}
    if not rows:
        return {}
    first = f.num(begin, 1)
    letters = (first >= 65) & (first <= 90)  # a method, HTTP/ and the HTTP/2 preface start with a capital
    maybe = has & (dns | np.where(tcp, (first == 0x16) | letters, first >= 0x80))
    for i in np.flatnonzero(maybe).tolist():
        raw, at = data[i].as_py(), int(begin[i])
        if dns[i]:
            found = {"dns": app.dns(raw, at)} if "dns" in rows else {}
        elif not tcp[i]:
            found = {"quic": quic(raw, at)} if "quic" in rows else {}
        else:
            found = app.parse_one(raw, at)
        for k, v in found.items():
            if k in rows:
                rows[k][i] = v
    return {k: pa.array(v, _APP[k]) for k, v in rows.items()}


def _decode(schema: pa.Schema, want: frozenset[str], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = b.column(b.schema.names.index("linktype")).fill_null(-1).to_numpy(zero_copy_only=False)
            got = layers_of(b.column(b.schema.names.index("data")).fill_null(b""), link, want)
            cols = [b.column(i) for i in range(b.num_columns)] + [got[k] for k in names]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, schema)], schema=schema)

    return run


def _types(names: list[str]) -> pa.Schema:
    """The Arrow types of layers, from decoding nothing."""
    got = layers_of(pa.array([], pa.binary()), np.zeros(0, np.int64), frozenset(names))
    return pa.schema([(k, got[k].type) for k in names])


def layered(raw: DataFrame, want: Iterable[str]) -> DataFrame:
    """``raw`` with the wanted ones of LAYERS, ``source`` and ``destination``; others aren't made."""
    ship(raw.sparkSession)
    names = [x for x in (*LAYERS, "source", "destination") if x in set(want)]
    raw = raw.drop(*names)
    types = _types(names)
    schema = StructType([*raw.schema.fields, *from_arrow_schema(types).fields])
    arrow = to_arrow_schema(schema)
    return spread(raw).mapInArrow(_decode(arrow, frozenset(names), names), schema)


def headers(raw: DataFrame) -> DataFrame:
    """``raw`` with the layers up to transport."""
    return layered(raw, ("eth", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6"))


def decode(raw: DataFrame, summary: bool = True, want: Iterable[str] = LAYERS) -> DataFrame:
    """All layers of ``raw`` (number, ts, wire_len, data, linktype, and what else it has), and the summary.

    A payload is there whenever bytes remain after the transport header.  Null
    frames have no layers.  ``want`` leaves layers out; the summary needs all.
    """
    if not summary:
        return layered(raw, want)
    return with_summary(layered(raw, (*LAYERS, "source", "destination"))).drop("source", "destination")


def payload_bytes(data: str = "data", payload: str = "payload") -> Column:
    """The bytes after the transport header, or null."""
    return F.when(F.col(payload).isNotNull(), cut(F.col(data), F.col(f"{payload}.offset"), F.col(f"{payload}.len")))


def flags_text(flags: str = "tcp.flags") -> Column:
    """``[SYN, ACK]``; flags in the fixed order."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.when(F.col(f"{flags}.{f}"), f.upper()) for f in FLAG_ORDER]), F.lit("]"))


def icmp_text(kind: Column, code: Column) -> Column:
    """What an ICMP type and code say."""
    return (
        F.when(kind == 0, "Echo Reply")
        .when((kind == 3) & (code == 0), "Destination Net Unreachable")
        .when((kind == 3) & (code == 1), "Destination Host Unreachable")
        .when((kind == 3) & (code == 3), "Destination Port Unreachable")
        .when(kind == 3, F.format_string("Destination Unreachable (code=%d)", code))
        .when(kind == 8, "Echo Request")
        .when(kind == 11, "Time Exceeded")
        .otherwise(F.format_string("Type=%d Code=%d", kind, code))
    )


def answer_text(answers: Column) -> Column:
    """Addresses and aliases among answers, joined by comma and blank."""
    shown = F.filter(answers, lambda r: r["rdata"]["kind"].isin("A", "Aaaa", "Cname"))
    return F.array_join(F.transform(shown, lambda r: F.when(r["rdata"]["kind"] == "Cname", F.concat(F.lit("CNAME "), r["rdata"]["name"])).otherwise(r["rdata"]["ip"])), ", ")


def with_summary(packets: DataFrame) -> DataFrame:
    """``packets`` with ``summary``: source, destination, protocol, length, info and colour.

    The last layer that says something wins; link addresses stand in only while
    there is no network layer.
    """
    c = F.col
    any_of = lambda *names: [c(x).isNotNull() for x in names]
    eth, arp, ip4, ip6, tcp, udp, icmp, icmp6, dns, hello, shake, http, http2, quic_ = any_of(*LAYERS[:-1])
    order = ((quic_, "QUIC"), (http2, "HTTP/2"), (http, "HTTP"), (hello | shake, "TLS"), (dns, "DNS"), (icmp6, "ICMPv6"), (icmp, "ICMP"), (udp, "UDP"), (tcp, "TCP"), (ip6, "IPv6"), (ip4, "IPv4"), (arp, "ARP"))
    protocol = F.lit("???")
    for there, name in reversed(order):
        protocol = F.when(there, name).otherwise(protocol)
    colour = F.when(hello | shake, "Tls").when(dns, "Dns").when(icmp | icmp6, "Icmp").when(udp, "Udp").when(tcp, "Tcp").when(arp, "Arp").otherwise("Other")
    asks = F.array_join(F.transform("dns.questions", lambda q: q["qname"]), ", ")
    got = answer_text(c("dns.answers"))
    dns_info = F.when(~c("dns.is_response"), F.concat(F.lit("DNS Q "), asks)).when(got == "", F.concat(F.lit("DNS A "), asks)).otherwise(F.concat(F.lit("DNS A "), asks, F.lit(" → "), got))
    m = F.get("tls_handshake.messages", F.lit(0))
    shake_info = (
        F.when((m["kind"] == "ServerHello") & (F.size(m["alpn"]) > 0), F.concat(F.lit("TLS Server Hello (alpn: "), F.array_join(m["alpn"], ","), F.lit(")")))
        .when(m["kind"] == "ServerHello", "TLS Server Hello")
        .when(m["kind"] == "Certificate", F.format_string("TLS Certificate (%d)", m["cert_count"]))
        .when(m["kind"] == "Other", F.format_string("TLS Handshake (type %d)", m["msg_type"]))
        .otherwise("TLS Handshake")
    )
    blank = lambda f: F.coalesce(c(f).cast("string"), F.lit(""))
    http_info = F.when(c("http.is_request"), F.concat(F.coalesce("http.method", F.lit("?")), F.lit(" "), blank("http.host"), blank("http.uri"))).otherwise(F.concat(F.lit("HTTP "), blank("http.status_code"), F.lit(" response")))
    tcp_info = F.concat(
        c("tcp.src_port").cast("string"), F.lit(" → "), c("tcp.dst_port").cast("string"), F.lit(" "), flags_text(), F.lit(" Seq="), c("tcp.seq_num").cast("string"), F.lit(" Ack="), c("tcp.ack_num").cast("string"), F.lit(" Len="), c("tcp.payload_len").cast("string")
    )
    arp_info = (
        F.when(c("arp.operation") == 1, F.concat(F.lit("Who has "), c("destination"), F.lit("? Tell "), c("source")))
        .when(c("arp.operation") == 2, F.concat(c("source"), F.lit(" is at "), mac_text(c("arp.sender_mac"))))
        .otherwise(F.format_string("op=%d", c("arp.operation")))
    )
    info = (
        F.when(quic_, F.concat(F.lit("QUIC "), c("quic.packet_type"), F.lit(" v0x"), F.lower(F.lpad(F.hex("quic.version"), 8, "0"))))
        .when(http2, F.format_string("HTTP/2 (%d frame(s))", F.size("http2.frames")))
        .when(http, http_info)
        .when(shake, shake_info)
        .when(hello, F.when(c("tls_client_hello.sni").isNotNull(), F.concat(F.lit("TLS → "), c("tls_client_hello.sni"))).otherwise("TLS Client Hello"))
        .when(dns, dns_info)
        .when(icmp6, F.format_string("Type=%d Code=%d", c("icmpv6.icmp_type"), c("icmpv6.code")))
        .when(icmp, icmp_text(c("icmp.icmp_type"), c("icmp.code")))
        .when(udp, F.concat(c("udp.src_port").cast("string"), F.lit(" → "), c("udp.dst_port").cast("string"), F.lit(" Len="), c("udp.length").cast("string")))
        .when(tcp, tcp_info)
        .when(arp, arp_info)
        .otherwise("")
    )
    return packets.withColumn("summary", F.struct(c("source"), c("destination"), protocol.alias("protocol"), c("wire_len").alias("length"), info.alias("info"), colour.alias("color_hint")))
