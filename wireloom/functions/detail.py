"""The detail view of a decoded packet: its layers as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import ip_text, mac_text
from .text import dns_type_name, protocol_name

HEAD, FIELD = "▸ ", "    "


def _head(*parts: Column | str) -> Column:
    return F.concat(F.lit(HEAD), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _field(name: str, *parts: Column | str) -> Column:
    """A line; null (and so left out) if a part is."""
    return F.concat(F.lit(f"{FIELD}{name}: "), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _hex(value: Column, digits: int) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(value), digits, "0")))


def _record(r: Column) -> Column:
    """An answer's data in a word or two."""
    d = r["rdata"]
    text = (
        F.when(d["kind"].isin("A", "Aaaa"), F.concat(F.upper(d["kind"]), F.lit(" "), d["ip"]))
        .when(d["kind"].isin("Cname", "Ns", "Ptr"), F.concat(F.upper(d["kind"]), F.lit(" "), d["name"]))
        .when(d["kind"] == "Mx", F.concat(F.lit("MX "), d["preference"].cast("string"), F.lit(" "), d["name"]))
        .when(d["kind"] == "Txt", F.concat(F.lit("TXT "), F.array_join(d["strings"], " ")))
        .when(d["kind"] == "Srv", F.concat(F.lit("SRV "), d["name"], F.lit(":"), d["port"].cast("string")))
        .when(d["kind"] == "Soa", F.concat(F.lit("SOA "), d["mname"]))
        .otherwise(F.concat(F.lit("type"), r["rtype"].cast("string")))
    )
    return F.concat(F.lit(f"{FIELD}Answer: "), r["name"], F.lit(" → "), text)


def _message(m: Column) -> Column:
    return (
        F.when(m["kind"] == "ServerHello", F.concat(F.lit(f"{FIELD}Server Hello (version="), _hex(m["version"], 4), F.lit(", cipher="), _hex(m["cipher_suite"], 4), F.lit(", alpn="), F.array_join(m["alpn"], ","), F.lit(")")))
        .when(m["kind"] == "Certificate", F.concat(F.lit(f"{FIELD}Certificate ("), m["cert_count"].cast("string"), F.lit(" certs)")))
        .otherwise(F.concat(F.lit(f"{FIELD}Handshake type "), m["msg_type"].cast("string")))
    )


def lines(packets: DataFrame) -> Column:
    """The lines of all layers, outermost first, as one array; ``packets`` are decoded."""
    c = F.col
    none = F.array().cast("array<string>")
    ip = lambda f: ip_text(c(f))
    ends = lambda a: (f"{a}.src_port", f"{a}.dst_port")
    blank = lambda f: F.coalesce(c(f).cast("string"), F.lit(""))
    eth = [
        _head("Ethernet II, Src: ", mac_text(c("eth.src_mac")), ", Dst: ", mac_text(c("eth.dst_mac"))), _field("Source", mac_text(c("eth.src_mac"))), _field("Destination", mac_text(c("eth.dst_mac"))), _field("Type", _hex(c("eth.ethertype"), 4)),
    ]
    said = F.when(c("arp.operation") == 1, "Request").when(c("arp.operation") == 2, "Reply").otherwise("Unknown")
    arp = [_head("ARP (", said, ")"), _field("Sender MAC", mac_text(c("arp.sender_mac"))), _field("Sender IP", ip("arp.sender_ip")), _field("Target MAC", mac_text(c("arp.target_mac"))), _field("Target IP", ip("arp.target_ip"))]
    ipv4 = [
        _head("Internet Protocol Version 4, Src: ", ip("ipv4.src_ip"), ", Dst: ", ip("ipv4.dst_ip")), _field("Version", c("ipv4.version")), _field("Header Length", c("ipv4.ihl") * 4, " bytes (", c("ipv4.ihl"), ")"), _field("Total Length", c("ipv4.total_length")),
        _field("TTL", c("ipv4.ttl")), _field("Protocol", protocol_name(c("ipv4.protocol")), " (", c("ipv4.protocol"), ")"), _field("Source", ip("ipv4.src_ip")), _field("Destination", ip("ipv4.dst_ip")),
    ]
    ipv6 = [
        _head("Internet Protocol Version 6, Src: ", ip("ipv6.src_ip"), ", Dst: ", ip("ipv6.dst_ip")), _field("Next Header", protocol_name(c("ipv6.next_header")), " (", c("ipv6.next_header"), ")"),
        _field("Hop Limit", c("ipv6.hop_limit")), _field("Payload Length", c("ipv6.payload_length")),
    ]
    from ..operators.decode import flags_text

    tcp = [
        _head("TCP, Src Port: ", c(ends("tcp")[0]), ", Dst Port: ", c(ends("tcp")[1])), _field("Source Port", c("tcp.src_port")), _field("Destination Port", c("tcp.dst_port")), _field("Sequence Number", c("tcp.seq_num")),
        _field("Acknowledgment Number", c("tcp.ack_num")), _field("Flags", flags_text()), _field("Window Size", c("tcp.window_size")), _field("Payload Length", c("tcp.payload_len")),
    ]
    udp = [_head("UDP, Src Port: ", c(ends("udp")[0]), ", Dst Port: ", c(ends("udp")[1])), _field("Length", c("udp.length"))]
    icmp = [_head("ICMP, Type: ", c("icmp.icmp_type"), ", Code: ", c("icmp.code"))]
    icmp6 = [_head("ICMPv6, Type: ", c("icmpv6.icmp_type"), ", Code: ", c("icmpv6.code"))]
    asked = F.transform("dns.questions", lambda q: F.concat(F.lit(f"{FIELD}Question: "), q["qname"], F.lit(" (type="), dns_type_name(q["qtype"]), F.lit(")")))
    dns = F.concat(F.array(_head("DNS ", F.when(c("dns.is_response"), "Response").otherwise("Query"), " (", _hex(c("dns.transaction_id"), 4), ")")), asked, F.transform("dns.answers", _record))
    t = "tls_client_hello"
    hello = [_head("TLS Client Hello"), _field("Server Name", c(f"{t}.sni")), F.when(F.size(f"{t}.alpn") > 0, _field("ALPN", F.array_join(f"{t}.alpn", ", "))), _field("JA3", c(f"{t}.ja3")), _field("JA4", c(f"{t}.ja4"))]
    shake = F.concat(F.array(_head("TLS Handshake")), F.transform("tls_handshake.messages", _message))
    title = F.when(c("http.is_request"), _head("HTTP ", F.coalesce("http.method", F.lit("?")), " ", blank("http.uri"))).otherwise(_head("HTTP ", blank("http.status_code"), " response"))
    http = [title, _field("Host", c("http.host"))]
    each = F.flatten(F.transform("http2.frames", lambda f: F.transform(f["headers"], lambda h: F.concat(F.lit(FIELD), h["name"], F.lit(": "), h["value"]))))
    http2 = F.concat(F.array(_head("HTTP/2 (", F.size("http2.frames"), " frames)")), each)
    quic = [_head("QUIC ", c("quic.packet_type")), _field("Version", _hex(c("quic.version"), 8))]
    rest = [_head("Data (", c("payload.len"), " bytes at offset ", c("payload.offset"), ")")]
    parts = (("eth", eth), ("arp", arp), ("ipv4", ipv4), ("ipv6", ipv6), ("tcp", tcp), ("udp", udp), ("icmp", icmp), ("icmpv6", icmp6), ("dns", dns), (t, hello), ("tls_handshake", shake), ("http", http), ("http2", http2), ("quic", quic), ("payload", rest))
    made = [F.when(c(name).isNotNull(), F.array_compact(F.array(*x)) if isinstance(x, list) else x).otherwise(none) for name, x in parts]
    return F.concat(*made)
