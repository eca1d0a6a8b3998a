"""Decoded packets as JSON lines (K3): one object a line, layers as tagged values.

Addresses are text, link addresses and bytes are lists of numbers, ranges are
pairs, headers are pairs in order, times are RFC 3339.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import LAYERS
from ..session import ship

# How layers are tagged.
TAGS = dict(zip(LAYERS, ("Ethernet", "Arp", "Ipv4", "Ipv6", "Tcp", "Udp", "Icmp", "Icmpv6", "Dns", "TlsClientHello", "TlsHandshake", "Http", "Http2", "Quic", "Payload")))
# What each kind of record data holds; a lone field stands for itself.
RDATA = {
    "A": ("ip",), "Aaaa": ("ip",), "Cname": ("name",), "Ns": ("name",), "Ptr": ("name",), "Txt": ("strings",), "Mx": ("preference", "exchange"), "Srv": ("priority", "weight", "port", "target"),
    "Soa": ("mname", "rname", "serial", "refresh", "retry", "expire", "minimum"), "Unknown": ("rtype", "data"),
}
MESSAGES = {"ServerHello": ("version", "cipher_suite", "alpn"), "Certificate": ("cert_count",), "Other": ("msg_type",)}


def plain(name: str, value):
    """A field as JSON has it."""
    if isinstance(value, bytes):
        return str(ipaddress.ip_address(value)) if name.endswith("_ip") else list(value)
    if name == "header_range" and value:
        return [value["start"], value["end"]]
    if name == "headers" and value is not None:
        return [[h["name"], h["value"]] for h in value]
    if name == "rdata":
        fields = RDATA[value["kind"]]
        got = {f: plain(f, value["name" if f in ("exchange", "target") else f]) for f in fields}
        return {value["kind"]: got if len(fields) > 1 else got[fields[0]]}
    if name == "messages" and value is not None:
        return [{m["kind"]: {f: m[f] for f in MESSAGES[m["kind"]]}} for m in value]
    if isinstance(value, dict):
        return {k: plain(k, v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain("", v) for v in value]
    return value


def line(row: dict) -> str:
    """One packet's line."""
    layers = [{TAGS[k]: plain(k, row[k])} for k in LAYERS if row.get(k) is not None]
    ts = row["ts"]
    micro = f".{ts.microsecond:06d}".rstrip("0").rstrip(".") if ts.microsecond else ""
    if micro and len(micro) <= 4:
        micro = micro.ljust(4, "0")
    elif micro:
        micro = micro.ljust(7, "0")
    at = ts.strftime("%Y-%m-%dT%H:%M:%S") + micro + "Z"
    process = row.get("process")
    out = {"number": row["number"], "timestamp": at, "wire_len": row["wire_len"], "data": list(row["data"] or b""), "layers": layers, "summary": row["summary"], "process": process, "retransmission": bool(row.get("retransmission"))}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([line(r) for r in b.to_pylist()], pa.string())], names=["value"])


def lines(packets: DataFrame) -> DataFrame:
    """(value): the JSON line of each decoded packet."""
    ship(packets.sparkSession)
    extra = [c for c in ("process", "retransmission") if c in packets.columns]
    rows = packets.select("number", F.col("ts").cast("timestamp").alias("ts"), "wire_len", "data", *LAYERS, "summary", *extra)
    return rows.mapInArrow(_lines, "value string")


def write(packets: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """JSON lines as text files, in order of the packet number within each."""
    lines(packets.sortWithinPartitions("number")).write.mode(mode).text(folder)
