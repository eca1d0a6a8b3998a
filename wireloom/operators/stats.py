"""Statistics views: talkers, protocols, flows, timeline, throughput, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import ip_order, ip_text
from ..functions.text import registrable_domain


def top_talkers(packets: DataFrame) -> DataFrame:
    """(endpoint, packets, bytes): a packet counts for its source and for its destination (A1); most bytes first.

    ``packets`` have a summary, or just ``source`` and ``destination``.
    """
    ends = ("summary.source", "summary.destination") if "summary" in packets.columns else ("source", "destination")
    both = packets.select(F.explode(F.array(*ends)).alias("endpoint"), "wire_len").filter("endpoint <> ''")
    out = both.groupBy("endpoint").agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"))
    return out.orderBy(F.desc("bytes"), "endpoint")


def protocol_share(packets: DataFrame) -> DataFrame:
    """(protocol, packets, percent, bar) over all packets (A2): one decimal, half a mark a percent."""
    out = packets.groupBy(F.col("summary.protocol").alias("protocol")).agg(F.count("*").alias("packets"))
    share = F.col("packets") * 100.0 / F.sum("packets").over(Window.partitionBy())
    out = out.withColumn("_s", share).select("protocol", "packets", F.round("_s", 1).alias("percent"), F.floor(F.col("_s") / 2).cast("long").alias("bar"))
    return out.orderBy(F.desc("packets"), "protocol")


def flow_view(packets: DataFrame) -> DataFrame:
    """(label, protocol, packets, bytes, first_ms, last_ms) per pair of ends (A3); closing doesn't split a row here."""
    src, dst = F.coalesce("ipv6.src_ip", "ipv4.src_ip"), F.coalesce("ipv6.dst_ip", "ipv4.dst_ip")
    sp, dp = F.coalesce("tcp.src_port", "udp.src_port"), F.coalesce("tcp.dst_port", "udp.dst_port")
    rows = packets.filter(sp.isNotNull() & src.isNotNull()).select(src.alias("s"), sp.alias("sp"), dst.alias("d"), dp.alias("dp"), F.when(F.col("tcp").isNotNull(), "TCP").otherwise("UDP").alias("protocol"), "wire_len", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    up = F.struct(ip_order(F.col("s")), F.col("sp")) <= F.struct(ip_order(F.col("d")), F.col("dp"))
    end = lambda ip, p: F.struct(F.col(ip).alias("ip"), F.col(p).alias("port"))
    rows = rows.select(F.when(up, end("s", "sp")).otherwise(end("d", "dp")).alias("a"), F.when(up, end("d", "dp")).otherwise(end("s", "sp")).alias("b"), "protocol", "wire_len", "ms")
    out = rows.groupBy("a", "b", "protocol").agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    text = lambda e: F.concat(ip_text(F.col(f"{e}.ip")), F.lit(":"), F.col(f"{e}.port").cast("string"))
    out = out.select(F.concat(text("a"), F.lit(" <-> "), text("b")).alias("label"), "protocol", "packets", "bytes", "first_ms", "last_ms")
    return out.orderBy(F.desc("bytes"), "label", "protocol")


def timeline(flows: DataFrame, width: int = 40) -> DataFrame:
    """:func:`flow_view` rows with a bar: where in the whole time a flow starts and how long it is (A4)."""
    ends = flows.agg(F.min("first_ms").alias("_lo"), F.max("last_ms").alias("_hi"))
    out = flows.crossJoin(F.broadcast(ends))  # one row, whatever the input
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).cast("double")
    start = F.floor((F.col("first_ms") - F.col("_lo")) / span * width).cast("long")
    end = F.ceil((F.col("last_ms") - F.col("_lo")) / span * width).cast("long")
    out = out.withColumn("bar_start", start).withColumn("bar_length", F.greatest(end - F.col("bar_start"), F.lit(1)).cast("long"))
    bar = F.concat(F.repeat(F.lit(" "), F.least("bar_start", F.lit(width)).cast("int")), F.repeat(F.lit("▇"), F.least("bar_length", F.lit(width)).cast("int")))
    return out.withColumn("bar", bar).drop("_lo", "_hi").orderBy("first_ms", "label", "protocol")


def throughput(packets: DataFrame, seconds: int | None = None) -> DataFrame:
    """(second, packets, bytes) of event time, empty seconds included; ``seconds`` keeps the last ones (A5).

    The seconds come from the first and last packet: a sequence made in one
    row and exploded, as long as the capture, not as the packets are many.
    """
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    got = packets.groupBy(at.alias("second")).agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"))
    ends = got.agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo is not null")
    lo = F.col("lo") if seconds is None else F.greatest("lo", F.col("hi") - F.make_dt_interval(secs=F.lit(seconds - 1)))
    every = ends.select(F.explode(F.sequence(lo, F.col("hi"), F.expr("interval 1 second"))).alias("second"))
    out = every.join(got, "second", "left")
    return out.select("second", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy("second")


def process_rollup(connections: DataFrame) -> DataFrame:
    """(process, pid, conns, bytes_up, bytes_down) per process name; the pid of the lowest connection id."""
    out = connections.groupBy("process").agg(F.min_by("pid", "id").alias("pid"), F.count("*").alias("conns"), F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"))
    return out.orderBy((F.col("bytes_up") + F.col("bytes_down")).desc(), "process")


def domain_rollup(connections: DataFrame) -> DataFrame:
    """(domain, conns, bytes_up, bytes_down): the organisation, else the registrable domain."""
    domain = F.coalesce("as_org", registrable_domain(F.col("dest_name")))
    out = connections.groupBy(domain.alias("domain")).agg(F.count("*").alias("conns"), F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"))
    return out.orderBy((F.col("bytes_up") + F.col("bytes_down")).desc(), "domain")


def live_connections(events: DataFrame) -> DataFrame:
    """One row per flow event id, accumulated (A9): byte sums, and the last process, name and place.

    ``events`` are (id, seq, ts_ms, process, pid, dest_ip, dest_port, local_port,
    protocol, outbound, dest_name, country, asn, as_org, bytes_up, bytes_down).  Process,
    name, country and network are the last known ones (``?`` and the address
    stand in), the organisation is that of the last event with a network, and
    the ends and the direction are the first event's.
    """
    known = lambda c, by=None: F.max_by(F.col(c), F.when(F.col(by or c).isNotNull(), F.col("seq")))
    first = lambda c: F.min_by(c, "seq").alias(c)
    return events.groupBy("id").agg(
        F.coalesce(known("process"), F.lit("?")).alias("process"), known("pid", "process").alias("pid"), F.coalesce(known("dest_name"), F.min_by("dest_ip", "seq")).alias("dest_name"),
        *[first(c) for c in ("dest_ip", "dest_port", "local_port", "protocol", "outbound")],
        known("country").alias("country"), known("asn").alias("asn"), known("as_org", "asn").alias("as_org"),
        F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"), F.min_by("ts_ms", "seq").alias("first_seen"), F.max_by("ts_ms", "seq").alias("last_seen"),
    )


def matching_connections(connections: DataFrame, query: str) -> DataFrame:
    """Connections that a search text is part of: process, name, address, organisation or country.

    The text and all but the address are compared in lower case; an empty text
    matches all.  Newest first.
    """
    q = query.lower()
    hit = F.lit(False)
    for c in ("process", "dest_name", "as_org", "country"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    hit = hit | F.coalesce(F.col("dest_ip").contains(q), F.lit(False))
    return (connections.filter(hit) if q else connections).orderBy(F.desc("last_seen"), "id")


def last_packets(packets: DataFrame, n: int) -> DataFrame:
    """The ``n`` packets with the highest numbers, as a bounded buffer would hold them (K7)."""
    top = packets.agg(F.max("number").alias("_top"))
    return packets.crossJoin(F.broadcast(top)).filter(F.col("number") > F.col("_top") - n).drop("_top")


def one_shot(packets: DataFrame, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """The first ``count`` packets, or those within ``seconds`` of event time from the first."""
    out = packets
    if seconds is not None:
        first = packets.agg(F.min("ts").alias("_first"))
        late = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
        out = out.crossJoin(F.broadcast(first)).filter(late < int(seconds * 1e6)).drop("_first")
    return out.orderBy("number").limit(count) if count is not None else out


def page(rows: DataFrame, order: list, skip: int, height: int) -> DataFrame:
    """``height`` rows after the first ``skip`` in an order with a total key."""
    return rows.orderBy(*order).offset(skip).limit(height)


def bookmarked(packets: DataFrame, numbers: list[int]) -> DataFrame:
    """The packets with these numbers."""
    return packets.filter(F.col("number").isin(*numbers)) if numbers else packets.limit(0)
