"""Registered queries that read bytes: IPv6, TLS, HTTP/2, QUIC and FTP frames, and capture files written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import ip_text
from ..functions.text import hex_dump
from ..operators import anomaly, correlate
from ..operators.decode import decode, link_name
from ..session import new_path
from ..sources import capture
from ..sources import json_lines as sink
from ..streaming import stateful
from . import display_filter, views
from .queries import _INFO, _PROTO, P, _packets, query


def _sized(hexed: Column, n: int) -> Column:
    """Hex text behind its length in ``n`` bytes."""
    return F.concat(F.lpad(F.hex((F.length(hexed) / 2).cast("long")), 2 * n, "0"), hexed)


def _extension(kind: str, body: Column) -> Column:
    return F.concat(F.lit(kind), _sized(body, 2))


def frames6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, ts, wire_len, data, linktype): an IPv6 frame per order, of seven kinds by its customer.

    0 a ClientHello; 1 another handshake message; 2 an HTTP/2 connection's start;
    3 QUIC; 4 ICMPv6; 5 other UDP; 6 FTP.
    """
    r = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("n"), (F.col("o_custkey") + 1).cast("long").alias("c"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    n, c = F.col("n"), F.col("c")
    lit, cat = F.lit, F.concat
    text = lambda s: F.hex(s.cast("binary"))
    name = cat(lit("s"), c.cast("string"), lit(".example.com"))
    zeros = lit("00" * 32)
    alpn = lambda s: _extension("0010", _sized(_sized(text(s), 1), 2))
    sni = _extension("0000", _sized(cat(lit("00"), _sized(text(name), 2)), 2))
    asked = F.when(n % 2 == 0, "h2").otherwise("http/1.1")
    extensions = cat(sni, alpn(asked), lit("002B0005" "0403040303" "000A0006" "0004001D0017" "000D0006" "000404030804" "000B0002" "0100"))
    ciphers = _sized(cat(lit("0A0A1301"), F.lpad(F.hex(lit(0xC02B) + c % 4), 4, "0")), 2)
    message = lambda kind, body: cat(lit("160301"), _sized(cat(lit(kind), _sized(body, 3)), 2))
    hello = message("01", cat(lit("0303"), zeros, lit("00"), ciphers, lit("0100"), _sized(extensions, 2)))
    server = message("02", cat(lit("0303"), zeros, lit("00"), lit("1301"), lit("00"), _sized(alpn(lit("h2")), 2)))
    certificates = message("0B", _sized(F.repeat(lit("0000020102"), (c % 3 + 1).cast("int")), 3))
    other = F.when(n % 3 == 0, server).when(n % 3 == 1, certificates).otherwise(message("0E", lit("")))
    block = cat(lit("82848741"), _sized(text(name), 1), lit("400178" "0179" "BE"))
    headers = cat(F.lpad(F.hex((F.length(block) / 2).cast("long")), 6, "0"), lit("0104"), F.lpad(F.hex(2 * (n % 100) + 1), 8, "0"), block)
    http2 = cat(text(lit("PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n")), lit("000000" "0400" "00000000"), headers)
    ids = cat(lit("04"), F.lpad(F.hex(n % (1 << 32)), 8, "0"), F.when(c % 2 == 0, "00").otherwise("02BEEF"), lit("0000"))
    quic = F.when(n % 5 == 0, cat(lit("8000000000"), ids)).otherwise(cat(F.hex(lit(0xC0) + 16 * (n % 4)), lit("00000001"), ids))
    icmp = cat(F.when(n % 3 == 0, "80").when(n % 3 == 1, "81").otherwise("87"), F.lpad(F.hex(c % 3), 2, "0"), lit("000000000000"))
    ftp = text(F.when(n % 2 == 0, "PASS hunter2\r\n").otherwise("USER bob\r\n"))
    kind = c % 7
    tcp = lambda port, body: cat(lit("C350" + port + "000003E8000001F45018FFFF00000000"), body)
    udp = lambda port, body: cat(lit("C350" + port), F.lpad(F.hex((F.length(body) / 2 + 8).cast("long")), 4, "0"), lit("0000"), body)
    inner = (
        F.when(kind == 0, tcp("01BB", hello)).when(kind == 1, tcp("01BB", other)).when(kind == 2, tcp("01BB", http2)).when(kind == 3, udp("01BB", quic)).when(kind == 4, icmp).when(kind == 5, udp("2710", lit("0102"))).otherwise(tcp("0015", ftp))
    )
    proto = F.when(kind.isin(3, 5), "11").when(kind == 4, "3A").otherwise("06")
    src = cat(lit("20010DB8" + "0" * 16), F.lpad(F.hex(c), 8, "0"))
    dst = cat(lit("20010DB800000001" + "0" * 12), F.lpad(F.hex(n % 4 + 1), 4, "0"))
    r = r.withColumn("inner", inner)
    ip = cat(lit("60000000"), F.lpad(F.hex((F.length("inner") / 2).cast("long")), 4, "0"), proto, lit("40"), src, dst, F.col("inner"))
    rows = r.select(n.alias("number"), "ts", F.unhex(cat(lit("020000000001020000000002" "86DD"), ip)).alias("data"))
    return rows.select("number", "ts", F.length("data").cast("long").alias("wire_len"), "data", F.lit(1).alias("linktype"))


#: The same facts in DuckDB, straight from ``orders`` without any bytes: CTE ``g``.
G = """WITH g AS (SELECT CAST(o_orderkey AS BIGINT) AS number, CAST(c AS BIGINT) AS c, CAST(c % 7 AS BIGINT) AS kind, 's' || c || '.example.com' AS name,
  '2001:db8::' || CASE WHEN c >= 65536 THEN printf('%x', c // 65536) || ':' ELSE '' END || printf('%x', c % 65536) AS src, '2001:db8:0:1::' || (o_orderkey % 4 + 1) AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'h2' ELSE 'http/1.1' END AS alpn FROM (SELECT *, o_custkey + 1 AS c FROM orders)) """


def _six(spark: SparkSession, sf_dir: str, *want: str) -> DataFrame:
    return decode(frames6(spark, sf_dir), summary=False, want=want)


def _joined(c: str, by: str = "-") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)


@query(G + "SELECT number, src, dst, 6 AS version, 0 AS traffic_class, 0 AS flow_label, CASE WHEN kind IN (3, 5) THEN 17 WHEN kind = 4 THEN 58 ELSE 6 END AS next_header, 64 AS hop_limit FROM g", longs="version traffic_class flow_label next_header hop_limit")
def decode_ipv6(spark, sf_dir):
    rows = _six(spark, sf_dir, "ipv6").filter("ipv6 is not null")
    return rows.select("number", ip_text(F.col("ipv6.src_ip")).alias("src"), ip_text(F.col("ipv6.dst_ip")).alias("dst"), "ipv6.version", "ipv6.traffic_class", "ipv6.flow_label", "ipv6.next_header", "ipv6.hop_limit")


@query(G + "SELECT number, CASE number % 3 WHEN 0 THEN 128 WHEN 1 THEN 129 ELSE 135 END AS icmp_type, c % 3 AS code FROM g WHERE kind = 4", longs="icmp_type code")
def decode_icmpv6(spark, sf_dir):
    return _six(spark, sf_dir, "icmpv6").filter("icmpv6 is not null").select("number", "icmpv6.icmp_type", "icmpv6.code")


_QUIC = "CASE WHEN number % 5 = 0 THEN 'VersionNegotiation' ELSE ['Initial', 'ZeroRtt', 'Handshake', 'Retry'][number % 4 + 1] END"


@query(G + f"SELECT number, CASE WHEN number % 5 = 0 THEN 0 ELSE 1 END AS version, {_QUIC} AS packet_type, printf('%08x', number % 4294967296) AS dcid, CASE WHEN c % 2 = 0 THEN '' ELSE 'beef' END AS scid FROM g WHERE kind = 3", longs="version")
def decode_quic(spark, sf_dir):
    return _six(spark, sf_dir, "quic").filter("quic is not null").select("number", "quic.version", "quic.packet_type", "quic.dcid", "quic.scid")


@query(
    G
    + """SELECT number, 771 AS legacy_version, name AS sni, alpn, '2570-4865-' || (49195 + c % 4) AS ciphers, '0-16-43-10-13-11' AS extensions, '29-23' AS supported_groups, '772-771' AS supported_versions, '1027-2052' AS signature_algorithms,
    md5('771,4865-' || (49195 + c % 4) || ',0-16-43-10-13-11,29-23,0') AS ja3,
    't13d0206' || CASE WHEN alpn = 'h2' THEN 'h2' ELSE 'h1' END || '_' || sha256('1301,' || printf('%x', 49195 + c % 4))[1:12] || '_' || sha256('000a,000b,000d,002b_0403,0804')[1:12] AS ja4 FROM g WHERE kind = 0""",
    longs="legacy_version",
)
def decode_client_hello(spark, sf_dir):
    rows = _six(spark, sf_dir, "tls_client_hello").filter("tls_client_hello is not null")
    t = "tls_client_hello."
    lists = [_joined(t + x).alias(x) for x in ("extensions", "supported_groups", "supported_versions", "signature_algorithms")]
    return rows.select("number", t + "legacy_version", t + "sni", F.array_join(t + "alpn", ",").alias("alpn"), _joined(t + "cipher_suites").alias("ciphers"), *lists, t + "ja3", t + "ja4")


@query(
    G
    + """SELECT number, CASE number % 3 WHEN 0 THEN 'ServerHello' WHEN 1 THEN 'Certificate' ELSE 'Other' END AS kind, CASE WHEN number % 3 = 0 THEN 771 END AS version, CASE WHEN number % 3 = 0 THEN 4865 END AS cipher_suite,
    CASE WHEN number % 3 = 0 THEN 'h2' END AS alpn, CASE WHEN number % 3 = 1 THEN c % 3 + 1 END AS cert_count, CASE WHEN number % 3 = 2 THEN 14 END AS msg_type FROM g WHERE kind = 1""",
    longs="version cipher_suite cert_count msg_type",
)
def decode_handshake(spark, sf_dir):
    rows = _six(spark, sf_dir, "tls_handshake").filter("tls_handshake is not null").select("number", F.explode("tls_handshake.messages").alias("m"))
    return rows.select("number", "m.kind", "m.version", "m.cipher_suite", F.array_join("m.alpn", ",").alias("alpn"), "m.cert_count", "m.msg_type")


@query(
    G
    + """SELECT number, f.stream_id, f.frame_type, f.flags, f.headers FROM g, (VALUES (0), (1)) AS x(i), LATERAL (SELECT CASE WHEN i = 0 THEN 0 ELSE 2 * (number % 100) + 1 END AS stream_id, CASE WHEN i = 0 THEN 4 ELSE 1 END AS frame_type, CASE WHEN i = 0 THEN 0 ELSE 4 END AS flags,
    CASE WHEN i = 0 THEN '' ELSE ':method=GET;:path=/;:scheme=https;:authority=' || name || ';x=y;x=y' END AS headers) AS f WHERE kind = 2""",
    longs="stream_id frame_type flags",
)
def decode_http2(spark, sf_dir):
    rows = _six(spark, sf_dir, "http2").filter("http2 is not null").select("number", F.explode("http2.frames").alias("f"))
    shown = F.array_join(F.transform("f.headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";")
    return rows.select("number", "f.stream_id", "f.frame_type", "f.flags", shown.alias("headers"))


@query(
    G
    + f"""SELECT number, src AS source, dst AS destination, CASE kind WHEN 0 THEN 'TLS' WHEN 1 THEN 'TLS' WHEN 2 THEN 'HTTP/2' WHEN 3 THEN 'QUIC' WHEN 4 THEN 'ICMPv6' WHEN 5 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE kind WHEN 0 THEN 'Tls' WHEN 1 THEN 'Tls' WHEN 3 THEN 'Udp' WHEN 4 THEN 'Icmp' WHEN 5 THEN 'Udp' ELSE 'Tcp' END AS color_hint,
    CASE kind WHEN 0 THEN 'TLS → ' || name WHEN 1 THEN CASE number % 3 WHEN 0 THEN 'TLS Server Hello (alpn: h2)' WHEN 1 THEN 'TLS Certificate (' || (c % 3 + 1) || ')' ELSE 'TLS Handshake (type 14)' END WHEN 2 THEN 'HTTP/2 (2 frame(s))'
      WHEN 3 THEN 'QUIC ' || {_QUIC} || CASE WHEN number % 5 = 0 THEN ' v0x00000000' ELSE ' v0x00000001' END WHEN 4 THEN 'Type=' || CASE number % 3 WHEN 0 THEN 128 WHEN 1 THEN 129 ELSE 135 END || ' Code=' || (c % 3)
      WHEN 5 THEN '50000 → 10000 Len=10' ELSE '50000 → 21 [ACK, PSH] Seq=1000 Ack=500 Len=' || CASE WHEN number % 2 = 0 THEN 14 ELSE 10 END END AS info FROM g"""
)
def summary_ipv6(spark, sf_dir):
    return decode(frames6(spark, sf_dir)).select("number", "summary.source", "summary.destination", "summary.protocol", "summary.color_hint", "summary.info")


@query(G + "SELECT number, 'PlaintextCredential' AS kind, 'FTP password sent in cleartext' AS detail, 'Warning' AS severity FROM g WHERE kind = 6 AND number % 2 = 0")
def ftp_passwords(spark, sf_dir):
    """Everything encrypted is passed over, and so is FTP without a password."""
    return anomaly.annotated(_six(spark, sf_dir, "tcp", "udp", "tls_client_hello", "tls_handshake", "http", "quic", "payload")).filter("anomaly is not null").select("number", "anomaly.*")


@query(G + "SELECT number FROM g WHERE (kind IN (0, 1) AND coalesce(contains(name, 's1'), FALSE) AND kind = 0) OR kind = 4 OR (kind = 3 AND src = '2001:db8::3')")
def filter_ipv6(spark, sf_dir):
    text = "tls and tls.sni contains s1 or icmpv6"
    rows = decode(frames6(spark, sf_dir), summary=False, want=(*display_filter.layers(text), "ipv6", "quic"))
    one = display_filter.matching(rows, ":mine", {"mine": text}).select("number")
    return one.union(rows.filter(F.col("quic").isNotNull() & (ip_text(F.col("ipv6.src_ip")) == "2001:db8::3")).select("number"))


@query(G + "SELECT dst AS ip, arg_max(name, number) AS name, 'tls_sni' AS source FROM g WHERE kind = 0 GROUP BY dst")
def current_names(spark, sf_dir):
    got = correlate.current_names(correlate.name_observations(_six(spark, sf_dir, "ipv4", "ipv6", "dns", "tls_client_hello", "http")))
    return got.select(ip_text(F.col("ip")).alias("ip"), "name", "source")


# --- capture files ---------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, container: str, files: int) -> str:
    folder = new_path(spark, "capture")
    capture.write(views.frames(spark, sf_dir), folder, container, files=files)
    return folder


def _ends(rows: DataFrame) -> DataFrame:
    rows = decode(rows, summary=False, want=("ipv4",)).filter("ipv4 is not null")
    return rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "wire_len", "linktype", ip_text(F.col("ipv4.src_ip")).alias("src"), ip_text(F.col("ipv4.dst_ip")).alias("dst"), "ipv4.identification")


_ENDS = P + "SELECT us, wire_len, 1 AS linktype, src, dst, number % 65536 AS identification FROM w WHERE NOT is_arp"


@query(_ENDS, longs="linktype")
def capture_pcap(spark, sf_dir):
    return _ends(capture.read(spark, _written(spark, sf_dir, "pcap", 1)))


@query(_ENDS, longs="linktype")
def capture_pcapng(spark, sf_dir):
    return _ends(capture.read(spark, _written(spark, sf_dir, "pcapng", 3)))


@query(P + "SELECT us, wire_len, 1 AS linktype, src, dst, number % 65536 AS identification FROM w WHERE is_udp", longs="linktype")
def capture_filtered(spark, sf_dir):
    """A capture filter over files as they are read."""
    return _ends(capture.read(spark, _written(spark, sf_dir, "pcap", 2), "udp port 53"))


@query(_ENDS, longs="linktype")
def capture_stream(spark, sf_dir):
    """Rotated capture files as a stream, a file a trigger, into a table."""
    folder, out, checkpoint = _written(spark, sf_dir, "pcap", 3), new_path(spark, "stream"), new_path(spark, "checkpoint")
    stateful.to_tables(capture.stream(spark, folder), out, checkpoint).awaitTermination()
    return _ends(spark.read.parquet(out))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM events) SELECT number FROM r WHERE number < 100")
def capture_first(spark, sf_dir):
    """A bound on the number ends the walk through a file early."""
    return capture.read(spark, _written(spark, sf_dir, "pcap", 1)).filter("number < 100").select("number")


@query("SELECT 'part-00000.pcap' AS file, 1 AS linktype, count(*) AS packets FROM events", longs="linktype")
def capture_files(spark, sf_dir):
    return capture.interfaces(spark, _written(spark, sf_dir, "pcap", 1))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'ethernet' WHEN 1 THEN 'raw_ip' WHEN 2 THEN 'raw_ip' ELSE 'other' END AS link FROM nation", longs="id")
def link_types(spark, sf_dir):
    k = F.col("n_nationkey")
    number = F.when(k % 5 == 0, 1).when(k % 5 == 1, 101).when(k % 5 == 2, 228).otherwise(k + 2)
    return views.table(spark, sf_dir, "nation").select(k.alias("id"), link_name(number).alias("link"))


# --- texts of packets --------------------------------------------------------


@query(P + f"SELECT number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second, src AS source, dst AS destination, {_PROTO} AS protocol, wire_len AS length, {_INFO} AS info FROM w")
def json_fields(spark, sf_dir):
    """What the JSON lines of all packets say, read back from the text."""
    got = sink.lines(_packets(spark, sf_dir))
    line = F.col(got.columns[0])
    part = lambda p: F.get_json_object(line, f"$.{p}")
    return got.select(
        part("number").cast("long").alias("number"), F.substring(part("timestamp"), 1, 19).alias("second"), part("summary.source").alias("source"), part("summary.destination").alias("destination"),
        part("summary.protocol").alias("protocol"), part("summary.length").cast("long").alias("length"), part("summary.info").alias("info"),
    )


@query(
    """WITH l AS (SELECT p_partkey, p_name, unnest(generate_series(0, octet_length(encode(p_name)) - 1, 16)) AS i FROM part), x AS (SELECT p_partkey, i, substr(p_name, i + 1, 16) AS t FROM l),
    h AS (SELECT *, regexp_replace(lower(hex(encode(t))), '(..)', '\\1 ', 'g') AS p FROM x)
    SELECT CAST(p_partkey AS BIGINT) AS id, CAST(i AS BIGINT) AS offset_, printf('%04x', i) || '   ' || rpad(p[1:24] || CASE WHEN length(p) >= 24 THEN ' ' ELSE '' END || p[25:48], CASE WHEN length(p) = 24 THEN 50 ELSE 49 END, ' ') || '  ' || t AS line FROM h"""
)
def hex_lines(spark, sf_dir):
    """The names of all parts as dumps, a row a line."""
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.posexplode(hex_dump(F.col("p_name").cast("binary"))).alias("k", "line"))
    return rows.select("id", (F.col("k") * 16).cast("long").alias("offset_"), "line")

