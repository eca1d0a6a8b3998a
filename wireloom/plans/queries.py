"""The registered queries over the driver's tables, each with its SQL where there is one.

Integers are cast to long on the way out and binary columns shown as hex text,
so that both engines give one type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint
from ..functions.bytes import ip_text, ipv4_bytes, is_global
from ..functions.text import byte_size, dns_type_name, hex_dump, protocol_name, registrable_domain
from ..operators import alerts, anomaly, correlate, diff, flows, monitor, reassembly, stats, store
from ..operators.decode import decode, flags_text
from ..operators.flows import flow_packets
from ..session import written
from . import bpf, display_filter, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What the alert engine learns and when it speaks over the driver's month of events.
CONFIG = alerts.AlertConfig(volume_interval_ms=3_600_000, volume_z=2.0, volume_floor=100_000, cooldown_ms=86_400_000)


def _plain(df: DataFrame) -> DataFrame:
    kinds = {"int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "binary": lambda c: F.lower(F.hex(c)), "timestamp": lambda c: F.unix_micros(c), "float": lambda c: c.cast("double")}
    return df.select(*[kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def query(sql: str | None = None, longs: str = ""):
    """Registers a function under its name, with its SQL if it has one; ``longs`` names columns that SQL would give as 32-bit integers."""

    def take(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(f(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            text = " ".join(line.strip() for line in sql.strip().splitlines())
            wide = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({wide}) FROM ({text})" if wide else text
        return f

    return take


def _packets(spark: SparkSession, sf_dir: str, summary: bool = True, want: tuple[str, ...] = ()) -> DataFrame:
    raw = views.frames(spark, sf_dir)
    return decode(raw, summary=summary, want=want) if want else decode(raw, summary=summary)


P = "WITH " + views.PACKETS_SQL + " "
E = "WITH RECURSIVE " + views.EVENTS_SQL

# --- decoders ------------------------------------------------------------


@query(P + "SELECT number, 14 AS eth_end, 2048 + CASE WHEN is_arp THEN 6 ELSE 0 END AS ethertype, '02:00:00:00:00:02' AS src_mac FROM w", longs="eth_end ethertype")
def decode_ethernet(spark, sf_dir):
    from ..functions.bytes import mac_text

    rows = _packets(spark, sf_dir, False, ("eth",))
    return rows.select("number", F.col("eth.header_range.end").alias("eth_end"), "eth.ethertype", mac_text(F.col("eth.src_mac")).alias("src_mac"))


@query(P + "SELECT number, src, dst, CASE WHEN is_udp THEN 17 WHEN is_icmp THEN 1 ELSE 6 END AS protocol, 64 AS ttl, wire_len - 14 AS total_length, number % 65536 AS identification, 2 AS flags FROM w WHERE NOT is_arp", longs="protocol ttl flags")
def decode_ipv4(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("ipv4",)).filter("ipv4 is not null")
    return rows.select("number", ip_text(F.col("ipv4.src_ip")).alias("src"), ip_text(F.col("ipv4.dst_ip")).alias("dst"), "ipv4.protocol", "ipv4.ttl", "ipv4.total_length", "ipv4.identification", "ipv4.flags")


@query(P + "SELECT number, sport AS src_port, dport AS dst_port, seq AS seq_num, ack AS ack_num, plen AS payload_len, flags, 65535 AS window_size FROM w WHERE is_tcp", longs="window_size")
def decode_tcp(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("tcp",)).filter("tcp is not null")
    return rows.select("number", "tcp.src_port", "tcp.dst_port", "tcp.seq_num", "tcp.ack_num", "tcp.payload_len", flags_text().alias("flags"), "tcp.window_size")


@query(P + "SELECT number, sport AS src_port, dport AS dst_port, 8 + dnslen AS length FROM w WHERE is_udp")
def decode_udp(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("udp",)).filter("udp is not null")
    return rows.select("number", "udp.src_port", "udp.dst_port", "udp.length")


@query(P + "SELECT number, 1 AS operation, host AS sender, remote AS target FROM w WHERE is_arp", longs="operation")
def decode_arp(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("arp",)).filter("arp is not null")
    return rows.select("number", "arp.operation", ip_text(F.col("arp.sender_ip")).alias("sender"), ip_text(F.col("arp.target_ip")).alias("target"))


@query(P + "SELECT number, CASE k % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 11 END AS icmp_type, CASE WHEN k % 3 = 1 THEN k % 4 ELSE 0 END AS code FROM w WHERE is_icmp", longs="icmp_type")
def decode_icmp(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("icmp",)).filter("icmp is not null")
    return rows.select("number", "icmp.icmp_type", "icmp.code")


@query(P + "SELECT number, k AS txid, NOT o AS is_response, qname, CASE WHEN o THEN '' ELSE remote END AS answers, 'A' AS qtype FROM w WHERE is_udp")
def decode_dns(spark, sf_dir):
    from ..operators.decode import answer_text

    rows = _packets(spark, sf_dir, False, ("dns",)).filter("dns is not null")
    q = F.get(F.col("dns.questions"), F.lit(0))
    return rows.select("number", F.col("dns.transaction_id").alias("txid"), "dns.is_response", q["qname"].alias("qname"), answer_text(F.col("dns.answers")).alias("answers"), dns_type_name(q["qtype"]).alias("qtype"))


@query(
    P
    + """SELECT number, o AS is_request, CASE WHEN o THEN 'GET' END AS method, CASE WHEN o THEN '/item/' || k END AS uri, CASE WHEN NOT o THEN 200 END AS status_code, CASE WHEN o THEN 'shop' || (k % 7) || '.example.com' END AS host,
    CASE WHEN NOT o THEN v END AS content_length, CASE WHEN o AND k % 10 = 0 THEN 2 ELSE 1 END AS headers FROM w WHERE e = 'purchase'""",
    longs="status_code headers",
)
def decode_http(spark, sf_dir):
    rows = _packets(spark, sf_dir, False, ("http",)).filter("http is not null")
    return rows.select("number", "http.is_request", "http.method", "http.uri", "http.status_code", "http.host", "http.content_length", F.size("http.headers").alias("headers"))


_INFO = """CASE WHEN is_arp THEN 'Who has ' || remote || '? Tell ' || host
  WHEN is_icmp THEN CASE k % 3 WHEN 0 THEN 'Echo Request' WHEN 2 THEN 'Time Exceeded' ELSE CASE k % 4 WHEN 0 THEN 'Destination Net Unreachable' WHEN 1 THEN 'Destination Host Unreachable' WHEN 3 THEN 'Destination Port Unreachable' ELSE 'Destination Unreachable (code=2)' END END
  WHEN is_udp AND o THEN 'DNS Q ' || qname WHEN is_udp THEN 'DNS A ' || qname || ' → ' || remote
  WHEN e = 'purchase' AND o THEN 'GET shop' || (k % 7) || '.example.com/item/' || k WHEN e = 'purchase' THEN 'HTTP 200 response'
  ELSE sport || ' → ' || dport || ' ' || flags || ' Seq=' || seq || ' Ack=' || ack || ' Len=' || plen END"""
_PROTO = "CASE WHEN is_arp THEN 'ARP' WHEN is_icmp THEN 'ICMP' WHEN is_udp THEN 'DNS' WHEN e = 'purchase' THEN 'HTTP' ELSE 'TCP' END"


@query(P + f"SELECT number, src AS source, dst AS destination, {_PROTO} AS protocol, wire_len AS length, {_INFO} AS info, CASE WHEN is_arp THEN 'Arp' WHEN is_icmp THEN 'Icmp' WHEN is_udp THEN 'Dns' ELSE 'Tcp' END AS color_hint FROM w")
def packet_summary(spark, sf_dir):
    return _packets(spark, sf_dir).select("number", "summary.*")


@query(P + "SELECT number, k % 25 AS proto, CASE k % 25 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Unknown' END AS wide, CASE k % 25 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE '?' END AS narrow FROM p")
def protocol_names(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events"))
    p = F.col("k") % 25
    return rows.select(F.col("n").alias("number"), p.alias("proto"), protocol_name(p).alias("wide"), protocol_name(p, narrow=True).alias("narrow"))


# --- filters -------------------------------------------------------------


def _filter(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        want = tuple(display_filter.layers(text)) or ("eth",)
        return display_filter.matching(_packets(spark, sf_dir, False, want), text).select("number")

    run.__name__ = name
    query(P + f"SELECT number FROM w WHERE {where}")(run)


_filter("filter_port_any", "tcp.port == 443", "is_tcp AND rport = 443")
_filter("filter_port_ne", "tcp.port != 80", "is_tcp")
_filter("filter_not_absent", "not udp.dstport == 53", "NOT coalesce(is_udp AND dport = 53, FALSE)")
_filter("filter_ne_absent", "udp.dstport != 53", "is_udp AND dport <> 53")
_filter("filter_contains", "dns.qname contains d1", "is_udp AND contains(qname, 'd1')")
_filter("filter_bool", "(arp or icmp) || tcp and not ip.src == 93.184.216.1 && !tcp.dstport == 80", "is_arp OR is_icmp OR (is_tcp AND src <> '93.184.216.1' AND dport <> 80)")
_filter("filter_type_mismatch", "ip.src != 80 and not tcp.srcport == word", "NOT is_arp")
_filter("filter_no_word_boundary", "nottcp", "NOT is_tcp")
_filter("filter_unknown_field", "not frame.length == 60", "TRUE")
_filter("filter_icmp_arp_fields", "icmp.type == 3 or arp.sender.ip == 10.0.0.1", "(is_icmp AND k % 3 = 1) OR (is_arp AND host = '10.0.0.1')")


@query(P + "SELECT number FROM w WHERE (is_tcp AND (sport = 80 OR dport = 80) AND dst <> '10.0.0.5') OR is_arp")
def capture_filter(spark, sf_dir):
    return bpf.captured(views.frames(spark, sf_dir), "(tcp port 80 and not dst host 10.0.0.5) or arp").select("number")


@query(P + f"SELECT number FROM w WHERE regexp_matches({_INFO}, '^DNS .*d[0-4]\\.') OR src = '93.184.216.2' OR dst = '93.184.216.2'")
def regex_search(spark, sf_dir):
    return display_filter.searched(_packets(spark, sf_dir), r"^DNS .*d[0-4]\.|^93\.184\.216\.2$").select("number")


@query(P + "SELECT coalesce(min(number) FILTER (number > 500 AND is_arp), min(number) FILTER (is_arp)) AS number FROM w")
def search_next(spark, sf_dir):
    return display_filter.next_match(_packets(spark, sf_dir), "^Who has", 500)


# --- statistics ----------------------------------------------------------

_TALK = "SELECT endpoint, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM (SELECT src AS endpoint, wire_len FROM {0} UNION ALL SELECT dst, wire_len FROM {0}) GROUP BY endpoint"


@query(P + _TALK.format("w"))
def top_talkers(spark, sf_dir):
    return stats.top_talkers(_packets(spark, sf_dir, False, ("source", "destination")))


@query(P + ", x AS (SELECT * FROM w WHERE is_tcp AND rport = 443 AND src <> '10.0.0.1') " + _TALK.format("x"))
def top_talkers_filtered(spark, sf_dir):
    text = "tcp.port == 443 and not ip.src == 10.0.0.1"
    return stats.top_talkers(display_filter.matching(_packets(spark, sf_dir, False, (*display_filter.layers(text), "source", "destination")), text))


@query(P + f"SELECT protocol, count(*) AS packets, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS percent, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () / 2) AS BIGINT) AS bar FROM (SELECT {_PROTO} AS protocol FROM w) GROUP BY protocol")
def protocol_dist(spark, sf_dir):
    return stats.protocol_share(_packets(spark, sf_dir))


_FLOWVIEW = "SELECT host || ':' || hport || ' <-> ' || remote || ':' || rport AS label, CASE WHEN is_tcp THEN 'TCP' ELSE 'UDP' END AS protocol, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes, min(ms) AS first_ms, max(ms) AS last_ms FROM w WHERE is_tcp OR is_udp GROUP BY 1, 2"


@query(P + _FLOWVIEW)
def flow_table(spark, sf_dir):
    return stats.flow_view(_packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "udp")))


@query(
    P
    + f""", fl AS ({_FLOWVIEW}), ends AS (SELECT min(first_ms) AS lo, max(last_ms) AS hi FROM fl)
    SELECT label, protocol, packets, bytes, first_ms, last_ms, s AS bar_start, greatest(z - s, 1) AS bar_length, repeat(' ', least(s, 40)::INT) || repeat('▇', least(greatest(z - s, 1), 40)::INT) AS bar
    FROM (SELECT *, CAST(floor((first_ms - lo) / greatest(hi - lo, 1)::DOUBLE * 40) AS BIGINT) AS s, CAST(ceil((last_ms - lo) / greatest(hi - lo, 1)::DOUBLE * 40) AS BIGINT) AS z FROM fl, ends) AS fl"""
)
def timeline(spark, sf_dir):
    return stats.timeline(stats.flow_view(_packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "udp"))))


@query(
    P
    + """, g AS (SELECT date_trunc('second', ts) AS s, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM w GROUP BY 1), top AS (SELECT max(s) AS hi FROM g)
    SELECT epoch_us(t.s) AS second, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes FROM (SELECT unnest(generate_series(hi - INTERVAL 59 SECOND, hi, INTERVAL 1 SECOND)) AS s FROM top) AS t LEFT JOIN g ON g.s = t.s"""
)
def throughput(spark, sf_dir):
    return stats.throughput(views.frames(spark, sf_dir), 60)


@query("SELECT event_id AS number, length('' || event_id) AS digits FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 100")
def last_packets(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"))
    return stats.last_packets(rows, 100).withColumn("digits", F.length(F.col("number").cast("string")))


@query("SELECT event_id AS number FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 86400 SECOND ORDER BY event_id LIMIT 50")
def one_shot(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), "ts")
    return stats.one_shot(rows, 50, 86400).select("number")


@query("SELECT event_id AS number FROM events WHERE event_id IN (3, 5, 8, 13, 21)")
def bookmarks(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"))
    return stats.bookmarked(rows, [3, 5, 8, 13, 21])


@query("SELECT event_id AS number FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 100")
def page(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), "value")
    return stats.page(rows, [F.desc("value"), "number"], 100, 25).select("number")


def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flow_events(spark, sf_dir)
    return rows.select((F.col("seq") % 997).alias("id"), "seq", "ts_ms", F.col("proc_name").alias("process"), "pid", "dest_ip", "dest_port", "local_port", "protocol", "outbound", F.col("name").alias("dest_name"), "country", "asn", "as_org", "bytes_up", "bytes_down")


_LIVE = """, c AS (SELECT seq % 997 AS id, * FROM f), lc AS (SELECT id, coalesce(arg_max(proc_name, seq) FILTER (proc_name IS NOT NULL), '?') AS process, arg_max(pid, seq) FILTER (pid IS NOT NULL) AS pid,
  coalesce(arg_max(name, seq) FILTER (name IS NOT NULL), arg_min(dest_ip, seq)) AS dest_name, arg_min(dest_ip, seq) AS dest_ip, arg_max(country, seq) FILTER (country IS NOT NULL) AS country, arg_max(asn, seq) FILTER (asn IS NOT NULL) AS asn,
  first(as_org ORDER BY seq DESC) FILTER (asn IS NOT NULL) AS as_org, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down, max(ts_ms) AS last_seen, arg_min(outbound, seq) AS outbound FROM c GROUP BY id)"""


@query(E + _LIVE + " SELECT * FROM lc")
def live_connections(spark, sf_dir):
    return stats.live_connections(_connections(spark, sf_dir)).drop("dest_port", "local_port", "protocol", "first_seen")


@query(E + _LIVE + " SELECT process, arg_min(pid, id) AS pid, count(*) AS conns, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM lc GROUP BY process")
def process_rollup(spark, sf_dir):
    return stats.process_rollup(stats.live_connections(_connections(spark, sf_dir)))


_DOMAIN = "CASE WHEN regexp_matches({0}, '\\.site[0-9]+\\.(co\\.uk|com)$') THEN regexp_extract({0}, '(site[0-9]+\\..*)$', 1) ELSE regexp_extract({0}, '([0-9]+\\.[0-9]+)$', 1) END"


@query(E + _LIVE + f" SELECT coalesce(as_org, {_DOMAIN.format('dest_name')}) AS domain, count(*) AS conns, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM lc GROUP BY 1")
def domain_rollup(spark, sf_dir):
    return stats.domain_rollup(stats.live_connections(_connections(spark, sf_dir)))


@query(E + _LIVE + " SELECT id, last_seen FROM lc WHERE contains(lower(process), 'app1') OR contains(lower(dest_name), 'app1') OR contains(dest_ip, 'app1') OR contains(lower(coalesce(as_org, '')), 'app1') OR contains(lower(coalesce(country, '')), 'app1')")
def inspector_search(spark, sf_dir):
    return stats.matching_connections(stats.live_connections(_connections(spark, sf_dir)), "APP1").select("id", "last_seen")


# --- flows ---------------------------------------------------------------

# the state of a key after each packet: incarnation, which directions have sent FIN, and whether the packet closes
_FOLD = """
k0 AS (SELECT *, host || ':' || hport || '|' || remote || ':' || rport || '|' || is_tcp AS key FROM w WHERE is_tcp OR is_udp),
k1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY number) AS rn FROM k0),
st AS (
  SELECT key, rn, number, 1::BIGINT AS incarnation, is_tcp AND fin AND o AS fl, is_tcp AND fin AND NOT o AS fh, is_tcp AND rst AS closes, TRUE AS first_seen FROM k1 WHERE rn = 1
  UNION ALL
  SELECT k1.key, k1.rn, k1.number, st.incarnation + CASE WHEN st.closes THEN 1 ELSE 0 END, (NOT st.closes AND st.fl) OR (k1.fin AND k1.o), (NOT st.closes AND st.fh) OR (k1.fin AND NOT k1.o),
    k1.rst OR (((NOT st.closes AND st.fl) OR (k1.fin AND k1.o)) AND ((NOT st.closes AND st.fh) OR (k1.fin AND NOT k1.o))), st.closes
  FROM st JOIN k1 ON k1.key = st.key AND k1.rn = st.rn + 1),
an AS (SELECT k1.*, st.incarnation, st.closes, st.first_seen FROM k1 JOIN st USING (key, rn))"""
R = "WITH RECURSIVE " + views.PACKETS_SQL + "," + _FOLD + " "


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.annotated(flow_packets(_packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "udp"))))


@query(R + "SELECT number, incarnation, first_seen, closes FROM an")
def flow_incarnations(spark, sf_dir):
    return _notes(spark, sf_dir).select("number", "incarnation", "first_seen", "closes")


@query(R + ", m AS (SELECT *, max(CASE WHEN plen > 0 THEN seq + plen END) OVER (PARTITION BY key, incarnation, o ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM an) SELECT number FROM m WHERE is_tcp AND plen > 0 AND seq + plen <= top")
def retransmissions(spark, sf_dir):
    return _notes(spark, sf_dir).filter("retransmission").select("number")


@query(
    R
    + """, s1 AS (SELECT key, incarnation, min(number) AS sn, arg_min(us, number) AS sus FROM an WHERE is_syn AND o GROUP BY ALL),
    s2 AS (SELECT key, incarnation, arg_min(an.us - sus, number) / 1000.0::DOUBLE AS rtt FROM an JOIN s1 USING (key, incarnation) WHERE is_syn AND NOT an.o AND number > sn GROUP BY ALL)
    SELECT min(number) AS first_number, CAST(max(rtt) AS DOUBLE) AS handshake_rtt_ms FROM an JOIN s2 USING (key, incarnation) GROUP BY key, incarnation"""
)
def handshake_rtt(spark, sf_dir):
    return flows.flow_table(_notes(spark, sf_dir)).filter("handshake_rtt_ms is not null").select("first_number", "handshake_rtt_ms")


@query(
    R
    + """SELECT min(number) AS first_number, max(number) AS last_number, count(*) FILTER (o) AS pkts_up, count(*) FILTER (NOT o) AS pkts_down, CAST(coalesce(sum(wire_len) FILTER (o), 0) AS BIGINT) AS bytes_up, CAST(coalesce(sum(wire_len) FILTER (NOT o), 0) AS BIGINT) AS bytes_down,
    min(us) AS first_seen, max(us) AS last_seen, bool_or(closes) AS closed FROM an GROUP BY key, incarnation"""
)
def flow_accounting(spark, sf_dir):
    return flows.flow_table(_notes(spark, sf_dir)).select("first_number", "last_number", "pkts_up", "pkts_down", "bytes_up", "bytes_down", "first_seen", "last_seen", "closed")


@query(R + "SELECT max(number) AS id, CASE WHEN any_value(is_tcp) THEN 6 ELSE 17 END AS proto, any_value(hport) AS local_port, any_value(rport) AS remote_port, CAST(coalesce(sum(wire_len) FILTER (o), 0) AS BIGINT) AS bytes_up, CAST(coalesce(sum(wire_len) FILTER (NOT o), 0) AS BIGINT) AS bytes_down, min(ms) AS ts_start_ms, max(ms) AS ts_end_ms FROM an GROUP BY key, incarnation HAVING bool_or(closes)", longs="proto remote_port")
def closed_connections(spark, sf_dir):
    done = flows.completed(flows.flow_table(_notes(spark, sf_dir)))
    ms = lambda c: F.unix_millis(c)
    return done.select(F.col("last_number").alias("id"), F.col("protocol").alias("proto"), "local_port", "remote_port", "bytes_up", "bytes_down", ms("first_seen").alias("ts_start_ms"), ms("last_seen").alias("ts_end_ms"))


@query()
def smoothed_rtt(spark, sf_dir):
    return flows.flow_table(_notes(spark, sf_dir)).filter("srtt_ms is not null").select("first_number", "srtt_ms")


@query()
def follow_stream(spark, sf_dir):
    parts = reassembly.segments(_packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "payload")))
    return reassembly.followed(parts)


# --- correlation ---------------------------------------------------------


@query(
    P
    + """, d AS (SELECT *, lag(number) OVER x AS qn, lag(us) OVER x AS qus, lag(o) OVER x AS qo FROM w WHERE is_udp WINDOW x AS (PARTITION BY k ORDER BY number))
    SELECT number, qn AS query_number, CAST(greatest((us - qus) / 1000.0, 0.0) AS DOUBLE) AS rtt_ms, remote AS answers FROM d WHERE NOT o AND qo"""
)
def dns_pairing(spark, sf_dir):
    return correlate.dns_pairs(_packets(spark, sf_dir, False, ("dns",)))


@query(
    P
    + """, obs AS (SELECT number, remote AS ip, qname AS name, 2 AS prio FROM w WHERE is_udp AND NOT o UNION ALL SELECT number, remote, 'shop' || (k % 7) || '.example.com', 1 FROM w WHERE e = 'purchase' AND o),
    ev AS (SELECT number, remote FROM w WHERE is_tcp OR is_udp)
    SELECT ev.number, ev.remote, coalesce(a.name, b.name) AS name FROM ev ASOF LEFT JOIN (SELECT * FROM obs WHERE prio = 2) AS a ON ev.remote = a.ip AND ev.number >= a.number ASOF LEFT JOIN (SELECT * FROM obs WHERE prio = 1) AS b ON ev.remote = b.ip AND ev.number >= b.number"""
)
def name_asof(spark, sf_dir):
    packets = _packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "udp", "dns", "tls_client_hello", "http"))
    # hosts are the 10.x ends: the remote is the other one, whichever way the packet goes
    inner = F.substring("src_ip", 1, 1) == F.unhex(F.lit("0A"))
    events = flow_packets(packets).select("number", F.when(inner, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip"))
    out = correlate.name_as_of(events, correlate.name_observations(packets))
    return out.select("number", ip_text(F.col("ip")).alias("remote"), "name")


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = views.table(spark, sf_dir, "nation")
    s = lambda c: c.cast("string")
    i = F.col("n_nationkey")
    lo, hi = F.concat(F.lit("93.184."), s(i), F.lit(".0")), F.concat(F.lit("93.184."), s(i), F.lit(".30"))
    countries = nation.select(ipv4_bytes(lo).alias("start_ip"), ipv4_bytes(hi).alias("end_ip"), F.col("n_name").alias("country"))
    lo, hi = F.concat(F.lit("93.184."), s(i), F.lit(".20")), F.concat(F.lit("93.184."), s(i), F.lit(".40"))
    networks = nation.select(ipv4_bytes(lo).alias("start_ip"), ipv4_bytes(hi).alias("end_ip"), (i + 64500).cast("long").alias("asn"), F.concat(F.lit("NET"), s(i)).alias("as_org"))
    return countries, networks


@query(
    E
    + """ SELECT seq, dest_ip, a.n_name AS country, 64500 + b.n_nationkey AS asn, 'NET' || b.n_nationkey AS as_org FROM f LEFT JOIN nation AS a ON split_part(dest_ip, '.', 3)::INT = a.n_nationkey AND split_part(dest_ip, '.', 4)::INT BETWEEN 0 AND 30
    LEFT JOIN nation AS b ON split_part(dest_ip, '.', 3)::INT = b.n_nationkey AND split_part(dest_ip, '.', 4)::INT BETWEEN 20 AND 40""",
    longs="asn",
)
def geo_range(spark, sf_dir):
    rows = views.flow_events(spark, sf_dir).select("seq", "dest_ip").withColumn("ip", ipv4_bytes(F.col("dest_ip")))
    return correlate.located(rows, "ip", *_ranges(spark, sf_dir)).select("seq", "dest_ip", "country", "asn", "as_org")


@query(
    """WITH a AS (SELECT c_custkey, (c_custkey * 7919) % 256 AS x, (c_custkey * 104729) % 256 AS y, c_custkey % 256 AS z FROM customer)
    SELECT c_custkey AS id, NOT (x = 10 OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR x = 127 OR (x = 169 AND y = 254) OR (x = 192 AND y = 0 AND z = 2) OR (x = 198 AND y = 51 AND z = 100) OR (x = 203 AND y = 0 AND z = 113) OR x BETWEEN 224 AND 239 OR (x = 255 AND y = 255 AND z = 255) OR (x = 0 AND y = 0 AND z = 0)) AS is_global FROM a"""
)
def global_addresses(spark, sf_dir):
    c = F.col("c_custkey")
    octets = [(c * 7919) % 256, (c * 104729) % 256, c % 256]
    last = F.when((octets[0] == 255) & (octets[1] == 255), 255).otherwise(0)
    text = F.concat_ws(".", *[o.cast("string") for o in (*octets, last)])
    return views.table(spark, sf_dir, "customer").select(c.alias("id"), is_global(ipv4_bytes(text)).alias("is_global"))


@query(
    """WITH s AS (SELECT o_orderdate AS ts, o_custkey % 50 AS port, max(o_orderkey) AS pid FROM orders GROUP BY ALL), e AS (SELECT event_id, ts + INTERVAL 0 DAY AS ts, user_id % 50 AS port FROM events)
    SELECT event_id AS number, s.pid, 'p' || s.pid AS process FROM e ASOF LEFT JOIN s ON e.port = s.port AND e.ts >= s.ts"""
)
def socket_owner(spark, sf_dir):
    addr = F.unhex(F.lit("0A000001"))
    seen = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("int").alias("port")).agg(F.max("o_orderkey").alias("pid"))
    sockets = seen.select("ts", F.lit(6).alias("protocol"), addr.alias("addr"), "port", "pid", F.concat(F.lit("p"), F.col("pid").cast("string")).alias("name"), F.lit(None).cast("string").alias("exe_path"))
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), "ts", addr.alias("local_ip"), (F.col("user_id") % 50).cast("int").alias("local_port"), F.lit(6).alias("protocol"))
    return correlate.socket_owner(rows, sockets).select("number", "pid", "process")


@query(
    """WITH a AS (SELECT event_id AS number, event_type || (user_id % 40) AS data FROM events), b AS (SELECT event_id AS number, event_type || (user_id % 50) AS data FROM events),
    x AS (SELECT 'a' AS side, number, row_number() OVER (PARTITION BY data ORDER BY number) AS rn, (SELECT count(*) FROM b WHERE b.data = a.data) AS other FROM a),
    y AS (SELECT 'b' AS side, number, row_number() OVER (PARTITION BY data ORDER BY number) AS rn, (SELECT count(*) FROM a WHERE a.data = b.data) AS other FROM b)
    SELECT side, number FROM x WHERE rn > other UNION ALL SELECT side, number FROM y WHERE rn > other"""
)
def capture_diff(spark, sf_dir):
    return diff.difference(*_captures(spark, sf_dir))


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.table(spark, sf_dir, "events")
    data = lambda m: F.concat("event_type", (F.col("user_id") % m).cast("string")).cast("binary").alias("data")
    return rows.select(F.col("event_id").alias("number"), data(40)), rows.select(F.col("event_id").alias("number"), data(50))


@query(
    """WITH a AS (SELECT event_type || (user_id % 40) AS data, count(*) AS n FROM events GROUP BY 1), b AS (SELECT event_type || (user_id % 50) AS data, count(*) AS n FROM events GROUP BY 1)
    SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM a JOIN b USING (data)"""
)
def capture_common(spark, sf_dir):
    return diff.common(*_captures(spark, sf_dir))


@query(
    P
    + """SELECT number, CASE WHEN o AND k % 10 = 0 THEN 'PlaintextCredential' ELSE 'UnusualPort' END AS kind, CASE WHEN o AND k % 10 = 0 THEN 'HTTP Basic credentials sent in cleartext' ELSE 'cleartext HTTP on unusual port ' || dport END AS detail,
    CASE WHEN o AND k % 10 = 0 THEN 'Warning' ELSE 'Info' END AS severity FROM w WHERE e = 'purchase' AND ((o AND k % 10 = 0) OR rport <> 80)"""
)
def anomalies(spark, sf_dir):
    return anomaly.annotated(_packets(spark, sf_dir, False)).filter("anomaly is not null").select("number", "anomaly.*")


# --- alerts and the store ------------------------------------------------

_START = ", le AS (SELECT arg_min(ts_ms, seq) AS start_ms FROM f), ac AS (SELECT min(seq) AS active_from FROM f, le WHERE ts_ms >= start_ms + 604800000)"
_LOUD = "outbound AND seq >= (SELECT active_from FROM ac)"


@query(E + _START + " SELECT start_ms, active_from, start_ms + 604800000 AS end_ms FROM le, ac")
def learning_state(spark, sf_dir):
    return alerts.learning(views.flow_events(spark, sf_dir), CONFIG)


def _signal(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    return alerts.candidates(views.flow_events(spark, sf_dir), CONFIG).filter(F.col("step") == step).select("seq", "severity", "dedup_key", "title", "detail")


def _novel(key: str, more: str = "") -> str:
    return f", nv AS (SELECT *, row_number() OVER (PARTITION BY exe, {key} ORDER BY seq) AS rn FROM f JOIN ids USING (exe) WHERE exe IS NOT NULL {more})"


_LABEL = "coalesce(as_org, domain, dest_ip)"


@query(E + _START + _novel("exe") + f" SELECT seq, 'warning' AS severity, 'egress|' || exe AS dedup_key, proc_name || ' made its first outbound connection (→ ' || coalesce(name, dest_ip) || ')' AS title, '{{\"dest\":\"' || coalesce(name, dest_ip) || '\",\"exe\":\"' || exe || '\",\"pid\":' || pid || '}}' AS detail FROM nv WHERE rn = 1 AND {_LOUD}")
def first_egress(spark, sf_dir):
    return _signal(spark, sf_dir, 1)


@query(E + _START + _novel(_LABEL) + f" SELECT seq, 'notice' AS severity, 'dest|' || process_id || '|' || {_LABEL} AS dedup_key, proc_name || ' contacted a new destination: ' || {_LABEL} AS title, '{{\"exe\":\"' || exe || '\",\"ip\":\"' || dest_ip || '\",\"label\":\"' || {_LABEL} || '\",\"pid\":' || pid || '}}' AS detail FROM nv WHERE rn = 1 AND {_LOUD}")
def novelty_label(spark, sf_dir):
    return _signal(spark, sf_dir, 3)


@query(E + _START + _novel("country", "AND country IS NOT NULL") + f" SELECT seq, 'notice' AS severity, 'geo|' || process_id || '|cc|' || country AS dedup_key, proc_name || ' connected to a new country: ' || country AS title, '{{\"country\":\"' || country || '\",\"exe\":\"' || exe || '\",\"pid\":' || pid || '}}' AS detail FROM nv WHERE rn = 1 AND {_LOUD}")
def novelty_country(spark, sf_dir):
    return _signal(spark, sf_dir, 4)


@query(
    E + _START + _novel("asn", "AND asn IS NOT NULL")
    + f""" SELECT seq, 'notice' AS severity, 'geo|' || process_id || '|asn|' || asn AS dedup_key, proc_name || ' connected to a new network: AS' || asn || coalesce(' (' || as_org || ')', '') AS title,
    '{{"as_org":' || coalesce('"' || as_org || '"', 'null') || ',"asn":' || asn || ',"exe":"' || exe || '","pid":' || pid || '}}' AS detail FROM nv WHERE rn = 1 AND {_LOUD}"""
)
def novelty_network(spark, sf_dir):
    return _signal(spark, sf_dir, 5)


_VOLUME = """
, v0 AS (SELECT exe, seq, ts_ms, bytes_up::DOUBLE AS b, row_number() OVER (PARTITION BY exe ORDER BY seq) AS rn FROM f WHERE exe IS NOT NULL),
vs AS (
  SELECT exe, rn, seq, ts_ms AS start_ms, b AS acc, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS var, 0::BIGINT AS samples, FALSE AS closed, 0.0::DOUBLE AS x, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS ps FROM v0 WHERE rn = 1
  UNION ALL
  SELECT v0.exe, v0.rn, v0.seq, CASE WHEN v0.ts_ms - vs.start_ms >= 3600000 THEN v0.ts_ms ELSE vs.start_ms END, CASE WHEN v0.ts_ms - vs.start_ms >= 3600000 THEN 0.0::DOUBLE ELSE vs.acc + v0.b END,
    CASE WHEN v0.ts_ms - vs.start_ms >= 3600000 THEN vs.mean + 0.3::DOUBLE * ((vs.acc + v0.b) - vs.mean) ELSE vs.mean END,
    CASE WHEN v0.ts_ms - vs.start_ms >= 3600000 THEN (1.0::DOUBLE - 0.3::DOUBLE) * (vs.var + 0.3::DOUBLE * ((vs.acc + v0.b) - vs.mean) * ((vs.acc + v0.b) - vs.mean)) ELSE vs.var END,
    vs.samples + CASE WHEN v0.ts_ms - vs.start_ms >= 3600000 THEN 1 ELSE 0 END, v0.ts_ms - vs.start_ms >= 3600000, vs.acc + v0.b, vs.mean, sqrt(vs.var)
  FROM vs JOIN v0 ON v0.exe = vs.exe AND v0.rn = vs.rn + 1),
sm AS (SELECT exe, seq, x, pm AS mean, ps AS std, samples FROM vs WHERE closed)"""


@query(E + _VOLUME + " SELECT * FROM sm")
def volume_samples(spark, sf_dir):
    return alerts.volume_samples(views.flow_events(spark, sf_dir), CONFIG)


@query(
    E + _VOLUME
    + """, zs AS (SELECT *, CASE WHEN std > 0 THEN (x - mean) / std WHEN x > mean THEN 'inf'::DOUBLE ELSE 0.0 END AS z FROM sm WHERE samples >= 8 AND floor(x) >= 100000)
    SELECT exe, seq, z, CASE WHEN x >= 10.0::DOUBLE * greatest(mean, 1.0::DOUBLE) THEN 'critical' ELSE 'warning' END AS severity FROM zs WHERE z >= 2.0"""
)
def volume_spike(spark, sf_dir):
    return alerts.spikes(alerts.volume_samples(views.flow_events(spark, sf_dir), CONFIG), CONFIG).select("exe", "seq", "z", "severity")


@query(
    E
    + """, i0 AS (SELECT *, lag(id_value) OVER (PARTITION BY exe ORDER BY seq) AS pv FROM f WHERE has_id), i1 AS (SELECT exe, id_value AS v1, arg_min(id_team, seq) AS team1, arg_min(id_status, seq) AS status1 FROM f WHERE has_id GROUP BY ALL),
    j AS (SELECT i0.*, team1, status1 FROM i0 JOIN i1 ON i0.exe = i1.exe AND i0.pv = i1.v1)
    SELECT seq, exe, pv AS old_value, id_value AS new_value FROM j
    WHERE CASE WHEN id_kind = 'MacCodesign' THEN team1 <> id_team OR (status1 = 'Valid' AND id_status <> 'Valid') ELSE pv <> id_value OR (status1 = 'Valid' AND id_status <> 'Valid') END"""
)
def identity_change(spark, sf_dir):
    rows = alerts.identity_changes(views.flow_events(spark, sf_dir), CONFIG)
    return rows.select("seq", "exe", F.col("old.value").alias("old_value"), F.col("identity.value").alias("new_value"))


@query(
    """WITH RECURSIVE c AS (SELECT event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms, event_type || (user_id % 7) AS dedup_key FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY seq) AS rn FROM c),
    r AS (SELECT seq, dedup_key, rn, ts_ms AS last, TRUE AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.seq, n.dedup_key, n.rn, CASE WHEN n.ts_ms - r.last < 86400000 THEN r.last ELSE n.ts_ms END, n.ts_ms - r.last >= 86400000 FROM r JOIN n ON n.dedup_key = r.dedup_key AND n.rn = r.rn + 1)
    SELECT seq, dedup_key FROM r WHERE kept"""
)
def alert_cooldown(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events"))
    found = rows.select(F.col("n").alias("seq"), F.lit(1).alias("step"), F.unix_millis("ts").alias("ts_ms"), F.concat("e", (F.col("u") % 7).cast("string")).alias("dedup_key"))
    return alerts.emitted(found, CONFIG).select("seq", "dedup_key")


@query()
def alert_feed(spark, sf_dir):
    return alerts.alerts(views.flow_events(spark, sf_dir), CONFIG)


@query(E + " SELECT ids.process_id AS id, exe AS exe_path, arg_max(proc_name, seq) AS name, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms FROM f JOIN ids USING (exe) GROUP BY ALL")
def list_processes(spark, sf_dir):
    return store.list_processes(store.processes(views.flow_events(spark, sf_dir)).drop("identity"))


@query(E + ", i0 AS (SELECT exe, arg_max(id_kind, seq) AS kind, arg_max(id_value, seq) AS value FROM f WHERE has_id GROUP BY exe), i1 AS (SELECT exe, id_value AS value, arg_min(id_team, seq) AS team_id, arg_min(id_status, seq) AS status, min(ts_ms) AS first_seen_ms FROM f WHERE has_id GROUP BY ALL) SELECT process_id, kind, value, team_id, status, first_seen_ms FROM i0 JOIN i1 USING (exe, value) JOIN ids USING (exe)")
def current_identity(spark, sf_dir):
    return store.current_identity(views.flow_events(spark, sf_dir)).select("process_id", "kind", "value", "team_id", "status", "first_seen_ms")


@query(E + " SELECT dest_id AS id, dest_ip AS ip, arg_max(name, seq) FILTER (name IS NOT NULL) AS best_name, arg_max(asn, seq) FILTER (asn IS NOT NULL) AS asn, arg_max(as_org, seq) FILTER (as_org IS NOT NULL) AS as_org, arg_max(country, seq) FILTER (country IS NOT NULL) AS country, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms FROM f JOIN dids USING (dest_ip) GROUP BY ALL")
def destinations(spark, sf_dir):
    return store.destinations(views.flow_events(spark, sf_dir))


@query(E + " SELECT process_id, dest_id, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms, count(*) AS conn_count FROM f JOIN ids USING (exe) JOIN dids USING (dest_ip) GROUP BY ALL")
def process_dest_pairs(spark, sf_dir):
    return store.pairs(views.flow_events(spark, sf_dir))


@query(E + " SELECT dest_ip AS ip, name, 'obs' AS source, min(ts_ms) AS seen_ms FROM f WHERE name IS NOT NULL GROUP BY ALL")
def name_resolutions(spark, sf_dir):
    return store.name_resolutions(views.flow_events(spark, sf_dir))


@query(E + " SELECT process_id, asn, arg_min(coalesce(as_org, ''), seq) AS as_org, min(ts_ms) AS first_seen_ms FROM f JOIN ids USING (exe) WHERE asn IS NOT NULL GROUP BY ALL")
def process_networks(spark, sf_dir):
    return store.networks(views.flow_events(spark, sf_dir)).withColumn("as_org", F.coalesce("as_org", F.lit("")))


@query(E + f" SELECT process_id, {_LABEL} AS label, min(ts_ms) AS first_seen_ms FROM f JOIN ids USING (exe) GROUP BY ALL")
def process_labels(spark, sf_dir):
    return store.labels(views.flow_events(spark, sf_dir))


@query(E + ", x AS (SELECT dest_id, max(ts_ms) AS last FROM f JOIN ids USING (exe) JOIN dids USING (dest_ip) WHERE process_id = 3 GROUP BY ALL), d AS (SELECT dest_id, dest_ip, min(ts_ms) AS first_seen_ms FROM f JOIN dids USING (dest_ip) GROUP BY ALL) SELECT dest_id AS id, dest_ip AS ip, first_seen_ms FROM x JOIN d USING (dest_id)")
def dest_for_process(spark, sf_dir):
    e = views.flow_events(spark, sf_dir)
    return store.destinations_of(3, store.pairs(e), store.destinations(e)).select("id", "ip", "first_seen_ms")


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_alerts(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events")).select(F.col("n").alias("id"), F.unix_millis("ts").alias("ts_ms"))
    return store.recent_alerts(rows, 200)


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts_start_ms FROM events WHERE user_id = 3 AND (epoch_us(ts) // 1000) BETWEEN 1704067200000 AND 1705276800000")
def process_history(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events")).select(F.col("n").alias("id"), F.col("u").alias("process_id"), F.unix_millis("ts").alias("ts_start_ms"))
    return store.process_history(rows, 3, 1704067200000, 1705276800000).select("id", "ts_start_ms")


@query(E + " SELECT (SELECT count(*) FROM ids) AS processes, (SELECT count(*) FROM dids) AS destinations, (SELECT count(*) FROM events WHERE event_type = 'error') AS alerts")
def table_counts(spark, sf_dir):
    e = views.flow_events(spark, sf_dir)
    return store.counts(store.processes(e), store.destinations(e), views.table(spark, sf_dir, "events").filter("event_type = 'error'"))


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE (epoch_us(ts) // 1000) >= 1705276800000")
def retention(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events")).select(F.col("n").alias("id"), F.unix_millis("ts").alias("ts_ms"))
    return store.retained(rows, 1705276800000, "ts_ms")


@query("SELECT max((epoch_us(ts) // 1000)) AS ts_ms FROM events WHERE event_type || (user_id % 7) = 'error3'")
def latest_alert(spark, sf_dir):
    rows = views.numbers(views.table(spark, sf_dir, "events")).select(F.unix_millis("ts").alias("ts_ms"), F.concat("e", (F.col("u") % 7).cast("string")).alias("dedup_key"))
    return store.latest_alert(rows, "error3")


# --- functions -----------------------------------------------------------

_LISTS = "SELECT o_orderkey, list(CAST(l_partkey % 65536 AS BIGINT) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS c, list(CAST(l_suppkey * 257 % 65536 AS BIGINT) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS x FROM (SELECT *, l_orderkey AS o_orderkey FROM lineitem) GROUP BY o_orderkey"
_REAL = "list_filter({0}, lambda v: NOT (v // 256 = v % 256 AND v % 16 = 10))"


def _hello_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem")
    key = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("r"))  # a few lines an order
    part = lambda f: F.transform("r", f)
    return lists.select(F.col("l_orderkey").alias("id"), part(lambda r: (r["l_partkey"] % 65536).cast("int")).alias("c"), part(lambda r: (r["l_suppkey"] * 257 % 65536).cast("int")).alias("x"))


@query(f"SELECT o_orderkey AS id, md5('771,' || coalesce(array_to_string({_REAL.format('c')}, '-'), '') || ',' || coalesce(array_to_string({_REAL.format('x')}, '-'), '') || ',,0') AS ja3 FROM ({_LISTS})")
def ja3(spark, sf_dir):
    rows = _hello_fields(spark, sf_dir)
    none = F.array().cast("array<int>")
    return rows.select("id", fingerprint.ja3(F.lit(771), F.col("c"), F.col("x"), none, F.array(F.lit(0))).alias("ja3"))


@query(
    f"""WITH t AS (SELECT o_orderkey, {_REAL.format('c')} AS c, {_REAL.format('x')} AS e, list_filter({_REAL.format('x')}, lambda v: v <> 0 AND v <> 16) AS r, x FROM ({_LISTS})),
    h AS (SELECT *, array_to_string(list_transform(list_sort(c), lambda v: printf('%04x', v)), ',') AS ch, array_to_string(list_transform(list_sort(r), lambda v: printf('%04x', v)), ',') AS rh, array_to_string(list_transform(x, lambda v: printf('%04x', v)), ',') AS xh FROM t)
    SELECT o_orderkey AS id, 't13d' || lpad('' || least(len(c), 99), 2, '0') || lpad('' || least(len(e), 99), 2, '0') || 'h2_' || CASE WHEN len(c) = 0 THEN '000000000000' ELSE sha256(ch)[1:12] END || '_' || sha256(coalesce(rh, '') || '_' || xh)[1:12] AS ja4 FROM h"""
)
def ja4(spark, sf_dir):
    rows = _hello_fields(spark, sf_dir)
    return rows.select("id", fingerprint.ja4(F.lit(0x0304), F.lit(True), F.col("c"), F.col("x"), F.col("x"), F.lit("h2")).alias("ja4"))


@query(
    """WITH h AS (SELECT page_id, rtrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.') AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS p FROM h),
    t AS (SELECT *, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three FROM l)
    SELECT page_id, CASE WHEN len(p) <= 2 THEN host WHEN two IN ('co.uk','org.uk','gov.uk','ac.uk','com.au','net.au','org.au','co.jp','co.nz','com.br','co.in','com.cn') THEN three ELSE two END AS domain FROM t"""
)
def registrable_domains(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return views.table(spark, sf_dir, "pages").select("page_id", registrable_domain(host).alias("domain"))


@query(
    """WITH b AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity * 1000 AS BIGINT) * CAST(l_quantity * 97 AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT id, n, CASE WHEN n >= 1073741824 THEN printf('%.1f', n / 1073741824.0::DOUBLE) || 'G' WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0::DOUBLE) || 'M' WHEN n >= 1024 THEN printf('%.1f', n / 1024.0::DOUBLE) || 'K' ELSE n || 'B' END AS size FROM b"""
)
def byte_sizes(spark, sf_dir):
    amount = (F.col("l_quantity") * 1000).cast("long") * (F.col("l_quantity") * 97).cast("long")
    rows = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(amount).alias("n"))
    return rows.withColumn("size", byte_size(F.col("n")))


@query()
def hex_dumps(spark, sf_dir):
    return views.frames(spark, sf_dir).select("number", F.array_join(hex_dump(F.col("data")), "\n").alias("dump"))


@query()
def json_lines(spark, sf_dir):
    from ..sources import json_lines as sink

    return sink.lines(_packets(spark, sf_dir))


@query()
def detail_lines(spark, sf_dir):
    from ..functions import detail

    packets = _packets(spark, sf_dir, False)
    return packets.select("number", F.array_join(detail.lines(packets), "\n").alias("detail"))


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames through the whole chain, with sockets of the 10.x hosts and the nations as places."""
    packets = _packets(spark, sf_dir, False)
    raw = views.numbers(views.table(spark, sf_dir, "events"))
    host = F.unhex(views.host_hex(F.col("u")))
    port = (50000 + F.col("u") % 15000).cast("int")
    seen = raw.groupBy("u").agg(F.min("ts").alias("ts"))
    sockets = seen.select("ts", F.lit(6).alias("protocol"), host.alias("addr"), port.alias("port"), (F.col("u") % 20 + 100).alias("pid"), F.concat(F.lit("app"), (F.col("u") % 20).cast("string")).alias("name"), F.lit(None).cast("string").alias("exe_path"))
    return monitor.flow_events(packets, None, sockets, *_ranges(spark, sf_dir))


@query(
    R
    + """, fl AS (SELECT key, incarnation, min(number) AS id FROM an GROUP BY ALL), fu AS (SELECT u, min(ts) AS t0 FROM b GROUP BY u)
    SELECT an.number AS seq, fl.id, CASE WHEN is_tcp AND o THEN 'pid:' || (an.u % 20 + 100) END AS exe, dst AS dest_ip, wire_len AS bytes_up, 0::BIGINT AS bytes_down, TRUE AS outbound, incarnation FROM an JOIN fl USING (key, incarnation)"""
)
def monitor_events(spark, sf_dir):
    return _monitored(spark, sf_dir).select("seq", "id", "exe", "dest_ip", "bytes_up", "bytes_down", "outbound", "incarnation")


@query()
def monitor_alerts(spark, sf_dir):
    # the engine reads its events several times: after a chain this long they are a table
    events = written(_monitored(spark, sf_dir), "events")
    return alerts.alerts(events, alerts.AlertConfig(learn_ms=3_600_000, volume_interval_ms=3_600_000, volume_floor=200, volume_z=2.0))


def _load() -> None:
    """The other modules that register queries here; they take their helpers from this one."""
    from . import byte_queries, host_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """Name to function of all registered queries."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to SQL of those that SQL can express."""
    _load()
    return dict(SQL)
