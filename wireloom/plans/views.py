"""The driver's tables in the roles of the operators' inputs.

``frames`` builds real Ethernet frames out of ``events`` with Column expressions,
so that decoders run on bytes; ``flow_events`` maps ``events`` to correlated packet
observations.  What a row becomes follows from four numbers: n (event_id), u
(user_id), k (the number in props) and v (value, rounded down).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbers(events: DataFrame) -> DataFrame:
    """``events`` as (n, ts, u, k, v, e)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"), k.alias("k"), F.floor("value").cast("int").alias("v"), F.col("event_type").alias("e"))


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def _text(value: Column) -> Column:
    return F.hex(value.cast("binary"))


def host_hex(user: Column) -> Column:
    """The address of a user, their number in the last three bytes of 10.0.0.0/8, as hex text; a number that doesn't fit is refused."""
    refused = F.raise_error(F.concat(F.lit("user_id "), user.cast("string"), F.lit(" has no address in 10.0.0.0/8")))
    return F.concat(F.lit("0A"), F.when((user < 0) | (user >= 1 << 24), refused).otherwise(_hex(user, 3)))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, ts, wire_len, data, linktype): a frame per event.

    click: TCP data, or every eighth a SYN or its answer; purchase: an HTTP request or
    response; error: RST or FIN; view: a DNS query or response; signup: ARP or ICMP.
    """
    r = numbers(table(spark, sf_dir, "events"))
    n, u, k, v, e = (F.col(c) for c in "nukve")
    view, signup = e == "view", e == "signup"
    out = F.when(view, n % 2 == 0).otherwise(n % 3 != 0)
    host = host_hex(u)
    remote = F.concat(F.lit("5DB8D8"), _hex(k % 4 + 1, 1))
    hport = _hex(50000 + u % 15000, 2)
    rport = F.when(view, "0035").when(k % 4 == 3, "0050").otherwise("01BB")
    ends = lambda a, b: F.when(out, F.concat(a, b)).otherwise(F.concat(b, a))
    line = "\r\n"
    request = F.concat(F.lit("GET /item/"), k.cast("string"), F.lit(f" HTTP/1.1{line}Host: shop"), (k % 7).cast("string"), F.lit(f".example.com{line}"), F.when(k % 10 == 0, f"Authorization: Basic YTpi{line}").otherwise(""), F.lit(line))
    response = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Length: "), v.cast("string"), F.lit(line * 2))
    syn = (e == "click") & (v % 8 == 0)
    body = F.when(e == "purchase", _text(F.when(out, request).otherwise(response))).when((e == "click") & ~syn, F.repeat(F.lit("61"), v % 64)).otherwise("")
    flags = F.when(syn & out, "02").when(syn, "12").when(e != "error", "18").when(F.floor(k / 4) % 2 == 1, "04").otherwise("11")
    tcp = F.concat(ends(hport, rport), _hex(1000 + 64 * (n + 3000 * (F.floor(k / 4) % 2)), 4), _hex(1000 + 64 * n, 4), F.lit("50"), flags, F.lit("FFFF00000000"), body)
    label = F.concat(F.lit("d"), (k % 13).cast("string"))
    question = F.concat(_hex(F.length(label), 1), _text(label), F.lit("076578616D706C6503636F6D0000010001"))
    answer = F.when(out, "").otherwise(F.concat(F.lit("C00C000100010000012C0004"), remote))
    dns = F.concat(_hex(k, 2), F.when(out, "0100").otherwise("8180"), F.lit("0001"), F.when(out, "0000").otherwise("0001"), F.lit("00000000"), question, answer)
    udp = F.concat(ends(hport, rport), _hex(8 + F.length(dns) / 2, 2), F.lit("0000"), dns)
    icmp = F.concat(F.when(k % 3 == 0, "0800").when(k % 3 == 1, F.concat(F.lit("03"), _hex(k % 4, 1))).otherwise("0B00"), F.lit("000000000000"))
    inner = F.when(view, udp).when(signup, icmp).otherwise(tcp)
    proto = F.when(view, "11").when(signup, "01").otherwise("06")
    ip = F.concat(F.lit("0800" "4500"), _hex(20 + F.length(inner) / 2, 2), _hex(n % 65536, 2), F.lit("400040"), proto, F.lit("0000"), ends(host, remote), inner)
    arp = F.concat(F.lit("0806" "0001080006040001" "020000000002"), host, F.lit("000000000000"), remote)
    data = F.unhex(F.concat(F.lit("020000000001020000000002"), F.when(signup & (n % 2 == 0), arp).otherwise(ip)))
    rows = r.select(n.alias("number"), "ts", data.alias("data"))
    return rows.select("number", "ts", F.length("data").cast("long").alias("wire_len"), "data", F.lit(1).alias("linktype"))


#: The same facts in DuckDB, straight from ``events`` without any bytes: CTEs ``b`` and ``p``.
PACKETS_SQL = r"""
b AS (SELECT event_id AS n, ts, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, event_type AS e FROM events),
q AS (
  SELECT *, CASE WHEN e = 'view' THEN n % 2 = 0 ELSE n % 3 <> 0 END AS o, e = 'signup' AND n % 2 = 0 AS is_arp, e = 'signup' AND n % 2 = 1 AS is_icmp, e = 'view' AS is_udp, e IN ('click', 'purchase', 'error') AS is_tcp,
    '10.0.' || (u // 256) || '.' || (u % 256) AS host, '93.184.216.' || (k % 4 + 1) AS remote, 50000 + u % 15000 AS hport, CASE WHEN e = 'view' THEN 53 WHEN k % 4 = 3 THEN 80 ELSE 443 END AS rport,
    e = 'click' AND v % 8 = 0 AS is_syn, 'd' || (k % 13) || '.example.com' AS qname
  FROM b),
p AS (
  SELECT n AS number, ts, (epoch_us(ts) // 1000) AS ms, epoch_us(ts) AS us, u, k, v, e, o, is_arp, is_icmp, is_udp, is_tcp, is_syn, host, remote, hport, rport, qname,
    CASE WHEN o OR is_arp THEN host ELSE remote END AS src, CASE WHEN o OR is_arp THEN remote ELSE host END AS dst, CASE WHEN o THEN hport ELSE rport END AS sport, CASE WHEN o THEN rport ELSE hport END AS dport,
    1000 + 64 * (n + 3000 * ((k // 4) % 2)) AS seq, 1000 + 64 * n AS ack,
    CASE WHEN is_syn AND o THEN '[SYN]' WHEN is_syn THEN '[SYN, ACK]' WHEN e <> 'error' THEN '[ACK, PSH]' WHEN (k // 4) % 2 = 1 THEN '[RST]' ELSE '[ACK, FIN]' END AS flags,
    is_tcp AND e = 'error' AND (k // 4) % 2 = 1 AS rst, is_tcp AND e = 'error' AND (k // 4) % 2 = 0 AS fin,
    CASE WHEN e = 'purchase' AND o THEN length('GET /item/' || k || ' HTTP/1.1  Host: shop' || (k % 7) || '.example.com  ') + CASE WHEN k % 10 = 0 THEN 27 ELSE 0 END + 2
         WHEN e = 'purchase' THEN length('HTTP/1.1 200 OK  Content-Length: ' || v) + 4 WHEN e = 'click' AND NOT is_syn THEN v % 64 ELSE 0 END AS plen,
    12 + length(qname) + 2 + 4 + CASE WHEN o THEN 0 ELSE 16 END AS dnslen
  FROM q),
w AS (SELECT *, CASE WHEN is_arp OR is_icmp THEN 42 WHEN is_udp THEN 42 + dnslen ELSE 54 + plen END AS wire_len FROM p)
""".strip()


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated packet observations out of ``events`` and ``nation``: the input of the alert engine."""
    r = numbers(table(spark, sf_dir, "events"))
    n, u, k, v = (F.col(c) for c in "nukv")
    s = lambda c: c.cast("string")
    app = u % 20
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("_nn"))
    r = r.join(F.broadcast(nation), (k % 25) == F.col("_nk"), "left")  # 25 rows
    known = k % 25 != 24
    name = F.when(k % 3 != 0, F.concat(F.lit("h"), s(k % 7), F.lit(".site"), s(u % 9), F.when(u % 2 == 0, ".co.uk").otherwise(".com")))
    identity = F.when(
        (n % 4 == 0) & known,
        F.struct(
            F.when(app % 2 == 0, "MacCodesign").otherwise("Sha256").alias("kind"), F.concat(F.lit("h"), s((F.floor(n / 500) + app) % 7)).alias("value"), F.lit("com.app").alias("signing_id"),
            F.when(F.floor(n / 2000) % 2 == 1, "T1").otherwise("T0").alias("team_id"), F.lit(None).cast("string").alias("authority"), F.when(n % 12 == 0, "AdHoc").otherwise("Valid").alias("status"),
        ),
    )
    outbound = n % 3 != 0
    size = v * 100 + F.when(n % 97 == 0, 200_000).otherwise(0)
    return r.select(
        n.alias("seq"), F.unix_millis("ts").alias("ts_ms"), F.when(known, F.concat(F.lit("/bin/app"), s(app))).alias("exe"), F.when(known, F.concat(F.lit("app"), s(app))).alias("proc_name"), F.when(known, app + 100).alias("pid"),
        F.concat(F.lit("93.184."), s(k % 10), F.lit("."), s(u % 50)).alias("dest_ip"), F.when(k % 4 == 3, 80).otherwise(443).alias("dest_port"), (50000 + u % 15000).cast("int").alias("local_port"), F.lit(6).alias("protocol"),
        name.alias("name"), F.when(k % 5 != 0, F.col("_nn")).alias("country"), F.when(k % 4 == 0, 1000 + k).cast("long").alias("asn"), F.when(k % 8 == 0, F.concat(F.lit("ORG"), s(k % 6))).alias("as_org"),
        F.when(outbound, size).otherwise(0).cast("long").alias("bytes_up"), F.when(outbound, 0).otherwise(size).cast("long").alias("bytes_down"), outbound.alias("outbound"), identity.alias("identity"),
    )


#: The same in DuckDB, as CTE ``f``.
EVENTS_SQL = r"""
fb AS (SELECT event_id AS n, ts, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, user_id % 20 AS app FROM events),
f AS (
  SELECT n AS seq, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN k % 25 <> 24 THEN '/bin/app' || app END AS exe, CASE WHEN k % 25 <> 24 THEN 'app' || app END AS proc_name, CASE WHEN k % 25 <> 24 THEN app + 100 END AS pid,
    '93.184.' || (k % 10) || '.' || (u % 50) AS dest_ip, CASE WHEN k % 3 <> 0 THEN 'h' || (k % 7) || '.site' || (u % 9) || CASE WHEN u % 2 = 0 THEN '.co.uk' ELSE '.com' END END AS name,
    CASE WHEN k % 3 <> 0 THEN 'site' || (u % 9) || CASE WHEN u % 2 = 0 THEN '.co.uk' ELSE '.com' END END AS domain, CASE WHEN k % 5 <> 0 THEN n_name END AS country,
    CASE WHEN k % 4 = 0 THEN 1000 + k END AS asn, CASE WHEN k % 8 = 0 THEN 'ORG' || (k % 6) END AS as_org, n % 3 <> 0 AS outbound,
    CASE WHEN n % 3 <> 0 THEN v * 100 + CASE WHEN n % 97 = 0 THEN 200000 ELSE 0 END ELSE 0 END AS bytes_up, CASE WHEN n % 3 <> 0 THEN 0 ELSE v * 100 + CASE WHEN n % 97 = 0 THEN 200000 ELSE 0 END END AS bytes_down,
    n % 4 = 0 AND k % 25 <> 24 AS has_id, CASE WHEN app % 2 = 0 THEN 'MacCodesign' ELSE 'Sha256' END AS id_kind, 'h' || ((n // 500 + app) % 7) AS id_value, CASE WHEN (n // 2000) % 2 = 1 THEN 'T1' ELSE 'T0' END AS id_team,
    CASE WHEN n % 12 = 0 THEN 'AdHoc' ELSE 'Valid' END AS id_status
  FROM fb LEFT JOIN nation ON n_nationkey = k % 25),
ids AS (SELECT exe, row_number() OVER (ORDER BY min(seq)) AS process_id FROM f WHERE exe IS NOT NULL GROUP BY exe),
dids AS (SELECT dest_ip, row_number() OVER (ORDER BY min(seq)) AS dest_id FROM f GROUP BY dest_ip)
""".strip()
