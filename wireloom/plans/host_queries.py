"""Registered queries over what a host tells, the small texts and codes, the request interface, the store, and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Monitor
from ..functions import text
from ..functions.bytes import ip_text, serial_less
from ..operators import alerts, correlate, diff, flows, stats, store
from ..session import new_path
from ..sources import host
from ..streaming import stateful
from . import views
from .queries import _FLOWVIEW, _LIVE, _LOUD, _START, _VOLUME, CONFIG, SQL, E, P, R, _captures, _connections, _notes, _novel, _packets, query

#: An engine that learns for an hour, so that programs appear after it has learned.
EARLY = alerts.AlertConfig(learn_ms=3_600_000, volume_interval_ms=3_600_000, volume_z=2.0, volume_floor=100_000, cooldown_ms=86_400_000)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))


def _str(c: Column) -> Column:
    return c.cast("string")


def _k() -> Column:
    return F.col("k")


# --- what a host's tools print -----------------------------------------------

_HOST = "'10.0.' || (k // 256 % 256) || '.' || (k % 256)"
_C = "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) "


def _quad() -> Column:
    return F.concat(F.lit("10.0."), _str(F.floor(_k() / 256) % 256), F.lit("."), _str(_k() % 256))


@query(_C + f"SELECT k AS inode, CASE WHEN k % 2 = 0 THEN 17 ELSE 6 END AS protocol, {_HOST} AS addr, 1000 + k % 60000 AS port FROM c WHERE k % 10 <> 0", longs="protocol")
def socket_lines(spark, sf_dir):
    """Lines as the kernel's socket tables have them: addresses turned round, the first line a header, inode 0 a socket of nobody."""
    r = _customers(spark, sf_dir)
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    local = F.concat(byte(_k() % 256), byte(F.floor(_k() / 256) % 256), F.lit("000A:"), F.lpad(F.hex(1000 + _k() % 60000), 4, "0"))
    value = F.concat(F.lit("  "), _str(_k()), F.lit(": "), local, F.lit(" 00000000:0000 0A 00000000:00000000 00:00000000 00000000  1000        0 "), _str(F.when(_k() % 10 == 0, 0).otherwise(_k())), F.lit(" 1 0000 100 0 0 10 0"))
    lines = r.select(F.when(_k() % 2 == 0, "udp").otherwise("tcp").alias("file"), _k().alias("line_no"), value.alias("value"))
    lines = lines.unionByName(lines.limit(1).select("file", F.lit(0).cast("long").alias("line_no"), F.lit("  sl  local_address rem_address st").alias("value")))
    return host.proc_net(lines).select("inode", "protocol", ip_text(F.col("addr")).alias("addr"), "port")


@query(_C + f"SELECT k AS pid, CASE WHEN k % 3 = 0 THEN 17 ELSE 6 END AS protocol, CASE WHEN k % 4 = 0 THEN 'fe80::' || printf('%x', k % 65535 + 1) ELSE {_HOST} END AS addr, 1000 + k % 60000 AS port FROM c", longs="protocol")
def netstat_lines(spark, sf_dir):
    local = F.when(_k() % 4 == 0, F.concat(F.lit("[fe80::"), F.lower(F.hex(_k() % 65535 + 1)), F.lit("%12]:"))).otherwise(F.concat(_quad(), F.lit(":")))
    value = F.concat(F.when(_k() % 3 == 0, "  UDP    ").otherwise("  TCP    "), local, _str(1000 + _k() % 60000), F.lit("   *:*   "), F.when(_k() % 3 == 0, "").otherwise("LISTENING   "), _str(_k()))
    lines = _customers(spark, sf_dir).select(value.alias("value"))
    noise = lines.limit(1).select(F.lit("Active Connections").alias("value"))
    return host.netstat(lines.union(noise)).select("pid", "protocol", ip_text(F.col("addr")).alias("addr"), "port")


@query(_C + "SELECT k AS pid, 'app' || (k % 7) || '.exe' AS name FROM c")
def task_lines(spark, sf_dir):
    value = F.concat(F.lit('"app'), _str(_k() % 7), F.lit('.exe","'), _str(_k()), F.lit('","Console","1","10,000 _k()"'))
    return host.tasklist(_customers(spark, sf_dir).select(value.alias("value"))).select("pid", "name")


@query(_C + f"SELECT k AS pid, 'cmd' || (k % 9) AS name, 6 AS protocol, {_HOST} AS addr, 1000 + k % 60000 AS port FROM c WHERE k % 5 <> 0 UNION ALL SELECT k, 'cmd' || (k % 9), 17, '::1', 53 FROM c", longs="protocol port")
def open_file_lines(spark, sf_dir):
    """Tagged lines: a process, its command, a TCP and a UDP socket each; one in five has no address."""
    tcp = F.when(_k() % 5 == 0, "n*:*").otherwise(F.concat(F.lit("n"), _quad(), F.lit(":"), _str(1000 + _k() % 60000), F.lit("->1.1.1.1:443")))
    parts = F.array(F.concat(F.lit("p"), _str(_k())), F.concat(F.lit("ccmd"), _str(_k() % 9)), F.lit("f3"), F.lit("PTCP"), tcp, F.lit("f4"), F.lit("PUDP"), F.lit("n[::1]:53"), F.lit("f5"), F.lit("n10.9.9.9:1"))
    rows = _customers(spark, sf_dir).select(_k(), F.posexplode(parts).alias("i", "value"))
    lines = rows.select((_k() % 64).alias("snapshot"), (_k() * 16 + F.col("i")).alias("line_no"), "value")
    return host.lsof(lines).select("pid", "name", "protocol", ip_text(F.col("addr")).alias("addr"), "port")


@query(
    _C
    + """SELECT '/app/' || k AS path, 'MacCodesign' AS kind, 'hash' || k AS value, 'com.app' || (k % 11) AS signing_id, CASE WHEN k % 3 <> 0 THEN 'TEAM' || (k % 5) END AS team_id, 'First ' || (k % 4) AS authority,
    CASE WHEN k % 6 = 0 THEN 'AdHoc' WHEN k % 2 = 0 THEN 'Valid' ELSE 'Unsigned' END AS status FROM c"""
)
def signature_lines(spark, sf_dir):
    said = F.array(
        F.concat(F.lit("Identifier=com.app"), _str(_k() % 11)), F.when(_k() % 6 == 0, "Signature=adhoc").otherwise("Format=app"), F.concat(F.lit("Authority=First "), _str(_k() % 4)), F.lit("Authority=Root"),
        F.concat(F.lit("CDHash=hash"), _str(_k())), F.when(_k() % 3 == 0, "TeamIdentifier=not set").otherwise(F.concat(F.lit("TeamIdentifier=TEAM"), _str(_k() % 5))),
    )
    rows = _customers(spark, sf_dir).select(F.concat(F.lit("/app/"), _str(_k())).alias("path"), (_k() % 2 == 0).alias("success"), F.posexplode(said).alias("line_no", "value"))
    return host.codesign(rows)


@query(
    _C
    + f"""SELECT k AS id, CASE k % 4 WHEN 0 THEN {_HOST} WHEN 1 THEN '2001:db8::' || printf('%x', k % 65535 + 1) END AS addr, CASE WHEN k % 4 < 2 THEN 1 + k % 65535 END AS port FROM c"""
)
def endpoints(spark, sf_dir):
    port = _str(1 + _k() % 65535)
    shown = F.when(_k() % 4 == 0, F.concat(_quad(), F.lit(":"), port)).when(_k() % 4 == 1, F.concat(F.lit("[2001:db8::"), F.lower(F.hex(_k() % 65535 + 1)), F.lit("]:"), port)).when(_k() % 4 == 2, "*:*").otherwise(F.concat(_quad(), F.lit(":99999")))
    ip, at = host.endpoint(F.col("shown"))
    return _customers(spark, sf_dir).select(_k().alias("id"), shown.alias("shown")).select("id", ip_text(ip).alias("addr"), at.cast("long").alias("port"))


@query(
    """WITH s AS (SELECT o_orderdate AS ts, o_custkey % 50 AS port, max(o_orderkey) AS pid FROM orders WHERE o_custkey % 50 < 25 GROUP BY ALL), e AS (SELECT event_id, ts + INTERVAL 0 DAY AS ts, user_id % 50 AS sp, event_id % 50 AS dp FROM events),
    o AS (SELECT e.*, s.pid AS p1 FROM e ASOF LEFT JOIN s ON e.sp = s.port AND e.ts >= s.ts)
    SELECT event_id AS number, coalesce(p1, s.pid) AS pid, 'p' || coalesce(p1, s.pid) AS process FROM o ASOF LEFT JOIN s ON o.dp = s.port AND o.ts >= s.ts"""
)
def foreground_owner(spark, sf_dir):
    """The process at the source address by source port, else by destination port."""
    addr = F.unhex(F.lit("0A000001"))
    seen = views.table(spark, sf_dir, "orders").filter("o_custkey % 50 < 25").groupBy(F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("int").alias("port")).agg(F.max("o_orderkey").alias("pid"))
    sockets = seen.select("ts", F.lit(6).alias("protocol"), addr.alias("addr"), "port", "pid", F.concat(F.lit("p"), F.col("pid").cast("string")).alias("name"), F.lit(None).cast("string").alias("exe_path"))
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), "ts", addr.alias("src_ip"), (F.col("user_id") % 50).cast("int").alias("src_port"), (F.col("event_id") % 50).cast("int").alias("dst_port"), F.lit(6).alias("protocol"))
    return correlate.source_owner(rows, sockets).select("number", "pid", "process")


# --- texts and codes -----------------------------------------------------------


@query("SELECT event_id AS id, strftime(ts, '%H:%M:%S.%g') AS clock, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS day FROM events")
def clock_texts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.clock(at).alias("clock"), text.day_and_time(F.unix_millis(at)).alias("day"))


@query("SELECT page_id AS id, left(url, 70) AS wide, left(url, 50) AS narrow FROM pages")
def cut_texts(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.shortened(F.col("url"), 70).alias("wide"), text.shortened(F.col("url"), 50).alias("narrow"))


@query("SELECT p_partkey AS id, regexp_replace(replace(p_name || chr(13) || chr(10) || chr(9) || chr(7) || p_name, chr(13), ' '), '[^\\x20-\\x7E\\n\\t]', '.', 'g') AS shown FROM part", longs="id")
def printable_texts(spark, sf_dir):
    shown = F.concat(F.col("p_name"), F.lit("\r\n\t\x07"), F.col("p_name"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.printable(shown.cast("binary")).alias("shown"))


@query("WITH s AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 AS a, (user_id * 40503 * 65537) % 4294967296 AS b FROM events) SELECT id, a < b AND b - a <= 2147483648 OR a > b AND a - b > 2147483648 AS less FROM s WHERE abs(a - b) <> 2147483648")
def serial_order(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), (F.col("event_id").cast("long") * 2654435761 % (1 << 32)).alias("a"), (F.col("user_id").cast("long") * 40503 * 65537 % (1 << 32)).alias("b"))
    return rows.filter(F.abs(F.col("a") - F.col("b")) != 1 << 31).select("id", serial_less(F.col("a"), F.col("b")).alias("less"))


_CODES = "WITH c AS (SELECT c_custkey AS id, ['new_process_dest', 'new_process_egress', 'new_geo', 'volume_spike', 'identity_change', 'odd'][c_custkey % 6 + 1] AS k, ['info', 'notice', 'warning', 'critical', 'loud'][c_custkey % 5 + 1] AS s, ['MacCodesign', 'Sha256', 'Pe'][c_custkey % 3 + 1] AS i, ['Valid', 'AdHoc', 'Unreadable', 'Broken'][c_custkey % 4 + 1] AS t FROM customer) "


@query(_CODES + "SELECT id, CASE WHEN k = 'odd' THEN 'new_process_dest' ELSE k END AS kind, CASE WHEN s = 'loud' THEN 'info' ELSE s END AS severity, CASE s WHEN 'notice' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END AS rank, CASE WHEN i = 'Pe' THEN 'Unknown' ELSE i END AS identity, CASE WHEN t = 'Broken' THEN 'Unsigned' ELSE t END AS status FROM c", longs="id rank")
def stored_codes(spark, sf_dir):
    """Codes as they are read back: unknown text is the first of its kind."""
    k = F.col("c_custkey")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    kind, severity = pick(*alerts.KINDS, "odd"), pick(*alerts.SEVERITIES, "loud")
    who, status = alerts.stored_identity(pick("MacCodesign", "Sha256", "Pe"), pick("Valid", "AdHoc", "Unreadable", "Broken"))
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), alerts.stored_kind(kind).alias("kind"), alerts.stored_severity(severity).alias("severity"), text.severity_rank(severity).alias("rank"), who.alias("identity"), status.alias("status"))


@query(E + " SELECT seq, coalesce(exe, 'pid:' || seq) AS exe, coalesce(name, dest_ip) AS shown, seq % 3 = 0 AND exe IS NULL AS dark FROM f")
def program_names(spark, sf_dir):
    """The program's path, else its pid; the destination's name, else its address."""
    rows = views.flow_events(spark, sf_dir).withColumnRenamed("exe", "exe_path").withColumn("pid", F.col("seq"))
    return rows.select("seq", alerts.exe_of().alias("exe"), alerts.dest_label().alias("shown"), ((F.col("seq") % 3 == 0) & F.col("exe_path").isNull()).alias("dark"))


# --- flows and captures ----------------------------------------------------------


@query(R + "SELECT min(number) AS first_number, max(number) AS last_number, count(*) AS packets FROM an GROUP BY key, incarnation HAVING NOT bool_or(closes)")
def live_flows(spark, sf_dir):
    return flows.live(flows.flow_table(_notes(spark, sf_dir))).select("first_number", "last_number", (F.col("pkts_up") + F.col("pkts_down")).alias("packets"))


@query(
    """WITH a AS (SELECT event_id AS number, event_type || (user_id % 40) AS data FROM events), b AS (SELECT event_id AS number, event_type || (user_id % 50) AS data FROM events),
    x AS (SELECT 'a' AS side, number, row_number() OVER (PARTITION BY data ORDER BY number) AS rn, (SELECT count(*) FROM b WHERE b.data = a.data) AS other FROM a), y AS (SELECT 'b' AS side, number, row_number() OVER (PARTITION BY data ORDER BY number) AS rn, (SELECT count(*) FROM a WHERE a.data = b.data) AS other FROM b)
    (SELECT side, number FROM x WHERE rn > other ORDER BY number LIMIT 20) UNION ALL (SELECT side, number FROM y WHERE rn > other ORDER BY number LIMIT 20)"""
)
def diff_report(spark, sf_dir):
    """The first twenty differences of each side, as they are listed."""
    return diff.report(*_captures(spark, sf_dir))


@query(R + ", l AS (SELECT number, bool_or(closes) OVER (PARTITION BY key, incarnation) AS closed FROM an) SELECT count(*) FILTER (NOT closed) AS open_packets, count(*) FILTER (closed) AS closed_packets FROM l")
def live_count(spark, sf_dir):
    done = flows.flow_table(_notes(spark, sf_dir)).select("closed", (F.col("pkts_up") + F.col("pkts_down")).alias("n"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return done.agg(total(~F.col("closed")).alias("open_packets"), total(F.col("closed")).alias("closed_packets"))


# --- the engine, the store and the requests ----------------------------------------


@query(E + ", le AS (SELECT arg_min(ts_ms, seq) AS start_ms FROM f), ac AS (SELECT min(seq) AS active_from FROM f, le WHERE ts_ms >= start_ms + 3600000)" + _novel("exe") + f" SELECT seq, 'egress|' || exe AS dedup_key, 'warning' AS severity FROM nv WHERE rn = 1 AND {_LOUD}")
def first_egress_early(spark, sf_dir):
    """First outbound connections of programs that appear after an hour of learning."""
    return alerts.candidates(views.flow_events(spark, sf_dir), EARLY).filter("step = 1").select("seq", "dedup_key", "severity")


_LABELS = "coalesce(as_org, domain, dest_ip)"
_NV = "SELECT seq, {step} AS step, ts_ms, {key} AS dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY exe, {by} ORDER BY seq) AS rn FROM f JOIN ids USING (exe) WHERE exe IS NOT NULL {more}) WHERE rn = 1 AND outbound"


@query(
    E + _START + _VOLUME
    + ", zs AS (SELECT *, CASE WHEN std > 0 THEN (x - mean) / std WHEN x > mean THEN 'inf'::DOUBLE ELSE 0.0 END AS z FROM sm WHERE samples >= 8 AND floor(x) >= 100000)"
    + """, i0 AS (SELECT *, lag(id_value) OVER (PARTITION BY exe ORDER BY seq) AS pv FROM f WHERE has_id), i1 AS (SELECT exe, id_value AS v1, arg_min(id_team, seq) AS team1, arg_min(id_status, seq) AS status1 FROM f WHERE has_id GROUP BY ALL),
    mv AS (SELECT i0.* FROM i0 JOIN i1 ON i0.exe = i1.exe AND i0.pv = i1.v1 WHERE CASE WHEN id_kind = 'MacCodesign' THEN team1 <> id_team OR (status1 = 'Valid' AND id_status <> 'Valid') ELSE pv <> id_value OR (status1 = 'Valid' AND id_status <> 'Valid') END),
    ca AS (""" + _NV.format(step=1, key="'egress|' || exe", by="exe", more="") + " UNION ALL " + _NV.format(step=3, key=f"'dest|' || process_id || '|' || {_LABELS}", by=_LABELS, more="")
    + " UNION ALL " + _NV.format(step=4, key="'geo|' || process_id || '|cc|' || country", by="country", more="AND country IS NOT NULL") + " UNION ALL " + _NV.format(step=5, key="'geo|' || process_id || '|asn|' || asn", by="asn", more="AND asn IS NOT NULL")
    + """ UNION ALL SELECT seq, 2, ts_ms, 'identity|' || exe || '|' || id_value FROM mv WHERE outbound
      UNION ALL SELECT f.seq, 6, f.ts_ms, 'volume|' || process_id FROM zs JOIN f ON f.seq = zs.seq JOIN ids ON ids.exe = f.exe WHERE z >= 2.0),
    cn AS (SELECT ca.*, row_number() OVER (PARTITION BY dedup_key ORDER BY seq, step) AS k FROM ca, ac WHERE seq >= active_from),
    cr AS (SELECT seq, step, dedup_key, k, ts_ms AS last, TRUE AS kept FROM cn WHERE k = 1 UNION ALL SELECT cn.seq, cn.step, cn.dedup_key, cn.k, CASE WHEN cn.ts_ms - cr.last < 86400000 THEN cr.last ELSE greatest(cr.last, cn.ts_ms) END, cn.ts_ms - cr.last >= 86400000 FROM cr JOIN cn ON cn.dedup_key = cr.dedup_key AND cn.k = cr.k + 1)
    SELECT seq, step, dedup_key FROM cr WHERE kept""",
    longs="step",
)
def alerts_kept(spark, sf_dir):
    """All six signals through the cooldown: which alerts are raised."""
    return alerts.alerts(views.flow_events(spark, sf_dir), CONFIG).select("seq", "step", "dedup_key")


@query(E + _VOLUME + ", vl AS (SELECT exe, max(rn) AS rn FROM vs GROUP BY exe) SELECT process_id, mean AS ewma_mean, var AS ewma_var, acc AS interval_acc, start_ms AS interval_start_ms, samples FROM vs JOIN vl USING (exe, rn) JOIN ids USING (exe)")
def volume_state(spark, sf_dir):
    return store.volumes(views.flow_events(spark, sf_dir), CONFIG)


def _asked(spark: SparkSession, sf_dir: str) -> Monitor:
    e = views.flow_events(spark, sf_dir)
    raised = views.numbers(views.table(spark, sf_dir, "events")).select(F.col("n").alias("id"), F.unix_millis("ts").alias("ts_ms"), F.col("e").alias("kind"))
    done = views.numbers(views.table(spark, sf_dir, "events")).select(F.col("n").alias("id"), F.col("u").cast("long").alias("process_id"), F.unix_millis("ts").alias("ts_start_ms"))
    tables = {"processes": store.processes(e).drop("identity"), "destinations": store.destinations(e), "process_dest_pairs": store.pairs(e), "alerts": raised.filter("kind = 'error'").drop("kind"), "connections": done}
    return Monitor(spark, tables, _connections(spark, sf_dir).withColumn("seq", F.col("seq")), config=CONFIG)


@query(E + _START + " SELECT 'active' AS baseline, start_ms + 604800000 AS learning_ends_ms, (SELECT count(*) FROM ids) AS processes, (SELECT count(*) FROM dids) AS destinations, (SELECT count(*) FROM events WHERE event_type = 'error') AS alerts, 1 AS schema_version FROM le, ac WHERE active_from IS NOT NULL", longs="schema_version")
def ask_status(spark, sf_dir):
    return _asked(spark, sf_dir).ask("status").select("baseline", "learning_ends_ms", "processes", "destinations", "alerts", "schema_version")


@query(E + _LIVE + " SELECT id, process, dest_name, bytes_up, bytes_down, last_seen FROM lc")
def ask_live(spark, sf_dir):
    return _asked(spark, sf_dir).ask("live_connections").select("id", "process", "dest_name", "bytes_up", "bytes_down", "last_seen")


@query(SQL["list_processes"])
def ask_processes(spark, sf_dir):
    return _asked(spark, sf_dir).ask("list_processes")


@query(SQL["dest_for_process"])
def ask_destinations(spark, sf_dir):
    return _asked(spark, sf_dir).ask("list_destinations", process_id=3).select("id", "ip", "first_seen_ms")


@query(SQL["process_history"])
def ask_history(spark, sf_dir):
    return _asked(spark, sf_dir).ask("process_history", process_id=3, since_ms=1704067200000, until_ms=1705276800000).select("id", "ts_start_ms")


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE event_type = 'error' ORDER BY 2 DESC, 1 DESC LIMIT 100")
def ask_alerts(spark, sf_dir):
    return _asked(spark, sf_dir).ask("recent_alerts", limit=100)


@query("SELECT event_id AS id, CAST(user_id AS BIGINT) AS process_id, (epoch_us(ts) // 1000) AS ts_start_ms FROM events ORDER BY 3 DESC, 1 DESC LIMIT 100")
def ask_connections(spark, sf_dir):
    return _asked(spark, sf_dir).ask("recent_connections", limit=100)


@query(SQL["list_processes"])
def store_round_trip(spark, sf_dir):
    """The table of programs as the store's folder gives it back."""
    folder = new_path(spark, "store")
    store.write({"processes": store.processes(views.flow_events(spark, sf_dir)).drop("identity")}, folder)
    return store.list_processes(store.open_store(spark, folder)["processes"])


@query("SELECT CAST(n_regionkey AS BIGINT) AS value, CASE WHEN n_regionkey = 1 THEN 'active' ELSE 'learning' END AS state FROM nation WHERE n_nationkey = 7")
def meta_values(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation")
    meta = nation.select(F.concat(F.lit("k"), _str(F.col("n_nationkey"))).alias("key"), _str(F.col("n_regionkey")).alias("value"))
    state = nation.filter("n_nationkey = 7").select(F.lit("baseline_state").alias("key"), F.when(F.col("n_regionkey") == 1, "active").otherwise("other").alias("value"))
    return store.meta_integer(meta, "k7").crossJoin(F.broadcast(store.baseline_state(state)))


# --- streams -------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame, over) -> DataFrame:
    """``over`` a stream of ``rows``, which are written first, in order, as the one file that a trigger takes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = new_path(spark, "source"), new_path(spark, "stream")
    rows.orderBy("seq").coalesce(1).write.parquet(source)
    made = over(spark.readStream.schema(rows.schema).parquet(source))
    stateful.to_tables(made, out, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query(SQL["alert_cooldown"])
def stream_cooldown(spark, sf_dir):
    """The cooldown as a stateful stream over all events."""
    rows = views.numbers(views.table(spark, sf_dir, "events"))
    none = F.lit(None).cast("string")
    found = rows.select(
        F.col("n").cast("long").alias("seq"), F.lit(1).alias("step"), none.alias("kind"), none.alias("severity"), F.unix_millis("ts").alias("ts_ms"), F.lit(0).cast("long").alias("process_id"), F.lit(0).cast("long").alias("dest_id"),
        F.concat("e", (F.col("u") % 7).cast("string")).alias("dedup_key"), none.alias("title"), none.alias("detail"),
    )
    return _streamed(spark, found, lambda s: stateful.emitted(s, CONFIG)).select("seq", "dedup_key")


@query(SQL["volume_samples"])
def stream_volume(spark, sf_dir):
    """The volume baseline as a stateful stream over all events."""
    rows = views.flow_events(spark, sf_dir).select("exe", F.col("seq").cast("long").alias("seq"), "ts_ms", "bytes_up")
    return _streamed(spark, rows, lambda s: stateful.volume_samples(s, CONFIG))


@query(P + f", fl AS ({_FLOWVIEW}) SELECT count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets FROM fl")
def flow_totals(spark, sf_dir):
    return stats.flow_view(_packets(spark, sf_dir, False, ("ipv4", "ipv6", "tcp", "udp"))).agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"))
