"""The store's tables, derived from events, and the fixed statements over them.

Nothing is updated in place: a table is what its upserts would have left, as an
aggregate over the events.  Ids are numbers of first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import AlertConfig, destination_ids, process_ids, stable_label, volume_state
from .flows import KEY

SCHEMA_VERSION = 1
#: The tables and their columns (Q5).
TABLES = {
    "meta": "key string, value string",
    "processes": "id long, exe_path string, name string, first_seen_ms long, last_seen_ms long, cur_identity_id long",
    "binary_identities": "id long, process_id long, kind string, value string, signing_id string, team_id string, authority string, status string, first_seen_ms long",
    "destinations": "id long, ip string, best_name string, asn long, as_org string, country string, first_seen_ms long, last_seen_ms long",
    "name_resolutions": "ip string, name string, source string, seen_ms long",
    "process_dest_pairs": "process_id long, dest_id long, first_seen_ms long, last_seen_ms long, conn_count long",
    "process_countries": "process_id long, country string, first_seen_ms long",
    "process_asns": "process_id long, asn long, as_org string, first_seen_ms long",
    "process_labels": "process_id long, label string, first_seen_ms long",
    "volume_stats": "process_id long, ewma_mean double, ewma_var double, interval_acc double, interval_start_ms long, samples long",
    "connections": "id long, process_id long, dest_id long, proto int, local_port int, remote_port int, bytes_up long, bytes_down long, name string, ts_start_ms long, ts_end_ms long",
    "alerts": "id long, kind string, severity string, ts_ms long, process_id long, dest_id long, dedup_key string, title string, detail_json string",
}


def _first(c: str) -> Column:
    return F.min_by(c, "seq")


def _last(c: str) -> Column:
    return F.max_by(c, "seq")


def _known(c: str) -> Column:
    """The last value that isn't null: what an upsert with COALESCE leaves."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))


def processes(events: DataFrame) -> DataFrame:
    """One row per program (U3): first and last time, the last name, and its current identity."""
    rows = events.filter("exe is not null").groupBy("exe").agg(_last("proc_name").alias("name"), _first("ts_ms").alias("first_seen_ms"), _last("ts_ms").alias("last_seen_ms"), _known("identity").alias("identity"))
    return rows.join(process_ids(events), "exe").select(F.col("process_id").alias("id"), F.col("exe").alias("exe_path"), "name", "first_seen_ms", "last_seen_ms", "identity")


def identities(events: DataFrame) -> DataFrame:
    """One row per program, kind and value, with what it was first seen with."""
    rows = events.filter("exe is not null and identity is not null").groupBy("exe", F.col("identity.kind").alias("kind"), F.col("identity.value").alias("value")).agg(_first("identity").alias("i"), _first("ts_ms").alias("first_seen_ms"))
    return rows.join(process_ids(events), "exe").select("process_id", "kind", "value", "i.signing_id", "i.team_id", "i.authority", "i.status", "first_seen_ms")


def current_identity(events: DataFrame) -> DataFrame:
    """Each program's current identity: its last (kind, value), with the attributes stored first."""
    now = processes(events).filter("identity is not null").select(F.col("id").alias("process_id"), F.col("identity.kind").alias("kind"), F.col("identity.value").alias("value"))
    return now.join(identities(events), ["process_id", "kind", "value"])


def destinations(events: DataFrame) -> DataFrame:
    """One row per address; name and place are the last known ones."""
    rows = events.groupBy("dest_ip").agg(_known("name").alias("best_name"), _known("asn").alias("asn"), _known("as_org").alias("as_org"), _known("country").alias("country"), _first("ts_ms").alias("first_seen_ms"), _last("ts_ms").alias("last_seen_ms"))
    return rows.join(destination_ids(events), "dest_ip").select(F.col("dest_id").alias("id"), F.col("dest_ip").alias("ip"), "best_name", "asn", "as_org", "country", "first_seen_ms", "last_seen_ms")


def name_resolutions(events: DataFrame, source: str = "obs") -> DataFrame:
    """Every name that an address had, once, with the first time."""
    return events.filter("name is not null").groupBy(F.col("dest_ip").alias("ip"), "name").agg(_first("ts_ms").alias("seen_ms")).withColumn("source", F.lit(source))


def pairs(events: DataFrame) -> DataFrame:
    """Programs and addresses; ``conn_count`` counts the events, that is packets."""
    rows = events.filter("exe is not null").groupBy("exe", "dest_ip").agg(_first("ts_ms").alias("first_seen_ms"), _last("ts_ms").alias("last_seen_ms"), F.count("*").alias("conn_count"))
    return rows.join(process_ids(events), "exe").join(destination_ids(events), "dest_ip").select("process_id", "dest_id", "first_seen_ms", "last_seen_ms", "conn_count")


def _novel(events: DataFrame, key: Column, name: str, *more: Column) -> DataFrame:
    rows = events.filter("exe is not null").withColumn("_k", key).filter("_k is not null")
    rows = rows.groupBy("exe", "_k").agg(*more, _first("ts_ms").alias("first_seen_ms"))
    return rows.join(process_ids(events), "exe").withColumnRenamed("_k", name).drop("exe")


def countries(events: DataFrame) -> DataFrame:
    """(process_id, country, first_seen_ms)."""
    return _novel(events, F.col("country"), "country")


def networks(events: DataFrame) -> DataFrame:
    """(process_id, asn, as_org, first_seen_ms); the organisation is the first row's."""
    return _novel(events, F.col("asn"), "asn", _first("as_org").alias("as_org"))


def labels(events: DataFrame) -> DataFrame:
    """(process_id, label, first_seen_ms)."""
    return _novel(events, stable_label(), "label")


def volumes(events: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The state of every program's volume baseline (Q2)."""
    return volume_state(events, config).join(process_ids(events), "exe").drop("exe")


def connections(flows: DataFrame, events: DataFrame) -> DataFrame:
    """Closed flows with the process, the destination and the name of their last event.

    ``events`` carry the flow key and incarnation.  The name is the last known
    one; the address stands in.
    """
    keys = [*KEY, "incarnation"]
    last = events.groupBy(*keys).agg(_last("exe").alias("exe"), _last("dest_ip").alias("dest_ip"), F.coalesce(_known("name"), _first("dest_ip")).alias("name"))
    last = last.join(process_ids(events), "exe", "left").join(destination_ids(events), "dest_ip", "left")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    same = F.lit(True)
    done = flows.filter("closed")
    for k in keys:
        same = same & (done[k] == last[k])
    out = done.join(last, same, "left")
    return out.select(
        F.col("last_number").alias("id"), "process_id", "dest_id", done["protocol"].alias("proto"),
        "local_port", "remote_port", "bytes_up", "bytes_down", "name", ms("first_seen").alias("ts_start_ms"), ms("last_seen").alias("ts_end_ms"),
    )


def list_processes(table: DataFrame) -> DataFrame:
    """Programs, last seen first (O1)."""
    return table.orderBy(F.desc("last_seen_ms"), "id")


def destinations_of(process_id: int, pair_table: DataFrame, dest_table: DataFrame) -> DataFrame:
    """A program's destinations, newest contact first."""
    mine = pair_table.filter(F.col("process_id") == process_id).select("dest_id", F.col("last_seen_ms").alias("_last"))
    return dest_table.join(mine, dest_table["id"] == mine["dest_id"]).drop("dest_id").orderBy(F.desc("_last"), "id").drop("_last")


def recent_alerts(table: DataFrame, limit: int) -> DataFrame:
    """The newest alerts (O2)."""
    return table.orderBy(F.desc("ts_ms"), F.desc("id")).limit(limit)


def process_history(table: DataFrame, process_id: int, since_ms: int, until_ms: int) -> DataFrame:
    """A program's connections that started in a range, both ends included, newest first."""
    return table.filter((F.col("process_id") == process_id) & F.col("ts_start_ms").between(since_ms, until_ms)).orderBy(F.desc("ts_start_ms"), F.desc("id"))


def recent_connections(table: DataFrame, limit: int) -> DataFrame:
    """The connections that started last."""
    return table.orderBy(F.desc("ts_start_ms"), F.desc("id")).limit(limit)


def counts(process_table: DataFrame, dest_table: DataFrame, alert_table: DataFrame) -> DataFrame:
    """(processes, destinations, alerts) (A10)."""
    one = lambda t, n: t.agg(F.count("*").alias(n))
    return one(process_table, "processes").crossJoin(one(dest_table, "destinations")).crossJoin(one(alert_table, "alerts"))


def latest_alert(table: DataFrame, dedup_key: str) -> DataFrame:
    """(ts_ms): when an alert of this key was last raised, null if never."""
    return table.filter(F.col("dedup_key") == dedup_key).agg(F.max("ts_ms").alias("ts_ms"))


def retained(table: DataFrame, before_ms: int, column: str) -> DataFrame:
    """What is left when rows from before a time are deleted (U4)."""
    return table.filter(F.col(column) >= before_ms)


def meta_integer(meta: DataFrame, key: str) -> DataFrame:
    """(value) of a meta key as a number; null if it isn't there or isn't one (Q1)."""
    return meta.filter(F.col("key") == key).agg(F.max(F.expr("try_cast(value as long)")).alias("value"))


def baseline_state(meta: DataFrame) -> DataFrame:
    """(state): ``active`` or, for any other text or none, ``learning`` (Q1)."""
    return meta.filter("key = 'baseline_state'").agg(F.when(F.max("value") == "active", "active").otherwise("learning").alias("state"))


def write(tables: dict[str, DataFrame], folder: str, append: tuple[str, ...] = ("connections", "alerts")) -> None:
    """The tables as Parquet (K14): logs are appended to, derived tables written anew.

    Parquet's own statistics and the sort below stand in for the store's indexes.
    """
    sort = {"connections": "ts_start_ms", "alerts": "ts_ms"}
    for name, df in tables.items():
        out = df.sortWithinPartitions(sort[name]) if name in sort else df
        out.write.mode("append" if name in append else "overwrite").parquet(f"{folder}/{name}")


def open_store(spark, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder that are there; the others are empty."""
    out = {}
    for name, schema in TABLES.items():
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            out[name] = spark.createDataFrame([], schema)
    return out
