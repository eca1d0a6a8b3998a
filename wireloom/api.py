"""The request interface: what a client of the monitor asks for, as DataFrames and as wire lines."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import store
from .operators.alerts import AlertConfig, alerts, learning
from .operators.stats import live_connections


class BadRequest(ValueError):
    """A line that is no request."""


# Request types with the fields that they need.
REQUESTS = {
    "status": (), "live_connections": (), "list_processes": (), "list_destinations": ("process_id",), "process_history": ("process_id", "since_ms", "until_ms"), "recent_alerts": ("limit",),
    "recent_connections": ("limit",), "subscribe": (), "stop": (),
}
# How answers are tagged.
ANSWERS = {"live_connections": "connections", "list_processes": "processes", "list_destinations": "destinations", "process_history": "history", "recent_alerts": "alerts", "recent_connections": "history"}


def parse_request(line: str) -> tuple[str, dict[str, int]]:
    """(type, fields) of a request line."""
    try:
        got = json.loads(line)
    except json.JSONDecodeError as e:
        raise BadRequest(str(e)) from e
    kind = got.get("type") if isinstance(got, dict) else None
    if kind not in REQUESTS:
        raise BadRequest(f"unknown request {kind!r}")
    out = {}
    for f in REQUESTS[kind]:
        if not isinstance(got.get(f), int) or isinstance(got.get(f), bool) or (f == "limit" and got[f] < 0):
            raise BadRequest(f"{kind} needs a number {f}")
        out[f] = got[f]
    return kind, out


def monitored(events: DataFrame, flows: DataFrame | None = None, flow_events: DataFrame | None = None, config: AlertConfig = AlertConfig()) -> dict[str, DataFrame]:
    """The store's tables out of events (and out of flows and their events, if there are any)."""
    raised = alerts(events, config)
    out = {
        "processes": store.processes(events).drop("identity"), "binary_identities": store.identities(events), "destinations": store.destinations(events), "name_resolutions": store.name_resolutions(events),
        "process_dest_pairs": store.pairs(events), "process_countries": store.countries(events), "process_asns": store.networks(events), "process_labels": store.labels(events), "volume_stats": store.volumes(events, config),
        "alerts": raised.select((F.col("seq") * 8 + F.col("step")).alias("id"), "kind", "severity", "ts_ms", "process_id", "dest_id", "dedup_key", "title", F.col("detail").alias("detail_json")),
    }
    if flows is not None and flow_events is not None:
        out["connections"] = store.connections(flows, flow_events)
    return out


@dataclass
class Monitor:
    """Answers requests over the store's tables and the live connections.

    ``events`` (optional) are flow events with a connection ``id`` for the live view, ``closed``
    the ids that have closed.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    events: DataFrame | None = None
    closed: DataFrame | None = None
    config: AlertConfig = AlertConfig()
    interface: str = "files"
    started: float = field(default_factory=time.time)
    stopping: bool = False

    def _table(self, name: str) -> DataFrame:
        return self.tables.get(name) if name in self.tables else self.spark.createDataFrame([], store.TABLES[name])

    def status(self) -> DataFrame:
        """One row: counts, the baseline's state and when learning ends."""
        counts = store.counts(self._table("processes"), self._table("destinations"), self._table("alerts"))
        if self.events is None:
            state = self.spark.createDataFrame([("learning", None)], "baseline string, learning_ends_ms long")
        else:
            over = F.when(F.col("active_from").isNotNull(), "active").otherwise("learning")
            state = learning(self.events, self.config).select(over.alias("baseline"), F.col("end_ms").alias("learning_ends_ms"))
        fixed = [F.lit(os.getpid()).cast("long").alias("pid"), F.lit(int(time.time() - self.started)).cast("long").alias("uptime_secs"), F.lit(self.interface).alias("interface")]
        tail = [F.lit(store.SCHEMA_VERSION).alias("schema_version"), F.lit(__version__).alias("version")]
        return state.crossJoin(counts).select(*fixed, "baseline", "learning_ends_ms", "processes", "destinations", "alerts", *tail)

    def live(self) -> DataFrame:
        """Connections that haven't closed, last seen first."""
        if self.events is None:
            return self.spark.createDataFrame([], "id long, process string, last_seen long")
        rows = live_connections(self.events)
        if self.closed is not None:
            rows = rows.join(self.closed.select("id").distinct(), "id", "left_anti")
        return rows.orderBy(F.desc("last_seen"), "id")

    def ask(self, kind: str, **fields: int) -> DataFrame:
        """The rows that answer a request (subscribe and stop have none)."""
        t = self._table
        answers: dict[str, Callable[[], DataFrame]] = {
            "status": self.status,
            "live_connections": self.live,
            "list_processes": lambda: store.list_processes(t("processes")),
            "list_destinations": lambda: store.destinations_of(fields["process_id"], t("process_dest_pairs"), t("destinations")),
            "process_history": lambda: store.process_history(t("connections"), fields["process_id"], fields["since_ms"], fields["until_ms"]),
            "recent_alerts": lambda: store.recent_alerts(t("alerts"), fields["limit"]),
            "recent_connections": lambda: store.recent_connections(t("connections"), fields["limit"]),
        }
        if kind not in answers:
            raise BadRequest(f"{kind} has no rows")
        return answers[kind]()

    def answer(self, line: str) -> str:
        """The answer line to a request line; a bad line gets an error and nothing else happens."""
        try:
            kind, fields = parse_request(line)
        except BadRequest as e:
            return json.dumps({"type": "error", "data": {"message": str(e)}})
        if kind == "subscribe":
            return json.dumps({"type": "subscribed"})
        if kind == "stop":
            self.stopping = True
            return json.dumps({"type": "stopping"})
        rows = [json.loads(r[0]) for r in self.ask(kind, **fields).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        return json.dumps({"type": kind, "data": rows[0]} if kind == "status" else {"type": ANSWERS[kind], "data": rows})

    def document(self, limit: int = 200) -> str:
        """Status, connections and recent alerts as one indented document (Q15)."""
        part = lambda line: json.loads(self.answer(line))["data"]
        ask = {"status": '{"type":"status"}', "connections": '{"type":"live_connections"}', "alerts": json.dumps({"type": "recent_alerts", "limit": limit})}
        return json.dumps({k: part(v) for k, v in ask.items()}, indent=2)

    def serve(self, lines: Iterator[str]) -> Iterator[str]:
        """Answers until a stop is asked for."""
        for line in lines:
            if line.strip():
                yield self.answer(line)
            if self.stopping:
                return


def event_line(kind: str, row: dict) -> str:
    """A pushed event: a flow, a closed id, an alert or a heartbeat, tagged inline."""
    if kind not in ("flow", "closed", "alert", "heartbeat"):
        raise BadRequest(f"no such event: {kind!r}")
    return json.dumps({"type": kind, **row})


def notifier(out: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A callable for ``foreachBatch`` that says each alert of a batch in order.

    Alerts are few by their cooldown; they reach the driver one partition at a time.
    """

    def tell(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("seq", "step").toLocalIterator():
            out(f"[{r['severity']}] {r['title']}")

    return tell


def open_monitor(spark: SparkSession, folder: str | Path, **kwargs) -> Monitor:
    """A monitor over a stored folder."""
    return Monitor(spark, store.open_store(spark, str(folder)), **kwargs)
