"""Stateful stream operators over the batch folds' transition functions.

A processor keeps one state a key and feeds it the rows of each micro-batch in
order.  Batches of a key must follow each other in number (T7): a capture
stream reads one file a trigger, and a row that comes with a lower number than
the last is an error, not a wrong answer.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import alerts, correlate, flows, reassembly
from ..operators.folds import Step
from ..session import ship


class OutOfOrder(ValueError):
    """A row with a lower number than one of its key before."""


class FoldProcessor(StatefulProcessor):
    """A fold's ``step`` over kept state; the state is pickled bytes and the last number."""

    def __init__(self, step: Step, order: str, columns: list[str]) -> None:
        self.step, self.order, self.columns = step, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("fold", "raw binary, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, last = None, None
        if self.kept.exists():
            raw, last = self.kept.get()
            state = pickle.loads(bytes(raw))
        found = sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: r[self.order])
        out: list[tuple] = []
        for row in found:
            if last is not None and row[self.order] < last:
                raise OutOfOrder(f"{self.order} {row[self.order]} after {last} of key {key!r}")
            last = row[self.order]
            state, new = self.step(state, {k: _plain(v) for k, v in row.items()})
            out += new
        self.kept.update((pickle.dumps(state), int(last) if last is not None else -1))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    """A value as the batch folds see it."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "item") and not isinstance(v, bytes | bytearray):
        return v.item()
    return bytes(v) if isinstance(v, bytearray) else v


def folded(rows: DataFrame, keys: list[str], order: str, step: Step, schema: str) -> DataFrame:
    """``step`` over a stream, by key; needs the RocksDB state store."""
    ship(rows.sparkSession)
    names = StructType.fromDDL(schema).names
    return rows.groupBy(*keys).transformWithStateInPandas(FoldProcessor(step, order, names), schema, "Append", "None")


def annotated(flow_rows: DataFrame) -> DataFrame:
    """:func:`wireloom.operators.flows.annotated` over a stream of flow packets."""
    rows = flow_rows.select(*flows.KEY, *flows._FACTS).withColumn("ts", F.col("ts").cast("timestamp"))
    # nullable numbers reach pandas as floats: absent TCP facts of UDP packets are 0 and false, which the step doesn't read
    for c, none in (("seq", 0), ("ack", 0), ("payload_len", 0), ("syn", False), ("ack_flag", False), ("fin", False), ("rst", False)):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(none)))
    return folded(rows, flows.KEY, "number", flows.packet_step, flows.ANNOTATED)


def closed_flows(flow_rows: DataFrame) -> DataFrame:
    """One row per flow that closes, as it closes (W1a): key, incarnation and the number of the closing packet."""
    return annotated(flow_rows).filter("closes").select(*flows.KEY, "incarnation", "number", "handshake_rtt_ms", "srtt_ms")


def volume_samples(events: DataFrame, config: alerts.AlertConfig) -> DataFrame:
    """:func:`wireloom.operators.alerts.volume_samples` over a stream of events."""
    rows = events.filter("exe is not null").select("exe", "seq", "ts_ms", "bytes_up")
    return folded(rows, ["exe"], "seq", alerts.volume_step(config), "exe string, seq long, x double, mean double, std double, samples long")


def first_step(row_columns: list[str]) -> Step:
    """Lets a key's first row through."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        return True, [] if state else [tuple(row[c] for c in row_columns)]

    return step


def firsts(events: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The first event of each key, over a stream; ``schema`` is the events' own."""
    names = StructType.fromDDL(schema).names
    return folded(events.select(*names), keys, "seq", first_step(names), schema)


def emitted(found: DataFrame, config: alerts.AlertConfig) -> DataFrame:
    """The cooldown over a stream of candidate alerts."""
    rows = found.select(*[x.split()[0] for x in alerts.ALERT.split(", ")])
    return folded(rows, ["dedup_key"], "seq", alerts.cooldown_step(config.cooldown_ms), alerts.ALERT)


def pair_step(state: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
    """A query waits for the response with its transaction id."""
    if not row["r"]:
        return (row["number"], row["us"]), []
    if state is None:
        return None, []
    return None, [(row["number"], state[0], max(0.0, (row["us"] - state[1]) / 1000.0), row["answers"])]


def dns_pairs(packets: DataFrame) -> DataFrame:
    """:func:`wireloom.operators.correlate.dns_pairs` over a stream of decoded packets."""
    rows = packets.filter("dns is not null").select(
        "number", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("dns.transaction_id").alias("txid"), F.col("dns.is_response").alias("r"), F.coalesce(correlate.answer_text(F.col("dns.answers")), F.lit("")).alias("answers")
    )
    return folded(rows, ["txid"], "number", pair_step, "number long, query_number long, rtt_ms double, answers string")


def reassembled(parts: DataFrame) -> DataFrame:
    """Newly contiguous bytes of each direction, drained as they come."""

    def step(state: reassembly.Stream | None, row: dict) -> tuple[reassembly.Stream, list[tuple]]:
        state = state or reassembly.Stream()
        state.insert(row["seq"], row["data"])
        new = state.drain()
        return state, [] if new is None else [(*(row[k] for k in keys), row["number"], new)]

    keys = [*flows.KEY, "low_to_high"]
    schema = "low_ip binary, low_port int, high_ip binary, high_port int, protocol int, low_to_high boolean, number long, bytes binary"
    return folded(parts.select(*keys, "number", "seq", "data"), keys, "number", step, schema)


def to_tables(stream: DataFrame, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that appends every micro-batch to a folder and hands it to ``each``.

    The trigger takes what is there and stops; open state stays in the
    checkpoint for the next start (T9).
    """

    def write(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        kept.write.mode("append").parquet(folder)
        if each:
            each(kept, n)
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def heartbeats(query) -> Iterable[dict]:
    """Progress of a running query, in place of idle heartbeats."""
    return [{"ts": p["timestamp"], "rows": p["numInputRows"]} for p in query.recentProgress]
