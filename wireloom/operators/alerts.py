"""The alert engine: five signals over flow events, behind a learned baseline.

An event is (seq, ts_ms, exe, proc_name, pid, dest_ip, dest_port, local_port, protocol,
name, country, asn, as_org, bytes_up, bytes_down, outbound, identity), with ``identity`` a
struct (kind, value, signing_id, team_id, authority, status) or null.  First-seen
signals are one aggregate (the event with the lowest number per key), not windows,
so a busy process is combined before the exchange; only the volume baseline
and the cooldown are ordered folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import registrable_domain
from .folds import fold

# Kinds and severities as they are stored, and how they are shown.
KINDS = {"new_process_dest": "New destination", "new_process_egress": "New process", "new_geo": "New country/ASN", "volume_spike": "Volume spike", "identity_change": "Program modified"}
SEVERITIES = ("info", "notice", "warning", "critical")


@dataclass(frozen=True)
class AlertConfig:
    """What the engine learns and when it speaks (L9); times in milliseconds."""

    learn_ms: int = 7 * 86_400_000
    volume_interval_ms: int = 60_000
    volume_alpha: float = 0.3
    volume_z: float = 4.0
    volume_floor: int = 5 * 1024 * 1024
    volume_min_samples: int = 8
    cooldown_ms: int = 3_600_000
    flag_signed_updates: bool = False

    @classmethod
    def demo(cls) -> AlertConfig:
        """Five seconds of learning."""
        return cls(learn_ms=5000)


def stored_kind(kind: Column) -> Column:
    """A kind as read back: unknown text is ``new_process_dest``."""
    return F.when(kind.isin(*KINDS), kind).otherwise("new_process_dest")


def stored_severity(severity: Column) -> Column:
    """A severity as read back: unknown text is ``info``."""
    return F.when(severity.isin(*SEVERITIES), severity).otherwise("info")


def stored_identity(kind: Column, status: Column) -> tuple[Column, Column]:
    """Identity kind and status as read back: unknown ones are Unknown and Unsigned (Q4)."""
    return F.when(kind.isin("MacCodesign", "Sha256"), kind).otherwise("Unknown"), F.when(status.isin("Valid", "AdHoc", "Unreadable"), status).otherwise("Unsigned")


def dest_label() -> Column:
    """The name, else the address (Q13)."""
    return F.coalesce("name", "dest_ip")


def stable_label() -> Column:
    """The organisation, else the registrable domain, else the address."""
    return F.coalesce("as_org", registrable_domain(F.col("name")), "dest_ip")


def exe_of(path: str = "exe_path", pid: str = "pid") -> Column:
    """The program path, else ``pid:N`` (L8); null without a process."""
    return F.coalesce(F.col(path), F.concat(F.lit("pid:"), F.col(pid).cast("string")))


def learning(events: DataFrame, config: AlertConfig) -> DataFrame:
    """One row: start_ms, end_ms and active_from, the first event number at which learning is over.

    The first event of all starts it, attributed or not; once over it stays over.
    """
    first = events.agg(F.min_by("ts_ms", "seq").alias("start_ms"))
    over = events.crossJoin(F.broadcast(first)).filter(F.col("ts_ms") >= F.col("start_ms") + config.learn_ms)
    from_ = over.agg(F.min("seq").alias("active_from"))
    return first.crossJoin(F.broadcast(from_)).withColumn("end_ms", F.col("start_ms") + config.learn_ms)


#: Event numbers that one task puts in order at a time, as bits.
RANK_BITS = 16


def ranked(first: DataFrame, order: str, name: str) -> DataFrame:
    """``first`` with ``name``: its rows' places from 1 on by ascending ``order``, a whole number that no two rows share.

    Rows are put in order within ranges of 2^RANK_BITS numbers, and a range's first
    place follows from how many rows the ranges before it have: no task sorts more than
    one range, or the list of the ranges.
    """
    rows = first.withColumn("_r", F.shiftright(F.col(order).cast("long"), RANK_BITS))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_r").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(order)) + F.col("_before")
    return rows.join(sizes, F.col("_r") == F.col("_s")).withColumn(name, place.cast("long")).drop("_r", "_s", "_before")


def process_ids(events: DataFrame) -> DataFrame:
    """(exe, process_id): numbers from 1 in order of first appearance."""
    first = events.filter("exe is not null").groupBy("exe").agg(F.min("seq").alias("_first"))
    return ranked(first, "_first", "process_id").select("exe", "process_id")


def destination_ids(events: DataFrame) -> DataFrame:
    """(dest_ip, dest_id), as :func:`process_ids`."""
    first = events.groupBy("dest_ip").agg(F.min("seq").alias("_first"))
    return ranked(first, "_first", "dest_id").select("dest_ip", "dest_id")


#: The first-seen signals: what is new, and its place in the order of signals.
NOVEL = {1: "process", 3: "label", 4: "country", 5: "network"}


def novelties(events: DataFrame) -> DataFrame:
    """The first event of every program and of every label, country and network of a program.

    One pass and one exchange for all four: an event stands for its keys, and
    the lowest event of each key is combined before the exchange.  ``step`` is the
    signal's (see NOVEL), ``key`` what was new.
    """
    known = events.filter("exe is not null")
    key = lambda step, c: F.when(c.isNotNull(), F.struct(F.lit(step).alias("step"), c.cast("string").alias("key")))
    keys = F.array_compact(F.array(key(1, F.lit("")), key(3, stable_label()), key(4, F.col("country")), key(5, F.col("asn"))))
    columns = [c for c in events.columns if c != "identity"]
    rows = known.select(F.explode(keys).alias("_k"), F.struct(*columns).alias("_e"))
    rows = rows.groupBy(F.col("_e.exe").alias("_x"), "_k.step", "_k.key").agg(F.min_by("_e", F.col("_e.seq")).alias("_e"))
    return rows.select("_e.*", "step", "key")


def _json(**fields: Column) -> Column:
    """An object with its names in order; nulls stay."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def changed(old: Column, new: Column, flag_signed_updates: bool) -> Column:
    """Whether identity ``new`` is a meaningful change from ``old``."""
    sealed = (old["status"] == "Unreadable") | (new["status"] == "Unreadable")
    regressed = (old["status"] == "Valid") & (new["status"] != "Valid")
    same = lambda f: old[f].eqNullSafe(new[f])
    signed = (old["kind"] == "MacCodesign") & (new["kind"] == "MacCodesign")
    by_signature = ~same("team_id") | ~same("signing_id") | regressed | (~same("value") & F.lit(flag_signed_updates))
    return ~sealed & F.when(signed, by_signature).otherwise(~same("value") | regressed)


def identity_changes(events: DataFrame, config: AlertConfig) -> DataFrame:
    """Events whose identity is a change from the program's last identified event, with ``old``.

    The baseline is the previous identified event's (kind, value), with the
    attributes that this pair was first stored with.
    """
    seen = events.filter("exe is not null and identity is not null")
    first = seen.groupBy("exe", F.col("identity.kind").alias("_k"), F.col("identity.value").alias("_v")).agg(F.min_by("identity", "seq").alias("old"))
    before = F.lag(F.struct("identity.kind", "identity.value")).over(Window.partitionBy("exe").orderBy("seq"))
    rows = seen.withColumn("_b", before).filter("_b is not null")
    first = first.withColumnRenamed("exe", "_x")
    rows = rows.join(first, (F.col("exe") == F.col("_x")) & F.col("_b.kind").eqNullSafe(F.col("_k")) & F.col("_b.value").eqNullSafe(F.col("_v")))
    return rows.filter(changed(F.col("old"), F.col("identity"), config.flag_signed_updates)).drop("_b", "_k", "_v", "_x")


@dataclass
class Volume:
    """A program's outbound volume: the interval that is open, and the moving mean and variance."""

    start_ms: int
    mean: float = 0.0
    var: float = 0.0
    acc: float = 0.0
    samples: int = 0


def volume_step(config: AlertConfig):
    """The transition of :class:`Volume` (W5): an event that is an interval or more after the start
    closes the interval, and is part of it; the next one starts there."""

    def step(state: Volume | None, row: dict) -> tuple[Volume, list[tuple]]:
        now = state or Volume(row["ts_ms"])
        now.acc += float(row["bytes_up"] or 0)
        if row["ts_ms"] - now.start_ms < config.volume_interval_ms:
            return now, []
        x, mean, std = now.acc, now.mean, math.sqrt(now.var)
        delta = x - now.mean
        now.mean += config.volume_alpha * delta
        now.var = (1.0 - config.volume_alpha) * (now.var + config.volume_alpha * delta * delta)
        now.samples += 1
        now.acc, now.start_ms = 0.0, row["ts_ms"]
        return now, [(row["exe"], row["seq"], x, mean, std, now.samples)]

    return step


def volume_samples(events: DataFrame, config: AlertConfig) -> DataFrame:
    """(exe, seq, x, mean, std, samples) per closed interval; mean and std are those before it."""
    rows = events.filter("exe is not null").select("exe", "seq", "ts_ms", "bytes_up")
    return fold(rows, ["exe"], ["seq"], volume_step(config), "exe string, seq long, x double, mean double, std double, samples long")


def volume_state(events: DataFrame, config: AlertConfig) -> DataFrame:
    """(exe, ewma_mean, ewma_var, interval_acc, interval_start_ms, samples) after all events."""
    rows = events.filter("exe is not null").select("exe", "seq", "ts_ms", "bytes_up")
    step = volume_step(config)
    done = lambda key, s: [(key[0], s.mean, s.var, s.acc, s.start_ms, s.samples)]
    return fold(rows, ["exe"], ["seq"], lambda s, r: (step(s, r)[0], []), "exe string, ewma_mean double, ewma_var double, interval_acc double, interval_start_ms long, samples long", finish=done)


def spikes(samples: DataFrame, config: AlertConfig) -> DataFrame:
    """Samples that are spikes, with ``z`` (infinite where nothing varied before) and ``severity`` (L4)."""
    x, mean, std = F.col("x"), F.col("mean"), F.col("std")
    # the two branches are evaluated for all rows: the division has to be safe by itself
    z = F.when(std > 0, (x - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))).when(x > mean, F.lit(float("inf"))).otherwise(F.lit(0.0))
    rows = samples.filter((F.col("samples") >= config.volume_min_samples) & (F.floor(x).cast("long") >= config.volume_floor)).withColumn("z", z)
    severity = F.when(x >= 10.0 * F.greatest(mean, F.lit(1.0)), "critical").otherwise("warning")
    return rows.filter(F.col("z") >= config.volume_z).withColumn("severity", severity)


def candidates(events: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """All alerts before the cooldown: (seq, step, kind, severity, ts_ms, process_id, dest_id, dedup_key, title, detail).

    ``step`` is the order of the signals within one event.  Ids are joined to the
    alerts, not to the events.
    """
    active = learning(events, config).select("active_from")
    c, cat = F.col, F.concat
    s = lambda x: F.col(x).cast("string")
    base = {"pid": c("pid"), "exe": c("exe")}
    # in front of and behind the program's number in the key; behind alone where the key is by path
    shape = ["seq", "step", "kind", "severity", "ts_ms", "exe", "dest_ip", "outbound", "front", "behind", "title", "detail"]
    step, key = c("step"), c("key")
    org = F.coalesce(cat(F.lit(" ("), c("as_org"), F.lit(")")), F.lit(""))
    new = novelties(events)
    new = new.withColumns(
        {
            "kind": F.when(step == 1, "new_process_egress").when(step == 3, "new_process_dest").otherwise("new_geo"),
            "severity": F.when(step == 1, "warning").otherwise("notice"),
            "front": F.when(step == 3, "dest|").when(step > 3, "geo|"),
            "behind": F.when(step == 1, cat(F.lit("egress|"), c("exe"))).when(step == 3, cat(F.lit("|"), key)).when(step == 4, cat(F.lit("|cc|"), key)).otherwise(cat(F.lit("|asn|"), key)),
            "title": cat(
                c("proc_name"),
                F.when(step == 1, cat(F.lit(" made its first outbound connection (→ "), dest_label(), F.lit(")")))
                .when(step == 3, cat(F.lit(" contacted a new destination: "), key))
                .when(step == 4, cat(F.lit(" connected to a new country: "), key))
                .otherwise(cat(F.lit(" connected to a new network: AS"), key, org)),
            ),
            "detail": F.when(step == 1, _json(**base, dest=dest_label())).when(step == 3, _json(**base, label=key, ip=c("dest_ip"))).when(step == 4, _json(**base, country=c("country"))).otherwise(_json(**base, asn=c("asn"), as_org=c("as_org"))),
        }
    )
    who = lambda i: F.struct(c(f"{i}.signing_id").alias("signing"), c(f"{i}.team_id").alias("team"), c(f"{i}.value").alias("value"))
    moved = identity_changes(events, config).withColumns(
        {
            "step": F.lit(2), "kind": F.lit("identity_change"), "severity": F.lit("critical"), "front": F.lit(None).cast("string"), "behind": cat(F.lit("identity|"), c("exe"), F.lit("|"), c("identity.value")),
            "title": cat(c("proc_name"), F.lit(" binary identity changed since baseline")), "detail": _json(**base, old=who("old"), new=who("identity")),
        }
    )
    burst = spikes(volume_samples(events, config), config).withColumnRenamed("exe", "_x").withColumnRenamed("seq", "_q")
    burst = events.join(burst, (c("exe") == c("_x")) & (c("seq") == c("_q")))
    finite = ~c("z").isin(float("inf"))
    shown = F.when(finite, F.format_string("%.1f", F.bround("z", 1))).otherwise("inf")
    size = F.floor("x").cast("long")
    burst = burst.withColumns(
        {
            "step": F.lit(6), "kind": F.lit("volume_spike"), "front": F.lit("volume|"), "behind": F.lit(""), "title": cat(c("proc_name"), F.lit(" outbound volume spike: "), size.cast("string"), F.lit(" bytes/interval (z="), shown, F.lit(")")),
            "detail": _json(**base, bytes=size, mean=c("mean"), std=c("std"), z=F.when(finite, c("z"))),
        }
    )
    found = new.select(*shape).unionByName(moved.select(*shape)).unionByName(burst.select(*shape))
    # a spike counts in either direction, the others only outbound
    found = found.crossJoin(F.broadcast(active)).filter((c("seq") >= c("active_from")) & (c("outbound") | (c("step") == 6)))
    found = found.join(process_ids(events), "exe").join(destination_ids(events), "dest_ip")
    dedup = F.when(c("front").isNull(), c("behind")).otherwise(cat(c("front"), s("process_id"), c("behind")))
    return found.select("seq", "step", "kind", "severity", "ts_ms", "process_id", "dest_id", dedup.alias("dedup_key"), "title", "detail")


def cooldown_step(cooldown_ms: int):
    """Keeps an alert unless one of its key was kept less than the cooldown before."""

    def step(last: int | None, row: dict) -> tuple[int | None, list[tuple]]:
        if last is not None and row["ts_ms"] - last < cooldown_ms:
            return last, []
        return row["ts_ms"] if last is None else max(last, row["ts_ms"]), [tuple(row.values())]

    return step


ALERT = "seq long, step int, kind string, severity string, ts_ms long, process_id long, dest_id long, dedup_key string, title string, detail string"


def emitted(found: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The candidates that the cooldown lets through (L6); suppressed ones don't extend it."""
    return fold(found, ["dedup_key"], ["seq", "step"], cooldown_step(config.cooldown_ms), found.schema)


def alerts(events: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """All alerts of the events, in the order in which they were raised.

    The events are read once a signal and once for each table of ids: give a
    written or persisted table where they come out of a long chain.
    """
    return emitted(candidates(events, config), config).orderBy("seq", "step")
