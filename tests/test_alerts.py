import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from wireloom.api import BadRequest, Monitor, event_line, monitored, notifier, open_monitor, parse_request
from wireloom.operators import alerts as A
from wireloom.operators import store

IDENTITY = "struct<kind: string, value: string, signing_id: string, team_id: string, authority: string, status: string>"
SCHEMA = f"seq long, ts_ms long, exe string, proc_name string, pid long, dest_ip string, dest_port int, local_port int, protocol int, name string, country string, asn long, as_org string, bytes_up long, bytes_down long, outbound boolean, identity {IDENTITY}"
NOW = A.AlertConfig(learn_ms=0)


def ident(value="h1", status="Valid", team="T", kind="MacCodesign", signing="com.a"):
    return (kind, value, signing, team, None, status)


def event(seq, ts=None, exe="/bin/curl", name="api.example.com", ip="1.2.3.4", country="US", asn=15169, org=None, up=100, out=True, identity=None):
    return (seq, seq * 1000 if ts is None else ts, exe, exe and exe.split("/")[-1], 7, ip, 443, 5000, 6, name, country, asn, org, up, 0, out, identity)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def fired(spark, rows, config=NOW):
    return [(r.seq, r.kind) for r in A.alerts(table(spark, rows), config).collect()]


def test_novelty_then_quiet(spark):
    assert fired(spark, [event(0), event(1)]) == [(0, "new_process_egress"), (0, "new_process_dest"), (0, "new_geo"), (0, "new_geo")]


def test_learning_is_silent_and_learns(spark):
    rows = [event(0, 0), event(1, 3_600_000), event(2, 7_200_000, ip="9.9.9.9", name=None)]
    assert fired(spark, rows, A.AlertConfig(learn_ms=3_600_000)) == [(2, "new_process_dest")]
    assert store.processes(table(spark, rows)).count() == 1


def test_inbound_and_unattributed(spark):
    assert fired(spark, [event(0, out=False), event(1)]) == []  # inbound fills the baselines
    assert fired(spark, [event(0, exe=None), event(1, out=False)]) == []
    assert A.learning(table(spark, [event(0, 500, exe=None), event(1, 900)]), A.AlertConfig(learn_ms=300)).head() == (500, 1, 800)


def test_identity_change(spark):
    rows = [event(0, identity=ident("h1", kind="Sha256")), event(1), event(2, identity=ident("h2", kind="Sha256"))]
    got = A.alerts(table(spark, rows), NOW).filter("kind = 'identity_change'").collect()
    assert [(r.seq, r.severity, r.dedup_key) for r in got] == [(2, "critical", "identity|/bin/curl|h2")]
    assert json.loads(got[0].detail)["old"]["value"] == "h1"


def test_regression_with_the_same_value_is_told_each_time(spark):
    rows = [event(0, identity=ident()), event(1, identity=ident(status="AdHoc")), event(2, identity=ident(status="AdHoc"))]
    assert A.identity_changes(table(spark, rows), NOW).count() == 2


@pytest.mark.parametrize(
    ("old", "new", "flag", "want"),
    [
        (ident(), ident(), False, False), (ident(), ident("h2"), False, False), (ident(), ident("h2"), True, True), (ident(), ident(team="U"), False, True), (ident(), ident(signing=None), False, True), (ident(), ident(status="AdHoc"), False, True),
        (ident(status="Unreadable"), ident(team="U"), False, False), (ident(kind="Sha256"), ident("h2", kind="Sha256"), False, True), (ident(kind="Sha256"), ident(kind="Sha256"), False, False), (ident(kind="Sha256"), ident(kind="Sha256", status="AdHoc"), False, True), (ident(), ident("h2", kind="Sha256"), False, True),
    ],
)
def test_identity_truth_table(spark, old, new, flag, want):
    df = spark.createDataFrame([(old, new)], f"o {IDENTITY}, n {IDENTITY}")
    assert df.select(A.changed(F.col("o"), F.col("n"), flag)).head()[0] is want


def test_volume_spike(spark):
    config = A.AlertConfig(learn_ms=0, volume_interval_ms=10, volume_floor=1000, volume_min_samples=3)
    rows = [event(i, i * 20, up=200) for i in range(6)] + [event(6, 200, up=5_000_000)]
    got = A.alerts(table(spark, rows), config).filter("kind = 'volume_spike'").collect()
    assert [(r.seq, r.severity, r.dedup_key) for r in got] == [(6, "critical", "volume|1")] and "5000000 bytes/interval" in got[0].title


def test_infinite_z(spark):
    df = spark.createDataFrame([("x", 1, 5e6, 0.0, 0.0, 9)], "exe string, seq long, x double, mean double, std double, samples long")
    r = A.spikes(df, A.AlertConfig(volume_floor=1)).head()
    assert r.z == float("inf") and r.severity == "critical"
    rows = [event(0, 0, up=0), event(1, 20, up=0), event(2, 40, up=9_000)]
    got = A.alerts(table(spark, rows), A.AlertConfig(learn_ms=0, volume_interval_ms=10, volume_floor=1, volume_min_samples=1)).filter("kind = 'volume_spike'").head()
    assert got.title.endswith("(z=inf)") and json.loads(got.detail)["z"] is None


def test_cooldown(spark):
    found = spark.createDataFrame([(i, 1, "k", "info", ts, 1, 1, key, "t", "{}") for i, (ts, key) in enumerate([(0, "a"), (30, "a"), (50, "a"), (70, "a"), (130, "a"), (60, "b"), (10, "b")])], A.ALERT)
    assert [r.ts_ms for r in A.emitted(found, A.AlertConfig(cooldown_ms=60)).orderBy("seq").collect()] == [0, 70, 130, 60]


class Slow:
    """The engine's rules, one event after another, over plain dictionaries."""

    def __init__(self, c):
        self.c, self.procs, self.dests, self.seen, self.first, self.ids, self.cur, self.vol, self.last, self.start, self.active = c, {}, {}, set(), {}, {}, {}, {}, {}, None, False

    def emit(self, out, ts, kind, key):
        if key in self.last and ts - self.last[key] < self.c.cooldown_ms:
            return
        self.last[key] = max(ts, self.last.get(key, ts))
        out.append((kind, key))

    def see(self, e):
        (_, ts, exe, _, _, ip, _, _, _, name, cc, asn, org, up, _, outbound, i) = e
        self.start = ts if self.start is None else self.start
        self.active |= ts >= self.start + self.c.learn_ms
        out = []
        if exe is None:
            return out
        new = exe not in self.procs
        pid = self.procs.setdefault(exe, len(self.procs) + 1)
        loud = self.active and outbound
        if new and loud:
            self.emit(out, ts, "new_process_egress", f"egress|{exe}")
        if i:
            old = self.cur.get(exe)
            self.first.setdefault((exe, i[0], i[1]), i)
            self.cur[exe] = (exe, i[0], i[1])
            if old and loud:
                o = self.first[old]
                worse = o[5] == "Valid" and i[5] != "Valid"
                hit = (o[3] != i[3] or o[2] != i[2] or worse) if o[0] == i[0] == "MacCodesign" else (o[1] != i[1] or worse)
                if hit and "Unreadable" not in (o[5], i[5]):
                    self.emit(out, ts, "identity_change", f"identity|{exe}|{i[1]}")
        label = org or (".".join(name.split(".")[-2:]) if name else ip)
        for key, kind, dedup in ((("l", exe, label), "new_process_dest", f"dest|{pid}|{label}"), (("c", exe, cc), "new_geo", f"geo|{pid}|cc|{cc}"), (("n", exe, asn), "new_geo", f"geo|{pid}|asn|{asn}")):
            if key[2] is not None and key not in self.seen:
                self.seen.add(key)
                if loud:
                    self.emit(out, ts, kind, dedup)
        v = self.vol.setdefault(exe, [0.0, 0.0, 0.0, ts, 0])
        v[2] += up
        if ts - v[3] >= self.c.volume_interval_ms:
            x, mean, std = v[2], v[0], v[1] ** 0.5
            d = x - mean
            v[0] += self.c.volume_alpha * d
            v[1] = (1 - self.c.volume_alpha) * (v[1] + self.c.volume_alpha * d * d)
            v[2], v[3], v[4] = 0.0, ts, v[4] + 1
            z = (x - mean) / std if std > 0 else float("inf") if x > mean else 0.0
            if self.active and v[4] >= self.c.volume_min_samples and int(x) >= self.c.volume_floor and z >= self.c.volume_z:
                self.emit(out, ts, "volume_spike", f"volume|{pid}")
        return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events_against_the_model(spark, seed):
    draw = random.Random(seed)
    config = A.AlertConfig(learn_ms=20_000, volume_interval_ms=5_000, volume_z=1.5, volume_floor=300, volume_min_samples=3, cooldown_ms=9_000)
    ts = list(itertools.accumulate(draw.randrange(400) for _ in range(500)))
    rows = [
        event(
            n, ts[n], draw.choice(["/bin/a", "/bin/b", "/c", None]), draw.choice([None, "x.com", "y.z.org"]), f"1.1.1.{draw.randrange(6)}", draw.choice([None, "US", "FR", "DE"]), draw.choice([None, 1, 2]), draw.choice([None, "Org"]),
            draw.choice([0, 50, 90, 2000]), draw.random() < 0.7, draw.choice([None, None, ident(draw.choice("hij"), draw.choice(["Valid", "AdHoc"]), draw.choice("TU"), draw.choice(["Sha256", "MacCodesign"]))]),
        )
        for n in range(500)
    ]
    model = Slow(config)
    want = [(n, *a) for n, e in enumerate(rows) for a in model.see(e)]
    got = [(r.seq, r.kind, r.dedup_key) for r in A.alerts(table(spark, rows), config).collect()]
    assert got == want and len(want) > 20


def test_stored_texts(spark):
    df = spark.createDataFrame([("new_geo", "critical"), ("what", "loud")], "k string, s string")
    assert [tuple(r) for r in df.select(A.stored_kind(F.col("k")), A.stored_severity(F.col("s")))
            .collect()] == [("new_geo", "critical"), ("new_process_dest", "info")]


def monitor(spark, rows):
    e = table(spark, rows)
    live = e.select((F.col("seq") % 2).alias("id"), "seq", "ts_ms", F.col("proc_name").alias("process"), "pid", "dest_ip", "dest_port", "local_port", "protocol", "outbound", F.col("name").alias("dest_name"), "country", "asn", "as_org", "bytes_up", "bytes_down").withColumn("exe", F.lit("x"))
    return Monitor(spark, monitored(e, config=NOW), live, spark.createDataFrame([(1,)], "id long"), NOW)


def test_requests(spark, tmp_path):
    m = monitor(spark, [event(i, ip=f"1.1.1.{i}") for i in range(4)])
    ask = lambda **k: json.loads(m.answer(json.dumps(k)))
    status = ask(type="status")
    assert status["type"] == "status" and (status["data"]["processes"], status["data"]["destinations"], status["data"]["alerts"], status["data"]["baseline"]) == (1, 4, 4, "active")
    assert [c["id"] for c in ask(type="live_connections")["data"]] == [0]
    assert [p["exe_path"] for p in ask(type="list_processes")["data"]] == ["/bin/curl"]
    assert [d["ip"] for d in ask(type="list_destinations", process_id=1)["data"]] == ["1.1.1.3", "1.1.1.2", "1.1.1.1", "1.1.1.0"]
    assert len(ask(type="recent_alerts", limit=2)["data"]) == 2 and ask(type="process_history", process_id=1, since_ms=0, until_ms=9)["type"] == "history"
    assert ask(type="recent_connections", limit=5)["data"] == [] and ask(type="subscribe") == {"type": "subscribed"}
    assert json.loads(m.answer("{bad"))["type"] == "error" and ask(type="recent_alerts")["type"] == "error" and not m.stopping
    assert set(json.loads(m.document())) == {"status", "connections", "alerts"}
    assert list(m.serve(iter(["", '{"type":"stop"}', '{"type":"status"}']))) == ['{"type": "stopping"}'] and m.stopping
    store.write({k: v for k, v in m.tables.items()}, str(tmp_path / "store"))
    again = open_monitor(spark, tmp_path / "store")
    assert again.ask("list_processes").count() == 1 and again.ask("recent_connections", limit=3).count() == 0
    assert event_line("closed", {"id": 3}) == '{"type": "closed", "id": 3}'
    with pytest.raises(BadRequest):
        parse_request("[]")
    said = []
    notifier(said.append)(A.alerts(table(spark, [event(0)]), NOW), 0)
    assert said[0].startswith("[warning] curl made its first outbound connection")


def test_store_tables(spark):
    rows = [event(0, name=None), event(1, name="a.com", country=None, asn=None), event(2, name=None, org="Org", ip="5.5.5.5", exe="/bin/x")]
    e = table(spark, rows)
    d = {r.ip: r for r in store.destinations(e).collect()}
    assert (d["1.2.3.4"].id, d["1.2.3.4"].best_name, d["1.2.3.4"].country, d["1.2.3.4"].last_seen_ms) == (1, "a.com", "US", 1000)
    assert [(r.process_id, r.dest_id, r.conn_count) for r in store.pairs(e).orderBy("process_id").collect()] == [(1, 1, 2), (2, 2, 1)]
    assert {r.label for r in store.labels(e).collect()} == {"1.2.3.4", "a.com", "Org"}
    meta = spark.createDataFrame([("n", "12"), ("bad", "x"), ("baseline_state", "active")], "key string, value string")
    assert [store.meta_integer(meta, k).head()[0] for k in ("n", "bad", "none")] == [12, None, None]
    assert store.baseline_state(meta).head()[0] == "active" and store.baseline_state(meta.limit(0)).head()[0] == "learning"
    v = store.volumes(e).filter("process_id = 1").head()
    assert v.interval_acc == 200.0 and v.samples == 0
