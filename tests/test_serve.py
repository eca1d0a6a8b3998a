import json
import socket

import pytest

from wireloom import serve
from wireloom.api import BadRequest, Monitor


@pytest.fixture
def server(spark, tmp_path):
    live = spark.createDataFrame([(1, "curl", 5), (2, "ssh", 9)], "id long, process string, last_seen long")
    monitor = Monitor(spark, {})
    monitor.live = lambda: live.orderBy("id")
    s = serve.Server(monitor, tmp_path / "s").start()
    yield s
    s.stop()


def test_requests(server, tmp_path):
    with serve.Client(tmp_path / "s") as c:
        assert c.ask("live_connections") == {"type": "connections", "data": [{"id": 1, "process": "curl", "last_seen": 5}, {"id": 2, "process": "ssh", "last_seen": 9}]}
        assert c.ask("recent_alerts", limit=3)["data"] == []
        for bad in ("nothing", "recent_alerts"):
            with pytest.raises(BadRequest):
                c.ask(bad)
        assert c.ask("status")["data"]["alerts"] == 0  # still there after errors
        with serve.Client(tmp_path / "s") as other:
            assert other.ask("stop") == {"type": "stopping"}
    assert server.wait(10)
    server.stop()
    assert not server.running and not (tmp_path / "s").exists()


def test_a_failing_query_is_an_error_answer(server, tmp_path):
    server.monitor.live = lambda: 1 / 0
    with serve.Client(tmp_path / "s") as c:
        with pytest.raises(BadRequest, match="division"):
            c.ask("live_connections")
        assert c.ask("recent_alerts", limit=1)["data"] == []


def test_one_server_a_path(server, tmp_path):
    with pytest.raises(BadRequest):
        serve.Server(server.monitor, tmp_path / "s").start()
    left = socket.socket(socket.AF_UNIX)
    left.bind(str(tmp_path / "dead"))
    left.close()
    other = serve.Server(server.monitor, tmp_path / "dead").start()
    assert other.running
    other.stop()


def test_events(spark, server, tmp_path):
    with serve.Client(tmp_path / "s") as c:
        assert c.ask("subscribe") == {"type": "subscribed"}
        server.publisher("flow")(spark.createDataFrame([(7, "curl")], "id long, process string"), 0)
        server.bus.publish(json.dumps({"type": "closed", "id": 7}))
        assert [json.loads(c._both.readline()) for _ in range(2)] == [{"type": "flow", "id": 7, "process": "curl"}, {"type": "closed", "id": 7}]


def test_slow_subscribers_lose_events_and_gone_ones_are_forgotten():
    bus = serve.Bus()
    slow, gone = bus.subscribe(), bus.subscribe()
    bus.leave(gone)
    for i in range(serve.WAITING + 5):
        bus.publish(str(i))
    assert slow.qsize() == serve.WAITING and gone.qsize() == 0 and slow.get() == "0"


def test_viewer():
    v = serve.Viewer()
    events = iter([{"type": "flow", "id": 1, "last_seen": 5}, {"type": "flow", "id": 2, "last_seen": 9}, {"type": "flow", "id": 1, "last_seen": 10}, {"type": "heartbeat", "ts": 1}])
    v.follow(events)
    assert [(c["id"], c["last_seen"]) for c in v.connections()] == [(1, 10), (2, 9)]
    v.follow(iter([{"type": "closed", "id": 1}, {"type": "closed", "id": 5}]))
    assert list(v.live) == [2]
    v.follow({"type": "alert", "n": n} for n in range(serve.FEED + 3))
    assert len(v.feed) == serve.FEED and v.feed[0] == {"n": serve.FEED + 2} and v.feed[-1] == {"n": 3}
    waiting = iter([{"type": "closed", "id": 2}])
    v.paused = True
    v.follow(waiting)
    assert 2 in v.live
    v.paused = False
    v.follow(waiting)
    assert not v.live
    v.snapshot([{"id": 4, "last_seen": 1}])
    v.recent([{"n": 1}])
    v.disconnected("gone")
    assert list(v.live) == [4] and list(v.feed) == [{"n": 1}] and (v.connected, v.message, v.status) == (False, "gone", None)
