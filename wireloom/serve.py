"""Requests over a Unix socket, pushed events, and the state that a viewer keeps of them."""

from __future__ import annotations

import contextlib
import json
import os
import queue
import socket
import threading
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from .api import BadRequest, Monitor, event_line, parse_request

# Events that wait for a slow subscriber, and alerts in a viewer's feed.
WAITING, FEED = 1024, 500
#: Seconds between two looks at whether to stop.
LOOK = 0.1


class Bus:
    """Hands events to subscribers; one that is slow loses events, one that has gone is forgotten (T4)."""

    def __init__(self) -> None:
        self._lock, self._queues = threading.Lock(), []

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(WAITING)
        with self._lock:
            self._queues.append(q)
        return q

    def leave(self, q: queue.Queue) -> None:
        with self._lock:
            self._queues = [x for x in self._queues if x is not q]

    def publish(self, line: str) -> None:
        with self._lock:
            for q in self._queues:
                with contextlib.suppress(queue.Full):
                    q.put_nowait(line)


class Server:
    """A monitor's answers on a Unix socket, one thread a client.

    ``start`` and ``stop`` are for the program that runs it; a client may stop it too.
    Requests are answered one after the other, as they share the monitor.
    """

    def __init__(self, monitor: Monitor, path: str | Path) -> None:
        self.monitor, self.path, self.bus = monitor, str(path), Bus()
        self._one, self._stop, self._thread = threading.Lock(), threading.Event(), None

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self) -> Server:
        """Listens; a socket that a dead server left behind is taken over, a live one is an error."""
        with contextlib.suppress(FileNotFoundError):
            with socket.socket(socket.AF_UNIX) as s:
                if s.connect_ex(self.path) == 0:
                    raise BadRequest(f"{self.path} is being served")
            os.unlink(self.path)
        listener = socket.socket(socket.AF_UNIX)
        listener.bind(self.path)
        listener.listen()
        listener.settimeout(LOOK)
        self._stop.clear()
        self._thread = threading.Thread(target=self._accept, args=(listener,), daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None and self._thread is not threading.current_thread():
            self._thread.join()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has stopped within the time."""
        return self._stop.wait(seconds)

    def _accept(self, listener: socket.socket) -> None:
        with listener:
            while not self._stop.is_set():
                try:
                    client, _ = listener.accept()
                except TimeoutError:
                    continue
                client.settimeout(None)
                threading.Thread(target=self._client, args=(client,), daemon=True).start()
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self.path)

    def _client(self, client: socket.socket) -> None:
        # a client that goes away in the middle ends its own thread only
        with client, client.makefile("rw", encoding="utf-8", newline="\n") as both, contextlib.suppress(OSError):
            for line in both:
                if not line.strip():
                    continue
                kind = ""
                with contextlib.suppress(BadRequest):
                    kind = parse_request(line)[0]
                # subscribed before it is said, so that nothing is missed in between
                events = self.bus.subscribe() if kind == "subscribe" else None
                try:
                    both.write(self._answered(line) + "\n")
                    both.flush()
                    if events is not None:
                        self._push(both, events)
                finally:
                    if events is not None:
                        self.bus.leave(events)
                if kind == "stop":
                    self._stop.set()
                if kind in ("stop", "subscribe"):
                    return

    def _answered(self, line: str) -> str:
        with self._one:
            try:
                return self.monitor.answer(line)
            except Exception as e:  # noqa: BLE001  a query that fails is an answer, not the server's end
                return json.dumps({"type": "error", "data": {"message": str(e)}})

    def _push(self, both, events: queue.Queue) -> None:
        while not self._stop.is_set():
            try:
                both.write(events.get(timeout=LOOK) + "\n")
                both.flush()
            except queue.Empty:
                continue

    def publisher(self, kind: str) -> Callable[[DataFrame, int], None]:
        """A callable for ``foreachBatch`` that pushes each row of a batch, in its order; rows come one partition at a time."""

        def push(batch: DataFrame, _: int) -> None:
            for r in batch.toJSON().toLocalIterator():
                self.bus.publish(event_line(kind, json.loads(r)))

        return push


class Client:
    """A connection to a server."""

    def __init__(self, path: str | Path) -> None:
        self._socket = socket.socket(socket.AF_UNIX)
        self._socket.connect(str(path))
        self._both = self._socket.makefile("rw", encoding="utf-8", newline="\n")

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._both.close()
        self._socket.close()

    def ask(self, kind: str, **fields: int) -> dict:
        """The answer to a request; an error answer is raised."""
        self._both.write(json.dumps({"type": kind, **fields}) + "\n")
        self._both.flush()
        line = self._both.readline()
        if not line:
            raise BadRequest("the server has gone")
        got = json.loads(line)
        if got["type"] == "error":
            raise BadRequest(got["data"]["message"])
        return got

    def events(self) -> Iterator[dict]:
        """Pushed events until the server stops."""
        self.ask("subscribe")
        for line in self._both:
            yield json.loads(line)


@dataclass
class Viewer:
    """What a viewer shows: live connections by id, the newest alerts, the status.

    It holds one connection an id and at most :data:`FEED` alerts, newest first.  While it is
    paused, ``follow`` takes no events, so they wait where they are.
    """

    live: dict[int, dict] = field(default_factory=dict)
    feed: deque = field(default_factory=deque)
    status: dict | None = None
    connected: bool = True
    message: str | None = None
    paused: bool = False

    def apply(self, event: dict) -> None:
        kind, row = event["type"], {k: v for k, v in event.items() if k != "type"}
        if kind == "flow":
            self.live[row["id"]] = row
        elif kind == "closed":
            self.live.pop(row["id"], None)
        elif kind == "alert":
            self.feed.appendleft(row)
            while len(self.feed) > FEED:
                self.feed.pop()

    def follow(self, events: Iterator[dict]) -> None:
        """Applies events until there are none or it is paused."""
        while not self.paused and (event := next(events, None)) is not None:
            self.apply(event)

    def snapshot(self, connections: list[dict]) -> None:
        """Replaces the live connections."""
        self.live = {c["id"]: c for c in connections}

    def recent(self, alerts: list[dict]) -> None:
        """Replaces the feed."""
        self.feed = deque(alerts)

    def disconnected(self, message: str) -> None:
        """Says so; what was known last stays."""
        self.connected, self.message = False, message

    def connections(self) -> list[dict]:
        """Last seen first."""
        return sorted(self.live.values(), key=lambda c: -c["last_seen"])
