"""Figures of running pipelines as text for Prometheus, and over HTTP."""

from __future__ import annotations

import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of the latency buckets, in ms (fixed values).
BUCKETS = (0.1, 0.5, 1, 5, 10, 25, 50, 100, 250, 500, 1000)

SERIES = {
    "tidemark_operator_rows_total": ("counter", "Rows that an operator took in"),
    "tidemark_watermark_lag_ms": ("gauge", "How far the watermark is behind the clock"),
    "tidemark_bytes_written_total": ("counter", "Bytes written by sinks"),
    "tidemark_state_rows": ("gauge", "Rows held in state"),
    "tidemark_operator_latency_ms": ("histogram", "Time of an operator's batch"),
    "tidemark_sink_latency_ms": ("histogram", "Time of a sink's batch"),
    "tidemark_queue_depth": ("gauge", "Offsets or files offered but not taken"),
    "tidemark_late_rows_total": ("counter", "Rows dropped behind the watermark"),
}


class Metrics:
    """Counters, gauges and histograms; safe to use from several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[tuple[str, tuple], float] = defaultdict(float)
        self._observed: dict[tuple[str, tuple], list[float]] = defaultdict(lambda: [0.0] * (len(BUCKETS) + 2))

    def add(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] += value

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, ms: float, **labels: str) -> None:
        with self._lock:
            row = self._observed[name, tuple(sorted(labels.items()))]
            for i, bound in enumerate(BUCKETS):
                row[i] += ms <= bound
            row[-2] += 1
            row[-1] += ms

    def render(self) -> str:
        """All series in Prometheus's text format."""

        def shown(labels: tuple, **more: object) -> str:
            parts = [f'{k}="{v}"' for k, v in (*labels, *more.items())]
            return "{" + ",".join(parts) + "}" if parts else ""

        out = []
        with self._lock:
            for name, (kind, text) in SERIES.items():
                out += [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]
                out += [f"{name}{shown(labels)} {value:g}" for (n, labels), value in sorted(self._values.items()) if n == name]
                for (n, labels), row in sorted(self._observed.items()):
                    if n == name:
                        out += [f"{name}_bucket{shown(labels, le=bound)} {row[i]:g}" for i, bound in enumerate((*BUCKETS, "+Inf"))]
                        out += [f"{name}_sum{shown(labels)} {row[-1]:g}", f"{name}_count{shown(labels)} {row[-2]:g}"]
        return "\n".join(out) + "\n"


class ProgressListener(StreamingQueryListener):
    """Feeds metrics from the progress of streaming queries."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        from datetime import datetime

        progress = event.progress
        name = progress.name or str(progress.id)
        m = self.metrics
        m.add("tidemark_operator_rows_total", progress.numInputRows or 0, operator=name)
        took = dict(progress.durationMs or {})
        m.observe("tidemark_operator_latency_ms", took.get("triggerExecution", 0), operator=name)
        m.observe("tidemark_sink_latency_ms", took.get("addBatch", 0), sink=name)
        states = progress.stateOperators or []
        m.set("tidemark_state_rows", sum(s.numRowsTotal for s in states), operator=name)
        m.add("tidemark_late_rows_total", sum(s.numRowsDroppedByWatermark for s in states), operator=name)
        for seen in dict(progress.observedMetrics or {}).values():
            if "bytes" in seen:
                m.add("tidemark_bytes_written_total", seen["bytes"] or 0, sink=name)
        # What a source has and the query has not taken yet, where the source tells: offsets of Kafka, else files.
        waiting = [dict(s.metrics or {}) for s in progress.sources or []]
        m.set("tidemark_queue_depth", sum(float(w.get("maxOffsetsBehindLatest", w.get("numFilesOutstanding", 0))) for w in waiting), operator=name)
        mark = dict(progress.eventTime or {}).get("watermark")
        if mark:
            at, now = (datetime.fromisoformat(t.replace("Z", "+00:00")) for t in (mark, progress.timestamp))
            m.set("tidemark_watermark_lag_ms", max(0.0, (now - at).total_seconds() * 1000), operator=name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def serve(metrics: Metrics, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serves ``/metrics`` in a thread; port 0 takes a free one. Call ``shutdown()`` to end it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = self.path.split("?")[0] == "/metrics"
            body = metrics.render().encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
