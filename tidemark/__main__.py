"""python -m tidemark run --config FILE [--http-port N] | serve [--port N]"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from tidemark.plans.config import ConfigError, PipelineConfig
from tidemark.plans.pipeline import build
from tidemark.session import build_session, ship_package
from tidemark.streaming.metrics import Metrics, ProgressListener, serve

log = logging.getLogger("tidemark")


def run(path: str, http_port: int | None, emit_time: str, checkpoint: str | None, master: str) -> None:
    cfg = PipelineConfig.load(path)
    cfg.validate()
    for name in cfg.ignored:
        log.warning("%s is not known and was ignored", name)
    metrics = Metrics()
    server = serve(metrics, http_port) if http_port is not None else None
    spark = build_session(master)
    ship_package(spark)
    spark.streams.addListener(ProgressListener(metrics))
    spark.sparkContext.setJobDescription(f"pipeline {path}")
    began = time.monotonic()
    query = build(spark, cfg, emit_time, checkpoint).measure(metrics, "window").run()
    if query is not None:
        query.awaitTermination()
    metrics.observe("tidemark_sink_latency_ms", (time.monotonic() - began) * 1000, sink=cfg.sink.kind)
    if server:
        server.shutdown()


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="run a pipeline")
    one.add_argument("--config", required=True)
    one.add_argument("--http-port", type=int)
    one.add_argument("--emit-time", choices=("watermark", "window_end"), default="watermark")
    one.add_argument("--checkpoint", help="folder of a streaming pipeline's checkpoint")
    one.add_argument("--master", default="local[*]")
    two = commands.add_parser("serve", help="serve metrics")
    two.add_argument("--port", type=int, default=9898)
    args = parser.parse_args(argv)
    try:
        if args.command == "run":
            run(args.config, args.http_port, args.emit_time, args.checkpoint, args.master)
        else:
            server = serve(Metrics(), args.port)
            print(f"metrics at http://127.0.0.1:{server.server_port}/metrics", flush=True)
            while True:
                time.sleep(3600)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
