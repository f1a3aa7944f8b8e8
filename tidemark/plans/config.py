"""Pipelines declared in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from tidemark.functions.durations import parse_duration_ms
from tidemark.operators.windows import AGGREGATES, Session, Sliding, Tumbling, Window


class ConfigError(ValueError):
    """A pipeline that cannot be built as declared."""


@dataclass
class SourceConfig:
    kind: str
    path: str
    time_field: str
    format: str | None = None
    text_field: str | None = None
    bootstrap_servers: str | None = None
    topic: str | None = None
    group_id: str | None = None
    auto_offset_reset: str | None = None
    commit_interval: str | None = None


@dataclass
class TimeConfig:
    allowed_lateness: str


@dataclass
class WindowConfig:
    type: str
    size: str
    slide: str | None = None
    gap: str | None = None


@dataclass
class OpsConfig:
    count_by: str | None = None
    agg: str | None = None
    agg_field: str | None = None


@dataclass
class SinkConfig:
    kind: str
    out_dir: str | None = None
    path: str | None = None
    partition_field: str | None = None
    partition_format: str | None = None
    compression: str | None = None
    max_rows: int | None = None
    max_age: str | None = None
    max_bytes: int | None = None
    bootstrap_servers: str | None = None
    topic: str | None = None
    acks: str | None = None


@dataclass
class PipelineConfig:
    source: SourceConfig
    time: TimeConfig
    window: WindowConfig
    ops: OpsConfig
    sink: SinkConfig
    ignored: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> PipelineConfig:
        """From TOML; unknown keys are noted in ``ignored``."""
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e
        kinds = {"source": SourceConfig, "time": TimeConfig, "window": WindowConfig, "ops": OpsConfig, "sink": SinkConfig}
        ignored: list[str] = []
        parts = {name: _section(kind, name, data.get(name), ignored) for name, kind in kinds.items()}
        return cls(**parts, ignored=ignored)

    @classmethod
    def load(cls, path: str) -> PipelineConfig:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @property
    def agg(self) -> str:
        return self.ops.agg or "count"

    def validate(self) -> None:
        """Raises ``ConfigError`` for the first thing that is wrong."""
        s, k = self.source, self.sink
        if s.kind == "file":
            if not s.path.strip():
                raise ConfigError("source.path must not be empty for a file source")
            if (s.format or "jsonl") not in ("jsonl", "csv"):
                raise ConfigError(f"source.format must be jsonl or csv, not {s.format!r}")
        elif s.kind == "kafka":
            for name in ("bootstrap_servers", "topic", "group_id"):
                if not getattr(s, name):
                    raise ConfigError(f"source.{name} is required for a kafka source")
        else:
            raise ConfigError(f"source.kind must be file or kafka, not {s.kind!r}")
        if k.kind not in ("parquet", "file", "kafka"):
            raise ConfigError(f"sink.kind must be parquet, file or kafka, not {k.kind!r}")
        if k.kind == "parquet" and not k.out_dir:
            raise ConfigError("sink.out_dir is required for a parquet sink")
        if k.kind == "kafka" and not (k.bootstrap_servers and k.topic):
            raise ConfigError("sink.bootstrap_servers and sink.topic are required for a kafka sink")
        if not self.ops.count_by:
            raise ConfigError("ops.count_by is required")
        if self.agg not in AGGREGATES:
            raise ConfigError(f"ops.agg must be one of {', '.join(AGGREGATES)}, not {self.agg!r}")
        if self.agg != "count" and not self.ops.agg_field:
            raise ConfigError(f"ops.agg_field is required for {self.agg}")
        try:
            parse_duration_ms(self.time.allowed_lateness)
            self.to_window()
        except ValueError as e:
            raise ConfigError(str(e)) from e

    def to_window(self) -> Window:
        w = self.window
        if w.type == "tumbling":
            return Tumbling(parse_duration_ms(w.size))
        if w.type == "sliding":
            if not w.slide:
                raise ConfigError("window.slide is required for a sliding window")
            return Sliding(parse_duration_ms(w.size), parse_duration_ms(w.slide))
        if w.type == "session":
            if not w.gap:
                raise ConfigError("window.gap is required for a session window")
            return Session(parse_duration_ms(w.gap))
        raise ConfigError(f"window.type must be tumbling, sliding or session, not {w.type!r}")


def _section(kind: type, name: str, data: Any, ignored: list[str]) -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"section [{name}] is required")
    known = {f.name: f for f in fields(kind)}
    ignored += [f"{name}.{k}" for k in data if k not in known]
    values = {k: v for k, v in data.items() if k in known}
    for key, f in known.items():
        optional = "None" in str(f.type)
        if key not in values and not optional:
            raise ConfigError(f"{name}.{key} is required")
        wants = int if "int" in str(f.type) else str
        if key in values and (not isinstance(values[key], wants) or isinstance(values[key], bool)):
            raise ConfigError(f"{name}.{key} must be a {'number' if wants is int else 'string'}")
    return kind(**values)
