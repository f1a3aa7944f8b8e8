"""What a streaming query has reached, for inspection and resumption."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass
class Progress:
    """Source offset, watermark (ms) and batch of a query; the query itself resumes from its checkpoint folder."""

    source_offset: str | None
    watermark_ms: int | None
    snapshot: str

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Progress:
        return cls(**json.loads(text))

    @classmethod
    def of(cls, query) -> Progress | None:
        """The last progress of a streaming query, or None before its first batch."""
        from datetime import datetime

        last = query.lastProgress
        if not last:
            return None
        last = last if isinstance(last, dict) else json.loads(last.json)
        mark = (last.get("eventTime") or {}).get("watermark")
        ms = int(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp() * 1000) if mark else None
        offsets = [s.get("endOffset") for s in last.get("sources", [])]
        return cls(json.dumps(offsets), ms, str(last["batchId"]))
