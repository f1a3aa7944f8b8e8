"""Durations as text."""

from __future__ import annotations

import re

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "": 1000}


def parse_duration_ms(text: str) -> int:
    """Milliseconds of ``500ms``, ``10s``, ``2m``, ``1h`` or a bare number of seconds; white space around it is ignored."""
    m = re.fullmatch(r"([+-]?[0-9]+)(ms|s|m|h|)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    ms = int(m[1]) * _UNITS[m[2]]
    if not -(1 << 63) <= ms < 1 << 63:
        raise ValueError(f"duration out of range: {text!r}")
    return ms
