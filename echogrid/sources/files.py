"""Path checks and audio headers."""

from __future__ import annotations

import datetime as dt
import os
import wave

from echogrid.schema import InputError


def resolve_file(path: str | None, default: str | None = None, allow_empty: bool = False) -> str | None:
    """Given path or default; a missing required file is an error."""
    chosen = path or default
    if not chosen:
        if allow_empty:
            return None
        raise InputError("InvalidInput", "a file path is required")
    if "://" not in chosen and not os.path.exists(chosen):
        if allow_empty:
            return None
        raise InputError("FileNotFound", chosen)
    return chosen


def audio_duration(path: str) -> float:
    """Seconds of a WAV file, read from its header."""
    with wave.open(path, "rb") as fh:
        return fh.getnframes() / fh.getframerate()


def stamped_name(slug: str, now: dt.datetime | None = None) -> str:
    """Output name of a run: slug and time."""
    return f"{slug}_{(now or dt.datetime.now()).strftime('%Y%m%d_%H%M%S')}"
