"""Payloads that an agent's hook gives on standard input, as raw records."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

COMMON = ("hook_event_name", "session_id", "transcript_path", "cwd")


@dataclass
class Hooked:
    """The common fields, all others, and the record as the sources give it."""

    common: dict[str, str | None]
    rest: dict = field(default_factory=dict)
    record: tuple[str, int, int, str] = ("", 1, 0, "")


def record_hook(data: bytes) -> Hooked | None:
    """The payload and a record placed at its transcript, or at <hook stdin>; None where it is no JSON object of the right types."""
    try:
        payload = json.loads(data)
    except (ValueError, RecursionError):
        return None
    if not isinstance(payload, dict) or any(not isinstance(payload.get(k), (str, type(None))) for k in COMMON):
        return None
    common = {k: payload.get(k) for k in COMMON}
    rest = {k: v for k, v in payload.items() if k not in COMMON}
    return Hooked(common, rest, (common["transcript_path"] or "<hook stdin>", 1, 0, data.decode("utf-8", "replace")))


def land(data: bytes, folder: str) -> bool:
    """Append a hook's record to a file that the live reader follows; False where it is no payload. Never raises for bad input."""
    import os

    hooked = record_hook(data)
    if hooked is None:
        return False
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "hook.jsonl"), "a", encoding="utf-8") as out:
        out.write(json.dumps(json.loads(data), separators=(",", ":"), ensure_ascii=False) + "\n")
    return True
