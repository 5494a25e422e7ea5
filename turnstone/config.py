"""Settings from a TOML file: unknown keys are errors, missing ones take the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from .functions import rules as R
from .functions.text import gate
from .sources.discover import Places

#: The keys that each part of the file may have.
KEYS = {
    "": {"capture", "tools", "gate", "redact", "ingest", "sink"}, "capture": {"tools", "project_filter", "home"}, "gate": {"rules"}, "redact": {"no_content", "patterns"},
    "ingest": {"poll_interval_secs", "resume_from_offset", "backfill_days"}, "sink": {"target", "ndjson", "sqlite", "memdb"},
}


@dataclass
class Config:
    tools: list[str] = field(default_factory=list)
    places: Places = field(default_factory=Places)
    rules: tuple = R.RULES
    secrets: tuple = R.SECRETS
    content: bool = True
    poll_seconds: int = 5
    resume: bool = True
    backfill_days: int = 0
    sink: str = "ndjson"
    out: str | None = None


def _checked(part: dict, name: str, keys: set[str] | None = None) -> dict:
    if odd := set(part) - (keys or KEYS[name]):
        raise ValueError(f"unknown settings in [{name}]: {', '.join(sorted(odd))}")
    return part


def parse(text: str) -> Config:
    """capture.tools, capture.home, tools.<name>.overrides, gate.rules (strong triples), redact, ingest and sink."""
    top = _checked(tomllib.loads(text), "")
    capture, gated, redact, ingest, sink = (_checked(top.get(k, {}), k) for k in ("capture", "gate", "redact", "ingest", "sink"))
    overrides = {k: v for name, tool in top.get("tools", {}).items() for k, v in _checked(tool, name, {"overrides"}).get("overrides", {}).items()}
    rules = [_checked(r, "gate.rules", {"id", "category", "pattern"}) for r in gated.get("rules", [])]
    patterns = [_checked(p, "redact.patterns", {"label", "pattern"}) for p in redact.get("patterns", [])]
    for name, keys in (("ndjson", {"path"}), ("sqlite", {"path"}), ("memdb", {"endpoint"})):
        _checked(sink.get(name, {}), f"sink.{name}", keys)
    target = sink.get("target", "ndjson")
    return Config(
        tools=capture.get("tools", []), places=Places(capture.get("home"), overrides), rules=gate((r["id"], r["category"], r["pattern"]) for r in rules) if rules else R.RULES,
        secrets=tuple((p["label"], p["pattern"]) for p in patterns) or R.SECRETS, content=not redact.get("no_content", False), poll_seconds=ingest.get("poll_interval_secs", 5),
        resume=ingest.get("resume_from_offset", True), backfill_days=ingest.get("backfill_days", 0), sink=target, out=sink.get("sqlite" if target == "sqlite" else "ndjson", {}).get("path"),
    )


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
