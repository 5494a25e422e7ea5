"""Where transcripts lie: home, folders of each tool, files by extension, and which tool a path belongs to."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.text import ALIASES, PATH_PARTS

EXTENSIONS = ("jsonl", "json", "ndjson", "zst")
TOOLS = ("claude_code", "codex", "gemini", "otel", "cursor", "windsurf", "zed", "vscode", "copilot", "hermes", "opencode")
#: Tools whose store is a database that a reader of its own opens.
NATIVE = ("cursor", "zed", "vscode", "hermes", "opencode")


@dataclass(frozen=True, order=True)
class Found:
    path: str
    tool: str = ""
    session_hint: str | None = None
    compressed: bool = False


@dataclass
class Places:
    """Where to look: home and settings that stand before the environment's."""

    home: str | None = None
    overrides: Mapping[str, str] = field(default_factory=dict)
    env: Mapping[str, str] = field(default_factory=lambda: os.environ)

    def setting(self, name: str) -> str | None:
        return self.overrides.get(name) or self.env.get(name) or None

    def home_dir(self) -> Path:
        """home, else HOME, USERPROFILE, HOMEDRIVE with HOMEPATH, the current folder; empty counts as unset."""
        e = self.env
        pair = e.get("HOMEDRIVE") and e.get("HOMEPATH") and e["HOMEDRIVE"] + e["HOMEPATH"]
        return Path(self.home or e.get("HOME") or e.get("USERPROFILE") or pair or ".")


def walk(root: Path | str, depth: int = 1 << 30) -> Iterator[Path]:
    """Files under a folder, links not followed, to so many levels."""
    root = Path(root)
    for top, folders, files in os.walk(root, followlinks=False):
        if len(Path(top).relative_to(root).parts) >= depth - 1:
            folders.clear()
        for name in files:
            path = Path(top) / name
            if path.is_file() and not path.is_symlink():
                yield path


def find_transcripts(root: Path | str, extensions: tuple[str, ...] = EXTENSIONS) -> list[Found]:
    """Files whose extension is one of these, in any case, in order; .zst is marked as compressed."""
    hits = {p for p in walk(root) if p.suffix[1:].lower() in extensions}
    return sorted(Found(str(p), compressed=p.suffix == ".zst") for p in hits)


def parse_tool(name: str) -> str | None:
    slug = name.strip().lower()
    return next((tool for tool, names in ALIASES.items() if slug in names), None)


def infer_tool(path: str) -> str | None:
    """The tool that a path tells of: the first that a part of it names."""
    p = path.lower()
    return next((tool for part, tool in PATH_PARTS if part in p), "otel" if p.endswith(".ndjson") else None)


def wanted_tools(names: list[str]) -> list[str]:
    """Tools by name or alias, each once; all of them if none is named."""
    asked = [n for n in names if n.strip()]
    if not asked:
        return list(TOOLS)
    out: list[str] = []
    for n in asked:
        tool = parse_tool(n)
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {n!r}")
        if tool not in out:
            out.append(tool)
    return out


def _user_folders(home: Path, product: str) -> list[Path]:
    return [home / "Library/Application Support" / product / "User", home / ".config" / product / "User", home / "AppData/Roaming" / product / "User"]


def _existing(tool: str, *paths: Path) -> list[Found]:
    return [Found(str(p), tool) for p in paths if p.is_file()]


def _claude_code(at: Places) -> list[Found]:
    base = Path(at.setting("CLAUDE_CONFIG_DIR") or at.home_dir() / ".claude")
    return [Found(str(p), "claude_code", p.stem) for p in walk(base / "projects") if p.suffix == ".jsonl"]


def _codex(at: Places) -> list[Found]:
    base = Path(at.setting("CODEX_HOME") or at.home_dir() / ".codex")
    out = []
    for p in walk(base / "sessions"):
        stem = p.name.removesuffix(".zst").removesuffix(".jsonl")
        if p.name.startswith("rollout-") and p.name.endswith((".jsonl", ".jsonl.zst")):
            out.append(Found(str(p), "codex", stem.removeprefix("rollout-") or None, p.suffix == ".zst"))
    return out


def _gemini(at: Places) -> list[Found]:
    """Chats; a project's .json blobs only where it has no .jsonl."""
    root = at.home_dir() / ".gemini/tmp"
    files = [p for p in walk(root) if p.suffix in (".jsonl", ".json")]
    project = lambda p: p.relative_to(root).parts[0]
    chats = {project(p) for p in files if p.suffix == ".jsonl"}
    return [Found(str(p), "gemini", p.stem.removeprefix("session-")) for p in files if p.suffix == ".jsonl" or project(p) not in chats]


def _cursor(at: Places) -> list[Found]:
    home = at.home_dir()
    roots = [(f / s, 3) for f in _user_folders(home, "Cursor") for s in ("workspaceStorage", "globalStorage")] + [(home / ".cursor", 6)]
    return [Found(str(p), "cursor", p.parent.name) for root, depth in roots for p in walk(root, depth) if p.name == "state.vscdb" or p.suffix in (".jsonl", ".cursorchat")]


def _vscode(at: Places) -> list[Found]:
    out = []
    for user in [*_user_folders(at.home_dir(), "Code"), at.home_dir() / ".vscode"]:
        out += [Found(str(p), "vscode", p.parent.name) for p in sorted((user / "workspaceStorage").glob("*/state.vscdb")) if p.is_file()]
        out += _existing("vscode", user / "globalStorage/state.vscdb")
    return out


def _data_home(at: Places) -> Path:
    return Path(at.setting("XDG_DATA_HOME") or at.home_dir() / ".local/share")


def _zed(at: Places) -> list[Found]:
    home = at.home_dir()
    return _existing("zed", home / "Library/Application Support/Zed/threads/threads.db", _data_home(at) / "zed/threads/threads.db", home / "AppData/Local/Zed/threads/threads.db", home / ".local/share/zed/threads.db")


def _copilot(at: Places) -> list[Found]:
    """Folders, whether or not they exist."""
    home = at.home_dir()
    return [Found(str(p), "copilot", p.name) for p in (home / ".config/github-copilot", *[f / "workspaceStorage" for f in _user_folders(home, "Code")])]


def _windsurf(at: Places) -> list[Found]:
    """Folders, whether or not they exist."""
    home = at.home_dir()
    return [Found(str(p), "windsurf") for p in (home / ".codeium/windsurf/cascade", *_user_folders(home, "Windsurf"))]


def _hermes(at: Places) -> list[Found]:
    if base := at.setting("HERMES_HOME"):
        return _existing("hermes", Path(base) / "state.db")
    return _existing("hermes", at.home_dir() / ".hermes/state.db", at.home_dir() / "AppData/Local/hermes/state.db")[:1]


def _opencode(at: Places) -> list[Found]:
    own = at.setting("OPENCODE_DB")
    if own and own != ":memory:" and Path(own).is_absolute():
        return _existing("opencode", Path(own))
    return _existing("opencode", _data_home(at) / "opencode/opencode.db")


_LOOK = {"claude_code": _claude_code, "codex": _codex, "gemini": _gemini, "otel": lambda at: [], "cursor": _cursor, "vscode": _vscode, "zed": _zed, "copilot": _copilot, "windsurf": _windsurf, "hermes": _hermes, "opencode": _opencode}


def discover(tool: str, places: Places | None = None) -> list[Found]:
    """The transcripts of a tool, in order of path, each once."""
    return sorted({f.path: f for f in reversed(_LOOK[tool](places or Places()))}.values())


def targets(tools: list[str], roots: list[str], places: Places | None = None) -> list[Found]:
    """What to read: files under the roots whose path tells a wanted tool; without roots, those under home and the tools' own places."""
    at = places or Places()
    out = {f.path: Found(f.path, tool, None, f.compressed) for root in roots or [str(at.home_dir())] for f in find_transcripts(root) if (tool := infer_tool(f.path)) in tools}
    if not roots:
        for tool in tools:
            for f in discover(tool, at):
                out.setdefault(f.path, f)
    return sorted(out.values())
