"""Commands: parse, replay, watch, verify, redact, hook, git. python -m turnstone.cli <command> --help."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import sinks
from .functions import rules as R
from .functions import text as T
from .operators import commits as M
from .operators import events as E
from .operators import nodes as N
from .operators.normalize import normalize
from .session import send, session
from .sources import commits as G
from .sources import discover as P
from .sources.hook import land, record_hook
from .sources.stores import read_store


def tool_of(path: str, name: str | None) -> str:
    tool = P.parse_tool(name) if name else P.infer_tool(path)
    if tool not in P.TOOLS:
        raise ValueError(f"unknown tool {name!r}" if name else f"the path {path} tells no tool: name one with --as")
    return tool


def events_of(spark: SparkSession, paths: list[str], tool: str) -> DataFrame:
    return normalize(read_store(spark, tool, paths), tool)


def parse(spark: SparkSession, path: str, tool: str | None = None, redact: bool = True, write: sinks.Sink | None = None, conf: C.Config | None = None) -> None:
    """The nodes of one file or store, to standard output by default."""
    c = conf or C.Config()
    nodes = N.prepare(events_of(spark, [path], tool_of(path, tool)), c.rules, c.secrets if redact else None, c.content)
    (write or sinks.stream())(nodes)


def mine(spark: SparkSession, repo: str, rev: str = "HEAD", most: int = 0, redact: bool = True, write: sinks.Sink | None = None) -> DataFrame:
    """The nodes of a repository's history; returns the summary."""
    commits, files = G.read_history(spark, repo, rev, most)
    nodes = M.commit_nodes(commits, files, R.SECRETS if redact else None)
    (write or sinks.stream())(nodes)
    return M.summary(commits, nodes)


def conformance(spark: SparkSession, path: str, tool: str) -> tuple[int, list[str]]:
    """The number of nodes of a file, and what it breaks: records lost, numbers that don't grow, ids that come twice, runs that differ."""
    raw = read_store(spark, tool, [path])
    events = normalize(raw, tool)
    broken = []
    if E.input_records(raw).join(events.groupBy("run_id").agg(F.count(F.lit(1)).alias("m")), "run_id", "left").where("n > 0 AND m IS NULL").count():
        broken.append("records were lost")
    if E.missing_places(events).count():
        broken.append("numbers don't grow")
    if E.repeated_ids(events).count():
        broken.append("ids come twice")
    plain = events.select([F.to_json(F.struct(c)).alias(c) for c in events.columns])
    if plain.exceptAll(normalize(read_store(spark, tool, [path]), tool).select([F.to_json(F.struct(c)).alias(c) for c in events.columns])).count():
        broken.append("two runs differ")
    return N.prepare(events).count(), broken


def verify(spark: SparkSession, folder: str) -> list[tuple[str, int, int, int, str]]:
    """(tool, cases, good ones, nodes, first failure) of a folder that has one for each tool."""
    out = []
    for top in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        cases = good = nodes = 0
        failure = ""
        for f in P.find_transcripts(top, ("jsonl", "json", "zst")):
            cases += 1
            try:
                n, broken = conformance(spark, f.path, tool_of(f.path, top.name))
            except ValueError as e:
                n, broken = 0, [str(e)]
            nodes, good = nodes + n, good + (not broken)
            failure = failure or (f"{f.path}: {', '.join(broken)}" if broken else "")
        out.append((top.name, cases, good, nodes, failure))
    return out


def capture(spark: SparkSession, path: str, folder: str, tool: str | None = None, name: str | None = None, with_nodes: bool = False) -> Path:
    """Take a file into a folder of samples, if it conforms; its nodes beside it if asked for."""
    tool = tool_of(path, tool)
    _, broken = conformance(spark, path, tool)
    if broken:
        raise ValueError(f"{path} doesn't conform: {', '.join(broken)}")
    target = Path(folder) / tool / "captured" / f"{name or Path(path).stem}{Path(path).suffix}"
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(path, target)
    if with_nodes:
        with open(target.with_suffix(".nodes.ndjson"), "w", encoding="utf-8") as out:
            sinks.stream(out)(N.prepare(events_of(spark, [path], tool)))
    return target


def watch(spark: SparkSession, roots: list[str], tools: list[str], write: sinks.Sink, work: str, once: bool = False, conf: C.Config | None = None) -> None:
    """Keep a sink up to date with the transcripts under the roots. Stores and, with once, all files are read whole."""
    from .streaming.tail import live

    c = conf or C.Config()
    wanted = P.wanted_tools(tools or c.tools)
    prepare = lambda events: N.prepare(events, c.rules, c.secrets, c.content)
    found = P.targets(wanted, roots, c.places)
    grown = [f for f in found if not f.path.lower().endswith((".vscdb", ".db")) and not f.compressed]
    for tool in wanted:
        whole = [f.path for f in found if f.tool == tool and Path(f.path).is_file() and (once or f not in grown)]
        if whole:
            write(prepare(events_of(spark, whole, tool)))
    if once:
        return
    queries = [live(spark, root, f"{work}/{i}/records", f"{work}/{i}/offsets", write, wanted, prepare) for i, root in enumerate(roots or [str(c.places.home_dir())])]
    try:
        for q in queries:
            q.awaitTermination()
    except KeyboardInterrupt:
        for q in queries:
            q.stop()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="turnstone", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("parse", "replay"):
        p = sub.add_parser(name)
        p.add_argument("file")
        p.add_argument("--as", dest="tool")
        if name == "parse":
            p.add_argument("--no-redact", action="store_true")
    p = sub.add_parser("watch")
    p.add_argument("--tools", default="")
    p.add_argument("--root", action="append", default=[])
    p.add_argument("--sink")
    p.add_argument("--out")
    p.add_argument("--once", action="store_true")
    p.add_argument("--config")
    p.add_argument("--work", default="watch-state")
    p = sub.add_parser("verify")
    p.add_argument("folder")
    p.add_argument("--capture")
    p.add_argument("--as", dest="tool")
    p.add_argument("--name")
    p.add_argument("--nodes", action="store_true")
    p = sub.add_parser("redact")
    p.add_argument("file")
    p.add_argument("--no-content", action="store_true")
    p = sub.add_parser("hook")
    p.add_argument("--land")
    p = sub.add_parser("git")
    p.add_argument("--repo", default=".")
    p.add_argument("--rev", default="HEAD")
    p.add_argument("--max", type=int, default=0)
    p.add_argument("--out", default="-")
    p.add_argument("--no-redact", action="store_true")
    a = top.parse_args(argv)
    if a.command == "hook":  # never fails, never waits for Spark
        data = sys.stdin.buffer.read()
        land(data, a.land) if a.land else record_hook(data)
        return 0
    spark = send(session("turnstone"))
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.command in ("parse", "replay"):
            parse(spark, a.file, a.tool, a.command == "replay" or not a.no_redact)
        elif a.command == "redact":
            df = spark.read.text(a.file, wholetext=True)
            row = df.select(T.redact(F.col("value"), content=not a.no_content).alias("text"), T.contains_secret(F.col("value")).alias("secret")).first()
            sys.stdout.write(row.text if row else "")
            if row and row.secret:
                print("secrets were redacted", file=sys.stderr)
        elif a.command == "git":
            s = mine(spark, a.repo, a.rev, a.max, not a.no_redact, sinks.build("ndjson", a.out)).first()
            print(f"{s.commits} commits, {s.decisions} decisions, {s.links} links", file=sys.stderr)
        elif a.command == "verify" and a.capture:
            print(capture(spark, a.capture, a.folder, a.tool, a.name, a.nodes))
        elif a.command == "verify":
            rows = verify(spark, a.folder)
            for tool, cases, good, nodes, failure in rows:
                print(f"{tool:<14} {cases:>6} {good:>6} {nodes:>8}  {'PASS' if good == cases > 0 else 'FAIL'} {failure}")
            return int(any(good != cases or not cases for _, cases, good, *_ in rows))
        else:
            c = C.load(a.config) if a.config else C.Config()
            write = sinks.build(c.sink if a.config and not a.sink else a.sink or "ndjson", a.out or c.out)
            watch(spark, a.root, [t for t in a.tools.split(",") if t], write, a.work, a.once, c)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
