"""The history of a git repository as two relations: commits and the files that they touch."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS = "sha string, epoch bigint, author string, subject string, body string"
_UNIT, _RECORD = "\x1f", "\x1e"


def _git(*args: str) -> str:
    done = subprocess.run(["git", *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)} failed: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def parse_messages(out: str) -> list[tuple[str, int, str, str, str]]:
    rows = []
    for record in out.split(_RECORD):
        sha, epoch, author, subject, body = (record.strip("\r\n").split(_UNIT, 4) + [""] * 5)[:5]
        if sha.strip():
            rows.append((sha.strip(), int(epoch) if epoch.strip().lstrip("-").isdigit() else 0, author.strip(), subject, body.strip()))
    return rows


def parse_files(out: str) -> list[tuple[str, str]]:
    rows, sha = [], None
    for line in out.split("\n"):  # not splitlines(), which takes the record mark for a line end
        if line.startswith(_RECORD):
            sha = line[1:].strip()
        elif sha and line.strip():
            rows.append((sha, line.strip()))
    return rows


def read_history(spark: SparkSession, repo: str, rev: str = "HEAD", most: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sha, epoch, author, subject, body) and (sha, path) of commits that are no merges; most: only so many of the latest."""
    limit = [f"--max-count={most}"] if most else []
    log = ["-C", repo, "log", "--no-merges", *limit]
    messages = _git(*log, f"--format=%H%x1f%ct%x1f%an <%ae>%x1f%s%x1f%b%x1e", rev)
    files = _git(*log, "--name-only", "--format=%x1e%H", rev)
    return spark.createDataFrame(parse_messages(messages), COMMITS), spark.createDataFrame(parse_files(files), "sha string, path string")
