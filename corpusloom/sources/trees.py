"""Source trees, change times and configuration as DataFrames.

``files`` has one row per file: repo, path (with slashes, from the root), size,
mtime, content. Many trees fit into one table; every operator keeps them apart
by ``repo``. At scale the table is Parquet; ``manifest`` makes it from one local
tree, whose size is that of a checkout.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "repo string, path string, size long, mtime timestamp, content string"
PRUNED = (".git",)


def manifest(spark: SparkSession, root: str, repo: str = "", hidden: bool = True, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """Files below ``root``, a folder that the executors see too; a file that cannot be read has null content.

    The driver lists paths and sizes, contents are read in tasks. ``hidden``:
    also names that start with a dot.
    """
    rows = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in pruned and (hidden or d[0] != "."))
        for n in sorted(names):
            if hidden or n[0] != ".":
                full = os.path.join(folder, n)
                about = os.lstat(full)
                rows.append((repo, os.path.relpath(full, root).replace(os.sep, "/"), about.st_size, datetime.fromtimestamp(about.st_mtime, UTC), full))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 100):
                g = f.iloc[at : at + 100]
                yield g.assign(content=[_content(p) for p in g["content"]])

    return spark.createDataFrame(rows, FILES).mapInPandas(read, FILES)


def _content(full: str) -> str | None:
    try:
        with open(full, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def write_back(changed: DataFrame, root: str) -> int:
    """Write the contents of (path, content) below ``root``; for the few files that a bootstrap changes. Their number."""
    n = 0
    for r in changed.select("path", "content").toLocalIterator():
        with open(os.path.join(root, r["path"]), "w", encoding="utf-8", newline="") as f:
            f.write(r["content"])
        n += 1
    return n


def is_in_folder(below: str, suffix: str = ".md", recursive: bool = False) -> Column:
    """Does ``path`` lie in a folder (or anywhere below it) and end with ``suffix``?"""
    inside = F.col("path").startswith(f"{below}/") if below else F.lit(True)
    flat = F.lit(True) if recursive else ~F.substring("path", len(below) + 2 if below else 1, 1 << 20).contains("/")
    return inside & flat & F.lower("path").endswith(suffix)


def folder(files: DataFrame, below: str, suffix: str = ".md", recursive: bool = False) -> DataFrame:
    return files.filter(is_in_folder(below, suffix, recursive))


def commit_times(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, committed): last commit of every path below ``root``, from one pass over the log; empty where there is no repository.

    Paths are relative to ``root``, as in ``manifest``, and not quoted.
    """
    done = subprocess.run(["git", "-C", root, "log", "-z", "--format=%x01%ct", "--name-only", "--no-renames", "--relative"], capture_output=True, check=False)
    seen: dict[str, int] = {}
    for block in done.stdout.split(b"\x01")[1:] if done.returncode == 0 else []:
        at, *paths = [x for x in block.replace(b"\n", b"\0", 1).split(b"\0") if x]
        for p in paths:
            seen.setdefault(p.decode(errors="replace").removeprefix("\n"), int(at))
    return spark.createDataFrame([(repo, p, datetime.fromtimestamp(t, UTC)) for p, t in seen.items()], "repo string, path string, committed timestamp")


def change_times(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, path, value, source): commit time, or else the file's own."""
    met = files.select("repo", "path", "mtime").join(commits, ["repo", "path"], "left")
    source = F.when(F.col("committed").isNull(), "fallback_last_write_time").otherwise("git_log")
    return met.select("repo", "path", F.coalesce("committed", "mtime").alias("value"), source.alias("source"))


def known_json(content):
    """Is the column valid JSON?"""
    return F.try_parse_json(content).isNotNull()


@dataclass(frozen=True)
class Config:
    """The 18 settings of an audit. The defaults."""

    maintenance_finding_threshold: int = 5
    stale_active_plan_days: int = 14
    placeholder_todo_threshold: int = 3
    placeholder_patterns: tuple[str, ...] = ("TODO", "FIXME", "TBD", "XXX", "???")
    require_exec_plan_usage: bool = True
    warning_lines: int = field(default=500, metadata={"under": "codeHealth"})
    feature_freeze_lines: int = field(default=800, metadata={"under": "codeHealth"})
    failure_lines: int = field(default=1200, metadata={"under": "codeHealth"})
    markup_warning_lines: int = field(default=800, metadata={"under": "codeHealth"})
    markup_feature_freeze_lines: int = field(default=1200, metadata={"under": "codeHealth"})
    markup_failure_lines: int = field(default=1800, metadata={"under": "codeHealth"})
    migration_warning_lines: int = field(default=1200, metadata={"under": "codeHealth"})
    migration_feature_freeze_lines: int = field(default=1800, metadata={"under": "codeHealth"})
    migration_failure_lines: int = field(default=2400, metadata={"under": "codeHealth"})
    long_function_lines: int = field(default=120, metadata={"under": "codeHealth"})
    repeated_line_threshold: int = field(default=6, metadata={"under": "codeHealth"})
    excluded_paths: tuple[str, ...] = field(default=(".git", "docs", ".harness", "vendor", "dist", "build", "coverage", "node_modules"), metadata={"under": "codeHealth"})
    excluded_patterns: tuple[str, ...] = field(default=("**/generated/**", "**/vendor/**", "**/*.lock", "**/*.generated.*", "**/migrations/**"), metadata={"under": "codeHealth"})


def _json_name(snake: str) -> str:
    head, *rest = snake.split("_")
    return head + "".join(x.title() for x in rest)


def read_config(spark: SparkSession, text: str | None) -> tuple[Config, DataFrame]:
    """(settings, findings) from one JSON text. Absent keys keep their defaults; a bad value is a finding and keeps its default too.

    Lists replace the default and lose blank entries. Text that is no JSON is
    one finding. No text is a warning event outside the findings' counts.
    """
    row, values, found = spark.range(1).select(F.lit(text).cast("string").alias("j")), {}, []
    if text is None:
        found.append(("config", "warning", {"reason": "missing_config", "counted": "no"}))
    elif not row.select(known_json("j")).first()[0]:
        found.append(("config", "failed", {"reason": "invalid_json"}))
    else:
        at = lambda f: "$.validation." + (f"{f.metadata['under']}." if f.metadata else "") + _json_name(f.name)
        raw = row.select(*(F.get_json_object("j", at(f)).alias(f.name) for f in fields(Config))).select(
            *(
                F.named_struct(
                    F.lit("raw"), F.col(f.name), F.lit("int"), F.expr(f"try_cast({f.name} as int)"), F.lit("bool"), F.lower(F.trim(f.name)),
                    F.lit("list"), F.filter(F.coalesce(F.from_json(f.name, "array<string>"), F.array(F.col(f.name))), lambda x: x.rlike(r"\S")),
                ).alias(f.name)
                for f in fields(Config)
            )
        ).first()
        for f in fields(Config):
            if raw[f.name]["raw"] is None:
                continue
            kind = type(f.default)
            if kind is tuple:
                values[f.name] = tuple(raw[f.name]["list"] or ())
            elif kind is bool and raw[f.name]["bool"] in ("true", "false"):
                values[f.name] = raw[f.name]["bool"] == "true"
            elif kind is int and (raw[f.name]["int"] or 0) >= 1:
                values[f.name] = raw[f.name]["int"]
            else:
                found.append(("config", "failed", {"key": f.name, "reason": "invalid_boolean" if kind is bool else "invalid_positive_integer"}))
    return Config(**values), spark.createDataFrame(found, "check string, status string, metadata map<string,string>")
