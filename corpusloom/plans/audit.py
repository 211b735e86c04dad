"""The audit: a registry of checks, each one DataFrame of findings, then severity, counts and outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit as O
from corpusloom.operators.settings import FOUND, own_settings, with_settings
from corpusloom.operators.settings import PATH as CONFIG
from corpusloom.plans.staging import stage
from corpusloom.sources.trees import Config, change_times, folder, is_in_folder, known_json

EVENTS = "repo string, check string, status string, metadata map<string,string>"
#: kind of a finding -> its status in template mode, in project mode
SEVERITY = {"failure": ("failed", "failed"), "drift": ("warning", "failed"), "notice": ("warning", "warning")}
# Check ids and the paths and headings that they look at.
REFERENCES = (
    ("required-reading", "AGENTS.md", "Required Reading", ""),
    ("docs-core-document", "docs/README.md", "Core Documents", "docs"),
    ("harness-checklist", ".harness/README.md", "Checklists", ".harness/checklists"),
    ("harness-prompt", ".harness/README.md", "Prompts", ".harness/prompts"),
)
REGISTERS = (("maintenance-unregistered-checklist", "Checklists", ".harness/checklists"), ("maintenance-unregistered-prompt", "Prompts", ".harness/prompts"))
INDEXES = ("AGENTS.md", "docs/README.md", ".harness/README.md", "docs/TESTING.md")
COMMANDS, ACTIVE, COMPLETED, GENERATED = "docs/TESTING.md", "docs/exec-plans/active", "docs/exec-plans/completed", "docs/generated"


@dataclass(frozen=True)
class Run:
    """What an audit is asked for; ``strict`` implies ``project``."""

    known: DataFrame  # settings of the trees that have a configuration file
    defaults: Config = Config()  # those of the others
    as_of: datetime | None = None
    maintenance: bool = False
    code_health: bool = False
    project: bool = False
    strict: bool = False
    commits: DataFrame | None = None

    def with_settings(self, rows: DataFrame, *more: str, only: tuple[str, ...] = ()) -> DataFrame:
        return with_settings(rows, self.known, self.defaults, *more, only=only)

    @property
    def in_project(self) -> bool:
        return self.project or self.strict

    @property
    def mode(self) -> dict[str, str]:
        return {"mode": "Project" if self.in_project else "Template", "strict": str(self.strict)}


def _map(metadata: dict) -> Column:
    """Text by key; absent values leave no key."""
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def _findings(rows: DataFrame, check: str, kind: str | Column, **metadata) -> DataFrame:
    return rows.select("repo", F.lit(check).alias("check"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), _map(metadata).alias("metadata"))


def _entry(check: str, kind: str | Column, **metadata) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(check).alias("check"), kind.alias("kind"), _map(metadata).alias("metadata"))


def all_references(files: DataFrame) -> DataFrame:
    """(repo, check, path): what the sections of REFERENCES name, repeats kept, from one scan."""
    at = [F.when(F.col("path") == source, F.transform(T.backticks(T.section("content", heading)), lambda r: F.struct(F.lit(check).alias("check"), O.reference_path(r, below).alias("path")))) for check, source, heading, below in REFERENCES]  # noqa: B023
    rows = files.filter(F.col("path").isin(*{source for _, source, _, _ in REFERENCES}))
    return rows.select("repo", F.explode(F.flatten(F.array_compact(F.array(*at)))).alias("x")).select("repo", "x.*")


def reference_checks(files: DataFrame, run: Run) -> DataFrame:
    missing = O.missing_references(all_references(files), files)
    return missing.select("repo", "check", F.lit("failure").alias("kind"), _map({"path": F.col("path"), "reason": "missing"}).alias("metadata"))


def index_checks(files: DataFrame, run: Run) -> DataFrame:
    """Files that the checks read themselves: without them the audit of a tree cannot be complete."""
    has = files.groupBy("repo").agg(*(F.max(F.col("path") == p).alias(f"has{k}") for k, p in enumerate(INDEXES)))
    missing = F.array_compact(F.array(*(F.when(~F.col(f"has{k}"), F.lit(p)) for k, p in enumerate(INDEXES))))
    return _findings(has.select("repo", F.explode(missing).alias("path")), "index-file", "failure", path=F.col("path"), reason="missing")


def register_checks(files: DataFrame, run: Run) -> DataFrame:
    """Files of a register's folder that its section does not name, of all registers at once."""
    mine = [F.when((F.col("path") == ".harness/README.md"), F.transform(T.backticks(T.section("content", heading)), lambda r: F.struct(F.lit(check).alias("check"), F.lower(T.name(r)).alias("name")))) for check, heading, _ in REGISTERS]  # noqa: B023
    registered = files.filter(F.col("path") == ".harness/README.md").select("repo", F.explode(F.flatten(F.array_compact(F.array(*mine)))).alias("x")).select("repo", "x.*")
    which = reduce(lambda w, r: w.when(is_in_folder(r[2]), r[0]), REGISTERS, F)
    listed = files.filter(reduce(Column.__or__, (is_in_folder(below) for _, _, below in REGISTERS))).select("repo", "path", which.alias("check"), F.lower(T.name("path")).alias("name"))
    gone = listed.join(registered, ["repo", "check", "name"], "left_anti")
    return gone.select("repo", "check", F.lit("drift").alias("kind"), _map({"path": F.col("path"), "reason": "not_registered", "strict": str(run.strict)}).alias("metadata"))


def plan_checks(files: DataFrame, run: Run) -> DataFrame:
    """Active plans that have not changed for as many days as their tree allows."""
    plans = folder(files, ACTIVE)
    none = files.select("repo", "path", F.lit(None).cast("timestamp").alias("committed")).limit(0)
    changed = run.with_settings(change_times(plans, none if run.commits is None else run.commits)).withColumn("allowed", F.col("settings.stale_active_plan_days")).drop("settings")
    old = O.stale(changed, F.lit(run.as_of).cast("timestamp"), F.col("allowed"))
    return _findings(old, "maintenance-stale-active-plan", "drift", path=F.col("path"), days=F.col("age_days"), source=F.col("source"), thresholdDays=F.col("allowed"), strict=str(run.strict))


def usage_checks(files: DataFrame, run: Run) -> DataFrame:
    unused = run.with_settings(O.plan_usage(files, ACTIVE, COMPLETED).filter("active + completed = 0"))
    return _findings(unused.filter("settings.require_exec_plan_usage"), "maintenance-exec-plan-usage", "drift", active=F.col("active"), completed=F.col("completed"), reason="no_exec_plans_found", strict=str(run.strict))


def command_findings(run: Run) -> Column:
    """Of the table of commands: too few rows (nothing else is reported of the rows then), rows without three cells or without a command in backticks, TODOs."""
    required = len(O.COMMANDS)
    command = lambda r: F.get(r["cells"], F.lit(1))
    short = lambda r: F.size(r["cells"]) < 3
    bare = lambda r: ~command(r).rlike("^`[^`]+`$")
    bad = lambda r: _entry("testing-command-row", "failure", path=COMMANDS, rowIndex=r["row_index"], reason=F.when(short(r), "malformed_command_row").otherwise("command_cell_must_be_backticked"), value=F.when(~short(r), command(r)))

    def found(rows: Column) -> Column:
        few = _entry("testing-command-row", "failure", path=COMMANDS, reason="missing_command_rows", count=F.size(rows), expected=required)
        wrong = F.transform(F.filter(F.slice(rows, 1, required), lambda r: short(r) | bare(r)), bad)
        todo = F.size(F.filter(rows, lambda r: O.is_todo_row(r["line"])))
        todos = _entry("testing-todo", "notice" if run.code_health and not run.maintenance else "drift", count=todo, path=COMMANDS, **run.mode)
        return F.concat(F.when(F.size(rows) < required, F.array(few)).otherwise(wrong), F.when(todo > 0, F.array(todos)).otherwise(F.array().cast(FOUND)))

    return T.let(O.command_table("content"), found)


def text_findings(run: Run) -> Column:
    """Of documents: placeholders, and generated ones whose time is a TODO."""
    own, count, strict = F.col("settings"), F.col("placeholders"), {"strict": str(run.strict)}
    dense = _entry("maintenance-placeholder-density", "drift", path=F.col("path"), count=count, patterns=F.array_join(own["placeholder_patterns"], ","), threshold=own["placeholder_todo_threshold"], **strict)
    todo = _entry("maintenance-generated-todo", "drift", path=F.col("path"), reason="generated_at_todo", **strict)
    return F.array_compact(F.array(F.when(count >= own["placeholder_todo_threshold"], dense), F.when(is_in_folder(GENERATED) & O.is_generated_todo("content"), todo)))


def code_findings(run: Run) -> Column:
    """Of code files: not readable; large, by three tiers; and of smaller ones long functions and repeated lines."""
    own, t, limits, n = F.col("settings"), F.col("tier"), F.col("limits"), F.col("n_lines")
    size = {"category": limits["category"], "lines": n, "threshold": F.when(t == "failure", limits["failure"]).when(t == "feature_freeze", limits["freeze"]).otherwise(limits["warning"])}
    reason = F.when(t == "failure", "file_size_failure_candidate").when(t == "feature_freeze", "feature_freeze_candidate").otherwise("large_file_candidate")
    unread = _entry("code-health-read-file", "drift", path=F.col("path"), reason="read_failed", **run.mode)
    large = _entry("code-health-large-file", F.when(t == "failure", "drift").otherwise("notice"), path=F.col("path"), **size, reason=reason, **run.mode)
    long = lambda f: _entry("code-health-long-function", "notice", path=F.col("path"), name=f["name"], startLine=f["start_line"], lines=f["lines"], threshold=own["long_function_lines"], **run.mode)
    repeat = lambda r: _entry("code-health-repeated-line", "notice", path=F.col("path"), count=r["repeats"], threshold=own["repeated_line_threshold"], sample=F.substring(r["line"], F.lit(1), F.lit(80)), **run.mode)
    inner = F.concat(F.transform(F.filter(O.functions("content"), lambda f: f["lines"] >= own["long_function_lines"]), long), F.transform(O.repeated("content", own["repeated_line_threshold"]), repeat))
    outer = F.array_compact(F.array(F.when(F.col("content").isNull(), unread), F.when(t != "ok", large)))
    return F.when(t.isin("ok", "warning"), F.concat(outer, inner)).otherwise(outer)


def file_checks(files: DataFrame, run: Run) -> DataFrame:
    """Everything that follows from one file and its tree's settings: of the table of commands, documents and code files an array of findings each, exploded once."""
    found = [(files.filter(F.col("path") == COMMANDS), command_findings(run))]
    if run.maintenance:
        texts = run.with_settings(files.filter(is_in_folder("", recursive=True)), only=("placeholder_patterns", "placeholder_todo_threshold"))
        found.append((texts.withColumn("placeholders", T.placeholders("content", F.col("settings.placeholder_patterns"))), text_findings(run)))
    if run.code_health:
        of_code = ("prefixes", "rules", "long_function_lines", "repeated_line_threshold", *(f.name for f in fields(Config) if f.name.endswith(("warning_lines", "freeze_lines", "failure_lines"))))
        rows = run.with_settings(files.filter(O.is_code("path")), only=of_code).filter(~O.is_excluded("path", F.col("settings")))
        rows = rows.withColumn("n_lines", F.when(F.col("content").isNotNull(), F.size(T.lines("content")))).withColumn("limits", O.thresholds("path", F.col("settings")))
        found.append((rows.withColumn("tier", F.when(F.col("n_lines").isNotNull(), O.tier("n_lines", F.col("limits")))), code_findings(run)))
    return reduce(DataFrame.unionByName, (rows.select("repo", F.inline(x.cast(FOUND))) for rows, x in found))


def config_checks(files: DataFrame, run: Run) -> DataFrame:
    return run.known.select("repo", F.inline("found"))


CHECKS: dict[str, list[Callable[[DataFrame, Run], DataFrame]]] = {"always": [config_checks, index_checks, reference_checks, file_checks], "maintenance": [register_checks, plan_checks, usage_checks]}


def _is_counted(prefix: str) -> Column:
    """Findings of a group; the event that there are enough of them is none."""
    return F.col("check").startswith(prefix) & (F.col("check") != "maintenance-finding-threshold")


def with_threshold(found: DataFrame, run: Run) -> DataFrame:
    """``found`` (repo, check, kind, metadata) and, for trees with enough maintenance findings, one event more that says so."""
    count = found.filter(_is_counted("maintenance-")).groupBy("repo").agg(F.count("*").alias("n"))
    enough = run.with_settings(count).withColumn("least", F.col("settings.maintenance_finding_threshold")).filter("n >= least")
    return found.unionByName(_findings(enough, "maintenance-finding-threshold", "drift", count=F.col("n"), threshold=F.col("least"), **run.mode))


def with_status(found: DataFrame, run: Run) -> DataFrame:
    """(repo, check, status, metadata): the severity of each kind in the mode of the run."""
    status = reduce(lambda w, k: w.when(F.col("kind") == k, SEVERITY[k][run.in_project]), SEVERITY, F)
    return found.select("repo", "check", status.alias("status"), "metadata")


def audit(files: DataFrame, config: Config | None = None, as_of: datetime | None = None, maintenance: bool = False, code_health: bool = False, project: bool = False, strict: bool = False, commits: DataFrame | None = None) -> DataFrame:
    """(repo, check, status, metadata) of all checks that are asked for; ``strict`` implies ``project``.

    Every tree is measured by its own configuration file, laid over ``config``; what
    is wrong with that file is a finding, and so is an index file that is not
    there. ``as_of`` is the time that ages are measured at; maintenance needs it.
    In a tree with enough maintenance findings one event more says so. What
    follows from a single file is found in one pass over the files of its kind.
    """
    if maintenance and as_of is None:
        raise ValueError("maintenance needs as_of")
    run = Run(stage(own_settings(files, config), "settings"), config or Config(), as_of, maintenance, code_health, project, strict, commits)
    groups = ["always"] + ["maintenance"] * maintenance
    found = [check(files, run) for g in groups for check in CHECKS[g]]
    found = reduce(DataFrame.unionByName, (x.select("repo", "check", "kind", "metadata") for x in found))
    return with_status(with_threshold(stage(found, "findings"), run) if maintenance else found, run)


def summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per tree: errors, warnings, maintenance and code_health findings, ok."""
    like = lambda p: F.count_if(_is_counted(p))
    counts = findings.groupBy("repo").agg(F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"), like("maintenance-").alias("maintenance_findings"), like("code-health-").alias("code_health_findings"))
    return files.select("repo").distinct().join(counts, "repo", "left").fillna(0).withColumn("ok", F.col("errors") == 0)


def tree_counts(files: DataFrame, run: Run) -> DataFrame:
    """One row per tree: how many files of each kind a check looks at. Reads paths only."""
    of = lambda below, recursive=False: F.count_if(is_in_folder(below, recursive=recursive))
    counts = {"documents": of("", True), "active": of(ACTIVE), "completed": of(COMPLETED), "generated": of(GENERATED)} | {check: of(below) for check, _, below in REGISTERS}
    code = F.count_if(O.is_code("path") & ~O.is_excluded("path", F.col("settings")))
    return run.with_settings(files.select("repo", "path")).groupBy("repo").agg(*(c.alias(k) for k, c in counts.items()), code.alias("code"))


def events(files: DataFrame, findings: DataFrame, config: Config | None = None, maintenance: bool = False, code_health: bool = False, project: bool = False, strict: bool = False) -> DataFrame:
    """(repo, check, status, metadata) of all that is no finding: start, configuration, present references, totals, success and outcome of every tree.

    A check without a finding in a tree says success with what it looked at, so
    that "clean" differs from "not run". A tree's events are one array, from its
    counts of files, references and findings.
    """
    run = Run(stage(own_settings(files, config), "settings"), config or Config(), None, maintenance, code_health, project, strict)
    refs = all_references(files)
    named = refs.groupBy("repo").agg(*(F.count_if(F.col("check") == r[0]).alias(f"{r[0]} refs") for r in REFERENCES))
    checks = ["testing-todo", *(r[0] for r in REGISTERS), "maintenance-stale-active-plan", "maintenance-generated-todo", "maintenance-placeholder-density"]
    like = {"all code": F.col("check").startswith("code-health-")}
    seen = findings.groupBy("repo").agg(*(F.count_if(F.col("check") == c).alias(f"{c} found") for c in checks), *(F.count_if(c).alias(f"{k} found") for k, c in like.items()))
    row = run.with_settings(summary(files, findings).join(tree_counts(files, run), "repo").join(named, "repo", "left").join(seen, "repo", "left").fillna(0), "state")
    row = row.withColumn("state", F.coalesce("state", F.lit("missing")))
    own, out = F.col("settings"), []

    def say(check: str, status: str | Column = "success", when: Column | None = None, **metadata) -> None:
        event = F.struct(F.lit(check).alias("check"), (F.lit(status) if isinstance(status, str) else status).alias("status"), _map(metadata).alias("metadata"))
        out.append(event if when is None else F.when(when, event))

    count = lambda c: F.col(f"`{c}`")
    clean = lambda c: count(f"{c} found") == 0
    say("validation", "start", codeHealth=str(code_health), effectiveMode=run.mode["mode"], maintenance=str(maintenance), mode="Project" if project else "Template", strict=str(strict))
    say("config", "warning", F.col("state") == "missing", path=CONFIG, reason="missing_using_defaults")
    say("config", "success", F.col("state") == "ok", path=CONFIG, source="file")
    for check, *_ in REFERENCES:
        say(f"{check}-summary", count=count(f"{check} refs"))
    say("testing-todo", "success", clean("testing-todo"), count=0, **run.mode)
    if maintenance:
        say("maintenance", "start", **run.mode)
        for check, *_ in REGISTERS:
            say(check, "success", clean(check), count=count(check))
        say("maintenance-stale-active-plan", "success", clean("maintenance-stale-active-plan"), count=count("active"), thresholdDays=own["stale_active_plan_days"])
        say("maintenance-generated-todo", "success", clean("maintenance-generated-todo"), count=count("generated"))
        say("maintenance-placeholder-density", "success", clean("maintenance-placeholder-density"), scanned=count("documents"), threshold=own["placeholder_todo_threshold"])
        used = own["require_exec_plan_usage"]
        say("maintenance-exec-plan-usage", "success", used & (count("active") + count("completed") > 0), active=count("active"), completed=count("completed"))
        say("maintenance-exec-plan-usage", "success", ~used, enabled="False")
        say("maintenance", "complete", findings=F.col("maintenance_findings"))
    if code_health:
        limits = {"warningThreshold": own["warning_lines"], "featureFreezeThreshold": own["feature_freeze_lines"], "failureThreshold": own["failure_lines"]}
        say("code-health", "start", **run.mode, **limits)
        say("code-health-large-file", "success", clean("all code"), scanned=count("code"), **limits)
        say("code-health", "complete", scanned=count("code"), findings=F.col("code_health_findings"))
    say("validation", F.when(F.col("ok"), "success").otherwise("failed"), effectiveMode=run.mode["mode"], errors=F.col("errors"), warnings=F.col("warnings"))
    whole = row.select("repo", F.inline(F.array_compact(F.array(*out))))
    present = O.present_references(refs, files).select("repo", "check", F.lit("success").alias("status"), _map({"path": F.col("path")}).alias("metadata"))
    return whole.unionByName(present)


def log_lines(found: DataFrame, component: str = "Audit") -> DataFrame:
    return found.select("repo", T.event_line(component, "check", "status", "metadata").alias("line"))


def bootstrap_lines(events: DataFrame) -> DataFrame:
    """(repo, line) of the events of a bootstrap, which name no check."""
    return events.select("repo", T.status_line("TestingBootstrap", "status", "metadata").alias("line"))


def command_events(files: DataFrame, apply: bool = False) -> DataFrame:
    """(repo, check, status, metadata) of a bootstrap of every tree: what was detected for each command, and what came of it.

    A package file that is no JSON is a warning. Where the table of commands is
    missing or too short to take the commands, ``apply`` has failed; otherwise it
    is applied, or a dry run.
    """
    of = lambda rows, status, **metadata: rows.select("repo", F.lit("testing-bootstrap").alias("check"), (F.lit(status) if isinstance(status, str) else status).alias("status"), _map(metadata).alias("metadata"))
    status = F.when(F.col("command") == "TODO", "not_detected").otherwise("detected")
    found = of(O.merged_commands(files), status, id=F.col("id"), command=F.col("command"), note=F.col("note"))
    broken = files.filter((F.col("path") == "package.json") & ~F.coalesce(known_json(F.when(F.trim("content") != "", F.col("content"))), F.lit(False)))
    found = found.unionByName(of(broken, "warning", path=F.col("path"), reason="invalid_json"))
    if not apply:
        return found.unionByName(of(files.select("repo").distinct(), "dry_run", apply=f"use apply to update {COMMANDS}"))
    rows = files.filter(F.col("path") == COMMANDS).select("repo", F.size(O.command_table("content")).alias("n"))
    trees = files.select("repo").distinct().join(rows, "repo", "left")
    need = len(O.COMMANDS)
    done = F.when(F.col("n") >= need, "applied").otherwise("failed")
    why = F.when(F.col("n").isNull(), "missing").when(F.col("n") < need, "missing_command_rows")
    return found.unionByName(of(trees, done, path=COMMANDS, reason=why, count=F.when(F.col("n") < need, F.col("n")), expected=F.when(F.col("n") < need, need)))


def log_lines(found: DataFrame, component: str = "Audit") -> DataFrame:
    return found.select("repo", T.event_line(component, "check", "status", "metadata").alias("line"))
