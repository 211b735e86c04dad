import re
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit as O
from corpusloom.plans import audit as A
from corpusloom.sources import trees as S

NOW = datetime(2024, 6, 1, tzinfo=UTC)
OLD = datetime(2024, 1, 1, tzinfo=UTC)
TABLE = "# T\n\n## Commands\n\n| Purpose | Command | Note |\n|---|---|---|\n" + "".join(f"| {i} | `TODO` | n |\n" for i in O.COMMANDS) + "\n## Other\n| a | b | c |\n"
TREE = {
    "AGENTS.md": "## Required Reading\n| x | `docs/WORKFLOW.md` |\n",
    "docs/README.md": "## Core Documents\n`WORKFLOW.md` `TESTING.md`\n",
    "docs/WORKFLOW.md": "# W\n",
    "docs/TESTING.md": TABLE,
    ".harness/README.md": "## Checklists\n| a |\n## Prompts\n| b |\n",
    "docs/exec-plans/active/p.md": "plan\n",
}


def tree(spark, changes=None, repo="r", mtime=NOW):
    files = {k: v for k, v in (TREE | (changes or {})).items() if v is not None}
    return spark.createDataFrame([(repo, p, len(c), mtime, c) for p, c in files.items()], S.FILES)


def checks(df):
    return {(r["check"], r["status"]) for r in df.collect()}


def test_text_functions(spark):
    row = spark.createDataFrame([("## A\none `x` two `y\nz`\n## B\nq\n", "  a \t b ", "a\nb\n", "", "TODO TODOs ?????? x")], "c string, l string, m string, e string, p string")
    got = row.select(T.section("c", "A").alias("a"), T.section("c", "C").alias("none"), T.backticks("c").alias("ticks"), T.squeeze("l").alias("l"), T.lines("m").alias("m"), T.lines("e").alias("e"), T.placeholders("p", ["TODO", "???", " "]).alias("p"), T.cells(F.lit("| a | b |c|")).alias("cells")).first()
    assert got["a"] == "one `x` two `y\nz`\n" and got["none"] == "" and got["ticks"] == ["x", "y\nz"]
    assert (got["l"], got["m"], got["e"], got["p"], got["cells"]) == ("a b", ["a", "b"], [], 3, ["a", "b", "c"])


@pytest.mark.parametrize(("path", "pattern", "fits"), [("a/generated/b", "**/generated/**", True), ("generated/b", "**/generated/**", False), ("a/B.LOCK", "**/*.lock", True), ("abc", "a?c", True), ("a+c", "a[+]c", True), ("a.c", "abc", False)])
def test_wildcard(spark, path, pattern, fits):
    assert spark.range(1).select(F.lit(path).rlike(T.wildcard(pattern))).first()[0] is fits


def test_age_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(NOW - timedelta(days=14, hours=12),), (NOW - timedelta(days=15, hours=12),)], "at timestamp")
    assert [r[0] for r in df.select(T.age_days("at", F.lit(NOW))).collect()] == [14, 16]


@pytest.mark.parametrize(("content", "want"), [
    ("function a() {\n x\n}\ny\n", [("function a", 1, 3)]),
    ("function a()\n{\n x\n}\ny\nz\n", [("function a", 1, 6)]),
    ("def a():\n  x\ndef b():\n  y\n", [("def a(", 1, 3)]),
    ("async def a():\n x\n", []),
    ("const f = (x) => {\n}\n", [("const f = (x) =>", 1, 2)]),
    ("", []),
])
def test_functions(spark, content, want):
    df = spark.createDataFrame([(content,)], "content string")
    assert [tuple(f) for f in df.select(O.functions("content")).first()[0]] == want


def test_valid_tree_and_missing_reference(spark):
    assert checks(A.audit(tree(spark))) == {("testing-todo", "warning")}
    assert ("testing-todo", "failed") in checks(A.audit(tree(spark), strict=True))
    assert checks(A.audit(tree(spark), strict=True, code_health=True)) == {("testing-todo", "warning")}
    assert ("testing-todo", "failed") in checks(A.audit(tree(spark), None, NOW, strict=True, code_health=True, maintenance=True))
    files = tree(spark, {"docs/WORKFLOW.md": None})
    found = A.audit(files)
    assert checks(found) == {("testing-todo", "warning"), ("required-reading", "failed"), ("docs-core-document", "failed")}
    got = A.summary(files, found).first()
    assert (got["errors"], got["warnings"], got["ok"]) == (2, 1, False)
    assert any(r["line"].startswith("[Audit] required-reading failed { path=docs/WORKFLOW.md; reason=missing }") for r in A.log_lines(found).collect())


def test_command_table(spark):
    bad = TABLE.replace("| install | `TODO` |", "| install | TODO |").replace("| dev | `TODO` | n |", "| dev |")
    rows = [(r["metadata"]["rowIndex"], r["metadata"]["reason"]) for r in A.audit(tree(spark, {"docs/TESTING.md": bad})).filter("check = 'testing-command-row'").collect()]
    assert sorted(rows) == [("0", "command_cell_must_be_backticked"), ("1", "malformed_command_row")]
    few = A.audit(tree(spark, {"docs/TESTING.md": "## Commands\n|a|\n"})).filter("check = 'testing-command-row'").collect()
    assert [r["metadata"]["reason"] for r in few] == ["missing_command_rows"]
    twice = O.command_rows(tree(spark, {"docs/TESTING.md": TABLE.replace("| lint", "## Commands\n| lint")}).filter("path = 'docs/TESTING.md'"))
    assert [r["row_index"] for r in twice.orderBy("line_index").collect()] == list(range(6))


def test_maintenance(spark):
    changes = {".harness/checklists/A.md": "x", "docs/generated/g.md": "Generated at: `TODO`", "n.md": "TODO FIXME ???\n"}
    files = tree(spark, changes, mtime=OLD)
    found = A.audit(files, S.Config(maintenance_finding_threshold=4), NOW, maintenance=True)
    names = {c for c, _ in checks(found)}
    assert {"maintenance-unregistered-checklist", "maintenance-stale-active-plan", "maintenance-generated-todo", "maintenance-placeholder-density", "maintenance-finding-threshold"} <= names
    ages = found.filter("check = 'maintenance-stale-active-plan'").first()["metadata"]
    assert ages["source"] == "fallback_last_write_time" and ages["days"] == "152" and ages["thresholdDays"] == "14"
    assert "maintenance-exec-plan-usage" in {c for c, _ in checks(A.audit(tree(spark, {"docs/exec-plans/active/p.md": None}), None, NOW, maintenance=True))}
    with pytest.raises(ValueError):
        A.audit(files, maintenance=True)


def test_code_health(spark):
    line = "value = compute_something(with_many, arguments_here)"
    changes = {"a.py": f"{line}\n" * 3 + "def f():\n" + "  x\n" * 5, "b.py": "x\n" * 12, "c.py": "x\n" * 8, "docs/d.py": "x\n" * 50, "e.py": None}
    config = S.Config(warning_lines=8, feature_freeze_lines=10, failure_lines=12, long_function_lines=5, repeated_line_threshold=3)
    found = A.audit(tree(spark, changes), config, code_health=True, project=True)
    got = {(r["check"], r["metadata"]["path"], r["status"]) for r in found.filter("check like 'code-health%'").collect()}
    assert ("code-health-large-file", "b.py", "failed") in got and ("code-health-large-file", "c.py", "warning") in got
    assert ("code-health-long-function", "a.py", "warning") in got and ("code-health-repeated-line", "a.py", "warning") in got
    assert not any(p == "docs/d.py" for _, p, _ in got)


def test_detected_commands(spark):
    node = {"package.json": '{"scripts": {"start": "x", "test": "y", "tsc": "z"}}', "yarn.lock": "", "Cargo.toml": "[package]"}
    files = tree(spark, node).unionByName(tree(spark, {"pyproject.toml": "pytest Ruff", "uv.lock": ""}, "py")).unionByName(tree(spark, {"go.mod": "module m", "package.json": "{broken"}, "go"))
    got = {(r["repo"], r["id"]): r["command"] for r in O.merged_commands(files).collect()}
    assert got["r", "install"] == "yarn install" and got["r", "dev"] == "yarn start" and got["r", "typecheck"] == "yarn tsc" and got["r", "build"] == "cargo build"
    assert got["py", "install"] == "uv sync" and got["py", "lint"] == "uv run ruff check ." and got["py", "build"] == "TODO"
    assert got["go", "test"] == "go test ./..." and got["go", "install"] == "TODO"
    rows = O.proposed_rows(files, "docs/TESTING.md").filter("repo = 'r'").orderBy("line_index").collect()
    assert len(rows) == 6 and rows[0]["proposed"] == "| install | `yarn install` | package.json detected |"


def test_config(spark):
    text = '{"validation": {"staleActivePlanDays": "7", "placeholderTodoThreshold": 0, "requireExecPlanUsage": "yes", "placeholderPatterns": ["A", " "], "codeHealth": {"warningLines": 9}}}'
    config, found = S.read_config(spark, text)
    assert (config.stale_active_plan_days, config.placeholder_todo_threshold, config.require_exec_plan_usage, config.placeholder_patterns, config.warning_lines) == (7, 3, True, ("A",), 9)
    assert {r["metadata"]["key"] for r in found.collect()} == {"placeholder_todo_threshold", "require_exec_plan_usage"}
    assert S.read_config(spark, "{broken")[1].first()["status"] == "failed" and S.read_config(spark, None)[1].first()["status"] == "warning"


def test_manifest_and_commits(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("x")
    (tmp_path / ".hidden").write_text("")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/z.js").write_text("")
    (tmp_path / "docs/é x.md").write_text("y")
    assert {r["path"]: r["content"] for r in S.manifest(spark, str(tmp_path)).collect()} == {"docs/a.md": "x", "docs/é x.md": "y", ".hidden": "", "node_modules/z.js": ""}
    assert {r["path"] for r in S.manifest(spark, str(tmp_path), hidden=False, pruned=("node_modules",)).collect()} == {"docs/a.md", "docs/é x.md"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, env={"GIT_COMMITTER_DATE": "2020-01-01T00:00:00Z", "PATH": "/usr/bin:/bin"})
    git("init")
    git("add", "docs")
    git("commit", "-m", "x")
    got = S.change_times(S.manifest(spark, str(tmp_path)), S.commit_times(spark, str(tmp_path))).collect()
    assert {r["path"]: r["source"] for r in got if not r["path"].startswith(".git/")} == {"docs/a.md": "git_log", "docs/é x.md": "git_log", ".hidden": "fallback_last_write_time", "node_modules/z.js": "fallback_last_write_time"}
    assert {r["path"] for r in S.commit_times(spark, str(tmp_path / "docs")).collect()} == {"a.md", "é x.md"}
    assert S.commit_times(spark, str(tmp_path / "none")).count() == 0


def test_events(spark):
    """Clean checks say so, with what they looked at."""
    files = tree(spark)
    found = A.audit(files, None, NOW, maintenance=True, code_health=True)
    got = {(r["check"], r["status"]): r["metadata"] for r in A.events(files, found, maintenance=True, code_health=True).collect()}
    assert got["required-reading-summary", "success"] == {"count": "1"} and got["docs-core-document-summary", "success"] == {"count": "2"} and got["harness-prompt-summary", "success"] == {"count": "0"}
    assert got["required-reading", "success"] == {"path": "docs/WORKFLOW.md"} and got["maintenance-stale-active-plan", "success"] == {"count": "1", "thresholdDays": "14"}
    assert got["maintenance-exec-plan-usage", "success"] == {"active": "1", "completed": "0"} and got["maintenance", "complete"] == {"findings": "1"}
    assert got["code-health", "complete"] == {"scanned": "0", "findings": "0"} and ("testing-todo", "success") not in got
    assert got["validation", "success"] == {"effectiveMode": "Template", "errors": "0", "warnings": "2"} and ("validation", "start") in got


def test_applied_commands(spark, tmp_path):
    files = tree(spark, {"go.mod": "module m"})
    (tmp_path / "docs").mkdir()
    assert S.write_back(O.applied_commands(files, "docs/TESTING.md"), str(tmp_path)) == 1
    want = TABLE.replace("| test | `TODO` | n |", "| test | `go test ./...` | go.mod detected |").replace("| build | `TODO` | n |", "| build | `go build ./...` | go.mod detected |")
    assert (tmp_path / "docs/TESTING.md").read_text() == want.replace("`TODO` | n |", "`TODO` | no command detected |")
    assert {(r["metadata"].get("id"), r["status"]) for r in A.command_events(files).collect()} >= {("test", "detected"), ("lint", "not_detected")}


def test_excluded_leading_slash(spark):
    paths = spark.createDataFrame([("/src/a.py",), ("x\\gen\\a.py",), ("scripts/validate-harness.ps1",), ("src/b.py",)], "path string")
    config = S.Config(excluded_paths=("/gen/",), excluded_patterns=("/src/a*", "/"))
    assert [r[0] for r in paths.select(O.is_excluded("path", config)).collect()] == [True, True, True, False]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("found", [O.missing_references, O.present_references])
def test_places_are_not_broadcast(spark, found):
    """However small Spark thinks them: they went through the driver."""
    files = tree(spark, {"a/b/c.md": "x"})
    refs = spark.createDataFrame([("r", p) for p in ("a", "a/b", "a/b/c.md", "a/b/c", "b", "docs", "docs")], "repo string, path string")
    got = sorted(r["path"] for r in found(refs, files).collect())
    assert got == (["a/b/c", "b"] if found is O.missing_references else ["a", "a/b", "a/b/c.md", "docs", "docs"])
    assert "Broadcast" not in plan(found(refs, files))


def test_proposals_are_made_in_the_row(spark):
    """One join of rows per tree: no ranking of commands, no table of lines, nothing broadcast."""
    files = tree(spark, {"package.json": '{"scripts": {"start": "x", "tsc": "z"}}', "bun.lock": "", "Cargo.toml": "[package]"}).unionByName(tree(spark, {"docs/TESTING.md": "## Commands\n|a|\n"}, "few"))
    got = {(r["repo"], r["id"]): (r["command"], r["note"]) for r in O.merged_commands(files).collect()}
    assert got["r", "typecheck"] == ("bun tsc", "package script 'tsc'") and got["r", "build"] == ("cargo build", "Cargo.toml detected") and got["few", "test"] == ("TODO", "no command detected")
    every = sorted((r["id"], r["priority"], r["ord"]) for r in O.detected_commands(files).collect())
    assert every == [("build", 2, 2), ("dev", 0, 2), ("install", 0, 0), ("test", 2, 0), ("typecheck", 0, 7), ("typecheck", 2, 1)]
    rows = O.proposed_rows(files, "docs/TESTING.md")
    assert {r["repo"] for r in rows.collect()} == {"r"} and not {"Window", "Broadcast"} & set(re.findall("Window|Broadcast", plan(rows)))


def test_commands_are_applied_in_the_row(spark):
    files = tree(spark, {"docs/TESTING.md": "\ufeffx\r\n" + TABLE}).unionByName(tree(spark, {"docs/TESTING.md": "## Commands\n|a|\n"}, "few"))
    got = O.applied_commands(files, "docs/TESTING.md")
    assert [(r["repo"], r["content"]) for r in got.collect()] == [("r", "x\n" + TABLE.replace("`TODO` | n |", "`TODO` | no command detected |"))]
    assert not re.search("Window|Broadcast|collect_list|Aggregate.*line_index", plan(got))


def test_settings_of_trees_without_a_file_are_not_made(spark):
    """Only trees with a configuration file have settings of their own; the others share one row, and absent patterns need no expression."""
    from corpusloom.operators import settings as X

    files = tree(spark).unionByName(tree(spark, {X.PATH: '{"validation": {"staleActivePlanDays": 3}}'}, "own"))
    own = X.own_settings(files)
    assert [r["repo"] for r in own.collect()] == ["own"]
    met = X.with_settings(files.select("repo").distinct(), own, S.Config(), only=("stale_active_plan_days",))
    assert {r["repo"]: tuple(r["settings"]) for r in met.collect()} == {"r": (14,), "own": (3,)}
    assert {r["repo"]: r["state"] for r in X.settings(files).collect()} == {"r": "missing", "own": "ok"}
