"""One small source tree for every customer: files whose contents follow from its key, for queries over many trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.settings import PATH as CONFIG_PATH
from corpusloom.plans.staging import table
from corpusloom.sources.trees import Config

CONFIG = Config(
    warning_lines=5, feature_freeze_lines=9, failure_lines=12, markup_warning_lines=6, markup_feature_freeze_lines=10, markup_failure_lines=14,
    migration_warning_lines=7, migration_feature_freeze_lines=11, migration_failure_lines=15, long_function_lines=5, repeated_line_threshold=4,
)
AS_OF = "2024-01-31 00:00:00"
LINE = "const value = computeSomething(withMany, argumentsHere);"


def _k(n: int) -> Column:
    return (F.col("k") % n).cast("int")


def _fill(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values) if values else F.lit(pattern)


def _commands() -> Column:
    kind = lambda i: (F.col("k") + i) % 4
    row = lambda i: F.when(kind(i) == 0, f"| c{i} | `TODO` | n |\n").when(kind(i) == 1, f"| c{i} | `run {i}` | n |\n").when(kind(i) == 2, f"| c{i} | run {i} | n |\n").otherwise(f"| c{i} |\n")
    rows = [row(i) if i < 5 else F.when(_k(3) >= i - 4, row(i)).otherwise("") for i in range(7)]
    return F.concat(F.lit("# T\n\n## commands\n\n| Purpose | Command | Note |\n|---|---|---|\n"), *rows, F.lit("\n## Other\n| z | `TODO` | n |\n"))


def trees(spark, sf_dir: str) -> DataFrame:
    """repo, path, size, mtime, content, and k, the key of the customer."""
    n = _k(12) + 3
    lines = F.concat_ws("", F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string("x = %d\n", i)))
    middle = lambda text, times: F.repeat(F.lit(text), times)
    package = F.when(_k(14) == 0, "{broken").otherwise(F.when(_k(4) == 0, '{"scripts": {"start": "a", "lint": "b", "tsc": "c", "build": "d"}}').otherwise('{"scripts": {"start": "a", "lint": "b"}}'))
    files = [
        ("AGENTS.md", _fill("# Agents\n\n## Required Reading\n| when | `docs/w%d.md` |\n`docs/` `lost%d.md`\n## Later\n`never.md`\n", _k(3), _k(2)), None),
        ("docs/README.md", F.when(_k(5) == 0, "## Core documents\n`none.md`\n").otherwise(_fill("## Core Documents\n- `TESTING.md`\n- `w%d.md`\n- `w%d.md`\n", _k(4), _k(4))), None),
        (".harness/README.md", _fill("## Checklists\n| `a.md` | `deep/B.md` |\n## Prompts\n`p%d.md`\n", _k(3)), None),
        (".harness/checklists/a.md", F.lit("a\n"), None), (".harness/checklists/b.md", F.lit("b\n"), None), (".harness/checklists/c.md", F.lit("c\n"), _k(7) == 0),
        (".harness/checklists/deep/B.md", F.lit("B\n"), _k(2) == 0), (".harness/prompts/p1.md", F.lit("p\n"), None), ("lost0.md", F.lit(""), None), ("docs/w1.md", F.lit("w\n"), None),
        ("docs/w0.md", F.concat(F.lit("TODO FIXME "), middle("??? ", _k(3)), F.lit("TODOs\n")), None),
        ("docs/TESTING.md", _commands(), None),
        ("docs/exec-plans/active/plan.md", F.lit("plan\n"), _k(3) == 0), ("docs/exec-plans/completed/done.md", F.lit("done\n"), _k(4) == 0),
        ("docs/generated/g.md", F.when(_k(3) == 0, "Generated at: `TODO`\n").when(_k(3) == 1, "generated AT:todo\n").otherwise("Generated at: 2024\n"), None),
        ("src/big.py", lines, None), ("db/schema.sql", lines, None), ("generated/root.py", F.lit("x\n"), None),
        ("web/page.tsx", F.concat(F.lit("function g() {\n"), middle("  a;\n", n - 2), F.lit("}\n")), None),
        ("src/fun.py", F.concat(F.format_string("def f%d():\n", "k"), middle("    y\n", _k(6)), F.lit("z = 1\n")), None),
        ("src/rep.js", middle(f"{LINE}\n", _k(4) + 2), None), ("src/gone.py", F.lit(None).cast("string"), _k(10) == 0),
        *((p, F.lit("x\n"), None) for p in ("vendor/v.py", "lib/Vendor/x.py", "sub/generated/g.py", "scripts/validate-harness.ps1", "notes.txt")),
        ("package.json", package, _k(2) == 0), ("pnpm-lock.yaml", F.lit(""), _k(3) == 0), ("yarn.lock", F.lit(""), _k(5) == 0),
        ("pyproject.toml", F.lit("pytest Ruff\n"), _k(3) == 1), ("uv.lock", F.lit(""), _k(6) == 1), ("Cargo.toml", F.lit("[package]\n"), _k(5) == 0), ("go.mod", F.lit("module m\n"), _k(7) == 0),
    ]
    # paths first, contents by path: what asks for some of the files, or for paths only, makes no other contents
    paths = F.array_compact(F.array(*(F.lit(path) if when is None else F.when(when, path) for path, _, when in files)))
    content = reduce(lambda found, x: found.when(F.col("path") == x[0], x[1]), files, F)
    # a customer is a short row and many files: spread before they are made
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("repo"), F.col("c_custkey").alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    every = own.select("repo", "k", F.explode(paths).alias("path")).withColumn("content", content)
    hours = 24 * (F.col("k") % 30) + 12 * (F.col("k") % 2)
    at = F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(hours=hours.cast("int"))
    return every.select("repo", "path", F.octet_length("content").cast("long").alias("size"), at.alias("mtime"), "content", "k")


def configured(spark, sf_dir: str) -> DataFrame:
    """``trees`` with a configuration file in most: none, broken, with two bad values, or with values that follow from the customer's columns."""
    plain = F.concat(
        F.lit('{"validation": {"staleActivePlanDays": '), F.when(_k(5) == 0, F.lit(0)).otherwise(F.col("c_nationkey") + 1), F.lit(', "placeholderTodoThreshold": "'), 1 + _k(4),
        F.lit('", "placeholderPatterns": ["TODO", " ", "'), F.col("c_mktsegment"), F.lit('"], "requireExecPlanUsage": '), F.when(_k(5) == 0, '"maybe"').when(_k(2) == 0, "true").otherwise('" FALSE"'),
        F.lit(', "maintenanceFindingThreshold": 2, "codeHealth": {"warningLines": '), 4 + _k(3), F.lit(', "longFunctionLines": '), 3 + _k(5), F.lit(', "repeatedLineThreshold": '), 2 + _k(3),
        F.when(_k(3) == 0, ', "excludedPaths": ["vendor", "/src/", ""]').otherwise(""), F.lit("}}}\n"),
    )
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("repo"), F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment").filter(_k(11) != 0)
    text = F.when(_k(7) == 0, '{"validation": {').otherwise(plain)
    more = own.select("repo", F.lit(CONFIG_PATH).alias("path"), F.octet_length(text).cast("long").alias("size"), F.to_timestamp(F.lit(AS_OF)).alias("mtime"), text.alias("content"), "k")
    return trees(spark, sf_dir).unionByName(more)


def commits(files: DataFrame) -> DataFrame:
    """(repo, path, committed) of the plans of every sixth tree."""
    at = F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days=(F.col("k") % 20).cast("int"))
    return files.filter((F.col("k") % 6 == 0) & F.col("path").startswith("docs/exec-plans/active/")).select("repo", "path", at.alias("committed"))
