import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import drift as D
from corpusloom.operators import graph as G
from corpusloom.operators import settings as S
from corpusloom.sources.trees import FILES, Config

EDGES = "repo string, source string, target string"


def files_of(spark, tree, repo="r"):
    return spark.createDataFrame([(repo, p, len(c or ""), None, c) for p, c in tree.items()], FILES)


def brute_reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 6, 5), (2, 9, 14), (3, 8, 8)])
def test_graphs_by_brute_force(spark, seed, n, m):
    draw = random.Random(seed)
    edges = {r: {(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(m)} for r in ("x", "y")}
    rows = [(r, *e) for r, es in edges.items() for e in es] * 2 + [("x", None, "n1")]
    df = spark.createDataFrame(rows, EDGES)
    want = set()
    for r, es in edges.items():
        reach = {f"n{i}": brute_reach(es, f"n{i}") for i in range(n)}
        want |= {(r, x, min(y for y in reach[x] if x in reach[y])) for x in reach if x in reach[x]}
    got = [tuple(x) for x in G.cycles(df).collect()]
    assert set(got) == want and len(got) == len(want)
    roots = spark.createDataFrame([("x", "n0"), ("x", "n0"), ("x", None), ("z", "lonely")], "repo string, node string")
    assert {tuple(x) for x in G.reached(df, roots).collect()} == {("x", "n0"), ("z", "lonely")} | {("x", b) for b in brute_reach(edges["x"], "n0")}


def test_long_chain_has_no_cycle(spark):
    df = spark.createDataFrame([("r", f"a{i}", f"a{i + 1}") for i in range(4)] + [("r", "b", "b")], EDGES)
    assert [tuple(x) for x in G.cycles(df).collect()] == [("r", "b", "b")]
    assert G.cycles(df.limit(0)).count() == 0 and G.reached(df.limit(0), df.select("repo", F.col("source").alias("node")).limit(0)).count() == 0


def test_unused_documents(spark):
    tree = {
        "AGENTS.md": "`docs/a.md` [b](docs/b.md#part) `missing.md`", "docs/README.md": "x", "docs/a.md": "see [c](../deep/c.md) `./d.md`", "docs/b.md": "`b.md`", "deep/c.md": "`docs/a.md`",
        "docs/d.md": "", "docs/lost.md": "`also.md`", "docs/also.md": "`lost.md`", "code.py": "x", ".harness/README.md": "`one.md`", ".harness/prompts/one.md": "1", ".harness/prompts/two.md": None,
    }
    assert {r["path"] for r in D.unused_documents(files_of(spark, tree)).collect()} == {"docs/lost.md", "docs/also.md", ".harness/prompts/two.md"}
    assert D.unused_documents(files_of(spark, tree).limit(0)).count() == 0


def test_imports_and_layers(spark):
    tree = {
        "src/ui/page.tsx": "import { x } from '../service/run'\nimport '../infrastructure/db.js'\nconst y = require(\"./part\")\n", "src/ui/part/index.ts": "export const a = 1\n", "src/service/run.ts": "import d from \"../domain/rule\"\n",
        "src/infrastructure/db.js": "from '../ui/page'\n", "src/domain/rule.ts": "import e from '../../../../out'\nimport { db } from '../infrastructure/db'\n", "app/domain/m.py": "from app.infrastructure.store import S\nimport os\nfrom . import n\nfrom .n import z\n",
        "app/infrastructure/store.py": "import app.domain.m\n", "app/domain/n.py": None, "other.py": "from app.domain import m\n",
    }
    files = files_of(spark, tree)
    edges = {(r["source"], r["target"]) for r in D.import_edges(files).collect()}
    assert edges == {
        ("src/ui/page.tsx", "src/service/run.ts"), ("src/ui/page.tsx", "src/infrastructure/db.js"), ("src/ui/page.tsx", "src/ui/part/index.ts"), ("src/service/run.ts", "src/domain/rule.ts"), ("src/infrastructure/db.js", "src/ui/page.tsx"),
        ("src/domain/rule.ts", "src/infrastructure/db.js"), ("app/domain/m.py", "app/infrastructure/store.py"), ("app/domain/m.py", "app/domain/n.py"), ("app/infrastructure/store.py", "app/domain/m.py"),
    }
    crossing = {(r["source_layer"], r["target_layer"]) for r in D.crossing_imports(files).collect()}
    assert crossing == {("ui", "infrastructure"), ("infrastructure", "ui"), ("domain", "infrastructure"), ("infrastructure", "domain")}
    assert {r["node"] for r in G.cycles(D.import_edges(files)).collect()} == {"src/ui/page.tsx", "src/service/run.ts", "src/domain/rule.ts", "src/infrastructure/db.js", "app/domain/m.py", "app/infrastructure/store.py"}


def test_placeholders_and_leftovers(spark):
    texts = spark.createDataFrame([(1, "a TODO here\nTODOs\n"), (2, "A  todo TODO\n a   TODO here\n"), (3, None), (4, "A TODO HERE")], "k int, content string")
    assert [tuple(r) for r in D.shared_placeholders(texts, ["k"], ["TODO", " "], 2).collect()] == [("TODO", "a todo here", 3, (1,))]
    tree = {"a.js": "function used() {}\nfunction gone() {}\nconst arrow = (x) => 1\nconsole.log(1)\n", "b.js": "used(); debugger;\n  debugger;\n", "c.py": "def twice():\n  print('x')\ndef helper(): pass\n", "d.py": "def twice(): pass\nx = printer(1)\n", "n.md": "gone() console.log(2)"}
    assert {(r["path"], r["name"]) for r in D.unused_functions(files_of(spark, tree)).collect()} == {("a.js", "gone"), ("a.js", "arrow"), ("c.py", "twice"), ("d.py", "twice"), ("c.py", "helper")}
    assert {(r["path"], r["line_number"]) for r in D.debug_lines(files_of(spark, tree)).collect()} == {("a.js", 4), ("b.js", 2), ("c.py", 2)}


def test_titles(spark):
    titles = ["feat(chat): add flow", "fix: no scope", "new(x): y", "[fix] resolve bug", "[fix]none", "docs(a b): c\nd", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "k int, t string").select("k", D.commit_title("t").alias("c"), D.pull_title("t").alias("p")).orderBy("k").collect()
    assert [r["c"] and tuple(r["c"]) for r in got] == [("feat", "chat", "add flow"), None, None, None, None, None, None]
    assert [r["p"] and tuple(r["p"]) for r in got] == [None, None, None, ("fix", "resolve bug"), None, None, None]


def test_settings_of_trees(spark):
    texts = {"none": None, "broken": "{", "empty": "", "other": '{"a": 1}', "scalar": "5", "all": '{"validation": {"staleActivePlanDays": " 7 ", "placeholderPatterns": "X", "requireExecPlanUsage": "False", "codeHealth": {"warningLines": -1, "failureLines": null, "excludedPatterns": [], "excludedPaths": ["/a/", " "]}}}'}
    files = spark.createDataFrame([(r, "x.py", 1, None, "x") for r in texts] + [(r, S.PATH, 1, None, t) for r, t in texts.items() if t is not None], FILES)
    got = {r["repo"]: r for r in S.settings(files, Config(stale_active_plan_days=3)).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"none": "missing", "broken": "invalid", "empty": "invalid", "other": "ok", "scalar": "ok", "all": "faulty"}
    s = got["all"]["settings"]
    assert (s["stale_active_plan_days"], s["placeholder_patterns"], s["require_exec_plan_usage"], s["warning_lines"], s["failure_lines"], s["excluded_patterns"], s["prefixes"], s["rules"]) == (7, ["X"], False, 500, 1200, [], ["a"], [])
    assert [f["metadata"] for f in got["all"]["found"]] == [{"path": S.PATH, "reason": "invalid_positive_integer", "key": "codeHealthWarningLines", "value": "-1"}]
    assert got["none"]["settings"]["stale_active_plan_days"] == 3 and len(got["none"]["settings"]["excluded_paths"]) == 8
    assert S.settings(files.limit(0)).count() == 0


def test_matches(spark):
    paths = spark.createDataFrame([("r", "a/gen/x.py"), ("r", "/A/GEN/y.lock"), ("r", "gen.lock"), ("s", "a/gen/x.py"), ("s", "a/gen/x.py"), ("r", None)], "repo string, path string")
    patterns = spark.createDataFrame([("r", "*/gen/*"), ("r", "*/gen/*"), ("r", "**/*.lock"), ("r", "g?n*"), ("r", "[ab]/gen/x.py"), ("s", "*"), ("s", " "), ("s", None), ("t", "*")], "repo string, pattern string")
    got = sorted(map(tuple, S.matches(paths, patterns, ["repo"]).collect()))
    assert got == sorted([("r", "a/gen/x.py", "*/gen/*"), ("r", "/A/GEN/y.lock", "*/gen/*"), ("r", "/A/GEN/y.lock", "**/*.lock"), ("r", "gen.lock", "g?n*"), ("r", "a/gen/x.py", "[ab]/gen/x.py"), ("s", "a/gen/x.py", "*"), ("s", "a/gen/x.py", "*")])
