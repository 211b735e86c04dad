"""Operators of an audit: each takes DataFrames and returns one, lazily; severity is applied later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.settings import matching, of
from corpusloom.sources.trees import Config, is_in_folder

# Extensions whose files are code, markup, migrations.
CODE = (
    ".astro", ".bash", ".c", ".cc", ".cjs", ".cpp", ".cs", ".css", ".fish", ".go", ".h", ".hh", ".hpp", ".html", ".java", ".js", ".jsx", ".kt", ".kts", ".m",
    ".mjs", ".mm", ".php", ".ps1", ".psd1", ".psm1", ".py", ".rb", ".rs", ".sass", ".scala", ".scss", ".sh", ".sql", ".svelte", ".swift", ".ts", ".tsx", ".vue", ".zsh",
)
MARKUP = (".astro", ".css", ".html", ".jsx", ".sass", ".scss", ".svelte", ".tsx", ".vue")
MIGRATION = (".proto", ".sql")
# Lock files, and the script that audits and is no candidate itself.
LOCKS = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum", "uv.lock")
AUDITOR = "scripts/validate-harness.ps1"
# Fixed value: the pattern by which a function starts, for either engine.
FUNCTION = r"^\s*(function\s+[\w-]+|(?:export\s+)?(?:async\s+)?function\s+\w+|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|def\s+\w+\s*\()"
KEY = ["repo", "path"]


def references(files: DataFrame, source: str, heading: str, below: str = "") -> DataFrame:
    """(repo, source_path, section, ord, ref, path): backtick spans of a section, repeats kept."""
    refs = F.posexplode(T.backticks(T.section("content", heading))).alias("ord", "ref")
    found = files.filter(F.col("path") == source).select("repo", F.col("path").alias("source_path"), F.lit(heading).alias("section"), refs)
    return found.withColumn("path", reference_path("ref", below))


def reference_path(ref: Column | str, below: str = "") -> Column:
    """The path that a reference stands for, from the root of the tree."""
    return F.concat(F.lit(f"{below}/" if below else ""), F.regexp_replace(T.col(ref), "^/+|/+$", ""))


def places(files: DataFrame) -> DataFrame:
    """(repo, path) of every file and of every folder that holds one, folders once for each of their files."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.call_function("substring_index", F.col("path"), F.lit("/"), n))
    return files.select("repo", F.explode(up).alias("path"))


def missing_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose path is no place. Places are many times what Spark expects of a table, so no join may broadcast them."""
    return refs.join(places(files).hint("merge"), KEY, "left_anti")


def present_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    return refs.join(places(files).hint("merge"), KEY, "left_semi")


def registered_names(files: DataFrame, source: str, heading: str) -> DataFrame:
    """(repo, name): distinct base names that a section refers to, in lower case."""
    return references(files, source, heading).select("repo", F.lower(T.name("ref")).alias("name")).distinct()


def unregistered(files: DataFrame, listed: DataFrame, registered: DataFrame) -> DataFrame:
    """Rows of ``listed`` (files) whose name no section registers; case does not count."""
    return listed.withColumn("name", F.lower(T.name("path"))).join(registered, ["repo", "name"], "left_anti").drop("name")


def placeholder_density(texts: DataFrame, patterns: list[str], threshold: int, content: str = "content") -> DataFrame:
    return texts.withColumn("placeholders", T.placeholders(content, patterns)).filter(F.col("placeholders") >= threshold)


def repeated(content: Column | str, threshold: Column | int, min_length: int = 40, top: int = 5) -> Column:
    """array<struct<line, repeats, rank>>: the most repeated lines of a text, counted inside the row.

    Lines are squeezed and told apart without case, and named by their first
    spelling; short ones and ones of brackets and signs only do not count. Ties are
    ranked by the line.
    """
    least = F.lit(threshold) if isinstance(threshold, int) else threshold
    # what is too short before it is squeezed cannot be long enough after
    squeezed = F.transform(F.filter(T.lines(content), lambda x: F.length(x) >= min_length), T.squeeze)
    kept = F.filter(squeezed, lambda x: (F.length(x) >= min_length) & ~x.rlike(r"^[{}\[\]();,]+$"))
    placed = F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("folded"), i.alias("at"), x.alias("line")))
    run = lambda folded, n, line, out: F.struct(folded.alias("folded"), n.alias("n"), line.alias("line"), out.alias("out"))
    entry = lambda s: F.struct((-s["n"]).alias("order"), s["folded"].alias("folded"), s["line"].alias("line"))
    closed = lambda s: F.when(s["n"] >= least, F.array_append(s["out"], entry(s))).otherwise(s["out"])
    start = run(F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(None).cast("string"), F.array().cast("array<struct<order:bigint,folded:string,line:string>>"))
    step = lambda s, x: F.when(s["folded"] == x["folded"], run(s["folded"], s["n"] + 1, s["line"], s["out"])).otherwise(run(x["folded"], F.lit(1).cast("long"), x["line"], closed(s)))
    none = F.array().cast("array<struct<order:bigint,folded:string,line:string>>")
    # most texts repeat nothing: there the count of distinct lines is that of all
    many = lambda x: F.size(x) - F.size(F.array_distinct(x["folded"])) >= least - 1
    counted = T.let(placed, lambda x: F.when(many(x), F.aggregate(F.sort_array(x), start, step, closed)).otherwise(none))
    return F.transform(F.slice(F.sort_array(counted), 1, top), lambda x, i: F.struct(x["line"].alias("line"), (-x["order"]).alias("repeats"), (i + 1).alias("rank")))


def repeated_lines(texts: DataFrame, key: list[str], threshold: int, min_length: int = 40, top: int = 5, content: str = "content") -> DataFrame:
    """The most repeated lines of each text: key, line (first spelling), repeats, rank. No shuffle: a text is counted where it lies."""
    return texts.select(*key, F.inline(repeated(content, threshold, min_length, top)))


def thresholds(path: Column | str, config: Config | Column) -> Column:
    """STRUCT<category, warning, freeze, failure> by extension or folder; the first that fits."""
    own = of(config)
    level = lambda category, kind: F.struct(F.lit(category).alias("category"), *(own[f"{kind}{x}_lines"].alias(y) for x, y in (("warning", "warning"), ("feature_freeze", "freeze"), ("failure", "failure"))))
    ext = T.extension(path)
    migration = ext.isin(*MIGRATION) | F.lower(T.col(path)).contains("/migrations/")
    return F.when(migration, level("migration_or_schema", "migration_")).when(ext.isin(*MARKUP), level("markup_or_component", "markup_")).otherwise(level("default_code", ""))


def tier(n: Column | str, limits: Column) -> Column:
    n = T.col(n)
    return F.when(n >= limits["failure"], "failure").when(n >= limits["freeze"], "feature_freeze").when(n >= limits["warning"], "warning").otherwise("ok")


def is_excluded(path: Column | str, config: Config | Column) -> Column:
    """Excluded by path, path segment, wildcard or lock-file name; slashes at the start do not count."""
    own, path = of(config), F.ltrim(T.slashes(path), F.lit("/"))

    def fits(p: Column) -> Column:
        whole, low, segments = p["path"], p["low"], p["segments"]
        by_name = F.element_at(segments, -1).isin([x.lower() for x in LOCKS]) | (low == AUDITOR)
        # what is one name is a segment wherever it is the whole path or its start
        by_path = F.arrays_overlap(segments, F.transform(own["prefixes"], F.lower)) | F.exists(own["prefixes"], lambda x: x.contains("/") & ((low == F.lower(x)) | whole.startswith(F.concat(x, F.lit("/")))))
        return by_name | by_path | F.exists(own["rules"], lambda r: matching(whole, segments, r))

    return T.let(F.struct(path.alias("path"), F.lower(path).alias("low"), F.split(F.lower(path), "/").alias("segments")), fits)


def is_code(path: Column | str) -> Column:
    return T.extension(path).isin(*CODE)


def code_files(files: DataFrame, config: Config | Column) -> DataFrame:
    return files.filter(is_code("path") & ~is_excluded("path", config))


def sized(files: DataFrame, config: Config | Column) -> DataFrame:
    """Code files that can be read, with n_lines, limits and tier."""
    n = files.filter("content is not null").withColumn("n_lines", F.size(T.lines("content"))).withColumn("limits", thresholds("path", config))
    return n.withColumn("tier", tier("n_lines", F.col("limits")))


def looked_into(sized: DataFrame) -> DataFrame:
    """Files below the freeze and failure tiers: larger ones are reported and not looked into."""
    return sized.filter(F.col("tier").isin("ok", "warning"))


def functions(content: Column | str) -> Column:
    """array<struct<name, start_line, lines>>: the functions of a text, by braces or indentation, in one fold over its lines.

    The ending line counts. One function is open at a time, and the line that
    ends it starts no other; a start whose braces balance counts as one open
    brace. Both are part of the definition.
    """
    sign = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    width = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    one = lambda x, i: F.struct(i.alias("at"), (sign(x, "{") - sign(x, "}")).alias("balance"), width(x).alias("width"), (~T.blank(x)).alias("full"), F.regexp_extract(x, f"(?iU){FUNCTION}", 1).alias("name"), x.rlike(r"(?iU)^\s*def\s").alias("by_indent"))
    kinds = {"start": "int", "name": "string", "by_indent": "boolean", "width": "int", "depth": "int", "out": "array<struct<name:string,start_line:int,lines:int>>", "last": "int"}
    state = lambda **new: F.struct(*(new[k].cast(kind).alias(k) for k, kind in kinds.items()))
    none = {"start": F.lit(None), "name": F.lit(None), "by_indent": F.lit(False), "width": F.lit(0), "depth": F.lit(0)}
    begin = lambda x: state(**none, out=F.array(), last=F.size(x) - 1)

    def step(s: Column, x: Column) -> Column:
        keep = {"out": s["out"], "last": s["last"]}
        opened = state(start=x["at"], name=T.strip(x["name"]), by_indent=x["by_indent"], width=x["width"], depth=F.when((x["balance"] > 0) | x["by_indent"], x["balance"]).otherwise(1), **keep)
        depth = s["depth"] + x["balance"]
        ended = F.when(s["by_indent"], x["full"] & (x["width"] <= s["width"])).otherwise(depth <= 0) | (x["at"] == s["last"])
        found = F.struct(s["name"].alias("name"), (s["start"] + 1).alias("start_line"), (x["at"] - s["start"] + 1).alias("lines"))
        closed = state(**none, out=F.array_append(s["out"], found), last=s["last"])
        goes_on = s.withField("depth", depth)
        return F.when(s["start"].isNull(), F.when(x["name"] != "", opened).otherwise(s)).otherwise(F.when(ended, closed).otherwise(goes_on))

    # most texts start no function
    return F.when(T.col(content).rlike(f"(?imU){FUNCTION}"), T.let(T.lines(content), lambda x: F.aggregate(F.transform(x, one), begin(x), step, lambda s: s["out"]))).otherwise(F.array().cast(kinds["out"]))


def long_functions(files: DataFrame, threshold: int) -> DataFrame:
    """(repo, path, name, start_line, lines) of functions with at least ``threshold`` lines."""
    return files.select(*KEY, F.inline(F.filter(functions("content"), lambda f: f["lines"] >= threshold)))


def is_generated_todo(content: Column | str) -> Column:
    return T.col(content).rlike(r"(?i)Generated at:\s*`?TODO`?")


def generated_todo(files: DataFrame) -> DataFrame:
    return files.filter(is_generated_todo("content"))


def plan_usage(files: DataFrame, active: str, completed: str) -> DataFrame:
    """(repo, active, completed): plans of either kind in every tree."""
    of = lambda p: F.count_if(is_in_folder(p)).alias
    return files.groupBy("repo").agg(of(active)("active"), of(completed)("completed"))


def stale(changes: DataFrame, as_of: Column, days: int | Column, at: str = "value") -> DataFrame:
    """Rows that changed strictly before ``days`` days ago, with their age."""
    cutoff = as_of - F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)
    return changes.filter(F.col(at) < cutoff).withColumn("age_days", T.age_days(at, as_of))


def command_table(content: Column | str, heading: str = "Commands") -> Column:
    """array<struct<row_index, line_index, line, cells>> of the pipe table under ``## heading``, in one fold over the lines.

    A repeated heading inside the section continues it. Rows start with a pipe
    in the first column and follow a separator row; separator rows are none.
    """
    kinds = {"inside": "boolean", "ended": "boolean", "ruled": "boolean", "out": "array<struct<line_index:int,line:string>>"}
    state = lambda s, **new: F.struct(*((new[k] if k in new else s[k]).cast(kind).alias(k) for k, kind in kinds.items()))
    begin = state(None, inside=F.lit(False), ended=F.lit(False), ruled=F.lit(False), out=F.array())
    rows = F.transform(T.lines(content), lambda x, i: F.struct(i.alias("at"), x.alias("line")))

    def step(s: Column, x: Column) -> Column:
        line = x["line"]
        row = F.struct(x["at"].alias("line_index"), line.alias("line"))
        # most lines start like neither a heading nor a row, and need no expression
        title = F.when(line.rlike(rf"(?i)^##\s+{T.escape(heading)}\s*$"), state(s, inside=F.lit(True))).when(s["inside"] & line.rlike(r"^##\s+"), state(s, ended=F.lit(True))).otherwise(s)
        inner = F.when(line.rlike(r"^\|\s*-"), state(s, ruled=F.lit(True))).when(s["ruled"], state(s, out=F.array_append(s["out"], row))).otherwise(s)
        return F.when(s["ended"], s).when(line.startswith("##"), title).when(s["inside"] & line.startswith("|"), inner).otherwise(s)

    found = F.aggregate(rows, begin, step, lambda s: s["out"])
    return F.transform(found, lambda x, i: F.struct(i.alias("row_index"), x["line_index"].alias("line_index"), x["line"].alias("line"), T.cells(x["line"]).alias("cells")))


def command_rows(files: DataFrame, heading: str = "Commands") -> DataFrame:
    """(repo, path, row_index, line_index, line, cells) of the pipe table under ``## heading`` of each file."""
    return files.select(*KEY, F.inline(command_table("content", heading)))


def is_todo_row(line: Column) -> Column:
    """Is the command of a table row still a TODO? Its cell has to be closed by a pipe."""
    return line.rlike(r"(?i)^\|\s*[^|]+\|\s*`TODO`\s*\|")


def todo_rows(rows: DataFrame) -> DataFrame:
    """(repo, n): table rows of each tree whose command is still a TODO, all of them, not the first six only."""
    return rows.filter(is_todo_row(F.col("line"))).groupBy("repo").agg(F.count("*").alias("n"))


def bad_command_rows(files: DataFrame, rows: DataFrame, required: int = 6) -> DataFrame:
    """(repo, path, row_index, reason, value): too few rows (nothing else is reported then), arity below 3, command without backticks."""
    counts = files.select(*KEY).join(rows.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").fillna(0, ["n"])
    few = counts.filter(F.col("n") < required).select(*KEY, F.lit(None).cast("int").alias("row_index"), F.lit("missing_command_rows").alias("reason"), F.col("n").cast("string").alias("value"))
    enough = rows.join(counts.filter(F.col("n") >= required).select(*KEY), KEY).filter(F.col("row_index") < required)
    command = F.get("cells", F.lit(1))
    reason = F.when(F.size("cells") < 3, "malformed_command_row").when(~command.rlike("^`[^`]+`$"), "command_cell_must_be_backticked")
    return few.unionByName(enough.select(*KEY, "row_index", reason.alias("reason"), command.alias("value")).filter("reason is not null"))


def first_by_priority(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("rank__ = 1").drop("rank__")


# Fixed values, here and in the notes of ``detected_commands``: command ids, commands and what is said of them.
COMMANDS = ("install", "dev", "test", "lint", "typecheck", "build")
# Script names by command, in order of preference.
SCRIPTS = (("dev", "dev"), ("dev", "start"), ("test", "test"), ("lint", "lint"), ("typecheck", "typecheck"), ("typecheck", "type-check"), ("typecheck", "tsc"), ("build", "build"))


ROOTS = ("package.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock", "pyproject.toml", "uv.lock", "poetry.lock", "Cargo.toml", "go.mod")
TOOLS = (("test", "pytest", ""), ("lint", "ruff", " check ."), ("typecheck", "mypy", " ."))


def _clues(files: DataFrame) -> DataFrame:
    """One row of truth values per tree: what its root files tell. Texts do not travel, and no sort is needed to group; of files that share a path all count."""
    at = lambda p: F.col("path") == p
    py = at("pyproject.toml") & F.col("content").isNotNull()
    clues = {"node": F.col("package").isNotNull(), "py": py} | {p: at(p) for p in ROOTS if p not in ("package.json", "pyproject.toml")}
    clues |= {f"script {x}": F.get_json_object("package", f"$.scripts['{x}']").isNotNull() for _, x in SCRIPTS} | {f"tool {x}": py & F.col("content").rlike(f"(?i){x}") for _, x, _ in TOOLS}
    roots = files.filter(F.col("path").isin(*ROOTS)).withColumn("package", F.when(at("package.json") & F.try_parse_json("content").isNotNull(), F.col("content")))
    # trees without any of these files have a row too
    rows = roots.select("repo", *(c.alias(k) for k, c in clues.items())).unionByName(files.select("repo", *(F.lit(False).alias(k) for k in clues)))
    return rows.groupBy("repo").agg(*(F.coalesce(F.max(F.col(f"`{k}`")), F.lit(False)).alias(k) for k in clues))


def _suggestions() -> list[tuple[str, int, int, Column]]:
    """(id, priority, ord, struct<command, note> or null) of all that the clues of a tree can suggest, the first choice first."""
    has = lambda p: F.col(f"`{p}`")
    rows = []

    def add(priority: int, order: int, command_id: str, when: Column, command: Column, note: Column | str) -> None:
        note = F.lit(note) if isinstance(note, str) else note
        rows.append((command_id, priority, order, F.when(when, F.struct(command.alias("command"), note.alias("note")))))

    manager = F.when(has("pnpm-lock.yaml"), "pnpm").when(has("yarn.lock"), "yarn").when(has("bun.lockb") | has("bun.lock"), "bun").otherwise("npm")
    add(0, 0, "install", has("node"), F.concat(manager, F.lit(" install")), "package.json detected")
    for k, (command_id, script) in enumerate(SCRIPTS, 1):
        run = F.concat(F.when(manager == "npm", "npm run ").otherwise(F.concat(manager, F.lit(" "))), F.lit(script))
        add(0, k, command_id, has("node") & has(f"script {script}"), run, f"package script '{script}'")
    uv, poetry = has("uv.lock"), has("poetry.lock")
    runner = F.when(uv, "uv run").when(poetry, "poetry run").otherwise("python -m")
    add(1, 0, "install", has("py"), F.when(uv, "uv sync").when(poetry, "poetry install").otherwise("python -m pip install -e ."), F.when(uv, "uv.lock detected").when(poetry, "poetry.lock detected").otherwise("pyproject.toml detected"))
    for k, (command_id, tool, rest) in enumerate(TOOLS, 1):
        add(1, k, command_id, has(f"tool {tool}"), F.concat(runner, F.lit(f" {tool}{rest}")), f"{tool} detected")
    for k, (command_id, command) in enumerate((("test", "cargo test"), ("typecheck", "cargo check"), ("build", "cargo build"))):
        add(2, k, command_id, has("Cargo.toml"), F.lit(command), "Cargo.toml detected")
    for k, (command_id, command) in enumerate((("test", "go test ./..."), ("build", "go build ./..."))):
        add(3, k, command_id, has("go.mod"), F.lit(command), "go.mod detected")
    return rows


def detected_commands(files: DataFrame) -> DataFrame:
    """(repo, id, priority, ord, command, note): every command that the files of each tree suggest."""
    one = lambda i, p, o, x: F.when(x.isNotNull(), F.struct(F.lit(i).alias("id"), F.lit(p).alias("priority"), F.lit(o).alias("ord"), x["command"].alias("command"), x["note"].alias("note")))
    return _clues(files).select("repo", F.inline(F.array_compact(F.array(*(one(*x) for x in _suggestions())))))


def _commands(files: DataFrame) -> DataFrame:
    """(repo, commands): the first suggestion for each of the six ids of every tree as one array, TODO where none is known."""
    none = F.struct(F.lit("TODO").alias("command"), F.lit("no command detected").alias("note"))
    first = [F.coalesce(*(x for i, _, _, x in _suggestions() if i == command_id), none) for command_id in COMMANDS]
    named = [F.struct(F.lit(i).alias("id"), x["command"].alias("command"), x["note"].alias("note")) for i, x in zip(COMMANDS, first, strict=True)]
    return _clues(files).select("repo", F.array(*named).alias("commands"))


def merged_commands(files: DataFrame) -> DataFrame:
    """(repo, place, id, command, note): the first command for each of the six ids of every tree, TODO where none is known."""
    return _commands(files).select("repo", F.posexplode("commands").alias("place", "x")).select("repo", "place", "x.*")


def _proposals(files: DataFrame, path: str) -> DataFrame:
    """(repo, path, content, proposed) of the files at ``path`` whose table has six rows or more; proposed: array<struct<line_index, line, proposed>> of the first six."""
    met = files.filter(F.col("path") == path).select(*KEY, "content").join(_commands(files).hint("merge"), "repo")
    line = lambda r, x: F.format_string("| %s | `%s` | %s |", F.get(r["cells"], F.lit(0)), x["command"], x["note"])
    one = lambda r: F.struct(r["line_index"].alias("line_index"), r["line"].alias("line"), line(r, F.get("commands", r["row_index"])).alias("proposed"))
    # exploded, not filtered: a filter would make the table twice
    rows = T.let(command_table("content"), lambda rows: F.when(F.size(rows) >= len(COMMANDS), F.array(F.transform(F.slice(rows, 1, len(COMMANDS)), one))))
    return met.select(*KEY, "content", F.explode(rows).alias("proposed"))


def proposed_rows(files: DataFrame, path: str) -> DataFrame:
    """(repo, path, line_index, line, proposed): the first six table rows with the merged commands in their place; fewer than six: none."""
    return _proposals(files, path).select(*KEY, F.inline("proposed"))


def applied_commands(files: DataFrame, path: str) -> DataFrame:
    """(repo, path, content): the files at ``path`` with the proposed rows written into their tables; the rest of their lines as before."""
    new = lambda i: F.get(F.filter("proposed", lambda p: p["line_index"] == i), F.lit(0))["proposed"]
    lines = F.transform(T.lines("content"), lambda x, i: F.coalesce(new(i), x))
    return _proposals(files, path).select(*KEY, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
