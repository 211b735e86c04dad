"""Signs of drift in trees: unused documents, imports against the direction of layers, shared placeholders, leftovers in code, and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.audit import is_code
from corpusloom.operators.graph import reached
from corpusloom.plans.staging import stage

# Documents that all others are found from, folders that entries of a register lie in.
ROOTS = ("AGENTS.md", "docs/README.md", ".harness/README.md")
BELOW = {".harness/README.md": (".harness/checklists", ".harness/prompts")}
# Layers by folder name, and which may depend on which.
LAYERS = {"ui": "ui", "presentation": "ui", "application": "application", "service": "application", "services": "application", "domain": "domain", "business": "domain", "infrastructure": "infrastructure"}
ALLOWED = (("ui", "application"), ("application", "domain"), ("application", "infrastructure"))
# Types of commits and of pull requests.
TYPES = ("feat", "fix", "refactor", "docs", "style", "test", "chore", "perf")
# Endings that an import may leave out.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".py")


def normal_path(path: Column) -> Column:
    """``path`` without empty, ``.`` and ``..`` parts; null where it leaves the root."""
    start = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", up(done)).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def folder_of(path: Column | str) -> Column:
    """The folder of a path with a slash at its end; empty at the root."""
    return F.regexp_extract(T.col(path), r"^(.*/)[^/]*$", 1)


def document_edges(files: DataFrame) -> DataFrame:
    """(repo, source, target): files that documents name, in backticks or as targets of links.

    A name counts from the root, from the document's folder, or from the folders
    of its register.
    """
    targets = F.regexp_extract_all("content", F.lit(r"\]\(([^)#?\s]+)"), 1)
    below = F.coalesce(*(F.when(F.col("path") == source, F.array(*(F.lit(f"{x}/") for x in more))) for source, more in BELOW.items()), F.array().cast("array<string>"))
    bases = F.concat(F.array(F.lit(""), folder_of("path")), below)
    rows = files.filter(F.lower("path").endswith(".md")).select("repo", F.col("path").alias("source"), F.explode(F.array_distinct(F.concat(T.backticks("content"), targets))).alias("ref"), bases.alias("bases"))
    tried = rows.select("repo", "source", F.explode(F.array_distinct(F.transform("bases", lambda b: normal_path(F.concat(b, F.col("ref")))))).alias("target"))
    return tried.filter("target <> source").join(files.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_semi").select("repo", "source", "target")


def unused_documents(files: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """(repo, path): documents that no chain of references leads to from the index files."""
    known = reached(document_edges(files), files.filter(F.col("path").isin(*roots)).select("repo", F.col("path").alias("node")))
    return files.filter(F.lower("path").endswith(".md")).select("repo", "path").join(known.withColumnRenamed("node", "path"), ["repo", "path"], "left_anti")


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, source, target): files that code files import, for Python modules and for quoted paths.

    Modules count from the root or from the file's folder, with a dot for each
    folder; quoted paths from the folder if they start with a dot, else from the
    root. Endings and index files may be left out.
    """
    code = files.filter(is_code("path") & F.col("content").isNotNull())
    modules = F.concat(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"), 1), F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*import[ \t]+([\w.]+)[ \t]*(?:as[ \t]+\w+[ \t]*)?(?:#.*)?$"), 1))
    dotted = F.transform(modules, lambda m: F.concat(F.when(m.startswith("."), F.concat(F.lit("./"), F.repeat(F.lit("../"), F.length(F.regexp_extract(m, r"^(\.+)", 1)) - 1))).otherwise(""), F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))))
    quoted = F.regexp_extract_all("content", F.lit("""(?:\\bfrom|\\bimport|\\brequire\\s*\\()\\s*['"]([^'"\\n]+)['"]"""), 1)
    rows = code.select("repo", F.col("path").alias("source"), F.explode(F.array_distinct(F.concat(dotted, quoted))).alias("ref"))
    own = folder_of("source")
    starts = F.when(F.col("ref").startswith("."), F.array(F.concat(own, F.col("ref")))).otherwise(F.array(F.col("ref"), F.concat(own, F.col("ref"))))
    based = rows.select("repo", "source", F.explode(F.filter(F.transform(starts, normal_path), lambda x: x != "")).alias("base"))
    ends = F.array(F.lit(""), *(F.lit(e) for e in ENDINGS), *(F.lit(f"/index{e}") for e in ENDINGS[:-1]), F.lit("/__init__.py"))
    tried = based.select("repo", "source", F.explode(F.transform(ends, lambda e: F.concat("base", e))).alias("target")).filter("target <> source").distinct()
    return tried.join(files.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_semi").select("repo", "source", "target")


def layer_of(path: Column | str, layers: dict[str, str] | None = None) -> Column:
    """The layer of the first folder of a path that names one; null if none does."""
    known = F.create_map(*(F.lit(x) for pair in (layers or LAYERS).items() for x in pair))
    folders = F.split(F.lower(folder_of(path)), "/")
    return F.get(F.filter(F.transform(folders, lambda x: known[x]), lambda x: x.isNotNull()), F.lit(0))


def layer_violations(edges: DataFrame, allowed: tuple[tuple[str, str], ...] = ALLOWED) -> DataFrame:
    """The rows of ``edges`` (source_layer and target_layer among their columns) that lead from one layer to another it may not depend on."""
    pair = F.concat_ws("\x01", "source_layer", "target_layer")
    known = F.col("source_layer").isNotNull() & F.col("target_layer").isNotNull() & (F.col("source_layer") != F.col("target_layer"))
    return edges.filter(known & ~pair.isin(*("\x01".join(x) for x in allowed)))


def crossing_imports(files: DataFrame) -> DataFrame:
    """(repo, source, target, source_layer, target_layer): imports against the direction of layers."""
    edges = import_edges(files)
    return layer_violations(edges.withColumns({"source_layer": layer_of("source"), "target_layer": layer_of("target")}))


def shared_placeholders(texts: DataFrame, key: list[str], patterns: list[str], least: int = 2, content: str = "content") -> DataFrame:
    """(pattern, context, n_texts, first): lines with a placeholder that at least ``least`` texts have, case and white space apart.

    An inverted index from the context to its texts, of which counts and the
    smallest key travel only. A line counts once a text.
    """
    spelled = texts.filter(T.placeholders(content, patterns) > 0)
    of = lambda p: F.when(T.placeholders("line", [p]) > 0, F.lit(p))
    rows = spelled.select(*key, F.explode(T.lines(content)).alias("line")).select(*key, "line", F.explode(F.array_compact(F.array(*(of(p) for p in patterns if p.strip())))).alias("pattern"))
    once = rows.select(*key, "pattern", F.lower(T.squeeze("line")).alias("context")).distinct()
    return once.groupBy("pattern", "context").agg(F.count("*").alias("n_texts"), F.min(F.struct(*key)).alias("first")).filter(F.col("n_texts") >= least)


def defined_names(content: Column | str) -> Column:
    """Names of the functions that a text defines, one for each definition."""
    plain = F.regexp_extract_all(T.col(content), F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|def)[ \t]+([A-Za-z_$][\w$]*)"), 1)
    arrow = F.regexp_extract_all(T.col(content), F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?:async[ \t]*)?\([^)\n]*\)[ \t]*=>"), 1)
    return F.concat(plain, arrow)


def unused_functions(files: DataFrame) -> DataFrame:
    """(repo, path, name): functions whose name stands nowhere in their tree's code but where they are defined."""
    code = files.filter(is_code("path") & F.col("content").isNotNull())
    defined = stage(code.select("repo", "path", F.explode(defined_names("content")).alias("name")), "defined-names")
    total = defined.groupBy("repo", "name").agg(F.count("*").alias("n_defined"))
    words = code.select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][\w$]*)"), 1)).alias("name"))
    seen = words.join(total.select("repo", "name"), ["repo", "name"], "left_semi").groupBy("repo", "name").agg(F.count("*").alias("n"))
    once = total.join(seen, ["repo", "name"]).filter("n = n_defined").select("repo", "name")
    return defined.join(once, ["repo", "name"], "left_semi").select("repo", "path", "name").distinct()


def debug_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line_number, line): temporary logs and stops that were left in code."""
    left = r"\bconsole\.(?:log|debug)\s*\(|^\s*debugger\s*;?\s*$|^\s*print\s*\(|\bpdb\.set_trace\s*\(|^\s*breakpoint\s*\(\s*\)|\bdbg!\s*\("
    rows = files.filter(is_code("path")).select("repo", "path", F.posexplode(T.lines("content")).alias("at", "line"))
    return rows.filter(F.col("line").rlike(left)).select("repo", "path", (F.col("at") + 1).alias("line_number"), T.strip("line").alias("line"))


def _title(title: Column | str, parts: str, names: tuple[str, ...]) -> Column:
    found = F.struct(*(F.regexp_extract(T.col(title), parts, i).alias(x) for i, x in enumerate(names, 1)))
    return F.when(T.col(title).rlike(parts) & F.regexp_extract(T.col(title), parts, 1).isin(*TYPES), found)


def commit_title(title: Column | str) -> Column:
    """STRUCT<type, scope, summary> of ``type(scope): summary`` with a known type; null for another form."""
    return _title(title, r"\A([a-z]+)\(([^()\s][^()]*)\): (\S.*)\z", ("type", "scope", "summary"))


def pull_title(title: Column | str) -> Column:
    """STRUCT<type, summary> of ``[type] summary`` with a known type; null for another form."""
    return _title(title, r"\A\[([a-z]+)\] (\S.*)\z", ("type", "summary"))
