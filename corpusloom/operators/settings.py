"""Settings of every tree: its configuration file laid over the defaults, as columns that operators read per row."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.trees import Config, known_json

# Fixed value: where a tree keeps its configuration.
PATH = ".harness/config.json"
FEW = 1_000  # settings that a join may broadcast
FOUND = "array<struct<check:string,kind:string,metadata:map<string,string>>>"


def json_name(field) -> str:
    """The name below ``validation`` or the part of it that the field is in."""
    head, *rest = field.name.split("_")
    return head + "".join(x.title() for x in rest)


def key(field) -> str:
    """The name that findings give a setting."""
    under, own = field.metadata.get("under", ""), json_name(field)
    return under + own[0].upper() + own[1:] if under else own


def _schema() -> str:
    plain = [json_name(f) for f in fields(Config) if not f.metadata]
    nested = [json_name(f) for f in fields(Config) if f.metadata]
    return f"validation struct<{','.join(f'{x}:string' for x in plain)},codeHealth:struct<{','.join(f'{x}:string' for x in nested)}>>"


def _literal(value) -> Column:
    return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)


def rules(patterns: Column) -> Column:
    """array<struct<regex, segment, ending>> of whole-path wildcards; blank ones are none.

    ``segment`` is a folder or file name that any path that fits must hold,
    ``ending`` its last signs, both in lower case and empty where the wildcard
    says nothing: what lacks them needs no regular expression.
    """
    own = F.transform(patterns, lambda p: F.ltrim(T.slashes(p), F.lit("/")))
    low = lambda p, regex: F.regexp_extract(F.lower(p), regex, 1)
    one = lambda p: F.struct(T.wildcard_of(p).alias("regex"), low(p, r"(?:^|/)([^*?\[\]/]+)(?:/|$)").alias("segment"), low(p, r"[*?]([^*?\[\]/]+)$").alias("ending"))
    return F.transform(F.filter(own, lambda p: ~T.blank(p)), one)


def prefixes(paths: Column) -> Column:
    """Excluded paths without slashes at the ends; blank ones are none."""
    return F.filter(F.transform(paths, lambda x: F.trim(T.slashes(x), F.lit("/"))), lambda x: ~T.blank(x))


def struct_of(columns: dict[str, Column]) -> Column:
    """All settings in one struct, with the compiled exclusions."""
    more = {"prefixes": prefixes(columns["excluded_paths"]), "rules": rules(columns["excluded_patterns"])}
    return F.struct(*(c.alias(k) for k, c in (columns | more).items()))


def literal(config: Config) -> Column:
    return struct_of({f.name: _literal(getattr(config, f.name)) for f in fields(Config)})


def of(config: Config | Column) -> Column:
    """Settings as a column: those of all trees as a constant, or those of each row's tree."""
    return literal(config) if isinstance(config, Config) else config


def settings(files: DataFrame, defaults: Config | None = None) -> DataFrame:
    """(repo, settings, state, found) of every tree: missing, invalid, faulty or ok, and what is wrong; see ``own_settings``."""
    met = with_settings(files.select("repo").distinct(), own_settings(files, defaults), defaults or Config(), "state", "found")
    return met.select("repo", "settings", F.coalesce("state", F.lit("missing")).alias("state"), F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def own_settings(files: DataFrame, defaults: Config | None = None) -> DataFrame:
    """(repo, settings, state, found) of the trees that have a configuration file: invalid, faulty or ok, and what is wrong.

    Absent keys keep their defaults; a bad value is a failure and keeps its
    default too; lists replace the default and lose blank entries, and one text
    is a list of itself. Text that is no JSON is one failure. Of files that share
    the path the last in order counts.
    """
    defaults = defaults or Config()
    own = files.filter(F.col("path") == PATH).groupBy("repo").agg(F.max(F.coalesce("content", F.lit(""))).alias("text"))
    rows = own.withColumn("valid", known_json(F.when(F.trim("text") != "", F.col("text"))))
    rows = rows.withColumn("read", F.from_json(F.when(F.col("valid"), F.col("text")), _schema()))
    raw = {f.name: F.col(f"read.validation.{'codeHealth.' if f.metadata else ''}{json_name(f)}") for f in fields(Config)}
    columns, bad = {}, []

    def fault(reason: str, **more: Column) -> Column:
        metadata = {"path": F.lit(PATH), "reason": F.lit(reason)} | more
        return F.struct(F.lit("config").alias("check"), F.lit("failure").alias("kind"), F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), v.cast("string")))).alias("metadata"))

    for f in fields(Config):
        value, default = raw[f.name], _literal(getattr(defaults, f.name))
        if isinstance(f.default, tuple):
            many = F.coalesce(F.from_json(value, "array<string>"), F.array(value))
            columns[f.name] = F.when(value.isNotNull(), F.filter(many, lambda x: x.rlike(r"(?U)\S"))).otherwise(default)
            continue
        is_bool = isinstance(f.default, bool)
        got = F.lower(T.strip(value)).try_cast("boolean") if is_bool else T.strip(value).try_cast("int")
        fits = F.lower(T.strip(value)).isin("true", "false") if is_bool else F.coalesce(got >= 1, F.lit(False))
        columns[f.name] = F.when(fits, got).otherwise(default)
        reason = "invalid_boolean" if is_bool else "invalid_positive_integer"
        bad.append(F.when(value.isNotNull() & ~fits, fault(reason, key=F.lit(key(f)), value=value)))
    invalid = F.col("text").isNotNull() & ~F.coalesce("valid", F.lit(False))
    found = F.when(invalid, F.array(fault("invalid_json"))).otherwise(F.array_compact(F.array(*bad))).cast(FOUND)
    state = F.when(invalid, "invalid").when(F.size("found") > 0, "faulty").otherwise("ok")
    return rows.select("repo", struct_of(columns).alias("settings"), found.alias("found"), "text", "valid").withColumn("state", state).select("repo", "settings", "state", "found")


def matching(path: Column, segments: Column, rule: Column) -> Column:
    """Does ``path`` fit a rule? Its expression is tried only where segment and ending allow it."""
    near = ((rule["segment"] == "") | F.array_contains(segments, rule["segment"])) & ((rule["ending"] == "") | F.lower(path).endswith(rule["ending"]))
    return F.when(near, F.rlike(path, rule["regex"])).otherwise(False)


def matches(paths: DataFrame, patterns: DataFrame, key: list[str], path: str = "path", pattern: str = "pattern") -> DataFrame:
    """The rows of ``paths`` with the patterns of their ``key`` that fit them: key, other columns of ``paths``, pattern.

    A theta join by way of an index: a pattern is filed under a folder or file
    name that it demands or else under its ending's extension or else under
    nothing; a path asks for all its names, its extension and nothing. The
    expressions run on what meets there. Repeated rows of ``paths`` stay,
    repeated patterns of a key count once; null or blank patterns fit nothing.
    """
    # columns of either side may have one origin or share a name
    own = patterns.select(*(F.col(k).alias(f"rule {k}") for k in key), F.col(pattern).alias("rule pattern")).distinct()
    ruled = own.select("*", F.explode(rules(F.array("rule pattern"))).alias("rule"))
    extension = lambda c: F.regexp_extract(c, r"(\.[^.]*)$", 1)
    filed = F.when(F.col("rule.segment") != "", F.concat(F.lit("s"), "rule.segment")).when(extension("rule.ending") != "", F.concat(F.lit("e"), extension(F.col("rule.ending")))).otherwise("")
    whole = F.ltrim(T.slashes(path), F.lit("/"))
    low = F.lower(whole)
    asked = F.array_distinct(F.concat(F.transform(F.split(low, "/"), lambda s: F.concat(F.lit("s"), s)), F.array(F.concat(F.lit("e"), extension(low)), F.lit(""))))
    met = paths.withColumn("rule asked", F.explode(asked)).join(ruled.withColumn("rule filed", filed), [*(F.col(k) == F.col(f"rule {k}") for k in key), F.col("rule asked") == F.col("rule filed")])
    return met.filter(matching(whole, F.split(low, "/"), F.col("rule"))).select(*paths.columns, F.col("rule pattern").alias(pattern))


def with_settings(rows: DataFrame, own: DataFrame, defaults: Config, *more: str, only: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the settings of their trees (``only`` some) and ``more`` of ``own``, the settings of trees with a file; others have ``defaults``, made once.

    Settings are many times the size of their Parquet files, so only few are broadcast.
    """
    some = F.struct(*(F.col(f"settings.{f}") for f in only)) if only else F.col("settings")
    default = rows.sparkSession.range(1).select(literal(defaults).alias("settings")).select(some.alias("default settings"))
    own, few = own.select("repo", some.alias("settings"), *more), own.limit(FEW + 1).count() <= FEW
    met = rows.join(F.broadcast(own) if few else own.hint("merge"), "repo", "left").crossJoin(F.broadcast(default))
    return met.withColumn("settings", F.coalesce("settings", "default settings")).drop("default settings")


def union(columns: list[Column]) -> Column:
    """Arrays of findings in one."""
    return reduce(lambda a, b: F.concat(a, b), columns)
