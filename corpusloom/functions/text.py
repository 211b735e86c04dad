"""Column builders for Markdown sections, paths, wildcards, counts and event text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the arguments of functions over arrays are computed anew wherever they stand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(literal: str) -> str:
    """A Java regular expression that matches ``literal``."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#~])", r"\\\1", literal)


def wildcard(pattern: str) -> str:
    """A Java regular expression for a whole-string, case-blind wildcard: * crosses slashes, ? is one character, [ab] a class."""
    out, at = "", 0
    while at < len(pattern):
        ch = pattern[at]
        end = pattern.find("]", at + 2) if ch == "[" else -1
        if end > 0:
            out += "[" + pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&") + "]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(ch) or escape(ch)
        at += 1
    return rf"(?isu)\A{out}\z"


def wildcard_of(pattern: Column) -> Column:
    """``wildcard`` of a column of patterns."""
    signs = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[.[^\]]*\]|.)"), 1)
    literal = lambda x: F.regexp_replace(x, r"([\\.^$|+()\[\]{}\-&#~])", r"\\$1")
    within = lambda x: F.concat(F.lit("["), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"([\\\[^&])", r"\\$1"), F.lit("]"))
    one = lambda x: F.when(x == "*", ".*").when(x == "?", ".").when(F.length(x) > 2, within(x)).otherwise(literal(x))
    return F.concat(F.lit(r"(?isu)\A"), F.array_join(F.transform(signs, one), ""), F.lit(r"\z"))


def blank(c: Column | str) -> Column:
    return col(c).isNull() | ~col(c).rlike(r"(?U)\S")


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def section(content: Column | str, heading: str) -> Column:
    """What stands under ``## heading``, up to the next ``## `` or the end; empty if absent. Case counts."""
    return F.regexp_extract(col(content), rf"(?ms)^##\s+{escape(heading)}\s*\r?\n(.*?)(?=^##\s+|\z)", 1)


def backticks(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit("`([^`]+)`"), 1)


def lines(content: Column | str) -> Column:
    """Lines without their ends; a last line break adds no line, no content has no lines."""
    text = F.replace(F.replace(col(content), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    none = F.array().cast("array<string>")

    def cut(t: Column) -> Column:
        first, n = F.when(t.startswith("\ufeff"), 2).otherwise(1), F.length(t)
        last = F.when(t.endswith("\n"), n - 1).otherwise(n)
        return F.when(n >= first, F.split(F.substring(t, first, last - first + 1), "\n", -1)).otherwise(none)

    return F.coalesce(let(text, cut), none)


def slashes(path: Column | str) -> Column:
    """Backslashes as slashes."""
    return F.translate(col(path), "\\", "/")


def name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]*)$", 1))


def placeholders(content: Column | str, patterns: list[str] | Column) -> Column:
    """Occurrences of all patterns; those of word characters count as whole words only. Blank patterns count nothing. Case counts."""
    if isinstance(patterns, Column):
        quoted = lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        regex = lambda p: F.when(p.rlike(r"(?U)\A\w+\z"), F.concat(F.lit(r"(?U)\b"), quoted(p), F.lit(r"\b"))).otherwise(quoted(p))
        # most texts hold none of the patterns: these need no expression, which would be compiled for each text
        return F.aggregate(F.filter(patterns, lambda p: col(content).contains(p) & ~blank(p)), F.when(col(content).isNotNull(), 0), lambda n, p: n + F.regexp_count(col(content), regex(p)))
    one = lambda p: F.regexp_count(col(content), F.lit(rf"(?U)\b{escape(p)}\b" if re.fullmatch(r"\w+", p) else escape(p)))
    return sum((one(p) for p in patterns if p.strip()), F.lit(0))


def age_days(at: Column | str, as_of: Column) -> Column:
    """Whole days from ``at`` to ``as_of``, halves to even."""
    return F.bround(F.expr("1D") * F.timestamp_diff("MICROSECOND", col(at), as_of) / 86_400_000_000, 0).cast("int")


def cells(row: Column | str) -> Column:
    """Trimmed cells of a pipe row; there is no escape for the pipe."""
    return F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1), strip)


def _pairs(metadata: Column | str) -> Column:
    """``{ k=v; k=v }`` with sorted keys."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(col(metadata))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")
    return F.concat(F.lit("{ "), pairs, F.lit(" }"))


def status_line(component: str, status: Column | str, metadata: Column | str) -> Column:
    """``[component] status { k=v; k=v }`` with sorted keys."""
    return F.concat(F.lit(f"[{component}] "), col(status), F.lit(" "), _pairs(metadata))


def event_line(component: str, check: Column | str, status: Column | str, metadata: Column | str) -> Column:
    """``[component] check status { k=v; k=v }`` with sorted keys."""
    return F.concat(F.lit(f"[{component}] "), col(check), F.lit(" "), col(status), F.lit(" "), _pairs(metadata))
