"""Divergence of sources within a language, with a frequent-pattern tree of term rows.

A term's row holds its nonzero counts by source. Between two sources the sum of
the differences of their smoothed shares over all terms is first taken as if no
term occurred in either. Then it is corrected for the terms of one source (which
needs its shares in order, and where the other's share of an absent term lies
among them) and for the terms that both have. The latter come from a
frequent-pattern tree: rows are paths of (source, share), ordered by how many
terms a source has, and rows with a common beginning share the nodes there. A
node knows how many terms pass through it, so each node corrects the pair it forms
with each of its ancestors once, for all of these terms.

The tree is spread over tasks: equal rows are counted, rows are sorted by their
paths over range partitions, and each task keeps only the path that it stands on.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage, table

SCALE, PRIOR, LEAST_DOCS, SHOWN = 1_000_000_000, 5, 30, 50
RANGE = 5_000  # paths that a task has, about
HELD = 500_000  # entries that a task counts before it hands its counts on
#: bytes of terms (letters, in lower case, and all of UTF-8 beyond ASCII); others become blanks
TERMS = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents that hold it, counted in parts per task."""
    kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), list(map(docs.__getitem__, n))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = (text.as_py() or b"").translate(TERMS).split()
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from out()
        yield from out()

    counted = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs")


def term_rows(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, counts), staged: each kept term with its count in the language and in each source that has it."""
    near = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = near.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return stage(rows.filter(F.col("docs") >= least_docs).drop("docs"), "term-rows")


def _share(count: str, n: str = "n", v: str = "v") -> Column:
    """1 + floor(SCALE (count + PRIOR) / (n + PRIOR v)), with products that go beyond a long; null if no term is kept."""
    return F.expr(f"1L + cast((cast({count} + {PRIOR} as decimal(22,0)) * cast({SCALE} as decimal(10,0))) div nullif(cast({n} as decimal(22,0)) + cast({PRIOR} as decimal(1,0)) * cast({v} as decimal(18,0)), 0) as bigint)")


def groups_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n, base, place), staged: every group of ``docs``; base is the share of an absent term, place ranks the sources of a language by kept terms."""
    own = rows.select("lang", F.explode("counts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"), F.count("*").alias("terms"))
    whole = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *map(zero, ("n", "v", "lang_n", "terms")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("terms"), "source")).cast("long")
    return stage(known.select("lang", "source", "n", "v", "lang_n", _share("0L").alias("base"), place.alias("place")), "term-groups")


def shares_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, place, p, base, q), staged: the share of each kept term in each source that has it, and in the language."""
    each = rows.select("lang", "term", "total", F.explode("counts").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("count"))
    return stage(each.join(groups, ["lang", "source"]).select("lang", "source", "term", "place", _share("count").alias("p"), "base", _share("total", "lang_n").alias("q")), "term-shares")


class Tree:
    """Node-ancestor corrections of rows that come in the order of their paths; only one path is held.

    Where both ends of a pair have the term, its difference takes the place of
    what was assumed: the two differences between one's share and the other's
    share of an absent term, less that between both shares of absent terms.
    """

    def __init__(self):
        self.path, self.rows, self.codes, self.sums, self.held = np.zeros((3, 16), np.int64), [], [], [], 0

    def insert(self, path: np.ndarray, times: int) -> None:
        """``path``: sources, shares and shares of absent terms, as three rows."""
        k = min(len(self.rows), path.shape[1])
        differ = (path[:2, :k] != self.path[:2, :k]).any(axis=0)
        shared = int(differ.argmax()) if differ.any() else k
        self.close(shared)
        while self.path.shape[1] < path.shape[1]:
            self.path = np.concatenate([self.path, np.zeros_like(self.path)], axis=1)
        self.path[:, shared : path.shape[1]] = path[:, shared:]
        self.rows += [0] * (path.shape[1] - shared)
        if self.rows:
            self.rows[-1] += times

    def close(self, depth: int = 0) -> None:
        """End the nodes below ``depth``: all rows that pass through them are known."""
        while len(self.rows) > depth:
            times, d = self.rows.pop(), len(self.rows)
            if d:
                self.rows[-1] += times
                (at, p, base), (b_at, b_p, b_base) = self.path[:, :d], self.path[:, d]
                fix = np.abs(p - b_p) - np.abs(p - b_base) - np.abs(base - b_p) + np.abs(base - b_base)
                self.codes.append(at << 32 | b_at)
                self.sums.append(fix * times)
                self.held += d
                if self.held > 1 << 20:
                    self.codes, self.sums = ([x] for x in self.pairs())
                    self.held = len(self.codes[0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (two places in one number) and their sums so far."""
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, at, np.concatenate(self.sums))
        return codes, sums


def tree_corrections(shares: DataFrame) -> DataFrame:
    """(lang, a, b, fix): what terms of both sources add to each pair of places a < b."""
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "base"))).alias("path"))
    rows = stage(paths.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times")), "term-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = Tree(), None

        def out() -> pa.RecordBatch:
            tree.close()
            codes, sums = tree.pairs()
            return pa.RecordBatch.from_arrays([pa.array([of] * len(codes), pa.string()), pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(sums)], names=["lang", "a", "b", "fix"])

        for batch in batches:
            lists = batch.column(1)
            nodes = np.stack([x.to_numpy() for x in lists.flatten().flatten()])
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for lang, a, b, times in zip(batch.column(0).to_pylist(), np.append(0, ends[:-1]), ends, batch.column(2).to_pylist(), strict=True):
                if lang != of:
                    if of is not None:
                        yield out()
                    tree, of = Tree(), lang
                tree.insert(nodes[:, a:b], times)
        if of is not None:
            yield out()

    # so many ranges as the rows need: their bounds are found from samples of paths on the driver
    sorted_rows = rows.repartitionByRange(-(-rows.count() // RANGE) or 1, "lang", "path").sortWithinPartitions("lang", "path")
    return sorted_rows.mapInArrow(run, "lang string, a long, b long, fix long").groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix"))


def single_corrections(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, fix): what the terms of place a add to each pair of ``pairs`` (lang, a, b, a_base, b_base), as if b had none of them.

    One sort of a's shares and of the other sources' shares of absent terms
    gives, for each of these, the count and the sum of the shares up to it.
    """
    own = shares.groupBy("lang", F.col("place").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("k")).select("lang", "a", F.lit(None).cast("long").alias("b"), "at", "k", F.lit(None).cast("long").alias("a_base"))
    asked = pairs.select("lang", "a", "b", F.col("b_base").alias("at"), F.lit(0).cast("long").alias("k"), "a_base")
    group = Window.partitionBy("lang", "a")
    below = group.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("k") * F.col("at")
    seen = own.union(asked).withColumns({"k_below": F.sum("k").over(below), "below": F.sum(part).over(below), "k_all": F.sum("k").over(group), "all_": F.sum(part).over(group)})
    apart = F.col("at") * (2 * F.col("k_below") - F.col("k_all")) + F.col("all_") - 2 * F.col("below")
    return seen.filter("b is not null").select("lang", "a", "b", (apart - F.col("k_all") * F.abs(F.col("a_base") - F.col("at"))).alias("fix"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, shown: int = SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by distance, and the terms that a source uses more than its language.

    Null text, lang and source count as empty. A language without kept terms has
    pairs of value 0 and no terms. Rows that repeat a document are documents of
    their own. Other columns of ``docs`` are not read. No rows: no rows. A
    source's counts in a language may reach 10^12.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = term_rows(docs, least_docs)
    groups = groups_of(docs, rows)
    shares = shares_of(rows, groups)
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("base").alias("b_base"))
    pairs = stage(groups.select("lang", "source", "v", F.col("place").alias("a"), F.col("base").alias("a_base")).join(other, "lang").filter("a <> b"), "source-pairs")
    both = stage(tree_corrections(shares), "pairs-of-both")
    fixes = both.union(both.select("lang", "b", "a", "fix"))
    one = stage(single_corrections(shares, pairs.filter("v > 0")), "pairs-of-one")
    fixes = fixes.union(one).union(one.select("lang", "b", "a", "fix")).groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix"))
    apart = F.coalesce(F.col("v") * F.abs(F.col("a_base") - F.col("b_base")), F.lit(0)) + F.coalesce("fix", F.lit(0))
    by_source = pairs.join(fixes, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", apart.alias("value"))
    by_term = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return by_source.select("*", rank).union(by_term.select("*", rank).filter(F.col("rank") <= shown))


def op13_source_divergence(spark, sf_dir):
    """The divergence of the sources of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (t.n + 5)) // (v.n + 5 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN t USING (lang, term) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
