"""Interaction of filters: what each would remove in every order, from one pass over the documents.

A document's failures are the bits of a mask. Its survival word is the truth
table of "survives the subset": bit s is 1 if the document fails no filter of
subset s. Five filters have 32 subsets, so a word has 32 bits. The number of
survivors of every subset is the positional popcount of the words, taken per
part and label with carry-save adders: three words of one weight become a sum
of that weight and a carry of twice the weight, until two are left. What a
filter removes at any place of any order is the difference of two of these
counts, so no document is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage, table

MOST = 5  # filters that a 32-bit word has subsets for
PARTS = 10_000  # parts that a task counts before it hands its counts on


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit, by carry-save adders."""
    counts, bits, weight = np.zeros(32, np.int64), np.arange(32, dtype=np.uint32), 0
    while len(words):
        carries = []
        while len(words) > 2:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k :]])
        for w in words:
            counts += ((w >> bits) & 1).astype(np.int64) << weight
        words = np.concatenate(carries) if carries else words[:0]
        weight += 1
    return counts


def survival_word(mask: int, n: int) -> int:
    """Bit s is 1 if a document with the failures ``mask`` survives subset s of ``n`` filters."""
    return sum(1 << s for s in range(1 << n) if not s & mask)


def survivors(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """(part, subset, all, ``labels``): how many of ``rows`` survive each subset of the boolean columns ``filters``, of all and of those with each boolean label.

    ``filters`` are true where a row fails; null counts as false, for labels
    too. A null part is one of its own. No rows: no counts.
    """
    n = len(filters)
    if not 1 <= n <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    words = np.array([survival_word(m, n) for m in range(1 << n)], np.uint32)
    kinds = ["all", *labels]
    bit = lambda names: sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    slim = rows.select(F.col(part).alias("part"), bit(filters).alias("mask"), bit(labels).alias("marks"))
    names = ["part", "subset", *(f"n{k}" for k in range(len(kinds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            own = [pa.array([p for p in seen for _ in range(1 << n)], pa.string()), pa.array(list(range(1 << n)) * len(seen), pa.int32())]
            counts = np.stack(list(seen.values()), axis=1).reshape(len(kinds), -1)
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in counts)], names=names)

        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            at, of, marks = coded.indices.to_numpy(), words[batch.column(1).to_numpy()], batch.column(2).to_numpy()
            for k, p in enumerate(coded.dictionary.to_pylist()):
                mine, mark = of[at == k], marks[at == k]
                found = [positional_popcount(mine), *(positional_popcount(mine[mark >> i & 1 == 1]) for i in range(len(labels)))]
                seen[p] = seen.get(p, 0) + np.stack(found)[:, : 1 << n]
            if len(seen) > PARTS:
                yield out()
                seen.clear()
        if seen:
            yield out()

    counted = slim.mapInArrow(run, f"part string, subset int, {', '.join(f'n{k} long' for k in range(len(kinds)))}")
    return counted.groupBy("part", "subset").agg(*(F.sum(f"n{k}").alias(x) for k, x in enumerate(kinds)))


def interactions(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """One row per part, order of ``filters`` and step, from the ``survivors`` of every subset.

    filter_order (names joined), step (from 1), kept after it, removed by it,
    redundant (fail it, removed earlier), unique_fails (fail it alone),
    ``<label>_lost`` (removed by it) and shapley (its removals summed over all
    orders).
    """
    n, every = len(filters), (1 << len(filters)) - 1
    kinds = ["all", *labels]
    whole = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *kinds))).alias("by"))  # 2^n entries
    of = lambda kind, subset: F.get(f"by.{kind}", subset)
    bit = F.create_map(*(F.lit(x) for i, name in enumerate(filters) for x in (name, 1 << i)))
    orders = F.array(*(F.array(*map(F.lit, o)) for o in permutations(filters)))
    rows = whole.withColumn("names", F.explode(orders)).select("part", "by", "names", F.posexplode("names").alias("at", "name"))
    rows = rows.withColumn("own", bit[F.col("name")]).withColumn("before", F.aggregate(F.slice("names", 1, F.col("at")), F.lit(0), lambda m, x: m + bit[x]))
    gone = lambda kind: of(kind, F.col("before")) - of(kind, F.col("before") + F.col("own"))
    removed = gone("all")

    def total(i: int) -> Column:
        """Orders in which the filters of s alone come before filter i, times what i then removes, for all s."""
        rest = [s for s in range(1 << n) if not s >> i & 1]
        return sum((of("all", F.lit(s)) - of("all", F.lit(s | 1 << i))) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in rest)

    shapley = F.coalesce(*(F.when(F.col("own") == 1 << i, total(i)) for i in range(n)))
    return rows.select(
        "part", F.array_join("names", "").alias("filter_order"), (F.col("at") + 1).cast("int").alias("step"), of("all", F.col("before") + F.col("own")).alias("kept"), removed.alias("removed"),
        (of("all", F.lit(0)) - of("all", F.col("own")) - removed).alias("redundant"), (of("all", F.lit(every) - F.col("own")) - of("all", F.lit(every))).alias("unique_fails"),
        *(gone(x).alias(f"{x}_lost") for x in labels), shapley.alias("shapley"),
    )


def _words(text: Column) -> Column:
    for sign in "\t\n\v\f\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def text_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E) of every row of ``docs``, staged: which of five filters it fails.

    A: under 100 words; B: under 80 distinct words per 100; C: over 10 capitals
    A-Z per 100 characters; D: one of #$%&*|; E: its text is also that of a
    smaller id. Null texts and parts count as empty; a null id is smaller than
    none, and rows that share an id and a text are no copies of each other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), _words(text).alias("words"))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = {"A": n < 100, "B": F.size(F.array_distinct("words")) * 100 < n * 80, "C": capitals.cast("long") * 100 > F.length("text").cast("long") * 10, "D": F.col("text").rlike("[#$%&*|]")}
    slim = stage(read.select("id", "part", *(c.alias(k) for k, c in flags.items()), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes")), "filter-flags")
    least = slim.groupBy("digest", "n_bytes").agg(F.min("id").alias("least"))
    return stage(slim.join(stage(least, "filter-copies"), ["digest", "n_bytes"]).select("id", "part", *flags, F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E")), "filter-fails")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters in all 120 orders, per language, with what each order costs in good and in toxic documents.

    A document is good or toxic if any row of ``labels`` with its id says 1.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = text_filters(docs).join(marks, "id", "left")
    names = ["A", "B", "C", "D", "E"]
    return interactions(survivors(rows, names, ["good", "toxic"]), names, ["good", "toxic"])


def op12_filter_audit(spark, sf_dir):
    """The interactions of the five filters over all documents."""
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part,
        CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
      FROM w),
g AS (SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS name, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (SELECT part, filter_order, step, name, fails, good, toxic, contains(fails, name) AS hit, translate(before, fails, '') <> before AS gone FROM g, s),
r AS (SELECT part, filter_order, step, name, count(*) FILTER (NOT gone AND NOT hit) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant,
        count(*) FILTER (fails = name) AS unique_fails, count(*) FILTER (hit AND NOT gone AND good) AS good_lost, count(*) FILTER (hit AND NOT gone AND toxic) AS toxic_lost
      FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r
"""
