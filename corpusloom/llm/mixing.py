"""Mixing sources to target weights by subset-sum budget fitting.

The words of every document are counted exactly. A source's target is met by
whole passes over the source and a remaining budget, which is fitted on the
source's table of lengths: each length first gives its proportional share, and
a bounded-knapsack dynamic programme over the lengths that are left finds the
subset sum nearest to the rest. The plan says how many documents of each length
to take; which ones is decided by a seeded hash.

A table of lengths has one row per distinct length of a source, however many
documents there are. Documents of one length are split by the seeded hash into
buckets, whose counts decide which buckets go whole, so only documents of the
one bucket in which the count runs out are ranked, and a length that a third
of all documents share is ranked in many small pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage, table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
KEY = ["no_source", "source_key"]


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, so that the words come near ``budget``.

    Proportional shares are rounded down; then longest lengths first close all
    but ``window`` words; a dynamic programme over the rest finds the largest
    reachable sum up to what is left. ``window`` bounds its memory, not what can
    be taken: a rest of more words is first filled with the longest texts left.
    """
    counts, take = counts.astype(np.int64), np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    rest = budget - int((take * lengths).sum())
    order = np.argsort(-lengths)
    for i in order:
        if lengths[i] > 0 and rest - window > 0:
            k = min(int(counts[i] - take[i]), max(0, rest - window) // int(lengths[i]))
            take[i] += k
            rest -= k * int(lengths[i])
    reached = np.full(rest + 1, -1, np.int32)  # the item that first reached a sum
    reached[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        length, left, k = int(lengths[i]), int(counts[i] - take[i]), 1
        while length > 0 and left > 0 and length * min(k, left) <= rest and reached[rest] < 0:
            k = min(k, left)
            step = length * k
            new = np.nonzero((reached[:-step] >= 0) & (reached[step:] < 0))[0] + step
            reached[new] = len(items)
            items.append((int(i), k))
            left, k = left - k, 2 * k
        if reached[rest] >= 0:
            break
    at = int(np.nonzero(reached >= 0)[0][-1])
    while at:
        i, k = items[reached[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(no_source, source_key, source_size, target) from rows (no_source, source_key, size).

    Sources stand in code-point order, null last, and take ``weights`` in turn.
    Targets share ``share`` times all words by weight; one that passes ``most``
    times its source's words stops there and the others share the excess. Each
    round of that reads two sums back, never the sources.
    """
    own = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    placed = stage(own.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id()), "sources")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.row_number().over(Window.partitionBy("part").orderBy(*KEY)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (row % len(weights) + 1).cast("int"))
    placed = stage(placed.join(before.select("part", "before"), "part").select(*KEY, "source_size", weight.alias("weight")), "weights")
    words = placed.agg(F.sum("source_size")).first()[0] or 0
    top, level, capped = F.col("source_size") * float(most), 0.0, -1
    while True:
        full = top <= F.col("weight") * level
        fixed, free, n = placed.agg(F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == capped or not free:
            break
        level, capped = (share * words - fixed) / free, n
    return placed.select(*KEY, "source_size", F.least(top, F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``keep``, id, size, source_size, target, copies, taken.

    ``copies`` says how often the mix takes the document (0 up to ``most``),
    ``taken`` is copies x size. Null texts have size 0, null sources form one
    source. Documents of size 0 take part in whole passes only. Rows that tie
    in source, size and id may be exchanged for each other. An empty table
    gives an empty result. A column of ``keep`` that is named like a new one
    gives way to it.
    """
    new = {id_col, "size", "source_size", "target", "copies", "taken"}
    keep = tuple(c for c in keep if c not in new)
    salt, order = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(BUCKETS)).cast("int"), F.xxhash64(F.col(id_col), F.lit(seed + 1))
    base = docs.select(*(F.col(c).alias(f"kept_{c}") for c in keep), F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col), F.lit("")).alias("source_key"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), salt.alias("bucket"), order.alias("rank"))
    base = stage(base, "sizes")
    cells = stage(base.groupBy(*KEY, "size", "bucket").agg(F.count("*").alias("n")), "length-counts")
    targets = stage(source_targets(cells.withColumn("size", F.col("size") * F.col("n")), weights, share, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("size", ignore_index=True)
        take = fit_budget(f["size"].to_numpy(np.int64), f["n"].to_numpy(np.int64), int(f["budget"].iloc[0]))
        return f[[*KEY, "size"]].assign(take=take)

    lengths = cells.groupBy(*KEY, "size").agg(F.sum("n").alias("n")).join(targets.select(*KEY, "budget"), KEY)
    plan = stage(lengths.groupBy(*KEY).applyInPandas(fit, "no_source boolean, source_key string, size long, take long").filter("take > 0"), "length-plan")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEY, "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = cells.join(plan, [*KEY, "size"]).withColumn("here", F.least("n", F.col("take") - before)).filter("here > 0")
    chosen = stage(chosen.select(*KEY, "size", "bucket", "here", (F.col("here") == F.col("n")).alias("whole")), "bucket-plan")
    marked = stage(base.join(chosen, [*KEY, "size", "bucket"], "left"), "bucket-rows")
    first = F.row_number().over(Window.partitionBy(*KEY, "size", "bucket").orderBy("rank", "id"))
    is_split = F.coalesce(~F.col("whole"), F.lit(False))
    split = marked.filter(is_split).withColumn("extra", (first <= F.col("here")).cast("int"))
    marked = marked.filter(~is_split).withColumn("extra", F.col("here").isNotNull().cast("int")).unionByName(split)
    marked = marked.select(*(f"kept_{c}" for c in keep), "id", *KEY, "size", "extra")
    copies = (F.col("passes") + F.col("extra")).cast("long")
    return marked.join(targets, KEY).select(*(F.col(f"kept_{c}").alias(c) for c in keep), F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4_mixing(spark, sf_dir):
    """doc_id, size, source_size, target and taken of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("copies")
