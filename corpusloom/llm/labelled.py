"""Bounded training samples of labelled documents, and which rows may be learnt from."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are fold -1."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def training_labels(labels: DataFrame, label_col: str, folds: int, held_out: int) -> DataFrame:
    """(id, label) with a 0 or 1 as label and an id outside the held-out fold; ids with both labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold("id", folds) != held_out))
    return known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def _texts_of(docs: DataFrame, ids: DataFrame, n: int, max_bytes: int, seed: int) -> DataFrame:
    """(id, text, label) of ``n`` rows of ``docs`` at most, also if ids repeat, by ``ids`` (id, label), staged and bounded."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.octet_length("text").between(1, max_bytes)).join(F.broadcast(ids), "id")
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", F.xxhash64("text")).limit(n)


def sample_texts(docs: DataFrame, known: DataFrame, per_label: int, max_bytes: int, seed: int) -> DataFrame:
    """(id, text, label) of at most ``per_label`` rows of each label, taken in the order of a seeded hash.

    Only rows up to ``max_bytes`` are fitted on, so the sample has a bound in
    bytes as well: ``2 * per_label * max_bytes``. The ids are staged first, and
    so few that they fit for a broadcast.
    """
    order = F.xxhash64("id", F.lit(seed))
    picked = [known.filter(F.col("label") == k).orderBy(order, "id").limit(per_label) for k in (0, 1)]
    return _texts_of(docs, stage(picked[0].unionByName(picked[1]), "training-ids"), 2 * per_label, max_bytes, seed)


def sample_unlabelled(docs: DataFrame, folds: int, held_out: int, n: int, max_bytes: int, seed: int) -> DataFrame:
    """(id, text, label 0) of ``n`` rows outside the held-out fold, in the order of a seeded hash, whether they have a label or not.

    Labels are not read, so labelled rows of either kind are there in their
    natural share. Rows without an id are left out, and texts over ``max_bytes``
    once the ids are drawn.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("id")).filter(F.col("id").isNotNull() & (fold("id", folds) != held_out))
    ids = some.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(n).dropDuplicates(["id"]).withColumn("label", F.lit(0))
    return _texts_of(docs, stage(ids, "unlabelled-ids"), n, max_bytes, seed)


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """``fit`` of the (text, label) of a bounded ``sample``, in one task; only the model comes to the driver."""

    def run(rows: pa.Table) -> pa.Table:
        texts = sorted(zip(*(rows.column(c).to_pylist() for c in ("id", "text", "label")), strict=True))
        return pa.table({"model": pa.array([pickle.dumps(fit([(t, k) for _, t, k in texts]))], pa.binary())})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
