"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition forms one sorted run of digests, holding one entry per
distinct text with its best identifier and its count. Runs then meet in rounds:
``fan_in`` neighbouring runs become one, and entries with equal digests are
merged. The struct aggregates make Spark plan sort aggregates, so that a round
is a sort by (run, digest), a partial merge where the rows lie, an exchange and
a multiway merge of the sorted pieces. Entries are exchanged by run and digest
together: no task ever holds a whole run, and a group of copies that makes up a
third of the input is one entry per partition after the first level.

Entries merge only if the SHA-256 digest, the byte length and an independent
64-bit hash all agree; rows that share a digest alone stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage, table

KEY = ["digest", "n_bytes", "check"]


def digest_groups(digests: DataFrame, keep: str = "smallest", runs: int = 16, fan_in: int = 4) -> DataFrame:
    """One row per distinct (digest, n_bytes, check) of ``digests`` (these and id): keep_id and group_size."""
    if fan_in < 2 or runs < 1:
        raise ValueError("fan_in must be 2 or more, runs 1 or more")
    best = {"smallest": F.min, "largest": F.max}[keep]
    level = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), *KEY).agg(best(F.struct("id")).alias("best"), F.count("*").alias("n"))
    while runs > 1:
        runs = -(-runs // fan_in)
        run = [F.floor(F.col("run") / fan_in).alias("run")] if runs > 1 else []
        level = level.groupBy(*run, *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", runs: int = 16, fan_in: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. ``keep`` is "smallest" or "largest"; a null
    id loses to any other, and a group with null ids only keeps null. Rows that
    repeat the id that stays are the same document, so all of them are kept.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = stage(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check")), "digests")
    # nulls must lose under min, where Spark sorts them first
    ranked = digests if keep == "largest" else digests.withColumn("id", F.struct(F.col("id").isNull().alias("last"), F.col("id")))
    groups = digest_groups(ranked, keep, runs, fan_in)
    if keep == "smallest":
        groups = groups.withColumn("keep_id", F.col("keep_id.id"))
    groups = stage(groups, "digest-groups")
    return digests.join(groups, KEY).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark, sf_dir):
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
