"""Documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm.line_dedup import drop_similar_lines
from corpusloom.llm.mixing import mix
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.rows import stored_row
from corpusloom.llm.simhash import simhash_components
from corpusloom.llm.toxicity import reject_toxic
from corpusloom.plans.staging import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark, docs, sf_dir):
    """Documents whose toxicity score stays below the cut."""
    return reject_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """All documents, without lines that match an earlier line; n_chars follows the text (null stays null)."""
    return drop_similar_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash component over shingles of five words: the one with the smallest doc_id. Rows that repeat that id all stay."""
    found = simhash_components(docs, width=5)
    keep = stage(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "near-dedup-keep")
    return docs.select(*COLUMNS).join(keep.withColumnRenamed("doc_id", "kept"), F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def mixing(spark, docs, sf_dir):
    """Each document as often as the mix takes it: not at all, once or twice."""
    numbered = docs.select(*COLUMNS).withColumn("row__", stored_row())
    taken = mix(numbered, keep=("row__",)).filter("copies > 0").select("row__", "copies")
    return numbered.join(taken, "row__").withColumn("copy__", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark, docs, sf_dir):
    """Token pieces with their sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing), ("best-fit packing", packing)]
ORACLE_SQL = None  # a trained classifier, SimHash components and a tokenizer are beyond SQL


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
