"""Substring deduplication by hashing lines and paragraphs.

Every text is cut into units: lines or paragraphs as they stand, or passages. A
passage is a paragraph of at least ``min_words`` words that starts at any line
or sentence: the shortest run of whole sentences from there that is long enough.
Passages overlap, so a paragraph that was copied into another text is found
whatever lines and sentences stand around it, but for a first or last sentence
that was cut. Normalised forms (A-Z in lower case, white space runs as one
space) are hashed, digests are grouped over the whole corpus with map-side
partial minima, and the occurrence of lowest rank (id, then place) stays; all
others are removed. Spans keep the offsets of the original text, in characters.

Digests are BLAKE2b of 128 bits; units with equal digests count as equal.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import map_column
from corpusloom.plans.staging import drop_stage, stage, table

# a unit ends behind such a sign
BREAK = {"line": re.compile("\n"), "paragraph": re.compile("\n\n+"), "passage": re.compile("\n|[.!?][ \t]")}
PASSAGE_WORDS = 30


def units_of(text: str | None, unit: str = "passage", min_words: int = PASSAGE_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, words before it, words up to its end, digest) of the units with at least ``min_words`` words."""
    text, parts, at, before = text or "", [], 0, 0
    for end in [*(m.end() for m in BREAK[unit].finditer(text)), len(text)]:
        words = text[at:end].encode().lower().split()
        if words:
            parts.append((at, end, before, before := before + len(words), b" ".join(words)))
        at = end
    out, to = [], 0
    for k, (start, _, word, *_) in enumerate(parts):
        to = max(to, k + 1)
        while unit == "passage" and to < len(parts) and parts[to - 1][3] - word < min_words:
            to += 1
        if parts[to - 1][3] - word >= min_words:
            out.append((start, parts[to - 1][1], word, parts[to - 1][3], hashlib.blake2b(b" ".join([p[4] for p in parts[k:to]]), digest_size=16).digest()))
    return out


def without(text: str | None, spans: list | None) -> str | None:
    """``text`` less its ``spans`` (start, end), which do not overlap."""
    if not text or spans is None or len(spans) == 0:
        return text
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of the row, staged: the numbers are the same for all that reads them."""
    return stage(docs.withColumn("number of row", F.monotonically_increasing_id()), "numbered-rows")


def _spans(rows: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(row, id, start, end, n_words, kept_id, kept_start) from staged ``rows`` (row, id, text)."""

    def make():
        def cut(texts):
            found = [units_of(t, unit, min_words) for t in texts]
            flat = [u for units in found for u in units]
            return [len(u) for u in found], *(zip(*flat, strict=True) if flat else [[]] * 5)

        return cut

    units = stage(map_column(rows, "text", make, "start int, end int, word int, word_to int, digest binary"), "units", "zstd")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "word", "word_to", "start", "end")).alias("first")
    groups = units.groupBy("digest").agg(first, F.count("*").alias("copies")).filter("copies > 1")
    groups = stage(groups.select("digest", *(F.col(f"first.{x}").alias(f"kept_{x}") for x in ("id", "row", "word", "word_to", "start", "end"))), "repeated-units")
    met = units.join(groups, "digest").filter("row <> kept_row or word <> kept_word").drop("digest")
    # what stays is not removed, where a unit overlaps the one that it repeats
    own = F.col("row") == F.col("kept_row")
    over = own & (F.col("start") < F.col("kept_end"))
    shifted = {"start": F.col("kept_end"), "word": F.col("kept_word_to"), "kept_start": F.col("kept_start")}
    met = met.withColumns({k: F.when(over, v).otherwise(F.col(k)) for k, v in shifted.items()}).filter("start < end")
    met = stage(met.select("row", "id", "start", "end", "word", "word_to", "kept_id", "kept_start"), "removed-units")
    drop_stage(units)
    by_row = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    joined = met.withColumn("reach", reach).withColumn("island", island).groupBy("row", "id", "island")
    source = F.min(F.struct("start", "end", "kept_id", "kept_start"))
    return joined.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word_to") - F.min("word")).cast("int").alias("n_words"), source.alias("s")).select(
        "row", "id", "start", "end", "n_words", F.col("s.kept_id").alias("kept_id"), F.col("s.kept_start").alias("kept_start")
    )


def repeated_units(docs: DataFrame, unit: str = "passage", min_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed span of neighbouring units: id, start, end, n_words, kept_id, kept_start.

    A span is what removed units that touch or overlap cover. ``kept_id`` and
    ``kept_start`` say where the first of them stays. A unit that repeats within
    a document goes as well; if it overlaps the one that stays, only what lies
    behind that. Units shorter than ``min_words`` words are never removed. Null
    and empty texts have no units. Null ids rank last, rows that repeat an id
    in the order in which the table was read. Other columns of ``docs`` are not
    read. An empty table gives no rows.
    """
    rows = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    found = _spans(rows.withColumnRenamed("number of row", "row"), unit, min_words)
    return found.select(F.col("id").alias(id_col), "start", "end", "n_words", "kept_id", "kept_start")


def remove_repeats(docs: DataFrame, unit: str = "passage", min_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed_spans") -> DataFrame:
    """``docs`` with the repeated units cut out of ``text_col`` and their original offsets in ``spans_col``; one row per row.

    A column of ``docs`` of that name gives way to the new one; all others stay.
    """
    numbered = _numbered(docs.drop(spans_col))
    found = _spans(numbered.select(F.col("number of row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), unit, min_words)
    spans = stage(found.groupBy(F.col("row").alias("number of row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans_col)), "spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([without(t, r) for t, r in zip(texts, removed, strict=True)], dtype=object)

    return numbered.join(spans, "number of row", "left").withColumn(text_col, cut(text_col, spans_col)).drop("number of row")


def op8_substring(spark, sf_dir):
    """The removed passages of all documents: doc_id, start, end, n_words, kept_id, kept_start."""
    return repeated_units(table(spark, sf_dir, "documents"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?][ \t])', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text <> ''
), numbered AS (
  SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS place FROM cut
), lengths AS (
  SELECT doc_id, place, parts[place] AS part, sum(length(parts[place])) OVER (PARTITION BY doc_id ORDER BY place) AS until FROM numbered
), words AS (
  SELECT *, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lengths
), units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k, until - length(part) AS "start", until AS "end",
         array_to_string(w, ' ') AS norm, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY place) AS word_to,
         sum(len(w)) OVER (PARTITION BY doc_id ORDER BY place) - len(w) AS word FROM words WHERE len(w) > 0
), whole AS (
  SELECT doc_id, list(norm ORDER BY k) AS norms FROM units GROUP BY doc_id
), met AS (
  SELECT s.doc_id, s.k, s.word, s.word + 30 AS least, s."start", e.k AS last, e.word_to, e."end" FROM units s
  ASOF JOIN units e ON s.doc_id = e.doc_id AND s.word + 30 <= e.word_to
), passages AS (
  SELECT doc_id, "start", "end", word, word_to, array_to_string(norms[k:last], ' ') AS norm FROM met JOIN whole USING (doc_id)
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS copies, first_value(doc_id) OVER byrank AS kept_id, first_value("start") OVER byrank AS kept_start,
         first_value("end") OVER byrank AS kept_end, first_value(word_to) OVER byrank AS kept_word_to, row_number() OVER byrank AS r
  FROM passages WINDOW byrank AS (PARTITION BY norm ORDER BY doc_id, word)
), removed AS (
  SELECT doc_id, CASE WHEN doc_id = kept_id THEN greatest("start", kept_end) ELSE "start" END AS "start", "end",
         CASE WHEN doc_id = kept_id THEN greatest(word, kept_word_to) ELSE word END AS word, word_to, kept_id, kept_start FROM ranked WHERE r > 1
), reached AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM removed WHERE "start" < "end"
), islands AS (
  SELECT *, sum(CASE WHEN "start" <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM reached
)
SELECT doc_id, CAST(min("start") AS INTEGER) AS "start", CAST(max("end") AS INTEGER) AS "end", CAST(max(word_to) - min(word) AS INTEGER) AS n_words,
       min({'s': "start", 'e': "end", 'id': kept_id, 'at': kept_start}).id AS kept_id, CAST(min({'s': "start", 'e': "end", 'id': kept_id, 'at': kept_start}).at AS INTEGER) AS kept_start
FROM islands GROUP BY doc_id, island
"""
