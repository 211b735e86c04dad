"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ
in at most ``max_bits`` bits differ in at most that many bytes, so they share at
least ``8 - max_bits`` positional bytes: the guaranteed minimum (four of eight
for the four bits of the default). An index on single positional bytes has lists
of n/256 entries, whose pairs, once tallied, grow with the square of the corpus.
Postings are therefore keyed by as many positional bytes at once as the minimum
asks for, for every choice of positions. A pair that meets in a list has
reached the minimum there, and a pair that meets nowhere has not: membership is
the tally, no pair below the minimum is ever formed, and chance lists of 32 bits
stay short when the corpus grows.

Pairs are not enumerated within a list. First each entry is compared with the
smallest fingerprint of its list only; components of these links are found.
Then, in lists that still hold several components, the entries outside the
list's most frequent component are compared with all others of the list. Any
link between two components has an end outside the most frequent one, so no
link that joins components is lost. Each pair that met is verified by its
number of differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm.batches import map_column
from corpusloom.llm.components import components
from corpusloom.plans.staging import stage, table

SEED = 42
MAX_BITS = 4
LIST = ["at", "shared"]  # which positions, and their bytes in place


def cover(max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """The sets of positions that key the index: every choice of the fewest that a link must share."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: beyond that a link may share no byte")
    return list(combinations(range(8), 8 - max_bits))


def fingerprint(text: bytes | None, width: int = 4, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text in UTF-8, repeats included; no words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, n - width + 1)
    spans = zip(starts[:m].tolist(), ends[min(width, n) - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, m)
    on = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 14):
        on += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def make():
        return lambda texts: (None, np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return map_column(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")), "text", make, "fp long")


def _near(a: F.Column, b: F.Column, max_bits: int) -> F.Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(fp, at, shared): one row for every set of positions, with the bytes at these positions and zeros elsewhere."""
    masks = [sum(255 << 8 * i for i in at) for at in cover(max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.struct(F.lit(n).cast("short").alias("at"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("shared")) for n, m in enumerate(signed)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.at", "key.shared")


def linked(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, label): components of the fingerprints ``fp`` (distinct) that have a link; label is the component's smallest."""
    postings = _postings(nodes, max_bits).repartition(*LIST)  # one exchange, read by the lists and by the join with them
    lists = postings.groupBy(*LIST).agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter("first <> last").drop("last")
    lists = lists.hint("merge")  # their size is underestimated before the explode, so they must not be broadcast on that estimate
    live = stage(postings.join(lists, LIST), "simhash-postings")
    stars = live.filter((F.col("fp") != F.col("first")) & _near(F.col("fp"), F.col("first"), max_bits)).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    known = components(stars)
    live = stage(live.select(*LIST, "fp").join(known, F.col("fp") == F.col("node"), "left").select(*LIST, "fp", F.coalesce("label", "fp").alias("part")), "simhash-parts")
    mixed = live.groupBy(*LIST, "part").agg(F.count("*").alias("n")).groupBy(*LIST).agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = stage(mixed.select(*LIST, F.col("most.part").alias("main")), "simhash-mixed")
    other = stage(live.join(mixed, LIST).filter("part <> main").select(*LIST, F.col("fp").alias("b"), F.col("part").alias("part_b")), "simhash-other")
    met = live.join(other, LIST).filter((F.col("part") != F.col("part_b")) & _near(F.col("fp"), F.col("b"), max_bits)).select(F.col("part").alias("a"), F.col("part_b").alias("b"))
    joined = components(met)  # of components, by their smallest fingerprints
    reach = nodes.select("fp").join(known, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("part"))
    return stage(reach.join(joined, F.col("part") == F.col("node"), "left").select(F.col("fp").alias("node"), F.coalesce("label", "part").alias("label")), "simhash-linked")


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other. A text
    with fewer words than ``width`` is one shingle. Equal fingerprints are
    linked, and so are those that differ in at most ``max_bits`` bits. Null ids
    take part but are never a component_id unless a component has no other. An
    empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    found = linked(nodes, max_bits).join(nodes, F.col("node") == F.col("fp"))
    best = stage(found.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-best")
    of = stage(found.select("fp", "label").join(best, "label").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir):
    """doc_id, fingerprint and component_id of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))
