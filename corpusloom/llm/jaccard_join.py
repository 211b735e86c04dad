"""Set-similarity join of documents on word shingles with PartEnum signatures.

A document is the set of its distinct shingles, as 64-bit hashes. Two sets with
Jaccard similarity 0.8 or more differ in at most a ninth of their sizes together.

The feature domain is partitioned by the leading bits of the hashes: a set's
partition is split in two for as long as it holds more than TOP = 6 features. What
is left are local sets of 1 to 6 features, so bands of equal size are a matter of
one partition, not of whole documents. Within a partition its features are
parts of their own, and signatures enumerate subsets of parts: all of them, and
for 5 to 7 features all but one (a partition of 7 does so before it is split).

Why similar sets a and b share a signature: split partitions for as long as both
sets have more than TOP features there. Where they then share none, they differ in
at least a seventh of what both have: by one of at most 7 features, by two of at
most 14, or by more. If all were like that, they would differ in a seventh in
all, but a ninth is the most. By the same count, a set may leave out partitions of
at most 3 features which hold less than a ninth of it: it leaves out the
smallest, whose signatures say least.

Signatures travel in arrays, a task and bucket at a time; the number of buckets grows
with the corpus. A signature that many texts of one task have is thinned there, so no
bucket gathers a large group. Documents with a common signature are a list.
Lists are not paired with themselves. First each document is compared with the
best connected one that it shares most lists with. Then, in lists that hold several
components of these links, what is outside the list's largest component is compared
with everything in other components: any link between components has an
end there. Candidates are filtered by size and by the parities of hash slots, and
verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm.batches import map_column, pieces_of
from corpusloom.llm.components import components
from corpusloom.plans.staging import drop_stage, stage, table

WIDTH = 5
TOP, DROPPED, PART = 6, 3, 9  # features of a partition; of one that may be left out; such partitions hold less than one PART-th of a set
ABOVE, BELOW = 4, 5  # the threshold as a fraction
BUCKET_BYTES = 6 << 20  # of text, about a million signatures
CROWD = 8  # texts of one task that send the same signature on
PARITIES = [f"parity{i}" for i in range(8)]
SLOTS, MOST_SLOTS = 512, 8192  # hash slots with a parity: of short sets, and of long ones, which have one for each feature up to so many
_M = np.random.default_rng(5).integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each whole text in UTF-8, A-Z in lower case; of fewer words the whole sequence, of none nothing."""
    words, found = _Words(), []
    m = np.resize(_M, width) * np.arange(1, 2 * width, 2, dtype=np.uint64)
    for t in texts:
        w = (t or b"").lower().split()  # bytes: A-Z only, ASCII white space only
        h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
        if not len(h):
            found.append(h)
        elif len(h) < width:
            found.append(_mixed(np.array([(h * m[: len(h)]).sum() + np.uint64(len(h))], np.uint64)))
        else:
            n = len(h) - width + 1
            total = h[:n] * m[0]
            for i in range(1, width):
                total += h[i : n + i] * m[i]
            found.append(np.unique(_mixed(total)))
    return found


def partitions(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the final partitions (of 1 to TOP features), and starts of those of TOP + 1 that are split further; ``h`` sorted within each ``doc``."""
    starts, sizes, split, at, depth = [], [], [], np.arange(len(h)), 0
    while len(at):
        node = h[at] >> np.uint64(64 - depth) if depth else np.zeros(len(at), np.uint64)
        own = doc[at]
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (node[1:] != node[:-1]))))
        n = np.diff(np.append(first, len(at)))
        done = n <= TOP
        starts.append(at[first[done]])
        sizes.append(n[done])
        split.append(at[first[n == TOP + 1]])
        at = at[np.repeat(~done, n)]
        depth += 1
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(starts), join(sizes), join(split)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all ``sets``, the number of the set of each, and whether it stands for a whole partition."""
    lengths = np.array([len(s) for s in sets], np.int64)
    h, doc = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), lengths)
    starts, sizes, split = partitions(h, doc)
    small = np.flatnonzero(sizes <= DROPPED)
    small = small[np.lexsort((sizes[small], doc[starts[small]]))]
    of = doc[starts[small]]
    upto = np.cumsum(sizes[small])
    first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    upto = upto - np.repeat((upto - sizes[small])[first], np.diff(np.append(np.flatnonzero(first), len(of))))
    keep = np.ones(len(starts), bool)
    keep[small[upto * PART < lengths[of]]] = False
    starts, sizes = starts[keep], sizes[keep]
    parts = _mixed(h + np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)))
    whole = sums[starts + sizes] - sums[starts]
    found, docs = [whole], [doc[starts]]
    for n in range(TOP - 1, TOP + 2):
        s = split if n > TOP else starts[sizes == n]
        total = sums[s + n] - sums[s]
        for i in range(n):
            found.append(total - parts[s + i])
            docs.append(doc[s])
    is_whole = np.zeros(sum(map(len, found)), bool)
    is_whole[: len(whole)] = True
    return _mixed(np.concatenate(found)), np.concatenate(docs), is_whole


def _thinned(sig: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted signatures: which to send on, and which stand in lists that are long in this task alone."""
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(sig)))
    place = np.arange(len(sig)) - np.repeat(first, n)
    return place < CROWD, np.repeat(n > CROWD, n)


def shared_signatures(texts: DataFrame, buckets: int) -> DataFrame:
    """(kind, a, b) of ``texts`` (ord, text): kind 0, list a holds text b (lists of two texts at least; rows may repeat); kind 1, text a has b shingles."""
    schema = "bucket long, kind int, base long, a binary, b binary"
    names = ["bucket", "kind", "base", "a", "b"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def cut(ords: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        base = int(ords[0])
        own = -1 - base  # a group of its own for what no other task has to see
        sig, doc, whole = signatures(sets)
        order = np.argsort(sig)
        sig, doc, whole = sig[order], doc[order], whole[order]
        sent, crowded = _thinned(sig, doc, whole)
        rows = [(own, 1, base, ords.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes())]
        if crowded.any():
            rows.append((own, 0, base, _list(sig[crowded], buckets).tobytes(), ords[doc[crowded]].tobytes()))
        sig = sig[sent]
        at = (ords[doc[sent]] - base).astype(np.uint32) << np.uint32(1) | whole[sent]
        bucket = _bucket(sig, buckets)
        bounds = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(sig) else np.zeros(0, np.int64)
        low = sig.astype(np.uint32)
        for a, b in zip(bounds, np.append(bounds[1:], len(sig)), strict=False):
            rows.append((int(bucket[a]), 0, base, low[a:b].tobytes(), at[a:b].tobytes()))
        return out(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, text = batch.column(0).to_numpy(), batch.column(1)
            for a, b in pieces_of(pc.binary_length(text).to_numpy(), 1 << 20, 8 << 20):
                sets = shingle_sets(text.slice(a, b - a).to_pylist())
                for x in np.split(np.arange(a, b), np.flatnonzero(np.diff(ords[a:b] >> 31)) + 1):  # numbers of one stored partition
                    yield cut(ords[x], [sets[i - a] for i in x])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, kind = key[0].as_py(), rows.column("kind").to_pylist()
        a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
        if bucket < 0:
            n = [len(x) // 8 for x in a]
            return pa.table({"kind": pa.array(np.repeat(kind, n), pa.int32()), "a": np.frombuffer(b"".join(a), np.int64), "b": np.frombuffer(b"".join(b), np.int64)})
        low, at = np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)
        order = np.argsort(low)
        low = low[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        n = np.diff(np.append(first, len(low)))
        useful = (n > 1) & np.logical_or.reduceat((at & 1).astype(bool)[order], first)
        take = np.repeat(useful, n)
        doc = np.repeat(np.array(rows.column("base").to_pylist(), np.int64), [len(x) // 4 for x in b])[order[take]] + (at[order[take]] >> 1)
        pairs = np.unique(np.stack([low[take].astype(np.int64), doc]), axis=1) if take.any() else np.zeros((2, 0), np.int64)
        several = np.unique(pairs[0], return_counts=True)[1]
        pairs = pairs[:, np.repeat(several > 1, several)]
        return pa.table({"kind": pa.array(np.zeros(pairs.shape[1], np.int32)), "a": (bucket << 32) + pairs[0], "b": pairs[1]})

    sent = texts.select("ord", F.col("text").cast("binary")).mapInArrow(send, schema)
    return stage(sent.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long"), "shared-signatures")


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _list(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(sig, buckets) << 32) + sig.astype(np.uint32)


def parities(s: np.ndarray, slots: int) -> np.ndarray:
    """Of the features of ``s`` in each of ``slots`` hash slots: even or odd, in longs."""
    return np.packbits(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).view(">i8").astype(np.int64)


def wanted_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, n, parities, more, features), staged, of the ``texts`` whose ord is in ``wanted``; features are sorted 64-bit hashes, ``more`` the parities of long sets."""

    def make():
        def work(some):
            sets = shingle_sets(some)
            bits = [parities(s, SLOTS) for s in sets]
            more = [parities(s, min(MOST_SLOTS, 1 << (len(s) - 1).bit_length())) if len(s) > SLOTS else [] for s in sets]
            return (None, [len(s) for s in sets], *(np.array([b[i] for b in bits], np.int64) for i in range(8)), more, [s.tobytes() for s in sets])

        return work

    new = f"n long, {', '.join(f'{p} long' for p in PARITIES)}, more array<long>, features binary"
    return stage(map_column(texts.join(wanted, "ord", "left_semi").select("ord", F.col("text").cast("binary").alias("text")), "text", make, new), "wanted-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), staged: the ``pairs`` whose sets have a Jaccard similarity of ABOVE / BELOW or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * BELOW >= (len(x) + len(y) - both) * ABOVE)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    of = lambda k: sets.select(F.col("ord").alias(k), F.col("features").alias(f"{k}_features"))
    return stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_features", "b_features").mapInArrow(run, "a long, b long"), "set-links")


def _passes(a: str, b: str) -> Column:
    """Size and parity filter: similar sets differ in (n_a + n_b) (BELOW - ABOVE) / (BELOW + ABOVE) features at most, and in as many at least as parities.

    The parities of two long sets are compared in as many slots as the one with
    fewer has.
    """
    n_a, n_b, x, y = F.col(f"{a}_n"), F.col(f"{b}_n"), F.col(f"{a}_more"), F.col(f"{b}_more")
    few = lambda bits: bits * (ABOVE + BELOW) <= (n_a + n_b) * (BELOW - ABOVE)
    bits = reduce(Column.__add__, (F.bit_count(F.col(f"{a}_{p}").bitwiseXOR(F.col(f"{b}_{p}"))) for p in PARITIES))
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    half = lambda x: xor(F.slice(x, F.lit(1), F.shiftright(F.size(x), 1)), F.slice(x, F.shiftright(F.size(x), 1) + 1, F.shiftright(F.size(x), 1)))
    differ = F.when(F.size(x) == F.size(y), xor(x, y)).when(F.size(x) > F.size(y), xor(half(x), y)).otherwise(xor(x, half(y)))
    more = F.aggregate(differ, F.lit(0), lambda n, p: n + F.bit_count(p))
    return (F.least(n_a, n_b) * BELOW >= F.greatest(n_a, n_b) * ABOVE) & few(bits) & ((F.least(n_a, n_b) <= SLOTS) | few(more))


def distinct_lists(rows: DataFrame) -> DataFrame:
    """(list, ord, size, weight), staged: of lists that hold the same texts one, with their number."""
    rows = stage(rows.distinct(), "lists")
    members = [F.bit_xor(F.xxhash64("ord")).alias("x"), F.bit_xor(F.xxhash64("ord", F.lit(7))).alias("y")]
    whole = rows.groupBy("list").agg(F.count("*").alias("size"), *members)
    one = whole.groupBy("size", "x", "y").agg(F.min("list").alias("list"), F.count("*").alias("weight"))
    return stage(rows.join(stage(one.select("list", "size", "weight"), "lists-one"), "list"), "lists-distinct")


def joined(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label), staged: components of the links among lists ``rows`` (list, ord), for texts that have one."""
    lists = distinct_lists(rows)
    # how well a text is connected: the entries of its lists
    degree = lists.groupBy("ord").agg(F.sum(F.col("size") * F.col("weight")).alias("degree"))
    known = stage(lists.join(degree, "ord"), "lists-ranked")
    centres = stage(known.groupBy("list").agg(F.max(F.struct("degree", "ord")).alias("c")).select("list", F.col("c.ord").alias("centre")), "list-centres")
    shared = known.join(centres, "list").filter("ord <> centre").groupBy("ord", "centre").agg(F.sum("weight").alias("n"))
    best = stage(shared.groupBy("ord").agg(F.max(F.struct("n", "centre")).alias("c")).select(F.col("c.centre").alias("a"), F.col("ord").alias("b")), "set-pairs-first")
    first = components(verified(best, sets))
    texts = stage(degree.select("ord").join(first, F.col("ord") == F.col("node"), "left").join(best.select(F.col("b").alias("ord"), F.col("a").alias("tried")), "ord", "left").select("ord", F.coalesce("label", "ord").alias("part"), F.coalesce("tried", "ord").alias("tried")), "set-parts")
    tagged = stage(lists.select("list", "ord").join(texts, "ord"), "lists-parts")
    by_part = tagged.groupBy("list", "part").agg(F.count("*").alias("n")).groupBy("list").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts"))
    mixed = stage(by_part.filter("parts > 1").select("list", F.col("most.part").alias("main")), "lists-mixed")
    live = stage(tagged.join(mixed, "list").join(sets.drop("features"), "ord"), "lists-live")
    side = lambda k, rows: rows.select("list", *(F.col(c).alias(f"{k}_{c}") for c in ("ord", "part", "tried", "n", "more", *PARITIES)), F.col("main").alias(f"{k}_main"))
    differ = (F.col("a_part") != F.col("b_part")) & ((F.col("a_part") == F.col("a_main")) | (F.col("a_ord") < F.col("b_ord"))) & (F.col("a_ord") != F.col("b_tried")) & (F.col("b_ord") != F.col("a_tried"))
    met = side("a", live).join(side("b", live.filter("part <> main")), "list").filter(differ & _passes("a", "b"))
    pairs = stage(met.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")).distinct(), "set-pairs-rest")
    part_of = lambda k, links: links.join(texts.select(F.col("ord").alias(k), F.col("part").alias(f"{k}_part")), k).drop(k).withColumnRenamed(f"{k}_part", k)
    between = components(part_of("b", part_of("a", verified(pairs, sets))))
    return stage(texts.join(between, F.col("part") == F.col("node"), "left").select(F.col("ord").alias("node"), F.coalesce("label", "part").alias("label")), "set-components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id that links reach).

    Links: shingle sets with Jaccard similarity 0.8 or more. Null, empty and
    blank texts have no shingles and no links, so each is its own component,
    also when there are several. Equal texts are linked, also when they are short.
    A null id takes part but is a component_id only where there is no other.
    Other columns of ``docs`` are not read; no rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes")]
    rows = stage(docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", *key), "text-digests")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    distinct = docs.select(text.alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("text").agg(F.lit(1).alias("one"))
    texts = stage(distinct.select(F.monotonically_increasing_id().alias("ord"), "text", *key), "distinct-texts", "zstd")
    found = shared_signatures(texts, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    lists = found.filter("kind = 0").select(F.col("a").alias("list"), F.col("b").alias("ord"))
    sets = wanted_sets(texts, stage(lists.select("ord").distinct(), "wanted-texts"))
    labels = joined(lists, sets)
    sizes = found.filter("kind = 1").select(F.col("a").alias("ord"), F.col("b").alias("n_shingles"))
    known = stage(texts.select("ord", "digest", "n_bytes").join(sizes, "ord").join(labels, F.col("ord") == F.col("node"), "left").select("digest", "n_bytes", "n_shingles", F.coalesce("label", "ord").alias("label")), "text-labels")
    least = rows.groupBy("digest", "n_bytes").agg(F.min("id").alias("least")).join(known, ["digest", "n_bytes"])
    best = stage(least.groupBy("label").agg(F.min("least").alias("component_id")), "component-ids")
    classes = stage(known.join(best, "label").drop("label"), "text-components")
    drop_stage(texts)
    met = rows.join(classes, ["digest", "n_bytes"], "left")
    none = F.col("n_shingles").isNull()
    return met.select(F.col("id").alias(id_col), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir):
    """doc_id, n_shingles and component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))
