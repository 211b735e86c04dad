"""Best-fit packing by linear grouping.

Documents become token ids in tasks. Only the table of piece lengths, at most
``capacity`` rows whatever the corpus, is planned on the driver: large lengths
are put in groups of equal cardinality and rounded up to the largest of each
group; the configuration program of the few rounded sizes is solved by column
generation, a knapsack pricing each new configuration, and rounded down; what
the rounding leaves is filled by a bounded knapsack, largest size first; the
actual lengths, known by their rank, take the places of the rounded ones; small
lengths then go, longest first, where they fit best, into what is left. A plan row covers a whole range of ranks
of one length. Pieces learn their rank among those of equal length from
bucket counts, so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import map_column
from corpusloom.plans.staging import stage, table

CAPACITY = 2048
BUCKETS = 256
CACHED = 600_000
_LETTER = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")
_PLAIN = re.compile(rf"[\t\n\r -&(-~À-Ö\u00d8-Þ{_LETTER}]*")
# The cut of the tokenizer whose pre-tokens are made here; with another one all texts go to the tokenizer whole.
_CUT = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "added": "<|",
}
_pieces: dict[str, _Pieces] = {}


def _is_known_cut(tokenizer: str) -> bool:
    """Does the tokenizer (as JSON) cut texts as ``_PIECE`` does where ``_PLAIN`` holds?"""
    d = json.loads(tokenizer)
    norm, pre = d["normalizer"] or {}, d["pre_tokenizer"] or {}
    steps = norm.get("normalizers", [])
    split, *levels = pre.get("pretokenizers") or [{}]
    return (
        [x["type"] for x in steps] == _CUT["normalizer"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and split.get("pattern") == {"Regex": _CUT["pattern"]} and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in levels] == [("ByteLevel", False, False)]
        and d["post_processor"] is None and d["model"]["type"] == "BPE" and all(x["content"].startswith(_CUT["added"]) for x in d["added_tokens"])
    )


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Pieces(dict):
    """Little-endian 32-bit ids by pre-token, for as many as the bound allows; one per tokenizer and Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model, self.known = self.tokenizer.model, _is_known_cut(self.tokenizer.to_str())
        self.by_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        signs = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        self[piece] = ids = b"".join([self.by_id[t.id] for t in self.model.tokenize(signs)])
        return ids

    def encode(self, text: str) -> bytes:
        if not self.known:
            return b"".join([self.by_id[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))
        if " " in text or "\n" in text:
            return b"".join([self.encode(w) for w in text.replace("\n", " ").split(" ") if w])
        return b"".join([self.by_id[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each whole text, as the tokenizer at ``path`` gives them.

    That tokenizer lower-cases, drops white space and cuts texts into runs of
    letters, single digits and runs of other characters before it merges. In
    texts of plain Latin letters, digits and ASCII signs without apostrophes
    the cut is made here and each pre-token is merged by the tokenizer's model
    once while the bounded cache holds it. In other texts that holds for their
    plain words; the rest goes through the tokenizer whole. A file that cuts in
    another way is found by its settings, and all of its texts go through it whole.
    """
    if path not in _pieces:
        _pieces[path] = _Pieces(path)
    return [_pieces[path].encode(t or "") for t in texts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): every document's ids and then ``end_id``, cut only beyond ``capacity``.

    Null texts count as empty: one piece that holds ``end_id`` alone.
    """

    def make():
        size, end = 4 * capacity, end_id.to_bytes(4, "little")

        def cut(texts):
            times, rows = [], []
            for ids in encode_texts(texts, tokenizer):
                ids += end
                starts = range(0, len(ids), size)
                times.append(len(starts))
                rows += [(k, a // 4, ids[a : a + size]) for k, a in enumerate(starts)]
            place, start, parts = zip(*rows, strict=True)
            return times, place, start, [len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts], parts

        return cut

    return map_column(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", make, "piece int, start long, length long, ids_crc32 long, ids binary")


class _Bins:
    """Equal bins: ``copies`` of them, each with the same lengths. parts: [length, first rank, how many per bin, offset]."""

    def __init__(self, copies: int, parts: list[list[int]], used: int):
        self.copies, self.parts, self.used = copies, parts, used

    def split(self, n: int) -> _Bins:
        """Take the first n bins off."""
        first = _Bins(n, [list(p) for p in self.parts], self.used)
        self.parts = [[length, r + n * k, k, off] for length, r, k, off in self.parts]
        self.copies -= n
        return first

    def add(self, length: int, rank: int, k: int) -> None:
        self.parts.append([length, rank, k, self.used])
        self.used += k * length


def _best_fill(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the fullest worth within ``capacity``; any number of each may be taken."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, n in enumerate(sizes):
        if worth[g] <= 0:
            continue
        for a in range(n, capacity + 1, n):  # a run of n sums builds on the run before it
            b = min(a + n, capacity + 1)
            more = best[a - n : b - n] + worth[g]
            better = more > best[a:b] + 1e-12
            best[a:b][better] = more[better]
            last[a:b][better] = g
    use, at = np.zeros(len(sizes)), capacity
    while last[at] >= 0:
        use[last[at]] += 1
        at -= sizes[last[at]]
    return use


def configuration_program(sizes: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """(times, {size's place: how many}) of the linear program with the fewest bins in all, and that number.

    Minimise the sum of times, so that every size is placed ``counts`` times.
    Columns are generated: the simplex basis starts with one size a
    configuration, its prices ask the knapsack for a configuration worth more
    than the bin it takes, and that one replaces the configuration which runs out
    first. It ends when no configuration is worth more. Sizes without a count
    are left out. Any basis on the way is a whole plan, so the limit on rounds
    costs bins at worst, never rows.
    """
    live = [g for g in range(len(sizes)) if counts[g]]
    if not live:
        return [], 0.0
    some, need = [sizes[g] for g in live], np.array([counts[g] for g in live], float)
    basis = np.diag([float(capacity // n) for n in some])
    for _ in range(50 * len(some)):
        prices = np.linalg.solve(basis.T, np.ones(len(some)))
        new = _best_fill(some, prices, capacity)
        if prices @ new <= 1 + 1e-9:
            break
        times, move = np.linalg.solve(basis, np.column_stack([need, new])).T
        may = move > 1e-9
        share = np.where(may, np.maximum(times, 0) / np.where(may, move, 1), np.inf)
        basis[:, int(share.argmin())] = new
    times = np.maximum(np.linalg.solve(basis, need), 0)
    columns = [(float(x), {live[i]: int(k) for i, k in enumerate(basis[:, j]) if k}) for j, x in enumerate(times)]
    return [c for c in columns if c[0] > 1e-9], float(times.sum())


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {group: how many}): the configuration program rounded down, then what is left over."""
    left, out = list(counts), []
    for x, use in configuration_program(sizes, counts, capacity)[0]:
        times = min([int(x + 1e-6), *(left[g] // k for g, k in use.items())])
        if times:
            out.append((times, use))
            for g, k in use.items():
                left[g] -= times * k
    return out + _fill_rest(sizes, left, capacity)


def _fill_rest(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {group: how many}): the largest size left and the fullest knapsack beside it, as often as counts allow."""
    left, out = list(counts), []
    order = sorted(range(len(sizes)), key=lambda g: -sizes[g])
    for top in order:
        while left[top]:
            room = capacity - sizes[top]
            came: list[tuple[int, int, int] | None] = [None] * (room + 1)  # (group, how many, sum before)
            came[0] = (-1, 0, 0)
            for g in order:
                have = min(left[g] - (g == top), room // sizes[g])
                if have <= 0:
                    continue
                for s in [s for s in range(room + 1) if came[s] is not None]:
                    for k in range(1, min(have, (room - s) // sizes[g]) + 1):
                        if came[s + k * sizes[g]] is None:
                            came[s + k * sizes[g]] = (g, k, s)
                        else:
                            break
                if came[room] is not None:
                    break
            s, use = max(s for s in range(room + 1) if came[s] is not None), defaultdict(int, {top: 1})
            while s:
                g, k, s = came[s]
                use[g] += k
            times = min(left[g] // k for g, k in use.items())
            for g, k in use.items():
                left[g] -= times * k
            out.append((times, dict(use)))
    return out


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 64, small: int = CAPACITY // 8) -> list[_Bins]:
    """Bins for all lengths; ``counts`` has how many pieces have each length (1 to ``capacity``)."""
    large = sorted((n for n in counts if n > small and counts[n]), reverse=True)
    total, sizes, members, seen = sum(counts[n] for n in large), [], [], 0
    each = max(1, -(-total // groups))
    for n in large:  # a group: (length, first rank, how many), longest first
        rank = 0
        while rank < counts[n]:
            if seen % each == 0 and not (sizes and sizes[-1] == n):  # groups of one length are one size
                sizes.append(n)
                members.append([])
            k = min(counts[n] - rank, each - seen % each)
            members[-1].append((n, rank, k))
            rank, seen = rank + k, seen + k
    bins: list[_Bins] = []
    used = [0] * len(sizes)
    for times, use in _configurations(sizes, [sum(k for *_, k in m) for m in members], capacity):
        places, cuts = [], {0, times}
        for g, k in use.items():
            for _ in range(k):
                spans, at = [], 0  # what stands at this place in the copies 0 to times
                for n, rank, m in members[g]:
                    lo, hi = max(at, used[g]), min(at + m, used[g] + times)
                    if lo < hi:
                        spans.append((lo - used[g], hi - used[g], n, rank + lo - at))
                        cuts.add(lo - used[g])
                    at += m
                places.append(spans)
                used[g] += times
        marks = sorted(cuts)
        for a, b in zip(marks, marks[1:], strict=False):
            new = _Bins(b - a, [], 0)
            for spans in places:
                lo, _, n, rank = next(x for x in spans if x[0] <= a < x[1])
                new.add(n, rank + a - lo, 1)
            bins.append(new)
    by_room: dict[int, list[_Bins]] = defaultdict(list)
    rooms: list[int] = []

    def put(x: _Bins) -> None:
        room = capacity - x.used
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(x)

    for x in bins:
        put(x)
    for n in sorted((n for n in counts if n <= small and counts[n]), reverse=True):
        rank, left = 0, counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                x = _Bins(max(1, left // (capacity // n)), [], 0)
                bins.append(x)
            else:
                x = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del rooms[at]
            k = min((capacity - x.used) // n, left)
            full = min(x.copies, left // k)
            if full < x.copies:
                rest, x = x, x.split(full)
                bins.append(x)
                put(rest)
            x.add(n, rank, k)
            rank, left = rank + full * k, left - full * k
            put(x)
    return bins


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[_Bins]:
    """The fewest bins among a few numbers of groups and limits for small lengths; the first plan that no other can beat."""
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for groups, part in ((24, 8), (96, 4), (384, 3), (384, 2)):
        plan = plan_lengths(counts, capacity, groups, max(1, capacity // part))
        if best is None or sum(x.copies for x in plan) < sum(x.copies for x in best):
            best = plan
        if sum(x.copies for x in best) == least:
            break
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece, length and others; staged) with sequence_id and offset.

    Sequences hold ``capacity`` tokens at most and are gapless from 0. Equal
    rows may be exchanged for each other. No rows: no rows.
    """
    cells = stage(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "length-counts")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows, first = [], 0
    for x in best_plan(counts, capacity):
        rows += [(n, rank, rank + k * x.copies, k, first, off) for n, rank, k, off in x.parts]
        first += x.copies
    plan = pieces.sparkSession.createDataFrame(rows, "length long, rank_from long, rank_to long, per long, sequence_from long, offset_from long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(cells.withColumn("before", before).drop("n"), "length-starts")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = pieces.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + within).drop("before", "bucket")
    # the plan grows with the number of distinct lengths, not with the pieces
    met = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(plan.length)
    at = F.col("rank") - F.col("rank_from")
    return met.withColumn("sequence_id", F.col("sequence_from") + F.floor(at / F.col("per"))).withColumn("offset", F.col("offset_from") + at % F.col("per") * F.col("length")).drop("rank", "rank_from", "rank_to", "per", "sequence_from", "offset_from")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary) if asked for.

    Null and empty texts are one piece of length 1. Repeated rows are packed as
    often as they stand there; null ids are packed like others. Other columns of
    ``docs`` are not read. No rows: no rows.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS)).cast("int"))
    packed = pack(stage(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    """The pieces of all documents with their sequences and places there."""
    return pack_documents(table(spark, sf_dir, "documents"))
