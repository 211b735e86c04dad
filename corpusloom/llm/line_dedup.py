"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words (lower case, told apart by 64-bit hashes). Lines
with equal sets form a class, and classes are joined with each other:

* words are ordered by rarity. Frequencies are counted in a fixed number of
  hash buckets; any order that is the same for all lines is right, so sharing a
  bucket costs speed only. Each word becomes one long: level of its frequency,
  then hash;
* prefix filter: two sets whose Jaccard similarity reaches the threshold share
  one of their rarest n - ceil(t n) + 1 words, so only these are indexed;
* length filter: neither set may be shorter than t times the other; lists of
  the index are kept by bands of lengths, so most others are never met;
* positional filter: what is left behind the shared word must still suffice;
* parity filter: a set's words flip the bits of one long, those of a long set
  the bits of four, which added bit by bit give what one long would hold; two
  sets differ in at least as many words as their parities in bits;
* candidates are verified on the words of both lines.

A line is removed if an earlier line (by document id, then place) matches it,
whether or not that line stays itself. All pairs of classes that match are
found and counted. What only asks which lines go (``removed_lines``)
stops comparing a class once it has an earlier match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import stored_row
from corpusloom.plans.staging import drop_stage, stage, table

BITS = 16  # of a hash, for its bucket: as many buckets as the first level of a hash aggregation holds
SLICES = 3  # the index and texts are joined in so many parts, whose shuffle files go before the next
ABOVE, BELOW = 4, 5  # the threshold as a fraction
LONG = 80  # sets of more words have four longs of parities
PARITIES = ["parity0", "parity1", "parity2", "parity3"]
CLASS = ["set_key", "n"]
GONE = "lines that go"


def _blanks(text: Column | str) -> Column:
    """White space other than line feeds as blanks."""
    return reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit(" ")), "\t\v\f\r", F.col(text) if isinstance(text, str) else text)


def _hashes(line: Column | str) -> Column:
    """The different words of a line whose white space is blanks."""
    return F.array_except(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text); null texts are empty."""
    return docs.select(stored_row().alias("row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def _rarity(texts: DataFrame) -> Column:
    """Level of the frequency of every hash bucket above 56 bits, as a constant of 2 ** BITS numbers."""
    bucket = _bucket(F.xxhash64("w")).alias("bucket")
    words = F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")  # of whole texts, as lines do not matter here
    counts = texts.select(F.explode(words).alias("w")).groupBy(bucket).agg(F.count("*").alias("count"))
    levels = ["0"] * (1 << BITS)
    for r in counts.select("bucket", F.floor(2 * F.log2("count")).cast("int").alias("level")).collect():  # a row a bucket at most; a long count has a level below 127, which fits above 56 bits
        levels[r["bucket"]] = str(r["level"] << 56)
    return F.from_json(F.lit(f"[{','.join(levels)}]"), "array<bigint>")


def line_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, place, set_key, n, prefix, parities) of every line, staged; blank lines have n = 0."""
    texts = _numbered(docs, id_col, text_col).withColumn("text", _blanks("text"))
    lines = texts.select("row", "id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    levels = _rarity(texts.select("text"))
    level = lambda h: F.coalesce(F.get(levels, _bucket(h)), F.lit(0).cast("long"))  # never null: so Spark sorts plain longs
    token = lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 8))
    sets = lines.select("row", "id", "place", F.sort_array(F.transform(_hashes("line"), token)).alias("tokens"))
    n = F.size("tokens")
    flip = lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int")))
    parity = lambda tokens: F.aggregate(tokens, F.lit(0).cast("long"), flip)
    part = lambda i: F.filter("tokens", lambda t: F.shiftright(t, 6).bitwiseAND(3) == i)
    parities = [F.when(n > LONG, parity(part(i))).otherwise(F.lit(0).cast("long") if i else parity("tokens")).alias(x) for i, x in enumerate(PARITIES)]
    return stage(sets.select("row", "id", "place", F.xxhash64("tokens").alias("set_key"), n.alias("n"), F.slice("tokens", F.lit(1), n - F.ceil(n * ABOVE / BELOW).cast("int") + 1).alias("prefix"), *parities), "line-sets")


def _passes(a: str, b: str) -> Column:
    """Length, positional and parity filter of two classes that share an indexed word."""
    n_a, n_b, at_a, at_b = F.col(f"{a}_n"), F.col(f"{b}_n"), F.col(f"{a}_at"), F.col(f"{b}_at")
    both = n_a + n_b
    long_enough = F.least(n_a, n_b) * BELOW >= F.greatest(n_a, n_b) * ABOVE
    reachable = F.least(n_a - at_a, n_b - at_b) * (ABOVE + BELOW) >= both * ABOVE
    # similar sets have (both - 2 x shared) words in one only, and shared x (ABOVE + BELOW) >= both x ABOVE
    flips = [F.col(f"{a}_{x}").bitwiseXOR(F.col(f"{b}_{x}")) for x in PARITIES]
    bits = F.when((n_a > LONG) == (n_b > LONG), sum(map(F.bit_count, flips))).otherwise(F.bit_count(reduce(Column.bitwiseXOR, flips)))
    return long_enough & reachable & (bits * (ABOVE + BELOW) <= both * (BELOW - ABOVE))


def _band(n: Column | str) -> Column:
    """Number of words (4 at least) as a length in bits and the two bits after the first: it grows with n, four bands an octave."""
    bits = F.length(F.bin(n))
    return bits * 4 + F.call_function("shiftright", n, bits - 3).bitwiseAND(3)


def _postings(classes: DataFrame, name: str, k: int, slices: int = SLICES, prefix: str | Column = "prefix", *more: str) -> DataFrame:
    """One row per indexed word of slice ``k``: token, and ord, n, at, parities and ``more`` of its class under ``name``."""
    # sets of up to BELOW - 2 words have no partner but themselves
    rows = classes.filter(F.col("n") > BELOW - 2).select("ord", "n", *PARITIES, *more, F.posexplode(prefix).alias("at", "token")).filter(F.pmod("token", F.lit(slices)) == k)
    return rows.select("token", *(F.col(x).alias(f"{name}_{x}") for x in ("ord", "n", "at", *PARITIES, *more)))


def _verified(docs: DataFrame, pairs: DataFrame, ranks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b), staged: the pairs of ``pairs`` (a < b) that match, compared on the words of both lines."""
    ends = pairs.select(F.col("a").alias("ord")).union(pairs.select("b")).distinct()
    wanted = stage(ends.join(ranks.select("ord", "row", "place"), "ord").groupBy("row").agg(F.collect_list(F.struct("place", "ord")).alias("wanted")), "wanted-lines")
    parts = []
    for k in range(SLICES):  # texts travel to their wanted lines, so one slice of them at a time; the hash table holds the wanted places, texts are not sorted
        of_slice = lambda x: x.filter(F.pmod("row.at", F.lit(SLICES)) == k)  # noqa: B023, E731
        found = of_slice(_numbered(docs, id_col, text_col).select("row", "text")).join(of_slice(wanted).hint("shuffle_hash"), "row").select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("x"))
        parts.append(stage(found.select(F.col("x.ord").alias("ord"), _hashes(_blanks(F.get("parts", F.col("x.place")))).alias("words")), "line-words"))
    words = reduce(DataFrame.union, parts)
    of = lambda k: words.select(F.col("ord").alias(k), F.col("words").alias(f"{k}_words"))
    similar = F.size(F.array_intersect("a_words", "b_words")) * (ABOVE + BELOW) >= (F.size("a_words") + F.size("b_words")) * ABOVE
    matched = []
    for k in range(SLICES):  # words travel with their pairs
        some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(SLICES)) == k)
        matched.append(stage(some.join(of("a"), "a").join(of("b"), "b").filter(similar).select("a", "b"), "line-links"))
    for part in parts:
        drop_stage(part)
    return reduce(DataFrame.union, matched)


def _earliest(links: DataFrame) -> DataFrame:
    """(ord, match), staged: the later classes of ``links`` with their earliest other."""
    return stage(links.groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("match")), "line-matches")


def _ranked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranks, classes): each class with its place in the order of first lines, ``ord``, and its first line; each with its index. ``lines`` is dropped."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "place")).alias("first")
    ranks = stage(lines.filter("n > 0").groupBy(*CLASS).agg(first).select(*CLASS, "first.*"), "line-firsts")
    order = ["last", "id", "row", "place"]
    # ranges in order, sorted: the numbers grow with the rank
    ranks = stage(ranks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()).drop("last"), "line-ranks")
    classes = stage(lines.select("row", "place", "n", "prefix", *PARITIES).join(ranks.select("row", "place", "ord"), ["row", "place"]).select("ord", "n", "prefix", *PARITIES), "line-classes")
    drop_stage(lines)
    return ranks, classes


def _met(classes: DataFrame, *more: str) -> DataFrame:
    """(a, b) with a < b, staged: all pairs of classes that share an indexed word and pass the filters, each once.

    The shorter set of a pair, whose partner is no shorter, needs
    n - ceil(2 t n / (1 + t)) + 1 words in the index only, and a shared word at
    place ``at`` leaves partners of n to (n - (1 + t) at) / t words: the lists of
    the longer ones are kept by bands of their lengths, and the shorter one looks
    into these bands only. With ``open`` as ``more``, pairs whose later class is
    not open are left out.
    """
    pairs, short = [], F.slice("prefix", F.lit(1), F.col("n") - F.ceil(F.col("n") * 2 * ABOVE / (ABOVE + BELOW)).cast("int") + 1)
    most = F.floor((F.col("s_n") * BELOW - F.col("s_at") * (ABOVE + BELOW)) / ABOVE)
    bands = F.sequence(_band(F.col("s_n")), _band(F.greatest("s_n", most).cast("int")))
    listed = F.xxhash64("token", "band")  # one long: lists that share it by chance are one, whose pairs are compared as any
    slices = SLICES + bool(more)
    for k in range(slices):
        s_first = F.col("s_ord") < F.col("l_ord")
        ordered = (F.col("s_n") < F.col("l_n")) | ((F.col("s_n") == F.col("l_n")) & s_first)
        wanted = F.when(s_first, F.col("l_open")).otherwise(F.col("s_open")) if more else F.lit(True)
        shorter = _postings(classes, "s", k, slices, short, *more).withColumn("band", F.explode(bands)).withColumn("list", listed).drop("token", "band")
        longer = _postings(classes, "l", k, slices, "prefix", *more).withColumn("band", _band(F.col("l_n"))).withColumn("list", listed).drop("token", "band")
        met = shorter.join(longer, "list").filter(ordered & wanted & _passes("s", "l"))
        pairs.append(stage(met.select(F.least("s_ord", "l_ord").alias("a"), F.greatest("s_ord", "l_ord").alias("b")).distinct(), "line-pairs-slice"))
    return stage(reduce(DataFrame.union, pairs).distinct(), "line-pairs")


def line_links(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ranks, links): the classes by rank, as in ``line_matches``; all pairs of classes that match, (a, b) with a < b by ``ord``.

    ``lines`` is dropped. Pairs grow with the square of a group of near copies.
    """
    ranks, classes = _ranked(lines)
    pairs = _met(classes)
    drop_stage(classes)
    return ranks, _verified(docs, pairs, ranks, id_col, text_col)


def line_matches(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ranks, matches): each class with its place in the order of first lines, ``ord``, and its first line; (ord, match) of those that match an earlier one.

    ``lines`` is dropped as soon as the classes are known.

    A list of the index is not paired with itself. First every class meets the
    earliest class of each of its lists. Only classes that match none of these
    meet all earlier ones of their lists. In a group of near copies nearly all
    are decided by the first step, so pairs do not grow with its square. This
    finds which lines go, not all links.
    """
    ranks, classes = _ranked(lines)
    pairs = []
    for k in range(SLICES):
        of = lambda x: F.min_by(f"a_{x}", "a_ord").alias(f"a_{x}")
        lists = _postings(classes, "a", k).groupBy("token").agg(F.min("a_ord").alias("a_ord"), of("n"), of("at"), *map(of, PARITIES), F.count("*").alias("size")).filter("size > 1")
        lists = stage(lists.drop("size"), "line-lists")
        met = _postings(classes, "b", k).join(lists, "token").filter((F.col("a_ord") != F.col("b_ord")) & _passes("a", "b"))
        pairs.append(stage(met.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")).distinct(), "line-pairs-first"))
        drop_stage(lists)
    tried = reduce(DataFrame.union, pairs).distinct()
    tried = stage(tried, "line-pairs")
    matches = _earliest(_verified(docs, tried, ranks, id_col, text_col))
    marked = stage(classes.join(matches.select("ord", F.lit(False).alias("open")), "ord", "left").withColumn("open", F.coalesce("open", F.lit(True))), "line-classes-open")
    drop_stage(classes)
    pairs = _met(marked, "open")
    drop_stage(marked)
    rest = stage(pairs.join(tried, ["a", "b"], "left_anti"), "line-pairs-rest")
    return ranks, matches.union(_earliest(_verified(docs, rest, ranks, id_col, text_col)))


def _placed(slim: DataFrame, known: DataFrame, id_col: str, *more: str) -> DataFrame:
    """The lines ``slim`` with what is ``known`` of their classes; counts among ``more`` are 0 where nothing is."""
    met = slim.join(stage(known, "line-decisions"), CLASS, "left")
    is_first = F.coalesce((F.col("row") == F.col("class_row")) & (F.col("place") == F.col("class_place")), F.lit(False))
    removed = F.col("class_row").isNotNull() & (F.col("match_place").isNotNull() | ~is_first)
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in more]
    return met.select("row", F.col("id").alias(id_col), F.col("place").alias("line"), F.col("n").alias("n_words"), "class_id", F.col("class_place").alias("class_line"), "match_id", F.col("match_place").alias("match_line"), *counts, removed.alias("removed"))


def _known(ranks: DataFrame, matched: DataFrame, *more: str) -> DataFrame:
    """Each class with its first line and what ``matched`` says of it; ``match`` there is the ord of another class."""
    to = ranks.select(F.col("ord").alias("match"), F.col("id").alias("match_id"), F.col("place").alias("match_place"))
    matched = stage(matched.join(to, "match", "left").drop("match"), "line-matched")
    return ranks.join(matched, "ord", "left").select(*CLASS, F.col("id").alias("class_id"), F.col("row").alias("class_row"), F.col("place").alias("class_place"), "match_id", "match_place", *more)


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of ``docs``: row, id, line, n_words, class_id, class_line, match_id, match_line, n_links, removed.

    The class is named by its first line. ``match``: the earliest line that the
    class matches, null if there is none. ``n_links`` counts all other classes
    that match it, earlier and later; ``line_links`` has the pairs. Blank lines have no
    class and are never removed. Null texts are one blank line; lines end at
    line feeds only. ``docs`` has to be read from Parquet and at most filtered
    or projected, as its rows are known by file and place; rows that repeat an
    id are ranked by these. An empty table gives no rows.
    """
    lines = line_sets(docs, id_col, text_col)
    slim = stage(lines.select("row", "id", "place", *CLASS), "line-classes-of")
    ranks, links = line_links(docs, lines, id_col, text_col)
    ends = links.select(F.col("b").alias("ord"), F.col("a").alias("match")).union(links.select("a", F.lit(None).cast("long")))
    known = ends.groupBy("ord").agg(F.min("match").alias("match"), F.count("*").alias("n_links"))
    return _placed(slim, _known(ranks, known, "n_links"), id_col, "n_links")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similar_lines`` without the links: ``match`` is the earliest of the lines a class was compared with, and ``removed`` is the same."""
    lines = line_sets(docs, id_col, text_col)
    slim = stage(lines.select("row", "id", "place", *CLASS), "line-classes-of")
    ranks, matches = line_matches(docs, lines, id_col, text_col)
    return _placed(slim, _known(ranks, matches), id_col)


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text_col``; all rows and columns stay, whatever their names, a text may become empty."""
    found = removed_lines(docs.select(id_col, text_col), id_col, text_col).filter("removed")
    gone = stage(found.groupBy(F.col("row").alias(f"row of {GONE}")).agg(F.collect_set("line").alias(GONE)), "removed-lines")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all")  # names of its columns meet no others
    joined = docs.select(row, stored_row().alias("row")).join(gone, F.col("row") == F.col(f"row of {GONE}"), "left")
    text = F.col("all").getField(text_col)
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(GONE, i)), "\n")
    return joined.select(*(F.when(F.col(GONE).isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col("all").getField(c).alias(c) for c in docs.columns))


def op3_line_dedup(spark, sf_dir):
    """The lines of all documents with their classes, matches and numbers of links."""
    return similar_lines(table(spark, sf_dir, "documents")).drop("row")
