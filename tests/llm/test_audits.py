import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from corpusloom.llm import filter_audit as A
from corpusloom.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, part string, quality string, term string, id string, n string"
WORDS = [a + b for a in "ka lo mi ne ru sa ti vo".split() for b in "bel dor fin gam hul".split()]


def rows_of(seed=3, n=160):
    draw = random.Random(seed)
    text = lambda: " ".join(draw.choice(WORDS).title() if draw.random() < 0.2 else draw.choice(WORDS[: draw.randint(1, 40)]) for _ in range(draw.randint(1, 250))) + draw.choice(["", " 5%", "\n#x", " é漢ß É"])
    rows = [(i, text(), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "s2", "s2", None, "é", "z"])) for i in range(n)]
    rows += [(n + i, rows[i // 3][1], rows[i][2], rows[i][3]) for i in range(40)]
    rows += [(900, None, "fr", "lonely"), (901, "", "fr", "lonely"), (902, None, None, None), (903, " ".join(draw.choice(WORDS) for _ in range(20_000)), "de", "s1"), (904, "A\tB\x1cC\x0bD", "en", "s2")]
    return [(*r, "clash", "clash", "clash", "clash", "clash") for r in rows]


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 190, 2)] + [(900, 1, 1), (900, 0, 0), (None, 1, 1), (5000, 1, 1), (903, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def by_sql(sql, docs, labels):
    con = duckdb.connect()
    documents, labels = docs.toArrow(), labels.toArrow()  # noqa: F841
    con.register("documents", documents)
    con.register("labels", labels)
    return con.execute(sql).to_arrow_table().to_pylist()


def same(got, want):
    key = lambda rows: sorted(str(sorted(r.items())) for r in rows)
    assert key([r.asDict() for r in got.collect()]) == key(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 100, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert A.positional_popcount(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]


def test_survival_word():
    assert A.survival_word(0, 5) == (1 << 32) - 1 and A.survival_word(31, 5) == 1
    assert A.survival_word(0b00010, 5) == sum(1 << s for s in range(32) if not s & 2)


def test_filter_interactions_by_brute_force(docs, labels):
    texts, good, toxic = [(r[0], r[1] or "", r[2] or "") for r in docs.collect()], {i for i, q, _ in LABELS if q == 1}, {i for i, _, t in LABELS if t == 1}
    least = {}
    for i, t, _ in texts:
        least[t] = min(least.get(t, i), i)
    fails = defaultdict(list)
    for i, t, part in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i > least[t]}
        fails[part].append((i, {k for k, x in bad.items() if x}))
    want = {}
    for part, rows in fails.items():
        for order in permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                gone, after = [i for i, x in alive if f in x], [(i, x) for i, x in alive if f not in x]
                want[part, "".join(order), step] = [len(after), len(gone), sum(f in x for _, x in rows) - len(gone), sum(x == {f} for _, x in rows), len(good & set(gone)), len(toxic & set(gone))]
                alive = after
    shapley = Counter()
    for (part, order, step), x in want.items():
        shapley[part, order[step - 1]] += x[1]
    got = A.filter_interactions(docs, labels).collect()
    assert len(got) == len(want) == 600 * len(fails)
    for r in got:
        assert [*r][3:] == [*want[r["part"], r["filter_order"], r["step"]], shapley[r["part"], r["filter_order"][r["step"] - 1]]], r


def test_filter_interactions_by_sql(docs, labels):
    same(A.filter_interactions(docs, labels), by_sql(A.SQL, docs, labels))
    assert A.filter_interactions(docs.limit(0), labels).count() == 0
    assert A.filter_interactions(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_filters_of_ones_own(spark):
    rows = spark.createDataFrame([("x", True, False, True), ("x", True, True, False), (None, None, False, None)], "k string, short boolean, loud boolean, mark boolean")
    got = A.interactions(A.survivors(rows, ["short", "loud"], ["mark"], "k"), ["short", "loud"], ["mark"]).collect()
    assert len(got) == 8 and {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["mark_lost"]) for r in got}["x", "loudshort", 2] == (0, 1, 1, 1)
    with pytest.raises(ValueError):
        A.survivors(rows, list("abcdef"), [])


def test_null_ids_are_no_copies(spark, labels):
    rows = spark.createDataFrame([(None, "same", "en"), (None, "same", "en"), (3, "same", "en"), (3, "same", "en"), (4, "same", "en")], "doc_id long, text string, lang string")
    assert sorted((r["id"] or 0, r["E"]) for r in A.text_filters(rows).collect()) == [(0, False), (0, False), (3, False), (3, False), (4, True)]


def test_divergence_by_sql(docs, labels, spark):
    same(D.divergence(docs), by_sql(D.SQL, docs, labels))
    few = docs.filter("lang = 'fr'")
    same(D.divergence(few), [])
    assert D.divergence(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, None), ("x", None, "s"), (None, None, None)], "text string, lang string, source string")
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in D.divergence(none).collect()) == [("", "s", 0, 1), ("s", "", 0, 1)]


def test_divergence_by_brute_force(spark):
    """Few documents a term, so that counts, zeros and ties are hit."""
    draw = random.Random(8)
    rows = [("en", f"s{draw.randint(0, 5)}", " ".join(draw.choice("a b c d E é é1f g-h ß".split()) for _ in range(draw.randint(0, 12)))) for _ in range(60)]
    got = D.divergence(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4), least_docs=9, shown=3).collect()
    terms = lambda t: re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t))
    seen = Counter(w for _, _, t in rows for w in set(terms(t)))
    kept = [w for w, n in seen.items() if n >= 9]
    count = Counter((s, w) for _, s, t in rows for w in terms(t) if w in kept) + Counter((None, w) for _, _, t in rows for w in terms(t) if w in kept)
    groups = {s for _, s, _ in rows}
    p = {(s, w): 1 + 10**9 * (count[s, w] + 5) // (sum(count[s, x] for x in kept) + 5 * len(kept)) for s in (*groups, None) for w in kept}
    want = set()
    for s in groups:
        pairs = sorted((-sum(abs(p[s, w] - p[o, w]) for w in kept), o) for o in groups - {s})
        own = sorted((p[None, w] - p[s, w], w.encode(), w) for w in kept if count[s, w] and p[s, w] > p[None, w])
        want |= {("en", s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)} | {("en", s, "term", w, -v, k) for k, (v, _, w) in enumerate(own[:3], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_tree_sums_are_those_of_all_pairs():
    draw, tree, want = np.random.default_rng(1), D.Tree(), Counter()
    rows = sorted({tuple(sorted((int(s), int(draw.integers(5, 8))) for s in draw.choice(9, draw.integers(1, 9), replace=False))) for _ in range(300)})
    for row in rows:
        path = np.array([(s, p, 4 - s % 3) for s, p in row], np.int64).T
        times = int(draw.integers(1, 5))
        tree.insert(path, times)
        for i in range(len(row)):
            for j in range(i):
                (a, pa, za), (b, pb, zb) = path[:, j].tolist(), path[:, i].tolist()
                want[a, b] += times * (abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))
    tree.close()
    codes, sums = tree.pairs()
    assert {(c >> 32, c & 0xFFFFFFFF): s for c, s in zip(codes.tolist(), sums.tolist(), strict=True)} == dict(want)
