import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, lang string, ord string, n_shingles string, component_id string, digest string"
WORDS = [a + b for a in "ka lo mi ne ru sa ti vo".split() for b in "bel dor fin gam hul".split()]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """{id: (n_shingles, component_id)} by comparing all pairs; ids are distinct."""
    sets, of = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root(i) != root(j):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed=2):
    """Chains of edits, copies, copies of other case, passages that many share, short and empty texts, one very long text."""
    draw = random.Random(seed)
    words = lambda n: [draw.choice(WORDS) + str(draw.randint(0, 30)) for _ in range(n)]
    texts, passage = [], words(45)
    for _ in range(8):
        own = words(draw.randint(6, 150))
        for _ in range(6):
            texts.append(" ".join(own))
            own = list(own)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = "edit" + str(draw.randint(0, 99))
    texts += [" ".join(words(40) + passage + words(40)) for _ in range(30)]
    for n in (600, 1020):  # sets that have more parities, of different numbers
        own = words(n)
        texts += [" ".join(own), " ".join([*own, *words(n // 25)]), " ".join([*own[: n * 3 // 4], *words(n // 4)])]
    long = words(9000)
    texts += [" ".join(long), "\n".join([*long[:-3], "other"]), texts[0].upper(), texts[0].replace(" ", " \t\n"), texts[0], None, "", " \n", "one", "ONE", "one two", "two one", "é ß 漢字 don't", "É ß 漢字 don't", " ".join(["same"] * 500)]
    return list(enumerate(texts))


def test_similar_sets_share_a_signature():
    """Pairs at and just above the threshold, of all sizes; a signature of two sets that leave a feature out both is none."""
    draw = np.random.default_rng(4)
    for size in [*range(1, 60), *draw.integers(60, 2000, 60)]:
        for _ in range(12):
            a = draw.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1)
            gone = int(draw.integers(0, size // 5 + 1))
            new = int((size - gone) * 5 // 4 - size)
            b = np.concatenate([a[gone:], draw.integers(0, 1 << 63, max(0, new), dtype=np.uint64) << np.uint64(1)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both):
                continue
            sig, doc, whole = J.signatures([a, b])
            of = lambda k, w: set(sig[(doc == k) & (whole | (not w))].tolist())  # noqa: B023, E731
            assert of(0, True) & of(1, False) or of(0, False) & of(1, True), (size, gone, new)


def test_signatures_of_a_set_do_not_depend_on_others():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 7, 8, 0, 300)]
    sig, doc, whole = J.signatures(sets)
    for k, s in enumerate(sets):
        alone = J.signatures([s])
        assert sorted(sig[doc == k].tolist()) == sorted(alone[0].tolist()) and whole[doc == k].sum() == alone[2].sum()
        assert len(s) == 0 or len(alone[0])


@pytest.mark.parametrize("crowd", [1, 8])
def test_components_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "BUCKET_BYTES", 20_000)
    rows = near_copies()
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(want) - 30
    docs = spark.createDataFrame([(i, t, "en", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)
    assert {r[0]: (r[1], r[2]) for r in J.jaccard_components(docs).collect()} == want


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (4, "other words are here now"), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(J.jaccard_components(docs).collect(), key=str)
    assert got == sorted([(None, 2, 4), (None, 2, 4), (4, 2, 4), (4, 1, 4), (7, 0, 7), (7, 0, 7), (None, 0, None)], key=str)
    assert J.jaccard_components(docs.limit(0)).collect() == []
    alone = docs.filter("doc_id is null and text <> ''")
    assert [tuple(r) for r in J.jaccard_components(alone).collect()] == [(None, 2, None)] * 2
