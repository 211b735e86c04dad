import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm import batches, components, exact_dedup, language_model, line_dedup, media, mixing, packing, quality, simhash, substring, toxicity
from corpusloom.llm.rows import stored_row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, n long, label int"
WORDS = [a + b for a in "ka lo mi ne ru sa ti vo".split() for b in "bel dor fin gam hul".split()]


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def rows_of(seed=1, n=60):
    draw = random.Random(seed)
    base = ["\n".join(sentence(draw, draw.randint(3, 30)) for _ in range(draw.randint(1, 6))) for _ in range(n)]
    texts = base + [base[0]] * 7 + [base[1].replace(base[1].split()[0], "other", 1), base[2].upper(), None, "", None, " \n ", "one", sentence(draw, 9000), "é ß 漢字 don't\x1c x"]
    sources = [None if i % 11 == 0 else f"s{i % 4}" for i in range(len(texts))]
    return [(i, t, "en", s, None, "clash", "clash", 1, 1) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids and repeated rows."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(None, "a b c d e f", None, None, None, None, None, None, None)] * 2 + [(1, None, None, None, None, None, None, None, None)] * 2 + [(2, "a b c d e f", "en", "x", 3, "", "", 0, 0)] * 3
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, empty, odd, keep):
    best, groups = {"smallest": min, "largest": max}[keep], defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep, runs=5, fan_in=2).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best(ids), len(ids), i == best(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty, keep).count() == 0
    assert Counter((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(odd, keep).collect()) == {(None, 2, False): 2, (2, 2, True): 3, (1, 1, True): 2}


def test_netpbm_and_bmp_round_trips():
    image = np.random.default_rng(0).integers(0, 256, (5, 7), np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P2 # c\n2 1\n# d\n15\n0 15") == [[0, 255]]).all() and (media.decode(b"P1\n2 2\n1 0\n01") == [[0, 255], [255, 0]]).all()
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]] and media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 9 1\n\x80\x00").tolist() == [[0] + [255] * 8]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    assert media.decode(head + b"\x03\x02\x01\x00").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5", b"P9 1 1", b"P5 2 2 255\n\x00"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize():
    image = np.random.default_rng(1).random((6, 9))
    fine = np.repeat(np.repeat(image, 4, 0), 5, 1)  # 24 x 45
    assert np.allclose(media.area_resize(image, 4, 5), fine.reshape(4, 6, 5, 9).mean(axis=(1, 3)))


def test_text_media(docs, empty):
    for r in media.text_media(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        data = (r["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r["feature"]) == 16 and np.load(__import__("io").BytesIO(r["tile_npy"])).shape == (32, 32)
    assert media.text_media(empty).count() == 0


def test_media_features(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(np.full((4, 4), 9, np.uint8)))), (2, bytearray(b"broken")), (3, None)], "k int, media binary")
    found = media.media_features(df, keep=("k",))
    got = {r["k"]: r for r in found.collect()}
    assert (got[1]["height"], got[1]["channels"], got[1]["feature"]) == (4, 1, "0" * 16) and got[2]["error"] and got[3]["feature"] is None
    media.write_tiles(found, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 1


def test_line_dedup(docs, empty, odd):
    lines, first = [], {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for k, line in enumerate((r["text"] or "").split("\n")):
            lines.append((r["doc_id"], k, frozenset(w for w in re.split(r"[ \t-\r]+", line.lower()) if w)))
            first.setdefault(lines[-1][2], lines[-1][:2])
    later = {s for s in first for t in first if s and t and first[t] < first[s] and 9 * len(s & t) >= 4 * (len(s) + len(t))}
    got = {(r["doc_id"], r["line"]): r for r in line_dedup.similar_lines(docs).collect()}
    assert len(got) == len(lines)
    for i, k, s in lines:
        assert got[i, k]["removed"] == (bool(s) and (first[s] != (i, k) or s in later)), (i, k)
        assert (got[i, k]["match_id"] is not None) == (s in later)
    kept = {r["doc_id"]: r for r in line_dedup.drop_similar_lines(docs).collect()}
    for r in docs.collect():
        parts = (r["text"] or "").split("\n")
        want = "\n".join(x for k, x in enumerate(parts) if not got[r["doc_id"], k]["removed"])
        assert (kept[r["doc_id"]]["text"] or "") == want
    assert line_dedup.similar_lines(empty).count() == 0 and line_dedup.drop_similar_lines(empty).count() == 0
    assert line_dedup.similar_lines(odd).filter("removed").count() == 4


def test_line_links(spark, docs, tmp_path):
    """Every pair of similar lines is found and returned once, whatever else its lines match."""
    base = WORDS[:20]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(6)] + [" ".join(base), "a b c d e\na b c d e f\nE D C B A", "quite another line"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "near"))
    for some in (spark.read.parquet(str(tmp_path / "near")), docs):
        first = {}
        for r in sorted(some.collect(), key=lambda r: r["doc_id"]):
            for k, line in enumerate((r["text"] or "").split("\n")):
                first.setdefault(frozenset(w for w in re.split(r"[ \t-\r]+", line.lower()) if w), (r["doc_id"], k))
        links = {tuple(sorted((first[s], first[t]))) for s, t in combinations(first, 2) if s and t and 9 * len(s & t) >= 4 * (len(s) + len(t))}
        rows = line_dedup.similar_lines(some).collect()
        ranks, pairs = line_dedup.line_links(some, line_dedup.line_sets(some))
        at = {r["ord"]: (r["id"], r["place"]) for r in ranks.collect()}
        got = [(at[r["a"]], at[r["b"]]) for r in pairs.collect()]
        assert set(got) == links and len(got) == len(links) > 0
        degree = Counter(end for pair in links for end in pair)
        for r in rows:
            assert r["n_links"] == degree[r["class_id"], r["class_line"]]
            assert (r["match_id"], r["match_line"]) == min((a for a, b in links if b == (r["class_id"], r["class_line"])), default=(None, None))
        key = lambda r: (r["doc_id"], r["line"], r["removed"])
        assert sorted(map(key, rows)) == sorted(map(key, line_dedup.removed_lines(some).collect()))


def test_line_lists_are_kept_by_length(spark, tmp_path):
    """Lines that share rare words meet in a list only if their lengths allow a link; those at the edge of a band still do."""
    bands = [r["band"] for r in spark.range(4, 3000).select(line_dedup._band(F.col("id").cast("int")).alias("band")).orderBy("id").collect()]
    assert bands == sorted(bands) and len(set(bands[:4])) == 4 and all(bands.count(b) <= 512 for b in set(bands))
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(4, 90)] + [" ".join([*(f"w{i}" for i in range(n)), f"own{n}"]) for n in range(4, 90)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "lengths"))
    some = spark.read.parquet(str(tmp_path / "lengths"))
    sets = [set(x.split()) for x in texts]
    similar = lambda s, t: 9 * len(s & t) >= 4 * (len(s) + len(t))
    got = {r["doc_id"]: (r["n_links"], r["match_id"]) for r in line_dedup.similar_lines(some).collect()}
    assert got == {i: (sum(similar(s, t) for t in sets) - 1, next((j for j, t in enumerate(sets[:i]) if similar(s, t)), None)) for i, s in enumerate(sets)}


def test_line_dedup_keeps_columns_of_any_name(docs):
    odd = docs.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in ("gone__", "row__", "row", "all", "place", line_dedup.GONE, "number of row", "a.b")))
    got = {r["doc_id"]: r for r in line_dedup.drop_similar_lines(odd).collect()}
    want = {r["doc_id"]: r["text"] for r in line_dedup.drop_similar_lines(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r[c] == f"own {c}" for r in got.values() for c in odd.columns[2:])


def test_rows_keep_their_names(spark, docs):
    """Line dedup and the pipeline's mix read a table more than once; its splits may differ, as they do when executors come or go."""
    import corpus_pipeline as P

    names = lambda: {r["doc_id"]: r["row"] for r in docs.select("doc_id", stored_row().alias("row")).collect()}
    want, before = names(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert len(set(want.values())) == docs.count()
    removed = sorted(map(str, line_dedup.similar_lines(docs).drop("row").collect()))
    calls, stage = [], line_dedup.stage

    def other_splits(*args):
        calls.append(1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str([2_000, 500_000_000, 30_000][len(calls) % 3]))
        return stage(*args)

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert names() == want
        with pytest.MonkeyPatch.context() as m:
            m.setattr(line_dedup, "stage", other_splits)
            assert sorted(map(str, line_dedup.similar_lines(docs).drop("row").collect())) == removed
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "stage", other_splits)
            got = Counter(r["doc_id"] for r in P.mixing(spark, docs, None).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}


def test_fit_budget():
    draw = np.random.default_rng(0)
    for _ in range(40):
        lengths, counts = np.unique(draw.integers(0, 40, 6)), None
        counts = draw.integers(1, 4, len(lengths))
        total, budget = int((lengths * counts).sum()), int(draw.integers(0, 120))
        take = mixing.fit_budget(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        assert int((take * lengths).sum()) <= min(budget, total)
        base = sum(int(c) * min(budget, total) // total * int(n) for n, c in zip(lengths, counts, strict=True)) if total else 0
        assert int((take * lengths).sum()) >= base


def test_mix(docs, empty, odd):
    got = mixing.mix(docs, keep=("lang",)).join(docs.select("doc_id", "text", "source"), "doc_id").collect()
    assert len(got) == docs.count() and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got)
    own = defaultdict(int)
    for r in got:
        own[r["source"]] += r["size"]
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight, free, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(order), 1.5 * sum(own.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * own[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s]) and r["source_size"] == own[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 0.02 * target[s] + max(r["size"] for r in mine) / 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, keep=("lang",)).join(docs.select("doc_id", "text", "source"), "doc_id").collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == odd.count()


def test_encode_texts_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["", "It's DON'T we'll", "a<|endoftext|>b", "ΑΣ straße ẞ İ é éx", "1234 ½ x²", "\x1c\x85a b c", "µ ª º ×÷", "don’t — 😀 \t\x0bz", "</w> <| |>", "ÀÖØÞß ÿŸ Thble, (x)!!"] + [r[1] or "" for r in rows_of()]
    for t, ids in zip(texts, packing.encode_texts(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_plan_lengths():
    draw = random.Random(4)
    for _ in range(15):
        counts = Counter(draw.randint(1, 100) for _ in range(draw.randint(0, 400)))
        bins = packing.best_plan(counts, 100)
        placed = Counter()
        for x in bins:
            at = 0
            for n, _, k, off in x.parts:
                assert off == at
                at += n * k
                placed[n] += k * x.copies
            assert 0 < at == x.used <= 100 and x.copies > 0
        assert placed == counts
        used, least = sum(x.copies for x in bins), -(-sum(n * c for n, c in counts.items()) // 100)
        assert used <= 1.1 * least + 2


def test_configuration_program():
    def all_configurations(sizes, room):
        if not sizes:
            yield ()
            return
        for k in range(room // sizes[0] + 1):
            for rest in all_configurations(sizes[1:], room - k * sizes[0]):
                yield (k, *rest)

    # a textbook cutting-stock problem: 452.25 rolls by the linear program, 453 whole ones
    sizes, counts = [45, 36, 31, 14], [97, 610, 395, 211]
    columns, value = packing.configuration_program(sizes, counts, 100)
    assert abs(value - 452.25) < 1e-6
    assert all(sum(sizes[g] * k for g, k in use.items()) <= 100 for _, use in columns)
    assert sum(x.copies for x in packing.best_plan(dict(zip(sizes, counts, strict=True)), 100)) == 453
    assert packing.configuration_program([3, 2], [0, 0], 10) == ([], 0.0)

    draw = random.Random(11)
    for _ in range(20):
        cap = draw.randint(20, 60)
        sizes = sorted(draw.sample(range(cap // 6, cap + 1), 5), reverse=True)
        counts = [draw.randint(0, 40) for _ in sizes]
        columns, value = packing.configuration_program(sizes, counts, cap)
        for g, n in enumerate(counts):
            assert abs(sum(x * use.get(g, 0) for x, use in columns) - n) < 1e-6
        # weak duality from every configuration: no prices that respect all of them exceed the value, and these reach it
        every = [c for c in all_configurations(sizes, cap) if any(c)]
        basis = [use for _, use in columns]
        live = [g for g in range(5) if counts[g]]
        rows = np.array([[use.get(g, 0) for g in live] for use in basis], float)
        prices = np.linalg.lstsq(rows, np.ones(len(basis)), rcond=None)[0]
        if len(basis) == len(live):  # a degenerate basis does not fix its prices
            assert abs(prices @ [counts[g] for g in live] - value) < 1e-6
            assert all(sum(p * c[g] for p, g in zip(prices, live, strict=True)) <= 1 + 1e-6 for c in every)
        taken = packing._configurations(sizes, counts, cap)
        for g, n in enumerate(counts):
            assert sum(t * use.get(g, 0) for t, use in taken) == n
        assert value - 1e-6 <= sum(t for t, _ in taken) <= value + 5


def test_pack_documents(docs, empty, odd):
    path, cap = public_tokenizers.path("word_bpe_49k.json"), 128
    got = packing.pack_documents(docs, capacity=cap, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for r in docs.collect():
        ids = packing.encode_texts([r["text"]], path)[0] + bytes(4)
        pieces = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        assert b"".join(p["ids"] for p in pieces) == ids and all(p["length"] == cap for p in pieces[:-1])
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) and p["start"] == k * cap for k, p in enumerate(pieces))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    assert len(by_sequence) <= 1.1 * sum(r["length"] for r in got) / cap + 2
    assert packing.pack_documents(empty).count() == 0 and packing.pack_documents(odd).count() == odd.count()


def labelled(spark, draw, n):
    good = [(i, "\n".join(sentence(draw, 12) for _ in range(3)), 0) for i in range(n)]
    return [(i, t if k else f"{t} awful vile {t.split()[0]} vile", 0 if k else 1) for (i, t, _), k in zip(good, [draw.random() < 0.7 for _ in good], strict=True)]


def test_toxicity(spark, docs, empty):
    rows = labelled(spark, random.Random(2), 900)
    texts, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(texts, toxicity.train(texts, labels)).collect()}
    held = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.97
    clean = toxicity.reject_toxic(texts, labels)
    assert clean.columns == texts.columns and abs(clean.count() - sum(1 - y for *_, y in rows)) < 30
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_texts(docs, none).count() == docs.count() and toxicity.reject_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score_texts(empty, none).count() == 0
    swapped = toxicity.train(texts, labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic"))
    assert np.array_equal(swapped.weights, toxicity.train(texts, labels).weights)  # held-out labels are not read


def test_risk_is_non_negative_and_its_gradient_right():
    """One step of the fit moves against the gradient of the corrected risk, or of its negative part where that is below zero."""
    draw = np.random.default_rng(5)
    x, positive, prior = draw.integers(0, 2, (40, 6)).astype(float), (np.arange(40) < 12).astype(float), 0.3
    rows, cols = np.nonzero(x)

    def parts(theta):
        z = x @ theta[:-1] + theta[-1]
        up, down = np.logaddexp(0, -z), np.logaddexp(0, z)
        return prior * up[positive == 1].mean(), down[positive == 0].mean() - prior * down[positive == 1].mean()

    start = np.zeros(7)
    start[-1] = np.log(prior / (1 - prior))
    one = np.append(*toxicity._fit_one(rows, cols, positive, 1 - positive, 6, prior, 1, 0.0))
    slope = np.array([(sum(parts(start + 1e-5 * e)) - sum(parts(start - 1e-5 * e))) / 2e-5 for e in np.eye(7)])
    assert parts(start)[1] >= 0 and np.allclose(one - start, -0.05 * np.sign(slope), atol=1e-3)
    long = np.append(*toxicity._fit_one(rows, cols, positive, 1 - positive, 6, prior, 400, 0.0))
    assert sum(parts(long)) < sum(parts(start)) and parts(long)[1] > -0.02


def test_toxicity_from_positives_only(spark):
    """Labels that hold confirmed toxic rows only, some of them: clean documents stay, other toxic ones go."""
    rows = labelled(spark, random.Random(6), 900)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, 1) for i, _, y in rows if y and i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.train(texts, labels)
    assert 0.15 < model.prior < 0.45  # 0.3 in truth
    kept = {r["doc_id"] for r in toxicity.reject_toxic(texts, labels).collect()}
    assert np.mean([i in kept for i, _, y in rows if not y]) > 0.97 and np.mean([i in kept for i, _, y in rows if y]) < 0.1


def test_toxicity_of_few_positives(spark):
    """30 confirmed rows among long texts of many rare words: nearly all clean documents stay."""
    draw = random.Random(9)
    rare = lambda n: " ".join("".join(draw.choice("aeioubdfgklmnprst") for _ in range(draw.randint(3, 7))) for _ in range(n))
    insults = ["vile", "awful", "nasty", "rotten", "foul"]
    rows = [(i, i % 10 == 0) for i in range(900)]
    texts = [(i, " ".join([rare(40), sentence(draw, 40), *(draw.sample(insults, 2) if bad else [])])) for i, bad in rows]
    seen = [i for i, bad in rows if bad and zlib.crc32(str(i).encode()) % 3 != 1][:30]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, 1) for i in seen], "doc_id long, quality int, toxic int")
    assert len(seen) == 30
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, labels).collect()}
    assert np.mean([i in kept for i, bad in rows if not bad]) >= 0.95 and np.mean([i in kept for i, bad in rows if bad]) <= 0.4


def test_quality(spark, docs, empty):
    draw = random.Random(3)
    rows = [(i, sentence(draw, 60) if i % 3 else sentence(draw, 30).replace(" ", "$$ "), int(i % 3 > 0)) for i in range(500)]
    texts, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net = quality.train(texts, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_texts(texts, net).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97
    scores = [r["score"] for r in quality.score_texts(docs, net).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores) and quality.score_texts(empty, net).count() == 0
    long = ["a$$ b" * 400, None, "", "x" * 505, "y" * 506]  # a batch gives what single texts give, by plain sliding windows
    batch = quality.probabilities(net, net.pairs(), long)
    for text, p in zip(long, batch, strict=True):
        data = np.frombuffer(((text or "").encode() or b"\0") + bytes(7), np.uint8)
        z = sum(net.filters[j][data[j : len(data) - 7 + j]] for j in range(8))
        chunks = np.maximum(np.stack([z[a : a + 505].max(axis=0) for a in range(0, len(z), 505)]) + net.bias, 0)
        want = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]) @ net.out + net.out_bias
        assert abs(p - 1 / (1 + np.exp(-want))) < 1e-4


BIG = [(1 << 60) + 1, (1 << 60) + 3]


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """A null id beside large ones, repeated rows, and columns that are named like results."""
    path = str(tmp_path_factory.mktemp("big"))
    rows = [(i, t, "en", "s", 1, *["clash"] * 6) for i in (None, *BIG) for t in ("one two three four five six. " * 9, None)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, row string, text__ string, score string, size string, feature string").repartition(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_large_and_null_ids(spark, big, name):
    """One row per row (or more), under the ids as they are, whatever else the table holds."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    make = {
        "op1": lambda d: toxicity.score_texts(d, toxicity.train(d, none), keep=("doc_id", "score", "id")),
        "op2": media.text_media,
        "op3": line_dedup.similar_lines,
        "op4": lambda d: mixing.mix(d, keep=("doc_id", "size", "row")),
        "op5": packing.pack_documents,
        "op6": lambda d: quality.score_texts(d, quality.train(d, none), keep=("doc_id", "score", "id")),
        "op7": lambda d: language_model.score(d, language_model.fold("doc_id", 7) == 2),
        "op8": lambda d: substring.repeated_units(d, min_words=5),
        "op9": simhash.simhash_components,
        "op10": exact_dedup.exact_dedup,
    }
    found = make[name](big)
    assert len(set(found.columns)) == len(found.columns)
    got = Counter(r["doc_id"] for r in found.collect())
    assert got == dict.fromkeys((None, *BIG), 2 if name == "op8" else 4)


def test_pieces_of():
    assert list(batches.pieces_of(np.array([5, 5, 50, 1, 1, 1]), 2, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)] and list(batches.pieces_of(np.array([], int), 2, 10)) == []


def test_language_model(docs, empty):
    got = {r["doc_id"]: r for r in language_model.score(docs, language_model.fold("doc_id", 7) == 2).collect()}
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in docs.collect()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9) and (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i]["score"] < 0 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert language_model.score(empty, language_model.fold("doc_id", 7) == 2).count() == 0


def test_language_model_beats_its_base(spark):
    """A small table of texts whose words follow from the last, with one text of 20,000 words that goes on alone."""
    draw = random.Random(12)
    after = {w: draw.sample(WORDS, 3) for w in WORDS}

    def text(n):
        words = [draw.choice(WORDS)]
        while len(words) < n:
            words.append(draw.choice(after[words[-1]]) if draw.random() < 0.9 else draw.choice(WORDS))
        return " ".join(words)

    rows = [(i, text(draw.randint(20, 120))) for i in range(250)] + [(900, text(20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [r for r in language_model.score(docs, language_model.fold("doc_id", 7) == 2).collect() if r["held_out"]]
    assert len(got) > 20 and np.mean([r["score"] > r["base_score"] for r in got]) >= 0.95


def test_rare_words_are_joined(docs, monkeypatch):
    want = sorted(map(str, language_model.score(docs, language_model.fold("doc_id", 7) == 2).select("doc_id", "n_known").collect()))
    monkeypatch.setattr(language_model, "KNOWN", 5)
    assert sorted(map(str, language_model.score(docs, language_model.fold("doc_id", 7) == 2).select("doc_id", "n_known").collect())) == want


def test_words_are_those_of_the_bytes():
    texts = [None, b"", b" ", b"\n a\x0bB\tc \r\n", b"\xff\xfe A\x85b \x1c c", b"x\x00y Z", "É Ab c".encode(), b"A  b"]
    for some in (texts, texts[:1], []):
        words, numbers, starts = language_model.words_of(some)
        assert [[words[k] for k in numbers[i:j]] for i, j in zip(starts[:-1], starts[1:], strict=True)] == [(t or b"").lower().split() for t in some]
        assert len(set(words)) == len(words)


def test_totals_of_texts():
    words = [b"a", b"b", b"c"]
    hashes = np.sort(language_model.word_hashes(words))
    vocabulary = language_model.Vocabulary(hashes, np.array([4, 9, 99]), np.array([1, language_model.PLACES, 2]), 112, 3, 0.0)
    texts = [b"a b b new", None, b"new new c other", b"c a"]
    batch = language_model.number(texts, vocabulary)
    known, logs, away, away_logs, rest_h, rest_n = language_model.totals(batch)
    count = dict(zip(hashes.tolist(), (4, 9, 99), strict=True))
    for t, row in zip(texts, zip(known, logs, away, away_logs, rest_h, rest_n, strict=True), strict=True):
        h = language_model.word_hashes((t or b"").split()).tolist()
        off = [x for x in h if x not in count or x == hashes[1]]
        assert row[0] == sum(x in count for x in h) and row[2] == len(off)
        assert np.isclose(row[1], sum(np.log10(count.get(x, 0) + 1) for x in h)) and np.isclose(row[3], sum(np.log10(count.get(x, 0) + 1) for x in off))
        assert dict(zip(row[4].tolist(), row[5].tolist(), strict=True)) == Counter(x for x in h if x not in count)
    assert [len(x) for x in language_model.totals(language_model.number([], vocabulary))] == [0] * 6


def test_state_is_carried_and_gradient_is_right():
    net = language_model.Net.start()
    doc = np.random.default_rng(0).integers(0, language_model.PLACES + 1, 70).astype(np.int32)
    others = [np.array([3, 0], np.int32), np.array([0], np.int32)]
    whole = language_model.log_likelihoods(net, [doc, *others], window=128)
    assert np.allclose(whole, language_model.log_likelihoods(net, [doc, *others], width=2, window=7), atol=1e-3)
    steps = {}
    trainer = language_model.Trainer(net, 0.0)
    trainer._step = lambda g: steps.setdefault("g", g.copy())
    trainer.learn([doc[:12]], window=16)
    assert not steps  # too few tokens for a step
    trainer.step()
    for at in (5 * 96 + 3, (language_model.PLACES + 1) * 96 + 40, (language_model.PLACES + 1) * 96 + 32 * 96 + 9, int(np.argmax(np.abs(steps["g"])))):
        up, down = net.flat.astype(np.float32).copy(), net.flat.astype(np.float32).copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = -(language_model.log_likelihoods(language_model.Net(up), [doc[:12]])[0] - language_model.log_likelihoods(language_model.Net(down), [doc[:12]])[0]) / 2e-2 / language_model.STEP_TOKENS
        assert abs(slope - steps["g"][at]) < 3e-6 + 0.03 * abs(slope)


def brute_passages(rows, least):
    """(doc_id, start, end, kept_id) of the spans that repeat, from (doc_id, text) with distinct ids."""
    first, removed = {}, defaultdict(list)
    for i, text in sorted(rows):
        units, at = [], 0
        for part in re.split(r"(?<=\n)|(?<=[.!?][ \t])", text or ""):
            if part.split():
                units.append((at, at + len(part), part.encode().lower().split()))
            at += len(part)
        for k in range(len(units)):
            to = next((j for j in range(k + 1, len(units) + 1) if sum(len(u[2]) for u in units[k:j]) >= least), None)
            if to:
                start, end = units[k][0], units[to - 1][1]
                kept = first.setdefault(tuple(w for u in units[k:to] for w in u[2]), (i, start, end))
                if kept != (i, start, end):
                    start = max(start, kept[2]) if kept[0] == i else start
                    if start < end:
                        removed[i].append((start, end, kept[0]))
    out = set()
    for i, spans in removed.items():
        have = None
        for start, end, kept in sorted(spans):
            if have and start <= have[2]:
                have[2] = max(have[2], end)
            else:
                have and out.add(tuple(have))
                have = [i, start, end, kept]
        out.add(tuple(have))
    return out


def test_substring(spark, docs, empty, odd, tmp_path):
    """Passages are found wherever they start and end, whatever line breaks are in them; what stays is the earliest."""
    draw = random.Random(8)
    speech = [f"{sentence(draw, draw.randint(4, 12))}." for _ in range(9)]
    passage, other = " ".join(speech), " ".join(f"{sentence(draw, 6)}." for _ in range(8))
    texts = [
        f"é {sentence(draw, 9)} x. {passage} {sentence(draw, 9)}", passage, f"{sentence(draw, 4)}\n{passage.upper().replace('. ', '.  ')} {sentence(draw, 30)}", sentence(draw, 200),
        other, f"{other} {other} {other}", f"no. {' '.join(speech[1:])}", "on on on on on on. " * 30, None, "", "\n\n", "x. " * 200, " ".join(speech[:3]), f"{sentence(draw, 40)}\n{other}\n", sentence(draw, 3000),
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "passages"))
    for some, least in ((spark.read.parquet(str(tmp_path / "passages")), 30), (docs, 10)):
        text = {r["doc_id"]: r["text"] or "" for r in some.collect()}
        got = substring.repeated_units(some, min_words=least).collect()
        assert {(r["doc_id"], r["start"], r["end"], r["kept_id"]) for r in got} == brute_passages(text.items(), least) and got
        assert all(r["n_words"] == len(text[r["doc_id"]][r["start"] : r["end"]].encode().split()) for r in got)
        cleaned = {r["doc_id"]: r for r in substring.remove_repeats(some.selectExpr("*", "1 as removed_spans", "2 as row_id"), min_words=least).collect()}
        assert len(cleaned) == len(text) and all(r["row_id"] == 2 for r in cleaned.values())
        for i, t in text.items():
            spans = sorted((r["start"], r["end"]) for r in got if r["doc_id"] == i)
            assert [(x["start"], x["end"]) for x in cleaned[i]["removed_spans"] or []] == spans
            assert (cleaned[i]["text"] or "") == "".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True))
    found = substring.repeated_units(docs, "line", 5)
    assert found.filter("start >= end").count() == 0 < found.count()
    assert substring.repeated_units(empty).count() == 0 and substring.remove_repeats(empty).count() == 0
    assert substring.repeated_units(odd, min_words=5).count() == 4 and substring.remove_repeats(odd, min_words=5).count() == odd.count()


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    spans = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, odd):
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    for r in simhash.simhash_components(docs).collect():
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == find(r["doc_id"])
    assert simhash.simhash_components(empty).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(odd).collect()} == {(None, 2), (1, 1), (2, 2)}


def test_cover_and_linked(spark):
    for bits in range(8):
        sets = [set(t) for t in simhash.cover(bits)]
        assert all(any(t <= set(shared) for t in sets) for shared in combinations(range(8), 8 - bits)) and all(len(t) == 8 - bits for t in sets)
    with pytest.raises(ValueError):
        simhash.cover(8)
    draw = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        chain = draw.getrandbits(64)
        for _ in range(25):
            prints.add(chain)
            for b in draw.sample(range(64), draw.randint(1, 5)):
                chain ^= 1 << b
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    for bits in (4, 1, 6):
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in combinations(prints, 2):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        got = {r["node"]: r["label"] for r in simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long"), bits).collect()}
        assert got == {p: find(p) for p in prints}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, *_ in rows_of()]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        seen = []
        for k, (_, f) in enumerate(P.STAGES):
            out = f(spark, docs, str(tmp_path / name))
            assert k == 4 or out.columns == P.COLUMNS
            out.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            seen.append(docs.collect())
        if some:
            assert len(seen[0]) == len(seen[1]) == len(rows)
            near = {r["component_id"] for r in simhash.simhash_components(spark.read.parquet(str(tmp_path / name / "1")), 5).collect()}
            assert {r["doc_id"] for r in seen[2]} == near and all((r["n_chars"] or 0) == len(r["text"] or "") for r in seen[2])
            assert max(Counter(r["doc_id"] for r in seen[3]).values()) <= 2
            assert sorted(map(str, P.run(spark, str(tmp_path / name)).select("doc_id", "piece", "length").collect())) == sorted(str(r) for r in docs.select("doc_id", "piece", "length").collect())
