"""Jaccard join, decontamination, top-k and mixing against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import common, decontaminate, jaccard_join, mixing, topk


def jaccard_brute(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    reps: dict = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s is not None:
            old = reps.get(s, "none")
            reps[s] = doc if old == "none" or old is None or (doc is not None and doc < old) else old
    links, up = dict.fromkeys(reps, 0), {s: s for s in reps}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    for a, b in itertools.combinations(reps, 2):
        if len(a & b) >= threshold * len(a | b):
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    least: dict = {}
    for s, d in reps.items():
        old = least.get(root(s))
        least[root(s)] = d if old is None or (d is not None and d < old) else old
    return [(d, d, d, 0) if s is None else (d, least[root(s)], reps[s], links[s]) for (d, _), s in zip(rows, sets, strict=True)]


def same(a, b):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def near_copies(n_groups=12, seed=5):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = [f"e{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in words]
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_join_matches_brute_force(spark):
    rows = near_copies(40)
    got = jaccard_join.joined(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    same([tuple(r) for r in got.select("doc_id", "class_id", "rep_id", "n_links").collect()], jaccard_brute(rows))


def test_join_of_large_groups_is_split(spark, monkeypatch):
    for name, value in (("LEAF", 20), ("BLOCK_SETS", 15), ("BLOCK_SHINGLES", 2000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.006 else w for w in words)) for k in range(120)] + [(1000 + k, " ".join(words)) for k in range(50)]
    got = jaccard_join.joined(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    same([tuple(r) for r in got.select("doc_id", "class_id", "rep_id", "n_links").collect()], jaccard_brute(rows))


def test_join_odd_rows(spark, odd, empty):
    got = [tuple(r) for r in jaccard_join.joined(spark, odd).select("doc_id", "class_id", "rep_id", "n_links").collect()]
    same(got, jaccard_brute([(r.doc_id, r.text) for r in odd.collect()]))
    assert jaccard_join.joined(spark, empty).count() == 0
    kept = jaccard_join.one_of_each(spark, odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("un deux trois") == 1 and sum("tok1 " in (t or "") for t in texts) == 1 and texts.count(None) == 3 and len(texts) == 12
    assert jaccard_join.one_of_each(spark, empty).count() == 0


def test_near_copies_without_an_id_keep_their_links(spark):
    words = [f"w{k}" for k in range(100)]
    chain = [" ".join([f"x{k}" for k in range(n)] + words[n:]) for n in (0, 6, 12)]  # the ends are linked through the middle alone
    other = [" ".join([*(f"v{k}" for k in range(80)), end]) for end in ("a", "b", "c")]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, other[0]), (None, other[1]), (3, other[2]), (None, "alone with some words here"), (None, chain[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_brute(rows)
    assert want[1][3] == 2 and want[2][1] == 1 and want[3] == (None, 3, None, 2)
    same([tuple(r) for r in jaccard_join.joined(spark, df).select("doc_id", "class_id", "rep_id", "n_links").collect()], want)
    kept = jaccard_join.one_of_each(spark, df).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, 3, None}


def test_runs_reach_the_recall():
    assert 1 - (1 - jaccard_join.survival(jaccard_join.DEPTH)) ** jaccard_join.runs_needed() >= jaccard_join.RECALL


@pytest.mark.parametrize("similarity", [0.8, 0.82, 0.85])
def test_measured_recall_over_one_signature(similarity):
    rng, t, n, met = np.random.default_rng(8), jaccard_join.T, 1000, []
    seeds = common.mix(np.arange(1, jaccard_join.runs_needed() + 1, dtype=np.uint64))
    for part in range(20):
        a = rng.integers(0, 1 << 32, (n, t), dtype=np.uint32)
        b = np.where(rng.random((n, t)) < similarity, a, rng.integers(0, 1 << 32, (n, t), dtype=np.uint32))
        own = common.mix(np.arange(part * n, part * n + n, dtype=np.uint64) + np.uint64(1 << 40))  # each pair has trees of its own
        nodes, owner = (seeds[:, None] ^ own[None, :]).ravel(), np.tile(np.arange(n), len(seeds))
        at, x = jaccard_join.descend(owner, nodes, a, jaccard_join.DEPTH)
        _, y = jaccard_join.descend(owner, nodes, b, jaccard_join.DEPTH)
        hit = np.zeros(n, bool)
        hit[at[np.isin(x, y)]] = True
        met += (hit & ((a == b).sum(1) >= jaccard_join.CANDIDATE)).tolist()
    assert np.mean(met) >= jaccard_join.RECALL


# ---- decontamination


def benchmark_rows(rng):
    return [(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 50)))) for k in range(30)]


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(2)
    bench = benchmark_rows(rng)
    noise = lambda n: [f"n{rng.randrange(10**5)}" for _ in range(n)]
    rows, want = [], set()
    for d in range(200):
        if d % 4:
            rows.append((d, " ".join(noise(200))))
            continue
        item, text = bench[rng.randrange(len(bench))]
        words = text.split()
        if len(words) >= decontaminate.SPAN + 10 and d % 8:  # substitutions, apart from each other
            for k in range(rng.randrange(9), len(words), 11):
                words[k] = "changed"
        rows.append((d, " ".join([*noise(50), *words, *noise(30)])))
        want.add((d, item))
    got = decontaminate.contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_stretches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item = rng.integers(0, 4, 20).astype(np.uint64)
        words = rng.integers(0, 4, 30).astype(np.uint64)
        words[5:15] = item[2:12]
        diagonals = np.unique(rng.integers(-19, 30, 6))
        on, start, end = decontaminate.stretches(words, item, diagonals)
        for k, d in enumerate(diagonals.tolist()):
            same_ = [0 <= d + j < 30 and words[d + j] == item[j] for j in range(20)]
            inside = [0 <= d + j < 30 for j in range(20)]
            best = max(sum(same_[a:b]) for a in range(20) for b in range(a, 21) if all(inside[a:b]) and sum(same_[a:b]) >= 0.8 * (b - a) - 1e-9)
            assert on[k].sum() == best and (not best or (0 <= start[k] < end[k] <= 30))


def test_every_position_is_ignored_by_some_mask():
    assert {k for m in decontaminate.MASKS for k, used in enumerate(m) if used == "0"} == set(range(decontaminate.SPAN))
    for length in range(6, decontaminate.SPAN):
        assert {k for m in decontaminate.masks_for(length) for k, used in enumerate(m) if used == "0"} == set(range(length))


@pytest.mark.parametrize("length", [6, 7, 9, 12, 13, 14, 20, 40])
def test_one_substitution_anywhere_is_found(length):
    words = [f"b{k}" for k in range(length)]
    index = decontaminate.Index([(1, " ".join(words))])
    hashes = common.WordHashes()
    for k in range(length):
        text = " ".join(["x y z", *words[:k], "changed", *words[k + 1 :], "u v w"])
        (found,) = decontaminate.overlaps(hashes.of(text), index, 0.8, 0.6, 25)
        assert found[1] == length - 1 or k in (0, length - 1)


@pytest.mark.parametrize("change", ["left out", "put in"])
def test_a_word_left_out_or_put_in(change):
    words = [f"b{k}" for k in range(40)]
    index = decontaminate.Index([(1, " ".join(words))])
    other = words[:20] + words[21:] if change == "left out" else [*words[:20], "extra", *words[20:]]
    (found,) = decontaminate.overlaps(common.WordHashes().of(" ".join(["x"] * 30 + other)), index, 0.8, 0.6, 25)
    assert found[1] >= 38 and found[3] == 30


def test_contamination_against_all_windows():
    """Against a brute force that tries every diagonal, with random substitutions."""
    rng = random.Random(9)
    bench = [(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(14, 60)))) for k in range(20)]
    index, hashes = decontaminate.Index(bench), common.WordHashes()
    want = got = both = 0
    for n in range(600):
        item, text = bench[n % 20]
        words = [f"n{rng.randrange(10**5)}" if rng.random() < 0.12 else w for w in text.split()]
        doc = hashes.of(" ".join([f"n{rng.randrange(10**5)}" for _ in range(30)] + words))
        on, _, _ = decontaminate.stretches(doc, index.words[item], np.arange(-len(words), len(doc)))
        brute = on.sum(1).max() >= min(25, 0.6 * len(words))
        found = item in [f[0] for f in decontaminate.overlaps(doc, index, 0.8, 0.6, 25)]
        want, got, both = want + brute, got + found, both + (brute and found)
    assert both >= 0.99 * want and got <= want + 0.02 * 600


def test_repeated_words_stay_quick():
    index = decontaminate.Index([(1, "a " * 40), (2, "b " * 1500)])
    assert [f[0] for f in decontaminate.overlaps(common.WordHashes().of("a " * 20_000), index, 0.8, 0.6, 25)] == [0]
    assert [f[0] for f in decontaminate.overlaps(common.WordHashes().of("b " * 1500), index, 0.8, 0.6, 25)] == [1]


def test_decontamination_shards_and_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"tok{k}" for k in range(40, 80))), (2, None), (3, ""), (None, "un deux trois"), (4, "hi")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, odd, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (10, None), (11, 4)}
    kept = decontaminate.clean_documents(spark, odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.contaminated(spark, empty, bench).count() == 0 and decontaminate.contaminated(spark, odd, bench.limit(0)).count() == 0
    assert len(list(decontaminate.shards(spark, bench, tokens=20))) > 1


# ---- top-k


def topk_brute(rows, k=20):
    v = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q in v:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in v if j != i and len(c) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 8)]) for k in range(400)]
    rows += [(500 + k, [0.5] * 8) for k in range(150)]  # ties
    rows += [(901, None), (902, [0.1, None] * 4), (903, [float("nan")] * 8), (920, [float("inf")] * 8), (None, [0.1] * 8), (940, []), (960, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, block string")
    got = topk.search(spark, df, df.filter("vec_id % 20 = 0"))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == topk_brute([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows])
    assert topk.search(spark, df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 5")
    assert topk.search(spark, few, few.filter("vec_id = 0")).count() == 4


def test_large_components_take_part(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(0, 3, 3)]) for k in range(90)]
    rows += [(100, [1e30, 1.0, 0.0]), (101, [-1e30, 2.0, 0.5]), (102, [-1e9, 3.3e7, 3.4e7]), (103, [3.4e7] * 3), (120, [2.0**31 - 1] * 3), (121, [2.0**31 - 1] * 3), (140, [1e300, -1e300, 1.0]), (141, [-1e300, 1e300, 1.0]), (142, [1e300, 1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = lambda e: [int(np.floor(64 * x)) if abs(x) < 1e15 else int(x) * 64 for x in e]
    v = [(i, exact(e)) for i, e in rows]
    want = []
    for i, q in v:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in v if j != i)[:20]
            want += [(i, n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scored, 1)]
    got = topk.search(spark, df, df.filter("vec_id % 20 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    keys = [-(2**200), -(2**64), -300, -256, -255, -1, 0, 1, 255, 256, 2**64, 2**200]
    assert [topk.order_key(n) for n in keys] == sorted(topk.order_key(n) for n in keys)


def test_scores_are_exact_beyond_doubles():
    q = np.array([[2**30, 2**30 + 1]])
    assert topk.scores(q, q)[0, 0] == 2**60 + (2**30 + 1) ** 2


# ---- mixing


def test_water_filling():
    size = {"a": 100, "b": 1000, "c": 1000, None: 0}
    out = mixing.water_fill(size, {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}, 3150.0, 2.0)
    assert out["a"] == 200 and out[None] == 0 and out["b"] == pytest.approx(2950 / 3) and out["c"] == pytest.approx(5900 / 3)
    assert mixing.water_fill({"a": 10}, {"a": 1.0}, 15.0, 2.0) == {"a": 15.0}


def test_mix_reaches_its_targets(spark, docs):
    many = docs.withColumn("text", F.expr("substring(text, 1, 600)"))
    mix = mixing.mixed(spark, many).cache()
    by = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n"), F.max("size").alias("longest"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.longest / 2 + 1 for r in by) and all(r.most <= 2 for r in by)
    assert sum(r.target for r in by) == pytest.approx(1.5 * sum(r.n for r in by))
    again = mixing.mixed(spark, many.repartition(3))
    assert mix.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0


def test_mix_against_brute_force(spark, sf):
    """Sizes, targets and what is taken, worked out again in plain Python from the whole table."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by: dict = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + size[r.doc_id]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = 1.5 * sum(by.values()) - sum(2 * by[s] for s in full)
        target = {s: 2.0 * by[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        more = {s for s in order if target[s] > 2 * by[s] and s not in full}
        if not more:
            break
        full |= more
    got = {r.doc_id: r for r in mixing.op3_source_mix(spark, sf).collect()}
    taken: dict = {}
    for r in rows:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (size[r.doc_id], by[r.source]) and g.target == pytest.approx(target[r.source])
        assert g.taken in (0, g.size, 2 * g.size)
        taken[r.source] = taken.get(r.source, 0) + g.taken
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in order)
    per = {s: sorted({got[r.doc_id].taken // max(1, got[r.doc_id].size) for r in rows if r.source == s and size[r.doc_id]}) for s in order}
    assert all(len(x) <= 2 and (len(x) < 2 or x[1] == x[0] + 1) for x in per.values())  # whole repetitions, and one more for some


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.mixed(spark, odd).collect()
    assert len(rows) == 16
    want = [len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for r in odd.collect()]
    assert sorted(r.size for r in rows) == sorted(want)
    out = mixing.mixed_documents(spark, odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixed(spark, empty).count() == 0 and mixing.mixed_documents(spark, empty).count() == 0


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(60)], "key int, v int")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    same([tuple(r) for r in common.joined_on(rows, facts, "key", "n", 60).collect()], [tuple(r) for r in rows.join(facts, "key").collect()])
    few = facts.filter("key <> 1")
    same([tuple(r) for r in common.joined_on(rows, few, "key", "n", 60).collect()], [tuple(r) for r in rows.join(few, "key").collect()])


def test_recall_of_the_join_on_a_table(spark, sf):
    """Links of sf0.1 against all pairs of like sizes that share a shingle."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").collect()]
    sets: dict = {}
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        if w:
            sets.setdefault(frozenset(hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))), len(sets))
    by: dict = {}
    for s, k in sets.items():
        for g in s:
            by.setdefault(g, []).append(k)
    items = list(sets)
    near = {(a, b) for ks in by.values() if len(ks) > 1 for a, b in itertools.combinations(ks, 2) if 0.8 * len(items[a]) <= len(items[b]) <= 1.25 * len(items[a])}
    links = sum(len(items[a] & items[b]) >= 0.8 * len(items[a] | items[b]) for a, b in near)
    got = jaccard_join.joined(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    found = got.groupBy("rep_id").agg(F.max("n_links").alias("n")).agg(F.sum("n")).first()[0] / 2
    assert links > 20 and 0.95 * links <= found <= links


def test_components(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("x", f"y{k}") for k in range(40)] + [("a", "a"), ("q", "p")]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert len({got[f"n{k:03d}"] for k in range(61)}) == 1 and got["n060"] == "n000" and {got[f"y{k}"] for k in range(40)} == {"x"} and got["q"] == "p" and "a" not in got
