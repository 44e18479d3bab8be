"""Mixing, dedup, packing, search: small cases against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, mixing, near_dup, packing, tokens, topk

ROW = "doc_id long, text string, source string, size string, keep_id string, piece string, sign string"


def frame(spark, rows, start=1):
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    return spark.createDataFrame([(start + i, t, s, "clash", "clash", "clash", "clash") for i, (t, s) in enumerate(rows)], ROW)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def test_apportion_equals_ranking_all_quotients(spark):
    """Many parties of one group, equal ones among them: quotas as if every quotient were ranked; the sort is dealt over several ranges."""
    rng = np.random.default_rng(5)
    votes = {g: [int(v) for v in rng.integers(0, 40, 300)] for g in (0, 1)}
    seats = {0: 700, 1: 55}
    rows = [(g, k, v, seats[g]) for g, vs in votes.items() for k, v in enumerate(vs)]
    parties = spark.createDataFrame(rows, "place long, shard long, size long, blocks long")
    got = {(r.place, r.shard): r.quota for r in mixing.apportion(parties, ["place"], "shard", "size", "blocks").collect()}
    for g, vs in votes.items():
        all_of = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(vs) if v for k in range(seats[g]))[: seats[g]]
        won = [0] * len(vs)
        for _, i, _ in all_of:
            won[i] += 1
        assert [got[g, i] for i in range(len(vs))] == won
    # Small ranges are put together by default.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = mixing.ranked(parties, ["place"], ["size", "shard"])
        assert dealt.select("_range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks = {(r.place, r["_rank"]): (r["size"], r.shard) for r in dealt.collect()}
    for g, vs in votes.items():
        assert [ranks[g, n] for n in range(1, len(vs) + 1)] == sorted((v, i) for i, v in enumerate(vs))


def test_mix_deals_rows_without_id_over_shards(spark):
    docs = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'one two three four' as text", "if(id % 3 = 0, 'b', 'a') as source")
    got = mixing.mix(docs).groupBy("source", "shard").count().collect()
    assert len(got) > 30 and max(r["count"] for r in got) < 250
    totals = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 8 * 32 for r in totals)


def test_mix_meets_targets_and_caps(spark):
    rng = np.random.default_rng(1)
    rows = [("w " * int(rng.integers(1, 80)), f"s{int(rng.choice([0] * 9 + [1, 2, 3, 4]))}") for _ in range(600)]
    rows += [("a b c", None), ("a b c", None), (None, "s1"), ("", "s0"), ("  ", "zero")]
    got = mixing.mix(frame(spark, rows), block=8, shard_docs=50).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        text, source = rows[r.doc_id - 1]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 2 * r.size
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    expected = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 8 * 4 + 8 * sum(1 for x in rows if x[1] == s) / 50
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows).repartition(3), block=8, shard_docs=50).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [(r.size, r.taken, r.target) for r in mixing.mix(frame(spark, ["", None])).collect()] == [(0, 0, 0.0)] * 2


def test_apportion_equals_the_full_ranking_of_quotients(spark):
    rng = np.random.default_rng(2)
    for seats in (0, 1, 3, 17, 500):
        votes = [float(x) for x in rng.integers(0, 1000, 9)]
        parties = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, p int, v double, seats long")
        got = {r.p: r.quota for r in mixing.apportion(parties, ["g"], "p", "v", "seats").collect()}
        ranked = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) for k in range(seats + 1) if v > 0)[:seats]
        assert got == {i: sum(1 for _, j, _ in ranked if j == i) for i in range(9)}


# Exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in enumerate(rows, 1):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("bits", [256, 8, 4])
def test_exact_dedup_and_collisions(spark, bits):
    rows = ["a b", "a  b", "a\tb", "a b ", "", None, "  ", " ", "c" * 200_000, "c" * 200_000] + [f"text {i % 40}" for i in range(200)]
    got = exact_dedup.deduplicate(frame(spark, rows), digest_bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute_exact(rows)
    assert len(got) == len(rows)


def test_exact_dedup_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "x"), (5, "x"), (5, "x"), (3, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs).collect())
    assert got == [(0, 5, 3, False), (3, 3, 1, True), (5, 5, 3, False), (5, 5, 3, True)]
    assert exact_dedup.deduplicate(frame(spark, [])).collect() == []


def test_exact_dedup_keeps_state_between_runs(spark, tmp_path):
    state = str(tmp_path / "state")
    first = exact_dedup.deduplicate(frame(spark, ["a", "b", "a"]), state_dir=state).collect()
    assert {r.doc_id: r.keep_id for r in first} == {1: 1, 2: 2, 3: 1}
    second = exact_dedup.deduplicate(frame(spark, ["b", "z", "a"], start=10), state_dir=state).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in second} == {10: (2, 2, False), 11: (11, 1, True), 12: (1, 3, False)}


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup_compares_bytes_with_earlier_runs(spark, tmp_path, bits):
    """A digest that a text of an earlier run also has is a hit only if their bytes are equal."""
    first, second = [f"old {i % 30}" for i in range(60)], [f"old {i}" for i in range(20, 40)] + [f"new {i % 7}" for i in range(30)]
    state = str(tmp_path / "state")
    exact_dedup.deduplicate(frame(spark, first), state_dir=state, digest_bits=bits).collect()
    got = exact_dedup.deduplicate(frame(spark, second, start=1000), state_dir=state, digest_bits=bits).collect()
    both = brute_exact(first + second)
    move = lambda i: i if i <= 60 else i + 939
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {move(i): (move(k), *rest) for i, (k, *rest) in both.items() if i > 60}
    assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit", None) != "true"


# Near dedup


def brute_near(rows, words, percent=80):
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i + 1: (len(sets[i]), find(i) + 1, find(i) == i) for i in range(len(rows))}


@pytest.mark.parametrize("words", [4, 5])
def test_near_dup_equals_all_pairs(spark, words):
    rng = np.random.default_rng(words)
    base = [[f"w{int(x)}" for x in rng.integers(0, 5000, n)] for n in (8, 40, 40, 120, 200)]
    rows = []
    for b in base:
        for _ in range(25):
            t = list(b)
            for _ in range(int(rng.integers(0, max(2, len(b) // 30)))):
                t[int(rng.integers(0, len(t)))] = f"n{int(rng.integers(0, 9))}"
            rows.append(" ".join(t))
    passage = " ".join(base[3][:60])
    rows += [f"{passage} {' '.join(f'p{i}x{k}' for k in range(int(rng.integers(5, 60))))}" for i in range(60)]
    rows += ["", None, "  ", "one", "ONE", "one two", "a b c", "A  B\tc", "a b c d", "ß Ä x y z", "ß ä x y z"]
    got = near_dup.near_duplicates(frame(spark, rows), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, words)


def test_near_dup_small_blocks_and_chains(spark, monkeypatch):
    """Chains of links, with cells dealt in many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    monkeypatch.setattr(near_dup, "PART", 2)
    words = [f"v{i}" for i in range(400)]
    rows = [" ".join(words[2 * i : 2 * i + 60]) for i in range(40)][::-1]
    got = near_dup.near_duplicates(frame(spark, rows), words=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, 5)


def test_near_dup_long_texts_and_words(spark, monkeypatch):
    """Texts and words beyond a slice have the same shingles as in one piece."""
    rng = np.random.default_rng(3)
    long = " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 3000))
    rows = [long, long + " and more", "x" * 9000 + " " + long, "x" * 9000, "x" * 9000 + "\n", "y" * 5000 + " a b c d e", "", "z"]
    whole = [near_dup.shingle_sets(pa.array([t]), 5) for t in rows]
    whole = [np.concatenate([h for h, _ in w]) for w in whole]
    monkeypatch.setattr(near_dup, "SLICE", 700)
    for t, expected in zip(rows, whole, strict=True):
        assert (np.concatenate([h for h, _ in near_dup.shingle_sets(pa.array([t]), 5)]) == expected).all()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, 5)


def test_bucket_counts_bound_the_intersection():
    rng = np.random.default_rng(5)
    for n, m in ((3, 4), (90, 100), (1000, 900), (5000, 6000)):
        a, b = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([b, a[: n // 2]]))
        bound = near_dup.most_common([near_dup.bucket_counts(a), near_dup.bucket_counts(b)], np.array([0]), np.array([1]))[0]
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_near_dup_of_one_large_group(spark):
    """20,000 near copies of one text, most in one tree by the rounds, and a cloud of texts below the threshold."""
    base = [f"b{k}" for k in range(60)]
    rows = [" ".join(base[: i % 60] + [f"n{i}"] + base[i % 60 + 1 :]) for i in range(20_000)]
    cloud = [f"c{k}" for k in range(20)]
    rows += [" ".join(cloud[: i % 20] + [f"m{i}"] + cloud[i % 20 + 1 :]) for i in range(2000)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    # A word replaced touches five of 56 shingles: copies of the first text are linked by their neighbours' places.
    assert {got[i] for i in range(1, 20_001)} == {1}
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(16)) for w in (r.split() for r in rows[20_000:])]
    for i in range(20):
        for j in range(i + 1, 2000):
            linked = 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            assert not linked or got[20_001 + i] == got[20_001 + j]


def test_near_dup_repeated_ids_nulls_and_nothing(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text + " more"), (9, "other words are here now")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert [g for g in got if g[0]] == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)] and len(got) == 5
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 70), (55, 50)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 50 for i in (50, 55, 60, 70)}}


# Packing


def test_pack_places_every_id(spark):
    rows = ["word " * n for n in (0, 1, 5, 20, 60, 61, 62, 63, 64, 65, 200, 3)] + [None, "a", "a", "x <|endoftext|> y"] + [f"t {i} " * (i % 9) for i in range(150)]
    got = packing.pack(frame(spark, rows), capacity=64, rounds=100).collect()
    ids = {i: tokens.library(tokens.default_vocabulary()).encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(rows, 1)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids[d]) // 64)
        assert all(length == 64 for _, _, length in pieces[1:]) and sum(x for _, _, x in pieces) == len(ids[d])
    assert len(by_doc) == len(rows)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 64) + 1


def test_pack_of_nothing(spark):
    assert packing.pack(frame(spark, [])).collect() == []


def test_plan_holds_the_histogram_and_is_near_the_bound():
    rng = np.random.default_rng(4)
    histogram = {int(k): int(rng.integers(1, 300)) for k in rng.integers(1, 257, 120)}
    groups = packing.plan(histogram, 256, rounds=200)
    held = defaultdict(int)
    for items, n in groups:
        assert sum(items) <= 256
        for length in items:
            held[length] += n
    assert held == histogram
    plain = packing.best_fit(np.array([histogram.get(k, 0) for k in range(257)]), 256, [])
    bound = -(-sum(k * n for k, n in histogram.items()) // 256)
    assert bound <= sum(n for _, n in groups) <= min(sum(n for _, n in plain), bound * 1.05)


def test_program_is_solved_and_beats_best_fit():
    """Where best fit isn't at the bound: the program's value is near its own bound, and rounding it saves sequences."""
    counts = np.zeros(1001, np.int64)
    counts[[341, 318, 340, 501, 249, 250]] = [400, 300, 200, 300, 600, 100]
    program = packing.solve(counts, 1000)
    assert program.bound <= program.value <= 1.02 * program.bound
    covered = defaultdict(float)
    for found, x in program.amounts:
        assert sum(length * n for length, n in found.items()) <= 1000
        for length, n in found.items():
            covered[length] += n * x
    assert all(covered[int(k)] >= counts[k] - 1e-6 for k in np.flatnonzero(counts))
    fewest = sum(n for _, n in packing.plan({int(k): int(counts[k]) for k in np.flatnonzero(counts)}, 1000))
    plain = sum(n for _, n in packing.best_fit(counts, 1000, []))
    assert program.bound <= fewest < 0.95 * plain
    rng = np.random.default_rng(1)
    hard = np.zeros(1001, np.int64)
    for k in rng.integers(260, 520, 60):
        hard[k] += int(rng.integers(50, 400))
    program = packing.solve(hard, 1000)
    assert program.value <= 1.08 * program.bound
    assert sum(n for _, n in packing.plan({int(k): int(hard[k]) for k in np.flatnonzero(hard)}, 1000)) < sum(n for _, n in packing.best_fit(hard, 1000, []))


def test_true_lengths_come_from_the_program():
    """Hundreds of lengths, few pieces of each: the program's own sequences reach its bound, nothing is left to best fit."""
    rng = np.random.default_rng(7)
    counts = np.bincount(np.minimum(rng.lognormal(5.2, 0.9, 6000).astype(int) + 1, 2048), minlength=2049)
    assert np.count_nonzero(counts) > 600
    stops, bound = packing.whole(counts, 2048)
    left, groups = stops[-1]
    held = np.zeros(2049, np.int64)
    for items, n in groups:
        assert sum(items) <= 2048
        for length in items:
            held[length] += n
    assert (held + left == counts).all() and bound >= counts @ np.arange(2049) / 2048 - 1e-6
    rest = packing.sequences(packing.best_fit(left, 2048, [])) if left.any() else 0
    assert rest <= 0.01 * packing.sequences(groups)
    fewest = packing.sequences(packing.plan({int(k): int(counts[k]) for k in np.flatnonzero(counts)}, 2048))
    assert np.ceil(bound - 1e-6) <= fewest <= min(packing.sequences(packing.best_fit(counts, 2048, [])), np.ceil(bound) + 1)


def test_best_configuration_is_optimal():
    value = np.zeros(31)
    value[[3, 5, 7, 11]] = [0.4, 0.8, 1.15, 1.7]
    found = packing.best_configuration(value, 30)
    best = max(a * 0.4 + b * 0.8 + c * 1.15 + d * 1.7 for a in range(11) for b in range(7) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 30)
    assert sum(value[k] * n for k, n in found.items()) == pytest.approx(best) and sum(k * n for k, n in found.items()) <= 30


# Search


def brute_top(vectors, is_query, k):
    fine = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if is_query(q):
            ranked = sorted((-int(x @ y), i) for i, y in fine if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    return out


def check_top(spark, vectors, kind="double", k=5):
    frame_ = spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], f"vec_id long, embedding array<{kind}>, score string, block string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame_, F.col("vec_id") % 50 == 0, k=k).collect()}
    exact = vectors if kind == "double" else [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert got == brute_top(exact, lambda i: i % 50 == 0, k)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 200)
    monkeypatch.setattr(topk, "BATCH", 7)
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.13, 16)]) for i in range(900)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)] + [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2050, [float("inf")] * 16), (None, vectors[0][1])]
    check_top(spark, vectors, "float")


def test_top_k_large_components_and_clusters(spark, monkeypatch):
    """Scores near and beyond what 53 bits hold, and vectors that differ little: exact integers."""
    monkeypatch.setattr(topk, "LEAST", 100)
    rng = np.random.default_rng(7)
    check_top(spark, [(i, [float(int(x)) for x in rng.integers(-(2**20), 2**20, 12)]) for i in range(600)])
    check_top(spark, [(i, [2.0**21 + float(int(x)) / 256 for x in rng.integers(0, 3, 8)]) for i in range(600)])
    centres = rng.normal(0, 1, (5, 24))
    check_top(spark, [(i, [float(x) for x in centres[i % 5] + rng.normal(0, 0.004, 24)]) for i in range(800)])
    check_top(spark, [(i, [0.25 if k == i % 3 else 0.0 for k in range(4)]) for i in range(500)], k=9)
    check_top(spark, [(i, [float(x) for x in rng.normal(0, 1, 700)]) for i in range(200)])


def test_top_k_scores_beyond_64_bits_keep_their_order(spark):
    large = [(0, [2.0**30] * 4), (1, [2.0**30] * 4), (2, [2.0**30, 2.0**30, 2.0**30, 2.0**29]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [-(2.0**30)] * 4)]
    frame_ = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame_, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, topk.LARGEST), (2, topk.LARGEST), (3, 2**38 * 256), (4, topk.SMALLEST)]


def test_top_k_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 1.0]), (0, [2.0, 1.0]), (1, [3.0]), (1, [3.0]), (2, []), (3, [1.0, 1.0, 9.0])]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame_, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 3 * 65536), (1, 3 * 65536), (3, 2 * 65536), (2, 0)]


def test_top_k_few_rows_and_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1])], kind)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 32768), (0, 2, 2, 32768)]
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") == 0).collect() == []
