"""Spelling variants, embedding whitening and repeated strings against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, spelling, suffix_dedup, whitening

GIVEN = "/root/testdata/sf0.001"


# Spelling variants


def brute_variants(rows, damage=199):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(upper)):
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % damage == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(((-n[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def variants_of(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash", 0) for i, t in rows], "doc_id long, text string, word string, form string, near string, n int")
    got = spelling.variants(docs, **kw).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("symbols", [2, 6])
def test_variants_equal_brute_force(spark, symbols):
    rng = np.random.default_rng(symbols)
    words = ["".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "àaaaaa", "ÀAAAAA", "ß" * 7]
    rows = [(int(i) if i % 7 else None, " ".join(np.array(words)[rng.zipf(1.3, 150) % len(words)])) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "12 34 __ !"), (503, "Aaaaaa" * 3000), (503, "Aaaaaa, aaaaaa; aaaaaa.x aaaaaa"), (503, "Aaaaaa, aaaaaa; aaaaaa.x aaaaaa")]
    expected = brute_variants(rows, damage=7)
    assert any(v[0] for v in expected.values()) and any(v[3] > 1 for v in expected.values())
    assert variants_of(spark, rows, damage=7, symbols=symbols) == expected


def test_variant_chains_and_ties(spark):
    # Counts 5, 25, 125, 625 in a chain, and two near words of equal count.
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 700, "xyzxyz": 5, "xyzxyb": 30, "xyzxya": 30, "lonely": 9}
    rows = [(i, w) for i, (w, n) in enumerate(counts.items()) for _ in range(n)]
    got = variants_of(spark, rows, damage=1 << 40)
    assert got["abcdef"] == ("abcdeg", "abcihg", 5, 1, 25) and got["abcdhg"][:2] == ("abcihg", "abcihg")
    assert got["xyzxyz"] == ("xyzxya", "xyzxya", 5, 2, 30) and got["lonely"] == (None, "lonely", 9, 0, None)


def test_variants_of_nothing(spark):
    assert variants_of(spark, []) == {} and variants_of(spark, [(1, None), (2, "")]) == {}


def test_variants_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()]
    got = queries.op11_spelling_variants(spark, GIVEN).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(rows)


def test_neighbourhoods_hold_all_single_edits(spark):
    codes = ["a", "ab", "abba", "aaabbc", "cbacba"]
    known = spark.createDataFrame([(c, 1, c) for c in codes], "word string, n int, code string")
    got = defaultdict(list)
    for r in spelling.neighbourhood(known, 3).collect():
        got[r.word].append(r.near)
    letters = sorted(spelling.symbol(chr(i), 3) for i in range(97, 100))
    for code in codes:
        every = {code} | {code[:i] + code[i + 1 :] for i in range(len(code))}
        every |= {code[:i] + c + code[i:] for i in range(len(code) + 1) for c in letters} | {code[:i] + c + code[i + 1 :] for i in range(len(code)) for c in letters}
        assert sorted(got[code]) == sorted(s for s in every if s >= code)


# Whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, x int, n int")


def check_whitening(rows, got, r=4):
    """Exact deviations; explained shares and projections of numpy's eigenvectors up to sign; the measured identity."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1][:r], axes[:, ::-1][:, :r]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for _, v in kept]
    assert Counter((g.vec_id, g.component, g.deviation) for g in got) == Counter((i, c + 1, d) for (i, _), d in zip(kept, deviations) for c in range(len(values)))
    assert {g.n for g in got} == {n} and all(g.identity_error < 1e-9 for g in got) and len({g.identity_error for g in got}) == 1
    for c in range(len(values)):
        mine = sorted((g.vec_id is not None, g.vec_id, g.whitened) for g in got if g.component == c + 1)
        other = sorted((i is not None, i, float(w)) for (i, _), w in zip(kept, (x - sums / n) @ axes[:, c] / np.sqrt(values[c])))
        ratio = 1 if np.dot([m[2] for m in mine], [o[2] for o in other]) > 0 else -1
        assert np.allclose([m[2] for m in mine], [ratio * o[2] for o in other], atol=1e-6)
        assert next(g.explained for g in got if g.component == c + 1) == pytest.approx(values[c] / np.trace(np.cov(fit.T.astype(float), bias=True)), rel=1e-9)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(60, 7)) * [3, 2, 1.4, 1, 0.5, 0.2, 0.1] + 5).tolist()
    rows = list(enumerate(points)) + [(100, points[0]), (100, points[0]), (101, None), (102, [1.0, None] + [0.0] * 5), (103, [float("nan")] * 7), (104, [float("inf")] * 7), (105, []), (106, [-0.0] * 7)]
    check_whitening(rows, whitening.whiten(vectors_of(spark, rows)).collect())


def test_whitening_of_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{GIVEN}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_embedding_whitening(spark, GIVEN).collect())


def test_whitening_with_equal_and_missing_variances(spark):
    # The corners of a cube: three equal eigenvalues; a plane: two components; one vector or none: none.
    cube = [(i, [float(i >> k & 1) * 4 for k in range(3)]) for i in range(8)]
    got = whitening.whiten(vectors_of(spark, cube)).collect()
    assert {g.component for g in got} == {1, 2, 3} and all(g.identity_error < 1e-12 for g in got)
    assert all(g.explained == pytest.approx(1 / 3, rel=1e-15) for g in got)
    flat = [(i, [float(i % 4), float(i // 4), 0.0, 1.0, 2.0]) for i in range(12)]
    assert {g.component for g in whitening.whiten(vectors_of(spark, flat)).collect()} == {1, 2}
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whitening.whiten(vectors_of(spark, [])).collect() == [] and whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).collect() == []


def test_whitening_of_mixed_lengths_and_large_components(spark):
    big = [[1e12, 5.0], [-1e12, 6.0], [3e12, 7.5], [2.0, 8.0]]
    rows = [(i, v) for i, v in enumerate(big)] + [(9, [1.0]), (None, big[0])]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    fit = [[math.floor(256 * float(np.float32(c))) for c in v] for v in big]
    sums = [sum(v[k] for v in fit) for k in (0, 1)]
    exact = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(fit)}
    assert {g.vec_id for g in got} == {0, 1, 2, 3, None}
    assert all(g.deviation is None for g in got if exact.get(g.vec_id, 1 << 63) >= 1 << 63) and all(g.identity_error < 1e-6 for g in got)


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 9):
        half = rng.integers(-50, 50, (d, d)).astype(object)
        matrix = half.dot(half.T)
        matrix[0, :] = matrix[:, 0] = 0  # zero pivots
        if d > 1:
            matrix[0, d - 1] = matrix[d - 1, 0] = 0
        # Faddeev and LeVerrier's recurrence in fractions.
        m, coefficients = np.zeros((d, d), object), [Fraction(1)]
        for k in range(1, d + 1):
            m = matrix.dot(m) + np.eye(d, dtype=int).astype(object) * coefficients[-1]
            coefficients.append(-Fraction(int(np.trace(matrix.dot(m)))) / k)
        assert whitening.characteristic_polynomial(spark, matrix.tolist()) == [int(c) for c in reversed(coefficients)]


def test_roots_are_isolated_with_their_multiplicity():
    polynomial = [1]
    for root in (7, 7, 7, 12, 12, 30, 0, 0):
        polynomial = [a - root * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert whitening.largest_roots(polynomial, 8, 40) == [30, 12, 12, 7, 7, 7, 0, 0]
    assert [whitening.roots_above(polynomial, a) for a in (30, 29, 12, 11, 0)] == [0, 1, 1, 3, 6]


# Repeated strings


def brute_repeats(rows, width=200):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + width] for i in range(len(raw) - width + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats_of(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], "doc_id long, text string, k1 string, start int, sha string")
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs.repartition(3), **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def prose(rng, n, letters="abcdefgé \n"):
    return "".join(rng.choice(list(letters), n))


def repeat_cases(rng):
    shared, other = prose(rng, 260), prose(rng, 199)
    rows = [(i, prose(rng, int(rng.integers(0, 700)))) for i in range(12)]
    rows += [(20 + i, prose(rng, 150) + shared + prose(rng, 90)) for i in range(4)]
    rows += [(30 + i, prose(rng, 40) + "\n" + other[: 199 - i] + "\t" + prose(rng, 30)) for i in range(3)]
    rows += [(40, "x" * 900), (41, "ab" * 400), (42, shared + "-" + shared), (43, "y" * 200), (44, "z" * 201)]
    whole = prose(rng, 800)
    rows += [(50, whole), (50, whole), (None, whole), (51, whole[:400] + "!" + whole[400:]), (52, whole[13:]), (53, None), (54, ""), (None, None)]
    return rows


@pytest.mark.parametrize("crowd", [20000, 2])
def test_repeats_equal_brute_force(spark, crowd):
    rows = repeat_cases(np.random.default_rng(6))
    assert repeats_of(spark, rows, crowd=crowd) == brute_repeats(rows)


def test_repeats_in_cut_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 170)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2)
    rows = repeat_cases(np.random.default_rng(7))
    assert repeats_of(spark, rows, width=64) == brute_repeats(rows, 64)


def test_repeats_of_nothing_and_short_width(spark):
    assert repeats_of(spark, []) == Counter() and repeats_of(spark, [(1, None)]) == brute_repeats([(1, None)])
    with pytest.raises(ValueError):
        repeats_of(spark, [], width=31)


def test_repeats_survive_colliding_pointers(monkeypatch):
    # All q-grams of equal hash: buckets hold unequal strings, which only the comparison of bytes tells apart.
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda data: np.zeros(len(data) - suffix_dedup.GRAM + 1, np.uint64))
    rng = np.random.default_rng(9)
    shared = bytes(rng.integers(97, 103, 70, dtype=np.uint8))
    contexts = [bytes(rng.integers(97, 103, 90, dtype=np.uint8)) for _ in range(4)] + [b"1" * 9 + shared + b"2", b"3" * 4 + shared]
    seen = Counter(c[i : i + 64] for c in contexts for i in range(len(c) - 63))
    for context, flags in zip(contexts, suffix_dedup.refine(contexts, 64)):
        assert flags.tolist() == [seen[context[i : i + 64]] > 1 for i in range(len(context) - 63)]


def test_repeats_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()]
    got = queries.op13_suffix_dedup(spark, GIVEN)
    assert got.where(F.col("n_removed") > 0).count() > 0
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_repeats(rows)
