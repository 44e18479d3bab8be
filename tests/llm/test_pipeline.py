"""The pipeline on a small corpus, stage by stage against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import mixing, quality, tokens
from tallyspark.llm.queries import QUERIES, quality_model


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["ta", "re", "on", "mi", "les", "ver", "no", "qua"]) for _ in range(r.randint(1, 4)))
    good = [" ".join(word() for _ in range(r.randint(30, 90))) + "." for _ in range(90)]
    texts = [*good, *[" ".join(w.upper() + "!!" for w in t.split()) for t in good[:30]]]
    texts += [good[i % 7].replace(" ", "  ", 3) for i in range(40)]  # equal but for blanks
    for i in range(30):  # near copies
        w = good[20 + i % 5].split()
        w[i % len(w)] = "zzz"
        texts.append(" ".join(w))
    texts += ["", None]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4 if i % 3 else 0], len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 90), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: t for i, t, *_ in rows}


def test_pipeline_equals_its_stages_in_plain_python(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_model(spark, path)
    ids = sorted(texts)
    kept = [i for i, s in zip(ids, model.scores([texts[i] or "" for i in ids]), strict=True) if s >= 0.3]
    assert set(range(90)) <= set(kept) and not set(range(90, 120)) & set(kept)
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    kept = sorted(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (texts[i] or "").lower().split()) else set() for i in kept}
    root = {i: i for i in kept}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in kept:
        for j in kept:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [i for i in kept if find(i) == i]
    taken = {r.doc_id: int(r.taken / max(r["size"], 1) + 0.5) for r in mixing.mix(docs.where(F.col("doc_id").isin(kept))).collect()}
    expected = Counter()
    for i in kept:
        n = len(tokens.encode_ids(texts[i] or "", tokens.default_ranks(), tokens.default_vocabulary())) + 1
        expected[i] += n * taken[i]
    got = corpus_pipeline.run(spark, path).collect()
    counted = Counter()
    places = {}
    for r in got:
        counted[r.doc_id] += r.length
        for k in range(r.offset, r.offset + r.length):
            assert places.setdefault((r.sequence_id, k), r) is r
    assert counted == +expected


def test_stages_return_the_documents_columns(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_stages_take_an_empty_table(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0")
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_stages_decide_on_rows_not_ids(spark):
    texts = [f"w{i} " * i for i in range(1, 60)]  # of different sizes
    ids = [None if i % 5 == 0 else 7 if i % 7 == 0 else i for i in range(1, 60)]
    docs = spark.createDataFrame([(d, t, "en", "ab"[k % 2], len(t)) for k, (d, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {(r.doc_id, r["size"]): int(r.taken / r["size"] + 0.5) for r in mixing.mix(docs).collect()}
    got = Counter((r.doc_id, len(r.text.split())) for r in corpus_pipeline.mix_stage(spark, docs, "").collect())
    assert got == +Counter(copies) and sum(d is None for d, _ in got) > 5 and sum(d == 7 for d, _ in got) > 3
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.concat("text", F.lit(" "))))
    assert sorted(len(r.text.split()) for r in corpus_pipeline.exact_stage(spark, twice, "").collect()) == list(range(1, 60))


CLASHES = ["locator", "copies", "copy", "score", "predicted", "_score", "_locator", "_copies", "_copy", "_row_number", "taken", "size", "shard", "place", "kept", "component_id"]


def test_stages_carry_columns_of_any_name(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clash = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES])
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        plain = Counter(r.doc_id for r in stage(spark, docs, path).collect())
        got = stage(spark, clash, path).collect()
        assert Counter(r.doc_id for r in got) == plain and got
        assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in CLASHES)


def test_near_stage_decides_on_rows(spark):
    word = lambda i: " ".join(f"t{i}w{k}" for k in range(40))
    rows = [(7, word(1)), (7, word(2)), (3, word(1) + " end"), (None, word(3)), (None, word(3) + " end"), (None, word(4)), (9, word(4)), (5, ""), (6, None), (8, "z " * 300_000)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or "")[:3]) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert got == Counter([(7, "t2w"), (3, "t1w"), (None, "t3w"), (9, "t4w"), (5, ""), (6, ""), (8, "z z")])


def test_long_texts_pass_all_stages(spark, corpus):
    path, texts = corpus
    long = " ".join(f"{texts[i]}" for i in range(40)) * 40
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " ", "en", "a", 0), (3, "x" * 100_000, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert {len(r.text) for r in docs.collect()} <= {len(long), len(long) + 1, 100_000}
    pieces = corpus_pipeline.pack_stage(spark, docs, path).collect()
    n = len(tokens.encode_ids(long + " ", tokens.default_ranks(), tokens.default_vocabulary())) + 1
    assert sum(r.length for r in pieces if r.doc_id in (1, 2)) % n in (0, n - 1)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_scores_of_the_whole_corpus_ignore_ids(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    model = quality_model(spark, path)
    a = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    b = {r.doc_id - 1000: r.score for r in quality.score(docs.withColumn("doc_id", F.col("doc_id") + 1000), model).collect()}
    assert a == b
