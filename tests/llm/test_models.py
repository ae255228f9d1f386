"""Quality, toxicity, decontamination, Jaccard join and the pipeline."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from tallywind.llm import components, decontaminate, jaccard_join, quality_knn, toxic_segments


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")


@pytest.fixture(scope="module")
def more_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")


def test_quality_on_held_out_rows(more_docs, labels):
    rows = quality_knn.quality_scores(more_docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("text", ["", "the same words for all of them"])
def test_quality_vote_keeps_label_shares(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    given = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(200)], "doc_id long, quality int")
    used = [r.quality for r in given.filter(quality_knn.fold(given.doc_id, 3) != 1).collect()]
    assert min(used.count(0), used.count(1)) > 7
    rows = quality_knn.quality_scores(docs, given, per_label=7).collect()  # 14 voters, and all of them vote
    assert len(rows) == 200 and all(r.score == pytest.approx(np.mean(used)) and r.predicted == 1 for r in rows)
    assert quality_knn.keep_good(docs, given, per_label=7).count() == 200


def test_toxicity_on_held_out_rows(more_docs, labels):
    rows = toxic_segments.toxicity(more_docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.7


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_classifiers_on_odd_rows(request, spark, labels, which):
    df = request.getfixturevalue(which)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    odd_labels = labels.limit(30).unionByName(spark.createDataFrame([(None, 1, None), (7, None, 0), (7, None, None), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    for given in (none, odd_labels):
        for rows in (quality_knn.quality_scores(df, given).collect(), toxic_segments.toxicity(df, given).collect()):
            assert len(rows) == df.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
            by_text = {}
            for r in rows:
                by_text.setdefault(r.doc_id, set()).add(r.score)
            assert len(by_text.get(7, {0})) == 1  # equal rows, equal scores
    assert quality_knn.keep_good(df, none).columns == df.columns and quality_knn.keep_good(df, none).count() == df.count()


def test_maximal_segments_match_definition():
    draw = random.Random(1)
    for _ in range(200):
        x = [draw.choice([-1.0, -1.0, -1.0, 1.5, 2.5]) for _ in range(draw.randint(1, 25))]
        at = np.array([i for i, v in enumerate(x) if v > 0], np.int64)
        got = toxic_segments.maximal_segments(at, np.array([x[i] for i in at]), 1.0)

        def best(a, b):
            found = max(((sum(x[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if found[0] <= 0:
                return []
            return [*best(a, found[2]), (found[2], found[3] - 1, found[0]), *best(found[3], b)]

        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in best(0, len(x))))
        assert len(got) == len(best(0, len(x)))


def plain_alignment(item, window):
    table, top = [[0] * (len(window) + 1)], 0
    for a in item:
        row = [0]
        for j, b in enumerate(window):
            row.append(max(0, table[-1][j] + (2 if a == b else -1), table[-1][j + 1] - 1, row[j] - 1))
        table.append(row)
        top = max(top, *row)
    return top


def test_alignment_matches_plain_version():
    draw = np.random.default_rng(2)
    for _ in range(100):
        item, window = draw.integers(0, 4, draw.integers(1, 12)), draw.integers(0, 4, draw.integers(0, 20))
        assert decontaminate.align(item, window)[0] == plain_alignment(item, window)


def test_leaks_against_alignment_of_all_pairs(spark, sf_dir, docs, plain):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12)
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in brute.lower(t or "")).split()
    few = docs.limit(60)
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    want = {(d, i) for d, t in plain(few) for i, w in items if plain_alignment(w, words(t)) / (2 * len(w)) >= decontaminate.THRESHOLD}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(few, benchmark).collect()}
    assert got == want


def test_edited_and_hot_leaks(spark, odd_docs, no_docs, monkeypatch):
    draw = random.Random(8)
    passage = ["".join(draw.choices("klmnop", k=6)) for _ in range(40)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(passage)]
    shifted = [*passage[:15], "two", "more", *passage[16:]]
    rows = [(i, " ".join(["lead", "in", *p, "and", "out"])) for i, p in enumerate([passage] * 30 + [edited, shifted, passage[:8]])]
    docs = spark.createDataFrame([*rows, (None, None), (99, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, ""), (4, "two words"), (5, " ".join(passage).upper())], "item_id long, text string")
    for size in (decontaminate.BLOCK_WORDS, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
        assert got == {(i, j) for i in range(32) for j in (1, 5)}
        assert decontaminate.keep_clean(docs, items).count() == 3
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd_docs, items).count() == odd_docs.count()


@pytest.mark.parametrize("copies, others", [(1, 0), (40, 0), (5, 1500)])
def test_leak_with_one_common_seed(spark, copies, others):
    item = [f"w{i}" for i in range(1, 17)]
    edited = [w if i not in (4, 7, 10, 13, 16) else "changed" for i, w in enumerate(item, 1)]
    weak = ["other", *item[:3], *(f"x{i}" for i in range(30))]  # the seed alone is no leak
    rows = [(i, " ".join(["lead", "in", *edited, "out"])) for i in range(copies)] + [(1000 + i, " ".join(weak)) for i in range(3)]
    rows += [(2000 + i, f"some text {i}") for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert plain_alignment(item, edited) == 18
    assert {(r.doc_id, r.score) for r in decontaminate.leaks(docs, items).collect()} == {(i, 18 / 32) for i in range(copies)}
    assert decontaminate.keep_clean(docs, items).count() == 3 + others


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_near_copies(request, plain, which):
    df = request.getfixturevalue(which)
    assert ordered(jaccard_join.near_copies(df).collect()) == ordered(brute.similar(plain(df)))


def test_large_family_in_blocks(spark, plain, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    draw = random.Random(6)
    base = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(80)]
    texts = []
    for i in range(150):
        w = list(base[:draw.choice([80, 80, 70, 60, 40])])
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = f"e{draw.randint(0, 30)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame([*texts, *texts[:9]], "doc_id long, text string")
    assert ordered(jaccard_join.near_copies(df).collect()) == ordered(brute.similar(plain(df)))


def test_keep_one(odd_docs, plain):
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _, _ in brute.similar(plain(odd_docs))}


def test_pipeline_stages(spark, more_docs, sf_dir, plain):
    folder = sf_dir.replace("0.001", "0.01")
    good = corpus_pipeline.quality_classifier(spark, more_docs, folder)
    scores = {r.doc_id for r in quality_knn.quality_scores(more_docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == scores
    unique = corpus_pipeline.exact_deduplication(spark, good, folder)
    assert {r.doc_id for r in unique.collect()} == {k for _, k, _, _ in brute.exact_groups(plain(good))}
    apart = corpus_pipeline.near_deduplication(spark, unique, folder)
    assert {r.doc_id for r in apart.collect()} == {c for _, c, _, _ in brute.similar(plain(unique))}
    clean = corpus_pipeline.benchmark_decontamination(spark, apart, folder)
    leaking = {r.doc_id for r in decontaminate.leaks(apart, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in plain(apart)} - leaking
    for df in (good, unique, apart, clean):
        assert df.columns == more_docs.columns
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert final.keys() == {d for d, _ in plain(clean)}
    assert all(r.parity and r.round_trip and len(r.token_ids) == r.n_tokens for r in final.values())
