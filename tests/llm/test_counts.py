"""Token counts, source audit and whitening against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallywind.llm import queries, source_audit, token_counts, transducer, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# --- token counts -----------------------------------------------------------------------------------------------------------------


def library_counts(texts, path=BYTE_BPE):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.fixture(scope="module")
def counter():
    return token_counts.ShortcutCounter(BYTE_BPE, token_counts.prove_whole(BYTE_BPE))


def test_proven_strings_are_one_token(counter):
    assert 45_000 < len(counter.whole) < 50_257 and "Ġthe" in counter.whole
    assert "<|endoftext|>" not in counter.whole and "ĠĠa" not in counter.whole


def test_counts_equal_the_library_on_random_texts(counter):
    draw = random.Random(8)
    letters = "ab Z  \t\n\r\x0b\x1c\x1f\x85\xa0 　᠎'sdtlmrve09²٣.,!?-_éßñ漢字😀́﻿\x00ǅʰ¼Ⅷɏɐ"
    bits = ["<|endoftext|>", "'s", "'ll", " don't", "  ", "\n\n", " hello", "World", "<|endoftext|", "   "]
    texts = ["".join(draw.choice(bits if draw.random() < 0.2 else letters) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    assert counter.batch(texts) == library_counts(texts)


def test_windows_change_no_count(counter, monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["word", " more", "\n", "  ", " x\t", "é", " 12", "."]) for _ in range(4000)) + "y" * 3000
    monkeypatch.setattr(token_counts.windows, "__defaults__", (300,))
    assert "".join(token_counts.windows(text)) == text and len(list(token_counts.windows(text))) > 10
    assert counter.batch([text]) == library_counts([text])


def test_kept_counts_are_trimmed(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    texts = [f"w{i} x{i}, y{i}" for i in range(400)]
    assert counter.batch(texts) + counter.batch(texts) == 2 * library_counts(texts)
    many = len(counter.later)
    counter.batch([])
    assert 0 < len(counter.later) <= many // 2 + 1


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_token_counts(request, plain, which):
    df = request.getfixturevalue(which)
    rows = plain(df)
    wanted = [(d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, library_counts([t for _, t in rows]))]
    got = token_counts.token_counts(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert ordered(got.collect()) == ordered(wanted)


def test_other_tokenizers_count_whole_texts(spark):
    texts = ["Hello  World", None, "", "naïve 漢字 <s>", "<|endoftext|> A b", "\n a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    word = public_tokenizers.path("word_bpe_49k.json")
    assert not token_counts.provable(word)
    assert [r.n_tokens for r in token_counts.token_counts(df, word).orderBy("doc_id").collect()] == library_counts(texts, word)
    import sentencepiece

    piece = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert [r.n_tokens for r in token_counts.token_counts(df, piece, 2).orderBy("doc_id").collect()] == [len(model.encode(t or "")) for t in texts]


def test_a_text_of_many_megabytes(spark, counter):
    text = " ".join(f"word{i % 977} and{i % 13}," for i in range(700_000))
    assert len(text) > 8 << 20
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {1: library_counts([text])[0], 2: 1}


# --- source audit -----------------------------------------------------------------------------------------------------------------


def test_transducer_orders_and_spells():
    draw = random.Random(1)
    for _ in range(100):
        terms = sorted({"".join(draw.choices("abé漢c", k=draw.randint(1, 6))).encode() for _ in range(draw.randint(0, 60))})
        t = transducer.build(terms)
        asked = terms + ["".join(draw.choices("abé漢c", k=draw.randint(0, 6))).encode() for _ in range(40)]
        end = np.cumsum([len(q) for q in asked])
        places = {x: i for i, x in enumerate(terms)}
        found = t.ordinals(np.frombuffer(b"".join(asked), np.uint8), end - [len(q) for q in asked], end)
        assert found.tolist() == [places.get(q, -1) for q in asked]
        assert [t.term(i) for i in range(len(terms))] == terms


def test_transducer_is_minimal():
    terms = sorted(a + b + c for a in (b"x", b"yy") for b in (b"a", b"b", b"c") for c in (b"", b"ing", b"ed"))
    assert len(transducer.build(terms).final) < 12


def audit_rows(df):
    return [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]


@pytest.fixture(scope="module")
def odd_sources(spark):
    draw = random.Random(4)
    pool = ["the", "The", "of", "straße", "ÉCOLE", "école", "漢字", "x", "don't", "a-b", "naïve", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(400):
        lang = draw.choice(["en", "en", "en", "de", None, "", "lonely", "rare"])
        source = draw.choice(["s1", "s2", "s3", "", None, "ü"]) if lang != "lonely" else "only"
        text = None if i % 17 == 0 else "".join(draw.choice(pool) + draw.choice([" ", "\n", "7", ", "]) for _ in range(draw.randint(0, 30)))
        rows.append((i % 350 if i % 5 else None, text, lang, source, i, "other", 1))
    rows += [(1, "the " * 200_000, "en", "s1", 0, "", 1), (2, "zz" * 100_000, "en", "new", 0, "", 1), (3, "", "nothing", "a", 0, "", 1), (3, None, "nothing", "b", 0, "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ord int, item string, n long").repartition(5)


# The third case has many blocks of sources and of ordinals.
@pytest.mark.parametrize("min_docs, resident, shard_terms, more", [(30, 64 << 20, 200_000, ()), (5, 0, 3, ()), (5, 64 << 20, 3, (2, 8)), (10_000, 64 << 20, 10, ())])
def test_source_audit(odd_sources, min_docs, resident, shard_terms, more):
    got = source_audit.source_audit(odd_sources, min_docs, 7, resident, shard_terms, *more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert ordered(got.collect()) == ordered(brute.source_audit(audit_rows(odd_sources), min_docs, 7))


def test_sums_hand_out_full_tables():
    sums, out = source_audit.Sums(["k"], 20), []
    for i in range(300):
        sums.add(k=[f"k{i * j % 37}" for j in range(5)], n=[1, 2, 3, 4, 5])
        out.append(sums.ready())
    out.append(sums.rest())
    assert len([t for t in out if t is not None]) > 5 and sums.rest() is None
    total = Counter()
    for t in out:
        for k, n in zip(t["k"].to_pylist(), t["n"].to_pylist()) if t is not None else ():
            total[k] += n
    assert total == _plain_sums()


def _plain_sums():
    total = Counter()
    for i in range(300):
        for j in range(5):
            total[f"k{i * j % 37}"] += j + 1
    return total


def test_source_audit_of_no_rows(no_docs):
    df = no_docs.withColumn("source", F.lit("x"))
    assert source_audit.source_audit(df).collect() == []


def test_audit_shares_beyond_64_bits(spark):
    shares = spark.range(1).select(source_audit._share(F.lit(10**15).cast("long"), F.lit(3 * 10**15).cast("long"), F.lit(10**9).cast("long")).alias("p"))
    assert shares.first().p == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**9)


# --- whitening --------------------------------------------------------------------------------------------------------------------


def check_whitening(vectors, column="embedding", id_column="vec_id", width=None, k=16):
    rows = vectors.select(id_column, column).collect()
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2.0**56 for c in v)]
    lengths = Counter(len(v) for _, v in usable)
    width = max(lengths, key=lambda x: (lengths[x], x))
    usable = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in usable if len(v) == width]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    a = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    found = min(k, int((e > 1e-11 * e[0]).sum()))
    got = whitening.whitened(vectors, column, id_column).collect()
    by_row = defaultdict(dict)
    for r in got:
        by_row[r[0], r.deviation].setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.identity_error <= 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    assert len(got) == found * len(usable)
    wanted = Counter((i, d if d < 1 << 63 else None) for i, d in ((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in usable))
    assert {key: found * m for key, m in wanted.items()} == Counter((r[0], r.deviation) for r in got)
    return usable, fit, n, sums, e, axes, by_row


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whitening(spark, sf_dir, sf):
    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', sf)}/embeddings.parquet")
    usable, _, n, sums, e, axes, by_row = check_whitening(vectors)
    x = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for _, v in usable])
    y = x @ axes[:, :16] / np.sqrt(e[:16])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in usable]
    mine = np.array([[by_row[i, d][k + 1][0] for k in range(16)] for (i, _), d in zip(usable, deviations)])
    signs = np.sign((mine * y).sum(axis=0))
    assert np.abs(mine - y * signs).max() < 1e-8


ODD_VECTORS = [
    (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (None, [0.5, -2.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]),
    (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0, 4.0]), (10, [-1.5, 0.01, 7.0]), (11, [0.1, 0.2, 0.3]), (12, [1e30, 0.0, 0.0]),
]


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_of_odd_rows(spark, scale):
    rows = [(i, None if v is None else [None if c is None else c * scale for c in v], "x", 3) for i, v in ODD_VECTORS]
    check_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int").repartition(3))


def test_whitening_finds_repeated_deviations(spark):
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(20)]) for i in range(20) for s in (0, 1)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 40 * 16 and all(r.explained == pytest.approx(1 / 20) and r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("vectors", [[], [None, None], [[1.0, 2.0]] * 5, [[]], [[float("nan")]]])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitening.whitened(df).collect() == []


def test_products_do_not_depend_on_partitions(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(vectors.repartition(1)).collect()}
    many = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(vectors.unionByName(vectors).repartition(9)).collect()}
    signs = {c: np.sign(sum(one[k] * many[k] for k in one if k[1] == c)) for c in {k[1] for k in one}}
    assert max(abs(one[k] - signs[k[1]] * many[k]) for k in one) < 1e-8


def test_registered_queries(spark, sf_dir):
    for name in ("op11_token_counts", "op12_source_audit", "op13_whitening"):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0
