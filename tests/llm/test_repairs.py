"""Backends that decide, whole measures of long texts, ties among voters, templates among benchmark items."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallywind.llm import decontaminate, piece_codec, quality_knn
from tallywind.llm.flat import flat_bytes


def test_the_rebuilt_tokenizer_decides_the_ids():
    """A backend with other merges gives its own ids, and parity says so."""
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["The quick brown fox,\njumps over 12 lazy dogs", "naïve café", "", None, "  two  spaces"]
    right, agree = codec.encode(texts)
    assert all(agree) and [np.frombuffer(x, codec.dtype).tolist() for x in right] == [codec.other.encode(t or "") for t in texts]
    broken = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [(p, -s if kind == piece_codec.NORMAL else s, kind) for p, s, kind in broken.model.pieces]
    broken.tokenizer = piece_codec.build_tokenizer(piece_codec.PieceModel(pieces, *[getattr(broken.model, f) for f in (
        "kind", "byte_fallback", "unknown_id", "charsmap", "dummy_prefix", "squeeze")]))
    wrong, agree = broken.encode(texts)
    assert wrong[0] != right[0] and not agree[0] and agree[2] and agree[3]
    assert np.frombuffer(wrong[1], broken.dtype).tolist() == broken.tokenizer.encode(texts[1], add_special_tokens=False).ids


@pytest.mark.parametrize("size", [50_000, 77_777])
def test_long_texts_are_measured_whole(size):
    draw = random.Random(size)
    pool = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(3000)]
    block = "".join(draw.choice(pool) + draw.choice([" ", " ", " ", "\n", "\r\n", "  "]) for _ in range(20_000))
    for text in (block * 3 + "tail", "x" * 200_000, "\n" * 120_000, block.replace(" ", "").replace("\n", "") + " end"):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = quality_knn.features(data, np.array([0, len(data)]))
        assert np.array_equal(whole, quality_knn._features_in_parts(data, size))


def test_a_text_of_twelve_megabytes_goes_through_in_parts():
    text = ("one block of words, repeated " * 40 + "\n") * 10_500
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(data) > 12_000_000
    found = quality_knn.features(data, np.array([0, len(data)]))[0, quality_knn.N_COUNTS:]
    assert found[0] < 0.0001 and found[1] < 0.0001 and found[2] < 0.0002


def test_ties_go_to_the_earlier_voter():
    draw = np.random.default_rng(2)
    near = draw.integers(0, 4, (200, 50)).astype(np.float32)
    for k in (1, 7, 50):
        wanted = [sorted(sorted(range(50), key=lambda j: (-row[j], j))[:k]) for row in near]
        assert quality_knn.nearest(near, k).tolist() == wanted


def test_votes_equal_a_plain_count():
    draw = random.Random(5)
    pool = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(draw.choices(pool[: 40 + 5 * (i % 40)], k=draw.randint(3, 60))) for i in range(240)] + ["", ""]
    x = quality_knn.features(*flat_bytes(pa.array(texts, pa.large_string())))
    labels = np.array([draw.randint(0, 1) for _ in texts])
    weight = np.where(labels == 1, 3.0, 1.0)
    voters = quality_knn.Voters.fit(x[::2], labels[::2], weight[::2])
    got = voters.score(x)
    vectors = voters.project(voters.weigh(x, voters.rarity), voters.axes)
    for i, v in enumerate(vectors):
        if not texts[i]:
            assert got[i] == voters.empty_score
            continue
        similar = [float(v @ u) for u in voters.vectors]
        order = sorted(range(len(similar)), key=lambda j: (-similar[j], j))[:quality_knn.NEIGHBOURS]
        votes = [max(similar[j], 1e-6) ** quality_knn.SHARPNESS * voters.stands_for[j] for j in order]
        assert got[i] == pytest.approx(sum(w for w, j in zip(votes, order) if voters.labels[j]) / sum(votes), abs=2e-3)


def _items(n, words=18, seed=1):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcdefgh", k=draw.randint(3, 9))) for _ in range(4000)]
    return draw, pool, [" ".join(draw.choices(pool, k=words)) for _ in range(n)]


def test_a_template_of_thousands_of_items_costs_no_alignment():
    draw, pool, items = _items(3000)
    items = ["which of the following is true " + t for t in items]
    texts = ["which of the following is true " + " ".join(draw.choices(pool, k=18)) for _ in range(20)]
    texts[3] = items[77]
    texts[4] = "x y " + " ".join("zz" if k % 5 == 0 else w for k, w in enumerate(items[99].split()))
    block = decontaminate.Block(list(range(3000)), items)
    data = flat_bytes(pa.array(texts, pa.large_string()))
    began = time.perf_counter()
    found = {(r, i) for r, i, *_ in block.leaks(*data, decontaminate.THRESHOLD)}
    assert time.perf_counter() - began < 10 and found == {(3, 77), (4, 99)}
    few = decontaminate.Block([0, 1], [items[77], items[99]])
    assert {(r, [77, 99][i]) for r, i, *_ in few.leaks(*data, decontaminate.THRESHOLD)} == found


@pytest.mark.parametrize("words, share", [(8, 0.3), (16, 0.2), (16, 0.3), (40, 0.3)])
def test_recall_on_edited_items(words, share):
    """Copies with a share of their words replaced, held against an alignment of every item with its whole document."""
    draw, pool, items = _items(400, words, 9)
    edited = [" ".join(draw.choice(pool) if draw.random() < share else w for w in t.split()) for t in items]
    texts = [" ".join(draw.choices(pool, k=30)) + " " + t + " " + " ".join(draw.choices(pool, k=30)) for t in edited]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in items + texts for w in t.split()))}
    coded = lambda t: np.array([number[w] for w in t.split()])
    wanted = {k for k, (i, t) in enumerate(zip(items, texts)) if decontaminate.align(coded(i), coded(t))[0] / (2 * words) >= decontaminate.THRESHOLD}
    found = {r for r, i, *_ in decontaminate.Block(list(range(400)), items).leaks(*flat_bytes(pa.array(texts, pa.large_string())), decontaminate.THRESHOLD) if r == i}
    assert len(wanted) > 250 and found <= wanted
    assert len(found) >= (0.9 if words < 16 else 0.99) * len(wanted)  # measured: 0.944 of items of eight words, which may keep no three in a row


def test_item_ids_of_any_type(spark):
    items = spark.createDataFrame([("q-1", "alpha beta gamma delta epsilon"), (None, "one two three four five")], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "say alpha beta gamma delta epsilon now"), ("d2", "one two three four five"), ("d3", "nothing here")], "doc_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {("d1", "q-1"), ("d2", None)}


def test_the_sample_of_the_quality_vote_is_not_collected(spark, monkeypatch):
    """The driver gets the fitted voters (one row), not the features of their texts."""
    from tallywind.llm import quality_knn as qk

    docs = spark.createDataFrame([(i, f"text {i} " + "good words here. " * (i % 7)) for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    sizes, plain = [], type(docs).collect

    def collect(self):
        rows = plain(self)
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", collect)
    voters = qk.fit_voters(docs, labels)
    limit = 4 * (qk.WIDTH * (qk.DIMENSIONS + 1) + len(voters.labels) * (qk.DIMENSIONS + 3)) + 4096
    assert len(voters.labels) > 150 and sum(sizes) <= limit < 4 * qk.WIDTH * len(voters.labels)
    assert qk.fit_voters(docs, labels.filter("false")) is None
