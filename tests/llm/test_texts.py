"""Token shards, piece codec, language model and repeated substrings."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallywind.llm import lm_trie, piece_codec, suffix_dedup, token_output
from tallywind.llm.elias_fano import EliasFano, bit_place, open_arrays, write_arrays
from tallywind.llm.flat import distinct


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_token_shards(request, plain, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_output.token_digests(df).collect(), key=lambda r: r.start)
    ids = {}
    for d, t in plain(df):
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [token_output.NULL_KEY if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, many in ids.items() for x in many]
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered(want)


def test_key_index_and_absent_keys(spark, odd_docs):
    keys = np.unique(np.random.default_rng(1).integers(-1 << 62, 1 << 62, 3000))
    assert sorted(token_output.KeyIndex.build(keys).slots(keys)) == list(range(len(keys)))
    record = token_output.write_shards(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), shards=1).first()
    shard = token_output.Shard(record.path)
    first, copies = shard.find(np.array([7, 13, 999_999]))
    assert list(copies) == [2, 2, 0] and first[2] == -1
    assert list(shard.read(first[0])) == [0]


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_piece_codec(request, plain, which):
    import sentencepiece

    df = request.getfixturevalue(which)
    other = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    coded = piece_codec.encode(df)
    rows = coded.collect()
    assert ordered((r.doc_id, r.token_ids) for r in rows) == ordered((d, other.encode(t or "")) for d, t in plain(df))
    assert all(r.parity for r in rows)
    back = ordered((r.doc_id, r.text) for r in piece_codec.decode(coded).collect())
    assert back == ordered((d, (t or "").replace("▁", " ")) for d, t in plain(df))
    assert sum(not r.round_trip for r in rows) == sum("▁" in (t or "") for _, t in plain(df))


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("▁", -4.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("a", -2.5, 1), ("▁ab", -1.5, 1)]
    model = piece_codec.PieceModel(pieces, piece_codec.UNIGRAM, False, 0, b"", True, True)
    tokenizer = piece_codec.build_tokenizer(model)
    assert tokenizer.encode("ab  a", add_special_tokens=False).tokens == ["▁ab", "▁a"]
    assert tokenizer.decode([5, 2]) == "ab a"


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 7), (3000, 3000), (20_000, 10 ** 12), (3, 10 ** 15)])
def test_elias_fano(tmp_path, n, universe):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, universe, n))
    head, arrays = EliasFano.encode(values, universe)
    write_arrays(str(tmp_path / "x"), {"s": head}, {f"s.{k}": a for k, a in arrays.items()})
    sequence = EliasFano.opened(*open_arrays(str(tmp_path / "x")), "s")
    asked = np.unique(np.concatenate([values, draw.integers(0, universe, 500)]))
    assert (sequence.values() == values).all() and (sequence.access(np.arange(n)) == values).all()
    assert (sequence.rank(asked) == np.searchsorted(values, asked)).all()


@pytest.mark.parametrize("pairs, words", [(1 << 21, 1 << 21), (400, 300)])
@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_language_model(request, plain, monkeypatch, which, pairs, words):
    monkeypatch.setattr(lm_trie, "SHARD_PAIRS", pairs)
    monkeypatch.setattr(lm_trie, "SHARD_WORDS", words)
    df = request.getfixturevalue(which)
    rows = lm_trie.lm_scores(df).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    texts = [(d, [*brute.words(t), None]) for d, t in plain(df)]
    train = [t for d, t in texts if not held(d)]
    count = Counter(w for t in train for w in t)
    both = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(count.values()), len(count)
    often = Counter(both.values())
    drop = lm_trie.discounts(*(often[i] for i in (1, 2, 3, 4)))
    given = Counter()
    for (a, _), c in both.items():
        given[a] += drop[min(c, 3) - 1]
    base = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    pair = lambda a, w: ((both[a, w] - drop[min(both[a, w], 3) - 1] if both[a, w] else 0) + given[a] * base(w)) / count[a] if count[a] else base(w)
    want = ordered((d, held(d), len(t), sum(count[w] > 0 for w in t), n) for d, t in texts)
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    got = sorted((r.base_score, r.score) for r in rows)
    for (b, s), (x, y, m) in zip(got, sorted((sum(math.log10(base(w)) for w in t), sum(math.log10(pair(a, w)) for a, w in zip([None, *t], t)), len(t)) for _, t in texts)):
        assert b == pytest.approx(x, abs=1e-6, rel=1e-9) and abs(s - y) <= 1.3e-4 * m
    if which == "docs" and n:
        for context in (None, train[0][0]):
            assert sum(pair(context, w) for w in count) + given[context] / count[context] * base("never") == pytest.approx(1)


@pytest.mark.parametrize("pairs, words", [(1 << 21, 1 << 21), (400, 300), (7, 3)])
@pytest.mark.parametrize("which", ["few", "odd_docs", "no_docs"])
def test_language_model_of_triples(request, spark, plain, monkeypatch, which, pairs, words):
    monkeypatch.setattr(lm_trie, "SHARD_PAIRS", pairs)
    monkeypatch.setattr(lm_trie, "SHARD_WORDS", words)
    if pairs < 100 and which != "few":
        pytest.skip("many shards only on the small table")
    draw = random.Random(11)
    text = lambda n: " ".join(draw.choices("abcdefgh", [9, 5, 4, 2, 1, 1, 1, 1], k=n))
    few = [(i, text(i % 9)) for i in range(30)] + [(i, None) for i in (100, 101)] + [(200, "new words a b"), (201, "a new b")]
    df = spark.createDataFrame(few, "doc_id long, text string") if which == "few" else request.getfixturevalue(which)
    rows = lm_trie.lm_scores(df, order=3).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    texts = [(d, [*brute.words(t), None]) for d, t in plain(df)]
    train = [t for d, t in texts if not held(d)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    seen = {k: Counter(tuple(x[i:i + k]) for t in train for x in [[None, *t]] for i in range(len(x) - k + 1)) for k in (2, 3)}
    drops, given, total = {}, Counter(), Counter()
    for k in seen:
        often = Counter(seen[k].values())
        drops[k] = lm_trie.discounts(*(often[i] for i in (1, 2, 3, 4)))
        for g, c in seen[k].items():
            given[g[:-1]] += drops[k][min(c, 3) - 1]
            total[g[:-1]] += c

    def chance(context, w):
        if not context:
            return (count[w] + 0.5) / (n + 0.5 * (v + 1))
        lower, c = chance(context[1:], w), seen[len(context) + 1][*context, w]
        return ((c - drops[len(context) + 1][min(c, 3) - 1] if c else 0) + given[context] * lower) / total[context] if total[context] else lower

    want = sorted((sum(math.log10(chance((), w)) for w in t), sum(math.log10(chance(tuple([None, *t][max(0, i - 1):i + 1]), w)) for i, w in enumerate(t)), len(t)) for _, t in texts)
    assert len(rows) == len(want)
    for (b, s), (x, y, m) in zip(sorted((r.base_score, r.score) for r in rows), want):
        assert b == pytest.approx(x, abs=1e-6, rel=1e-9) and abs(s - y) <= 4e-4 * m
    if which == "few":
        for context in ((None, train[3][0]), tuple(train[3][:2])):
            assert sum(chance(context, w) for w in count) + chance(context, "never") == pytest.approx(1)


def test_query_scores_longer_passages(spark, tmp_path):
    """Of texts with the same pairs, one that shares its triples with the training texts scores higher."""
    from tallywind.llm.queries import QUERIES

    train = [f"{a} m {a}x" for a in "pqrs" for _ in range(20)]
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:len(train)]
    kept = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs = [*zip(free, train), (kept[0], "p m px"), (kept[1], "p m qx")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = {r.doc_id: r.score for r in QUERIES["op3_lm_trie"](spark, str(tmp_path)).collect()}
    assert score[kept[0]] > score[kept[1]] + 1


@pytest.mark.parametrize("group, local", [(256, 64), (2, 2)])
@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_repeated_substrings(request, plain, monkeypatch, which, group, local):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "LOCAL_GROUP", local)
    df = request.getfixturevalue(which)
    rows = {}
    for r in suffix_dedup.removed_substrings(df).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r))
    want = {}
    for r in brute.removed(plain(df)):
        want.setdefault(r[0], []).append(r)
    assert rows.keys() == want.keys()
    for d, mine in rows.items():
        if len(mine) == 1:
            assert mine == want[d], d
        else:  # rows of one id: their order is not that of the plain version
            assert sorted(x[1] for x in mine) == sorted(x[1] for x in want[d])


def test_deep_shallow_orders_like_sorted():
    draw = random.Random(3)
    strings = [bytes(draw.choices(b"ab", k=40)) for _ in range(300)] + [b"a" * 40] * 5 + [b"a" * k + b"b" * (40 - k) for k in range(40)]
    group = np.sort(np.array([draw.randint(0, 3) for _ in strings]))
    order, common = suffix_dedup.deep_shallow(group, np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 40))
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], strings[i]) for i in range(len(strings)))
    for a, b, n in zip(order, order[1:], common[1:]):
        if group[a] == group[b]:
            shared = next((k for k in range(40) if strings[a][k] != strings[b][k]), 40)
            assert n == shared


def test_bit_place():
    words = np.concatenate([np.random.default_rng(0).integers(0, 2**64, 200, dtype=np.uint64), np.array([2**64 - 1, 1, 1 << 63, 255, 1 << 56], np.uint64)])
    for word in words:
        places = np.flatnonzero(np.unpackbits(np.array([word], "<u8").view(np.uint8), bitorder="little"))
        assert (bit_place(np.full(len(places), word), np.arange(len(places))) == places).all()


@pytest.mark.parametrize("keys", [
    [], [5], [5, 5, 3, -2], [-2**63, 2**63 - 1, 0, 0], [3, 1, 2] * 200, np.random.default_rng(1).integers(-2**63, 2**63 - 1, 3000),
    np.random.default_rng(2).integers(-2**40, 2**40, 3000) // 2**20 * 2**20 + np.arange(3000) % 3,
    np.concatenate([np.arange(500, 0, -1), [-2**63, 2**63 - 1]])])  # the last ones differ in bits that the sort leaves out
def test_distinct(keys):
    keys = np.array(keys, np.int64)
    for got, wanted in zip(distinct(keys), np.unique(keys, return_index=True, return_inverse=True)):
        assert got.tolist() == wanted.tolist()
