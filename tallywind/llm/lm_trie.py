"""Language-model scores from an Elias-Fano trie of the corpus' words, word pairs and triples, mapped from the shared folder.

Level 1 has the distinct words (sorted 64-bit hashes; a word's number is its rank) with their counts. Level 2 has the pairs: the key
of a pair is context * V + word, a monotone sequence over all contexts, and its number is its rank. Level 3 has the triples in the same
way, with the number of a pair as the context (``order`` levels are built: 2, or 3 with triples). A level is cut into shards of about
``SHARD_PAIRS`` tokens at places that the counts of the level before give, so a context of any frequency is spread over as many shards
as it needs. A shard keeps its part in Elias-Fano form, with monotone pointers to where each context's successors begin, and per pair or
triple the smoothed log10 probability, per context its interpolation weight, in 16 bits each (steps of 1/4096, an error of at most
0.00013 in each of the up to three steps). A gram is found by a successor search relative to its context, from the context's pointer on.

Smoothing: absolute discounts by count (1, 2, 3 and more), estimated from the counts of counts over all grams of a level, interpolated
with the probability after the context shorter by one, and at last with the word frequencies (c + 0.5) / (N + 0.5 (V + 1)), which leave
0.5 for a word never seen; the probabilities of a context add up to one. The end of a text is a word, and the context of the first,
which has no longer one. After a pair never seen the shorter context counts alone.

Counts come from every training text, whole; no pair or triple is left out. Building is three distributed passes for words and pairs and
two more for triples (counts, sent to their shard as compressed sorted runs; probabilities), scoring is one without a shuffle: its tasks
map the files and touch the pages they need, so memory stays bounded. Keys have 63 bits: the number of pairs times V has to fit.

Null and empty texts are one end. Repeated rows count and are scored each. Without training rows every word is unknown, with N = V = 0.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.session import scratch_path, stage

from . import files
from .elias_fano import EliasFano, open_arrays, write_arrays
from .flat import distinct, flat_bytes, slices, word_hashes
from .quality_knn import fold

END = np.int64(0x1E6E0F7A5B3C2D11)
SHARD_WORDS, SHARD_PAIRS, HELD_PAIRS, OPEN_FILES = 1 << 21, 1 << 21, 1 << 21, 256
ORDER = 3
STEP = 4096


def token_stream(batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and how many tokens stand before each text."""
    hashes, _, _, before = word_hashes(*flat_bytes(batch.column("text")))
    ends = before[1:] + np.arange(len(before) - 1)
    out = np.empty(len(hashes) + len(ends), np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = hashes.view(np.int64), END
    return out, np.concatenate([[0], ends + 1])


def grams(batch) -> tuple[np.ndarray, ...]:
    """Before each text so many tokens; the distinct words; each token's place among them; the distinct pairs (place of the context *
    number of words + place of the word); each token's place among those. All sorted."""
    stream, before = token_stream(batch)
    unique, _, where = distinct(stream)
    ahead = np.empty_like(where)
    ahead[1:] = where[:-1]
    ahead[before[:-1]] = np.searchsorted(unique, END)
    pair, _, pair_where = distinct(ahead * len(unique) + where)
    return before, unique, where, pair, pair_where


def with_two_before(before: np.ndarray) -> np.ndarray:
    """Tokens that follow a pair: all but the first of each text."""
    inner = np.ones(before[-1], bool)
    inner[before[:-1]] = False
    return np.flatnonzero(inner)


def pack_log(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 0, 65535).astype("<u2")


@dataclass(frozen=True)
class Trie:
    """Where the files are and the totals. Shards are listed in order: level 1 by the first hash, the others by the first key."""

    words: list[tuple[int, int, str]]  # first hash, number of its first word, file
    levels: list[list[tuple[int, int, str]]]  # of pairs and of triples: first key, number of the first gram, file
    tokens: int
    distinct: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


class Reader:
    """Vectorised look-ups; keeps at most ``OPEN_FILES`` mapped."""

    def __init__(self, trie: Trie):
        self.trie, self.open = trie, OrderedDict()
        self.first_hash = np.array([w[0] for w in trie.words], np.int64)
        self.first_key = [np.array([x[0] for x in level], np.int64) for level in trie.levels]
        self.first_gram = [np.array([x[1] for x in level], np.int64) for level in trie.levels]

    def _mapped(self, path: str):
        if path not in self.open:
            head, views = open_arrays(path)
            self.open[path] = head, views, {k: EliasFano.opened(head, views, k) for k in ("pair", "pointer") if k in head}
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)
        self.open.move_to_end(path)
        return self.open[path]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each word; ``hashes`` sorted."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, self.first_hash)
        for (_, base, path), a, b in zip(self.trie.words, cuts, [*cuts[1:], len(hashes)]):
            if a < b:
                _, views, _ = self._mapped(path)
                i = np.minimum(np.searchsorted(views["hash"], hashes[a:b]), len(views["hash"]) - 1)
                known = views["hash"][i] == hashes[a:b]
                number[a:b][known], count[a:b][known] = base + i[known], views["count"][i[known]]
        return number, count

    def follow(self, depth: int, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if never seen) and log10 probability of each (context, word), sorted by both; contexts known, words perhaps not
        (-1). ``lower`` is the log10 probability after the context shorter by one."""
        v, number, out = self.trie.distinct, np.full(len(context), -1, np.int64), lower.copy()
        key = np.maximum.accumulate(context * v + np.maximum(word, 0))  # an unknown word stays where its context is
        cuts = np.searchsorted(key, self.first_key[depth])
        for (_, base, path), a, b in zip(self.trie.levels[depth], cuts, [*cuts[1:], len(key)]):
            if a == b:
                continue
            head, views, sequences = self._mapped(path)
            level, pointers = sequences["pair"], sequences["pointer"]
            at = context[a:b] - head["context"]
            i = level.rank(key[a:b] - head["first"])
            runs = np.flatnonzero(np.diff(at, prepend=-1))  # a context's words stand together
            ends = np.repeat(pointers.access(at[runs] + 1), np.diff(runs, append=b - a))
            inside = (i < ends) & (word[a:b] >= 0)  # relative to the context's successors
            inside[inside] = level.access(i[inside]) == (key[a:b] - head["first"])[inside]
            weight = -views["weight"][at].astype(np.float64) / STEP
            found = np.zeros(b - a)
            found[inside] = -views["code"][i[inside]].astype(np.float64) / STEP
            out[a:b] = np.where(inside, found, weight + out[a:b])
            number[a:b][inside] = base + i[inside]
        return number, out

    def last_words(self, pairs: np.ndarray) -> np.ndarray:
        """The second word of pairs given by their sorted numbers."""
        out = np.empty(len(pairs), np.int64)
        cuts = np.searchsorted(pairs, self.first_gram[0])
        for (_, base, path), a, b in zip(self.trie.levels[0], cuts, [*cuts[1:], len(pairs)]):
            if a < b:
                head, _, sequences = self._mapped(path)
                out[a:b] = (sequences["pair"].access(pairs[a:b] - base) + head["first"]) % self.trie.distinct
        return out

    def score(self, batch) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        before, unique, where, pair, pair_where = grams(batch)
        number, count = self.words(unique)
        logs = np.log10(self.trie.base(count))
        text = np.repeat(np.arange(len(before) - 1), np.diff(before))
        context, word = pair // len(unique), pair % len(unique)
        score, pair_number = logs[word], np.full(len(pair), -1, np.int64)
        known = number[context] >= 0
        if self.trie.levels:
            pair_number[known], score[known] = self.follow(0, number[context[known]], number[word[known]], score[known])
        each = score[pair_where]
        if len(self.trie.levels) > 1:
            at = with_two_before(before)
            at = at[pair_number[pair_where[at - 1]] >= 0]
            triple, first, triple_where = distinct(pair_where[at - 1] * len(unique) + where[at])
            each[at] = self.follow(1, pair_number[triple // len(unique)], number[triple % len(unique)], each[at[first]])[1][triple_where]
        rows = len(before) - 1
        return (np.diff(before), np.bincount(text, count[where] > 0, rows).astype(np.int64), np.bincount(text, logs[where], rows), np.bincount(text, each, rows))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _word_level(texts: DataFrame, folder: str) -> Trie:
    def count(batches):
        for batch in slices(batches):
            unique, n = np.unique(token_stream(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n)], names=["hash", "n"])

    counts = stage(texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if not totals.v:
        return Trie([], [], 0, 0)
    bits = max(0, (totals.v // SHARD_WORDS).bit_length())

    def write(batches):
        shard, hashes, n = None, [], []

        def close():
            h, c = np.concatenate(hashes), np.concatenate(n)
            path = files.fresh_name(folder, f"words-{shard:06d}", "lm")
            write_arrays(path, {}, {"hash": h, "count": c})
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, int(h[0]), len(h), path)], names=["shard", "first", "words", "path"])

        for batch in batches:
            s = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if shard is not None and s[a] != shard:
                        yield close()
                        hashes, n = [], []
                    shard = int(s[a])
                    hashes.append(batch.column("hash").to_numpy()[a:b])
                    n.append(batch.column("n").to_numpy()[a:b])
        if hashes:
            yield close()

    shard = F.shiftright("hash", 64 - bits)if bits else F.lit(0).cast("long")
    written = stage(counts.withColumn("shard", shard).repartition(_partitions(counts), "shard").sortWithinPartitions("shard", "hash")
                    .mapInArrow(write, "shard long, first long, words long, path string"), "word-shards")
    words, base = [], 0
    for r in sorted(written.collect(), key=lambda r: r.shard):  # a row per shard of some two million words
        words.append((r.first, base, r.path))
        base += r.words
    return Trie(words, [], int(totals.n), int(totals.v))


def _cuts(seen: int, count: np.ndarray, base: int, v: int) -> list[int]:
    """First keys of the next level's shards within these contexts, the first of them number ``base`` and after ``seen`` tokens: equal
    shares of the tokens, a context's tokens spread evenly over its possible successors."""
    total, step = seen + np.cumsum(count.astype(np.int64)), SHARD_PAIRS
    marks = np.arange((seen // step + 1) * step, int(total[-1]) + 1, step)
    i = np.searchsorted(total, marks)
    share = (marks - (total[i] - count[i])) / count[i]
    return [int(x) for x in (base + i) * v + np.minimum((share * v).astype(np.int64), v - 1)]


def _bounds(trie: Trie) -> np.ndarray:
    """First keys of the level-2 shards."""
    reader, out, seen = Reader(trie), [0], 0
    for _, base, path in trie.words:
        _, views, _ = reader._mapped(path)
        out += _cuts(seen, views["count"], base, trie.distinct)
        seen += int(views["count"].sum())
    return np.unique(np.array(out, np.int64))


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences in planes of equal byte weight, compressed."""
    planes = np.concatenate([np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_run(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=12 * n, codec="zstd", asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view("<u8").ravel().astype(np.int64))
    return keys, np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _gram_counts(texts: DataFrame, trie: Trie, bounds: np.ndarray, folder: str) -> DataFrame:
    """Write the merged pairs (or triples, if ``trie`` has the pairs) of each shard; ``shard, path, size, tokens, n1..n4, begins, began,
    ends, ended`` (the border contexts: how many grams of each discount class and how many tokens they have here)."""
    v, depth = trie.distinct, len(trie.levels)

    def emit(keys, counts):
        keys, counts = summed(np.concatenate(keys), np.concatenate(counts))
        cuts = np.append(np.searchsorted(keys, bounds), len(keys))
        rows = [(s, b - a, pack_run(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "n", "run"])

    def count(batches):
        reader, keys, counts, held = Reader(trie), [], [], 0
        for batch in slices(batches):
            before, unique, where, pair, pair_where = grams(batch)
            number = reader.words(unique)[0]
            context, word = number[pair // len(unique)], number[pair % len(unique)]
            if depth:
                pairs, at = reader.follow(0, context, word, np.zeros(len(pair)))[0], with_two_before(before)
                k, n = np.unique(pairs[pair_where[at - 1]] * v + number[where[at]], return_counts=True)
            else:
                k, n = context * v + word, np.bincount(pair_where, minlength=len(pair))
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > HELD_PAIRS:
                yield emit(keys, counts)
                keys, counts, held = [], [], 0
        if keys:
            yield emit(keys, counts)

    def classes(n):
        return [int((n == 1).sum()), int((n == 2).sum()), int((n > 2).sum()), int(n.sum())]

    def write(batches):
        shard, keys, counts = None, [], []

        def close():
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            path = files.fresh_name(folder, f"grams{depth + 2}-{shard:06d}", "run")
            files.write_bytes(path, pack_run(k, n))
            low, high = int(k[0]) // v, int(k[-1]) // v
            a, b = np.searchsorted(k, [(low + 1) * v, high * v])
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (shard, path, len(k), int(n.sum()), *(int((n == i).sum()) for i in (1, 2, 3, 4)), low, classes(n[:a]), high, classes(n[b:]))],
                names=["shard", "path", "size", "tokens", "n1", "n2", "n3", "n4", "begins", "began", "ends", "ended"])

        for batch in batches:
            for s, n, run in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("run")):
                if shard is not None and s != shard:
                    yield close()
                    keys, counts = [], []
                shard = s
                k, c = unpack_run(n, run.as_py())
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys[1:])) > SHARD_PAIRS:
                    keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
        if keys:
            yield close()

    runs = texts.mapInArrow(count, "shard long, n long, run binary").repartition(_partitions(texts), "shard").sortWithinPartitions("shard")
    return stage(runs.mapInArrow(write, "shard long, path string, size long, tokens long, n1 long, n2 long, n3 long, n4 long, begins long, began array<long>, ends long, ended array<long>"), "gram-shards")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What grams seen once, twice and more often give away (Chen and Goodman), held between 0 and the count."""
    y = n1 / max(n1 + 2 * n2, 1)
    raw = [1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
    return np.clip(raw, 0.05, [0.99, 1.98, 2.97])


def _gram_level(merged: DataFrame, trie: Trie, bounds: np.ndarray, contexts: int, folder: str) -> tuple[Trie, int, np.ndarray]:
    """The trie with one more level, the number of its grams, and the first keys of the shards of the level after it."""
    rows = sorted(merged.collect(), key=lambda r: r.shard)  # a row per shard of some two million tokens
    drop = discounts(*(sum(r[f"n{i}"] for r in rows) for i in (1, 2, 3, 4)))
    border: dict[int, np.ndarray] = {}  # classes and tokens of the contexts that several shards share
    for r in rows:
        border[r.begins] = border.get(r.begins, 0) + np.array(r.began)
        if r.ends != r.begins:
            border[r.ends] = border.get(r.ends, 0) + np.array(r.ended)
    v, depth = trie.distinct, len(trie.levels)
    opens = [0, *(int(bounds[r.shard]) for r in rows[1:])]  # a shard answers for all grams, seen or not, up to where the next begins
    bases = [0, *(int(x) for x in np.cumsum([r["size"] for r in rows]))]
    seen = [0, *(int(x) for x in np.cumsum([r.tokens for r in rows]))]
    span = {r.shard: (a, b, r["size"], base, before) for r, a, b, base, before in zip(rows, opens, [*opens[1:], contexts * v], bases, seen)}

    def write(batches):
        reader = Reader(trie)
        starts = [w[1] for w in trie.words]

        def count_of(numbers):
            out = np.zeros(len(numbers), np.int64)
            where = np.searchsorted(starts, numbers, "right") - 1
            for s in np.unique(where):
                _, views, _ = reader._mapped(trie.words[s][2])
                out[where == s] = views["count"][numbers[where == s] - starts[s]]
            return out

        def lower(context, word):
            """Probability of each word after the context shorter by one."""
            if not depth:
                return trie.base(count_of(word))
            pairs, where = np.unique(context, return_inverse=True)
            ahead = reader.last_words(pairs)[where]
            order = np.lexsort((word, ahead))
            out = np.empty(len(word))
            out[order] = 10 ** reader.follow(0, ahead[order], word[order], np.zeros(len(word)))[1]
            return out

        for batch in batches:
            for s, source in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                first, after, size, base, before = span[s]
                key, n = unpack_run(size, files.read_bytes(source))
                context, word = key // v, key % v
                low, high = first // v, (after - 1) // v
                kind = np.minimum(n, 3) - 1
                given, total = np.bincount(context - low, drop[kind], high - low + 1), np.bincount(context - low, n, high - low + 1)
                for c in {low, high} & border.keys():
                    given[c - low], total[c - low] = float(border[c][:3] @ drop), border[c][3]
                weight = given / np.maximum(total, 1)  # a pair with the end of a text has no successors and is never a context
                p = (n - drop[kind]) / total[context - low] + weight[context - low] * lower(context, word)
                pair_head, pair = EliasFano.encode(key - first, after - first)
                pointer_head, pointer = EliasFano.encode(np.searchsorted(context, np.arange(low, high + 2)), len(key) + 1)
                path = files.fresh_name(folder, f"grams{depth + 2}-{s:06d}", "lm")
                write_arrays(path, {"first": first, "context": low, "pair": pair_head, "pointer": pointer_head},
                             {**{f"pair.{k}": a for k, a in pair.items()}, **{f"pointer.{k}": a for k, a in pointer.items()}, "code": pack_log(p), "weight": pack_log(weight)})
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([first]), pa.array([base]), pa.array([path]), pa.array([_cuts(before, n, base, v)], pa.list_(pa.int64()))],
                                                 names=["shard", "first", "base", "path", "cuts"])

    done = stage(merged.select("shard", "path").repartition(max(1, len(rows)), "shard").mapInArrow(write, "shard long, first long, base long, path string, cuts array<long>"), "gram-level")
    shards = sorted(done.collect(), key=lambda r: r.shard)
    level = [(r.first, r.base, r.path) for r in shards]
    return Trie(trie.words, [*trie.levels, level], trie.tokens, trie.distinct), bases[-1], np.unique(np.array([0, *(c for r in shards for c in r.cuts)], np.int64))


def build_trie(texts: DataFrame, folder: str | None = None, order: int = 2) -> Trie:
    """The trie of all ``text`` rows, in files below ``folder`` (by default in the shared folder)."""
    if order not in (2, 3):
        raise ValueError("a trie has two or three levels")
    texts = texts.select("text")
    folder = folder or scratch_path(texts.sparkSession, "lm")
    trie = _word_level(texts, folder)
    if not trie.distinct:
        return trie
    contexts, bounds = trie.distinct, _bounds(trie)
    for _ in range(order - 1):
        if contexts * trie.distinct >= 1 << 63:
            raise OverflowError(f"{contexts} contexts of {trie.distinct} words do not fit keys of 63 bits")
        trie, contexts, bounds = _gram_level(_gram_counts(texts, trie, bounds, folder), trie, bounds, contexts, folder)
    return trie


def lm_scores(docs: DataFrame, held_out: Column | None = None, order: int = 2) -> DataFrame:
    """Learn grams of up to ``order`` words from the rows that are not held out and score all: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    held_out = fold(F.col("doc_id"), 5) == 1 if held_out is None else held_out
    trie = build_trie(docs.filter(~held_out), order=order)

    def run(batches):
        reader = Reader(trie)
        for batch in slices(batches):
            n, known, base, score = reader.score(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), trie.tokens)), pa.array(base), pa.array(score)],
                                             names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
