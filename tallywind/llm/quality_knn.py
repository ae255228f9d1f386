"""Quality of documents by nearest-neighbour voting in a latent-semantic space.

Features of a whole text: hashed counts of byte trigrams, hashed counts of the shapes of four bytes in a row (lower, upper, digit, each
other character itself), and the shares of distinct words, distinct word triples and distinct lines. Counts are damped by a square root,
weighted by rarity and projected on the leading singular vectors of a labelled sample. The vectors of that sample (at most ``per_label``
rows of each label, chosen by a hash of their id: the documented bound of the fit and of the broadcast) are the voters: every document
gets exact cosine products with all of them, in blocks, and its ``k`` nearest vote with their similarity, each for as many
labelled rows as its label has per sampled one, so the bound does not change the labels' shares in the vote.

Labels are learned only from rows with ``crc32(doc_id as text) % 3 != 1``. Null or empty texts have a vector of zeros and get the share
of label 1 among such voters, or 0.5 without any. Null labels are not learned from; without labels every score is 0.5. Repeated rows get
equal scores; ties among neighbours go to the earlier voter, in the order of the hash. Extra columns of either table are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, SLICE_BYTES, flat_bytes, ngram_hashes, prefix_hash, slices, span_hash, word_hashes

PER_LABEL, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2000, 64, 15, 4
TRIGRAMS, SHAPES = 2048, 1024
N_COUNTS = TRIGRAMS + SHAPES
WIDTH = N_COUNTS + 3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _hashed_counts(symbols: np.ndarray, row: np.ndarray, starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Counts of n symbols in a row within a document, in ``size`` buckets."""
    rows = len(starts) - 1
    if len(symbols) < n:
        return np.zeros((rows, size), np.float32)
    code = np.zeros(len(symbols) - n + 1, np.uint32)
    for j in range(n):
        code = code * np.uint32(257) + symbols[j:len(symbols) - n + 1 + j]
    code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - int(np.log2(size)))
    whole = row[:len(code)] == row[n - 1:]
    return np.bincount(row[:len(code)][whole] * size + code[whole], minlength=rows * size).reshape(rows, size).astype(np.float32)


def _distinct_share(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    count = np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    return np.where(count > 0, np.bincount(r[new], minlength=len(count)) / np.maximum(count, 1), 1.0)


def _line_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.unique(np.concatenate([starts, np.flatnonzero(data == 10) + 1]))
    return span_hash(prefix_hash(data), edges[:-1], edges[1:]), np.searchsorted(edges[:-1], starts)


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row per document."""
    if len(starts) == 2 and len(data) > 2 * SLICE_BYTES:
        return _features_in_parts(data)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    hashes, _, _, before = word_hashes(data, starts)
    triples, _, triples_before = ngram_hashes(hashes, before, 3)
    return np.concatenate([
        _hashed_counts(LOWER[data], row, starts, 3, TRIGRAMS), _hashed_counts(_SHAPE[data], row, starts, 4, SHAPES),
        np.stack([_distinct_share(hashes, before), _distinct_share(triples, triples_before), _distinct_share(*_line_hashes(data, starts))], 1),
    ], axis=1, dtype=np.float32)


def _features_in_parts(data: np.ndarray, size: int = SLICE_BYTES) -> np.ndarray:
    """The same measures of one very long document. Symbols are counted part by part, each with what its last n-grams reach into; words
    and lines are hashed part by part, cut where none is cut, and their shares taken over all hashes."""
    counts = [np.zeros((1, TRIGRAMS)), np.zeros((1, SHAPES))]
    words, lines, at = [], [], 0
    space = np.flatnonzero(np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8)))
    breaks = np.flatnonzero(data == 10)
    while at < len(data):
        end = min(at + size, len(data))
        for k, (table, n, buckets) in enumerate(((LOWER, 3, TRIGRAMS), (_SHAPE, 4, SHAPES))):
            part = table[data[at:end + n - 1]]
            counts[k] += _hashed_counts(part, np.zeros(len(part), np.int64), np.array([0, len(part)]), n, buckets)
        at = end
    for cuts, hashed, out in ((space, lambda d: word_hashes(d, np.array([0, len(d)]))[0], words), (breaks, lambda d: _line_hashes(d, np.array([0, len(d)]))[0], lines)):
        at = 0
        while at < len(data):
            i = np.searchsorted(cuts, at + size)
            end = int(cuts[i]) + 1 if i < len(cuts) else len(data)
            out.append(hashed(data[at:end]))
            at = end
    words, lines = np.concatenate(words), np.concatenate(lines)
    triples, _, before = ngram_hashes(words, np.array([0, len(words)]), 3)
    shares = [_distinct_share(words, np.array([0, len(words)])), _distinct_share(triples, before), _distinct_share(lines, np.array([0, len(lines)]))]
    return np.concatenate([*counts, np.stack(shares, 1)], axis=1, dtype=np.float32)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row in the order of their places; of equal ones the earlier."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    above, level = near > least, near == least
    chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(len(near), k)


@dataclass(frozen=True)
class Voters:
    """The fitted space and the labelled vectors in it."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    empty_score: float

    @staticmethod
    def weigh(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), WIDTH), np.float32)
        for a, b, power in ((0, TRIGRAMS, 1.0), (TRIGRAMS, N_COUNTS, 1.0)):
            for i in range(0, len(x), 256):
                part = np.sqrt(x[i:i + 256, a:b]) * rarity[a:b]
                out[i:i + 256, a:b] = power * part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        out[:, N_COUNTS:] = (1 - x[:, N_COUNTS:]) * 0.7
        return out

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, stands_for: np.ndarray | None = None) -> "Voters | None":
        """``stands_for``: how many labelled rows each row of the sample is drawn from (one without it)."""
        if not len(x):
            return None
        stands_for = np.ones(len(x)) if stands_for is None else stands_for
        rarity = np.append(np.log((1 + len(x)) / (1 + (x[:, :N_COUNTS] > 0).sum(0))) + 0.3, [1, 1, 1]).astype(np.float32)
        weighed = cls.weigh(x, rarity)
        start = np.random.default_rng(7).standard_normal((WIDTH, DIMENSIONS + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            start, _ = np.linalg.qr(weighed.T @ (weighed @ start))
        _, _, turn = np.linalg.svd(weighed @ start, full_matrices=False)
        axes = (start @ turn.T)[:, :DIMENSIONS].astype(np.float32)
        empty = x[:, :N_COUNTS].sum(1) == 0
        return cls(rarity, axes, cls.project(weighed, axes), labels.astype(np.float32), stands_for,
                   float(np.average(labels[empty], weights=stands_for[empty])) if empty.any() else 0.5)

    @staticmethod
    def project(weighed: np.ndarray, axes: np.ndarray) -> np.ndarray:
        v = weighed @ axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), block):
            part = x[at:at + block]
            near = self.project(self.weigh(part, self.rarity), self.axes) @ self.vectors.T
            top = nearest(near, k)
            weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.stands_for[top]
            out[at:at + block] = (weight * self.labels[top]).sum(1) / weight.sum(1)
            out[at:at + block][part[:, :N_COUNTS].sum(1) == 0] = self.empty_score
        return np.clip(out, 0, 1)


def fit_voters(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Voters | None:
    """The voters from at most ``per_label`` labelled rows of each label."""
    usable = labels.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("turn"))
    pick = lambda v: usable.filter(F.col("label") == v).orderBy("turn", "doc_id").limit(per_label)
    often = {int(r.label): r["count"] for r in usable.filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()}  # two rows
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * per_label rows

    def measure(batches):
        for batch in slices(batches):
            x = features(*flat_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("label").cast(pa.int32()), pa.array([pa.compress(r.tobytes(), codec="zstd", asbytes=True) for r in x], pa.binary())],
                names=["turn", "label", "x"])

    def fit(batches):
        rows = pa.Table.from_batches(batches, pa.schema([("turn", pa.int64()), ("label", pa.int32()), ("x", pa.binary())]))
        turn, label = rows["turn"].to_numpy(), rows["label"].to_numpy()
        order = np.lexsort((label, turn))
        x = np.empty((len(order), WIDTH), np.float32)
        for to, value in zip(np.argsort(order), rows["x"]):
            x[to] = np.frombuffer(pa.decompress(value.as_buffer(), decompressed_size=4 * WIDTH, codec="zstd"), np.float32)
        found = Voters.fit(x, label[order], np.array([max(1.0, often[v] / per_label) for v in label[order].tolist()]))
        yield pa.RecordBatch.from_arrays([pa.array([] if found is None else [pickle.dumps(found)], pa.binary())], names=["voters"])

    measured = docs.select("doc_id", "text").join(chosen, "doc_id").select("turn", "label", "text").mapInArrow(measure, "turn long, label int, x binary")
    fitted = measured.repartition(1).mapInArrow(fit, "voters binary").collect()  # 2 * per_label rows in one task; the driver gets the 2 MB that are broadcast
    return pickle.loads(fitted[0].voters) if fitted else None


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = _scored(docs.select("doc_id", "text"), labels, per_label, "doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of ``docs`` that the vote does not reject."""
    scored = _scored(docs, labels, per_label, None, "_tallywind_score")
    return scored.filter(F.col("_tallywind_score") >= 0.5).drop("_tallywind_score")


def _scored(docs: DataFrame, labels: DataFrame, per_label: int, only: str | None, name: str) -> DataFrame:
    voters = docs.sparkSession.sparkContext.broadcast(fit_voters(docs, labels, per_label))

    def vote(batches):
        for batch in slices(batches):
            x = features(*flat_bytes(batch.column("text")))
            score = voters.value.score(x) if voters.value else np.full(batch.num_rows, 0.5)
            kept = batch.select([only]) if only else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score)], names=[*kept.schema.names, name])

    schema = docs.select(only).schema if only else docs.schema
    return docs.mapInArrow(vote, type(schema)(list(schema.fields)).add(name, "double"))
