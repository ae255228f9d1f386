"""Toxic passages by maximum-scoring segments of token log-odds.

A word scores the log-odds of toxic against clean text of the best attested of its units (the word and its first 6, 5 and 4 bytes),
counted once per pair of neighbouring words (so copies and repeated lines count once) and shrunk by a Dirichlet prior in proportion to the unit's overall frequency; units that are not clearly toxic leave the word at a small
penalty. A linear scan (Ruzzo and Tompa) finds every maximal segment of positive sum. Under the clean word distribution the number of
segments above S in n words is at most K n exp(-lambda S), lambda the positive root of sum p exp(lambda s) = 1 and K = 1 - (share of
penalised words) exp(-lambda penalty); the segments of a document are put together by the extreme-value sum statistic, and a
logistic curve turns the document's surprise into the probability of the label.

The model is fitted on at most ``per_label`` labelled rows of each label, chosen by a hash of their id (the documented bound); labels
are learned only from rows with ``crc32(doc_id as text) % 4 != 2``. Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased. Null or empty texts have no segment and get the score of zero surprise; without labels of both kinds every score is the
share of toxic labels, or 0. Repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import stage

from .flat import LOWER, PUNCTUATION, flat_bytes, mix, prefix_hash, slices, span_hash, words
from .quality_knn import fold

PER_LABEL = 3000
STEMS = (6, 5, 4)
PRIOR_SHARE, CERTAIN, LEAST_ODDS, PENALTY, THRESHOLD = 0.02, 4.5, 2.0, 0.15, 0.3
SEGMENT = "array<struct<start:bigint,end:bigint,score:double,expected:double>>"


def word_units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's units (one column each: the word, then shorter stems), starts and ends, and words before each row."""
    begin, end, before = words(data, starts, PUNCTUATION)
    prefix = prefix_hash(LOWER[data])
    return np.stack([span_hash(prefix, begin, end), *(span_hash(prefix, begin, np.minimum(end, begin + n)) for n in STEMS)], 1), begin, end, before


def maximal_segments(at: np.ndarray, gain: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) of a sequence that has ``gain`` at positions ``at`` and ``-penalty``
    elsewhere; linear time in the number of gains."""
    found: list[list] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist()):
        total -= penalty * (p - last - 1)
        new, last = [p, p, total, total + g], p
        total += g
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass(frozen=True)
class ToxicModel:
    """Sorted toxic units with their log-odds and certainty, the extreme-value parameters and the logistic curve."""

    units: np.ndarray
    odds: np.ndarray
    certainty: np.ndarray
    decay: float
    rate: float
    slope: float
    level: float

    def gains(self, units: np.ndarray) -> np.ndarray:
        """Log-odds of each word by its most certain unit, 0 if it has none."""
        best, sure = np.zeros(len(units)), np.zeros(len(units))
        if not len(self.units):
            return best
        for column in units.T:
            i = np.minimum(np.searchsorted(self.units, column), len(self.units) - 1)
            better = (self.units[i] == column) & (self.certainty[i] > sure)
            best[better], sure[better] = self.odds[i][better], self.certainty[i][better]
        return best

    def surprise(self, scores: list[float], n: int) -> float:
        """-log of the smallest sum-statistic probability over the r best segments."""
        best = total = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.decay * s - log(max(self.rate * n, 1e-300))
            if total > 0:
                best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
        return best

    def measure(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Surprise of each document and its segments as byte ranges with score and expected number in clean text of that length."""
        units, begin, end, before = word_units(data, starts)
        gain = self.gains(units)
        hot = np.flatnonzero(gain)
        edges = np.searchsorted(hot, before)
        out, passages = np.zeros(len(starts) - 1), [[] for _ in range(len(starts) - 1)]
        for d in np.flatnonzero(np.diff(edges)):
            mine, n = hot[edges[d]:edges[d + 1]], int(before[d + 1] - before[d])
            found = maximal_segments(mine, gain[mine], PENALTY)
            out[d] = self.surprise([s for *_, s in found], n)
            passages[d] = [{"start": int(begin[a] - starts[d]), "end": int(end[b] - starts[d]), "score": s,
                            "expected": self.rate * n * exp(-self.decay * s)} for a, b, s in found]
        return out, passages

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * surprise + self.level, -50, 50)))


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shrunk log-odds of units, their certainty (root of the likelihood ratio against equal shares) and the smoothed clean rate."""
    both, prior_size = toxic + clean, PRIOR_SHARE * (n1 + n0)
    a, b = toxic + PRIOR_SHARE * both, clean + PRIOR_SHARE * both
    odds = np.log(a / (n1 + prior_size - a)) - np.log(b / (n0 + prior_size - b))
    share = both / (n1 + n0)
    ratio = toxic * np.log(np.maximum(toxic, 1e-9) / (n1 * share)) + clean * np.log(np.maximum(clean, 1e-9) / (n0 * share))
    return odds, np.sign(odds) * np.sqrt(2 * np.maximum(ratio, 0)), b / (n0 + prior_size)


def toxic_units(table: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, ...]:
    """Clearly toxic units with log-odds, certainty and clean rate. ``table`` has the units of each distinct word, longest first;
    the words that a longer unit explains do not count for a shorter one."""
    n1, n0, left, kept = max(toxic.sum(), 1), max(clean.sum(), 1), np.ones(len(table), bool), []
    for column in table.T:
        unit, where = np.unique(column[left], return_inverse=True)
        y1, y0 = np.bincount(where, toxic[left], len(unit)), np.bincount(where, clean[left], len(unit))
        odds, sure, rate = _log_odds(y1, y0, n1, n0)
        good = (sure >= CERTAIN) & (odds >= LEAST_ODDS)
        kept.append((unit[good], odds[good], sure[good], rate[good]))
        left &= ~np.isin(column, unit[good])
    unit, odds, sure, rate = (np.concatenate(x) for x in zip(*kept))
    unit, first = np.unique(unit, return_index=True)
    return unit, odds[first], sure[first], rate[first]


def _decay(odds: np.ndarray, rate: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    rest = max(1 - rate.sum(), 0.0)
    low, high = 1e-6, 20.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if (rate * np.exp(np.minimum(x * odds, 500))).sum() + rest * exp(-x * PENALTY) < 1 else (low, x)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable, lightly held to zero."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    hold = np.diag([1e-3, 1e-3]) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + hold, design.T @ (weight * (y - p)) - hold @ beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def fit_toxic(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicModel:
    usable = labels.filter((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"), F.xxhash64("doc_id").alias("turn"))
    shares = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = lambda v: usable.filter(F.col("label") == v).orderBy("turn", "doc_id").limit(per_label)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id").select("label", "text"), "toxic-sample")

    def count(batches):
        for batch in slices(batches):
            units, _, _, before = word_units(*flat_bytes(batch.column("text")))
            label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), np.diff(before))
            word = np.concatenate([[0], units[:, 0], [0]]).astype(np.uint64)
            around = mix(mix(word[:-2] + np.uint64(1)) + mix(word[2:]) * np.uint64(3) + word[1:-1])
            _, once = np.unique(around + label.astype(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in units[once].T), pa.array(around[once].view(np.int64)), pa.array(label[once].astype(np.int32))],
                                             names=[*keys, "around", "toxic"])

    keys = ["u0", "u1", "u2", "u3"]
    counts = (sample.mapInArrow(count, "u0 long, u1 long, u2 long, u3 long, around long, toxic int")
              .groupBy(*keys, "around").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
              .groupBy(*keys).agg(F.sum("t").alias("toxic"), F.sum("c").alias("clean")).toArrow())
    table = np.stack([counts[k].to_numpy().view(np.uint64) for k in keys], 1)
    units, odds, sure, rate = toxic_units(table, counts["toxic"].to_numpy().astype(float), counts["clean"].to_numpy().astype(float))
    decay = _decay(odds, rate)
    model = ToxicModel(units, odds, sure, decay, 1 - (1 - rate.sum()) * exp(-decay * PENALTY), 0.0, -50.0)

    def measure(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.measure(*flat_bytes(batch.column("text")))[0])], names=["label", "x"])

    rows = sample.select("label", "text").mapInArrow(measure, "label int, x double").toArrow()
    y, x = rows["label"].to_numpy(), rows["x"].to_numpy()
    if len(set(y.tolist())) < 2:
        return ToxicModel(units, odds, sure, decay, model.rate, 0.0, 50.0 if 1 in y else -50.0)
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    slope, level = _logistic(np.sqrt(x), y, weight)
    return ToxicModel(units, odds, sure, decay, model.rate, slope, level)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, segments`` (byte ranges of all maximal segments)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxic(docs, labels, per_label))

    def scan(batches):
        for batch in slices(batches):
            surprise, found = model.value.measure(*flat_bytes(batch.column("text")))
            score = model.value.probability(np.sqrt(surprise))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(found, kind)], names=["doc_id", "score", "segments"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, score double, segments {SEGMENT}")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")
