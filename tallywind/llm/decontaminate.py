"""Benchmark passages in training documents: rare word n-grams seed, Smith-Waterman alignment decides.

Every three words in a row of a benchmark item are a seed. A first pass over all documents counts in how many each seed occurs; seeds in
at most ``rare_share`` of them are rare. A second pass looks the seeds up in each whole text and groups its hits by item and diagonal (a
little drift allowed for insertions). Every group opens a window. The share of the item's words that occur in it is an upper bound of the
score, taken for all groups of a batch together; where it reaches the threshold, the item is aligned word by word (match 2, mismatch and
gap -1). The score is the best local alignment over that of a perfect copy; from ``threshold`` on it is a leak, reported with the number
of rare seeds among its hits. So a passage leaked into very many documents, whose seeds are common for that, is still found from one seed
on, in a table of any size, nothing is capped, and a phrase that thousands of items share costs no alignment.

The items are a query set, taken in blocks of at most ``BLOCK_WORDS`` words (or one item): each block is broadcast and met by all documents.
Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. Null texts have no words. Items of fewer than three words
carry no evidence and never match; repeated items are reported apart. Repeated documents are reported each; an empty table on either
side gives no leak. Other columns are carried or ignored and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .flat import PUNCTUATION, flat_bytes, mix, ngram_hashes, slices, word_hashes

SEED_WORDS, RARE_SHARE, THRESHOLD, DRIFT = 3, 0.001, 0.45, 8
BLOCK_WORDS, TOGETHER = 1_000_000, 2_000_000
MATCH, MISS, GAP = 2, -1, -1


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the place in ``window`` where it ends."""
    ramp = np.arange(len(window) + 1) * -GAP
    row, best, at = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(window == word, MATCH, MISS), row[1:] + GAP)
        new = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps along the window
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best, at


class Block:
    """Some items: their words, and the sorted seeds with the items and places they come from."""

    def __init__(self, ids: list, texts: list[str | None]):
        data, starts = flat_bytes(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words, _, _, self.before = word_hashes(data, starts, PUNCTUATION)
        seeds, first, offsets = ngram_hashes(self.words, self.before, SEED_WORDS)
        item = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.first_of = np.unique(seeds[order], return_index=True)
        self.first_of = np.append(self.first_of, len(order))
        self.item, self.place = item[order], (first - self.before[item])[order]
        self.rare = np.zeros(len(self.seeds), bool)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams are seeds, and the number of the seed."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        at = np.flatnonzero(self.seeds[i] == grams)
        return at, i[at]

    def leaks(self, data: np.ndarray, starts: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, score, byte range of the passage, rare seeds) of every leak in these documents."""
        words, begin, end, before = word_hashes(data, starts, PUNCTUATION)
        grams, first, offsets = ngram_hashes(words, before, SEED_WORDS)
        at, seed = self.hits(grams)
        if not len(at):
            return []
        row = np.searchsorted(offsets, at, "right") - 1
        many = np.diff(self.first_of)[seed]
        source = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first_of[seed], many)
        row, item = np.repeat(row, many), self.item[source]
        diagonal = np.repeat(first[at], many) - before[row] - self.place[source]
        rare = self.rare[np.repeat(seed, many)].astype(np.int64)
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal, rare = row[order], item[order], diagonal[order], rare[order]
        opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > DRIFT)]))
        ends = np.append(opens[1:], len(row)) - 1
        r, i, size = row[opens], item[opens], np.diff(self.before)[item[opens]]
        low = before[r] + np.maximum(diagonal[opens] - 2 * DRIFT, 0)
        high = np.minimum(before[r] + diagonal[ends] + size + 2 * DRIFT, before[r + 1])
        rare = np.add.reduceat(rare, opens)
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for g in np.flatnonzero(self._bounds(words, low, high, i) >= threshold).tolist():
            mine = self.words[self.before[i[g]]:self.before[i[g] + 1]]
            best, stop = align(mine, words[low[g]:high[g]])
            score, key = best / (MATCH * len(mine)), (int(r[g]), int(i[g]))
            if score >= threshold and score > found.get(key, (0.0,))[0]:
                last = low[g] + max(stop - 1, 0)
                begins = max(last - len(mine) - 2 * DRIFT, low[g])
                found[key] = (score, int(begin[begins] - starts[r[g]]), int(end[last] - starts[r[g]]), int(rare[g]))
        return [(*key, *x) for key, x in found.items()]

    def _bounds(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For each window words[low:high], the share of the item's words that occur in it: a match needs the word, so no alignment scores
        more. Words are looked up together with the number of their window; windows are taken some ``TOGETHER`` words at a time."""
        size = np.diff(self.before)[item]
        work = np.cumsum(size + high - low)
        out, at = np.zeros(len(item)), 0
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + TOGETHER, "right")))
            spans = []
            for source, begin, n in ((words, low[at:to], (high - low)[at:to]), (self.words, self.before[item[at:to]], size[at:to])):
                window = np.repeat(np.arange(to - at), n)
                places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                spans.append((window, mix(source[places] + window.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            there = np.sort(spans[0][1])
            window, asked = spans[1]
            hit = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
            out[at:to] = np.bincount(window[hit], minlength=to - at) / np.maximum(size[at:to], 1)
            at = to
        return out


def _blocks(items: DataFrame):
    """The items in blocks of bounded size, in the order of their ids."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        more = len((r.text or "").split())
        if ids and size + more > BLOCK_WORDS:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
        ids, texts, size = [*ids, r.item_id], [*texts, r.text], size + more
    if ids:
        yield Block(ids, texts)


def _with_rarity(docs: DataFrame, block: Block, rare_share: float):
    """The block, broadcast, knowing which of its seeds are rare among all documents."""
    context = docs.sparkSession.sparkContext
    seeds = context.broadcast(block)

    def count(batches):
        total, rows = np.zeros(len(seeds.value.seeds), np.int64), 0
        for batch in slices(batches):
            data, starts = flat_bytes(batch.column("text"))
            hashes, _, _, before = word_hashes(data, starts, PUNCTUATION)
            grams, _, offsets = ngram_hashes(hashes, before, SEED_WORDS)
            at, seed = seeds.value.hits(grams)
            once = np.unique((np.searchsorted(offsets, at, "right") - 1) * len(total) + seed) if len(at) else at
            total += np.bincount(once % max(len(total), 1), minlength=len(total))
            rows += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], names=["seed", "n"])

    counts = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    found = {r.seed: r.n for r in counts}
    often = np.array([found.get(i, 0) for i in range(len(block.seeds))], np.int64)
    block.rare = often <= rare_share * found.get(-1, 0)
    return context.broadcast(block)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE) -> DataFrame:
    """One row per document and item that it leaks: ``doc_id, item_id, score, start, end`` (bytes of the passage), ``rare_seeds``. Ids may
    have any type."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, score double, start long, end long, rare_seeds long"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for block in _blocks(benchmark):
        known = _with_rarity(docs, block, rare_share)

        def search(batches, known=known):
            for batch in slices(batches):
                found = known.value.leaks(*flat_bytes(batch.column("text")), threshold)
                rows, item, score, start, end, rare = (list(x) for x in zip(*found)) if found else ([],) * 6
                ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([known.value.ids[i] for i in item], item_arrow), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                     pa.array(rare, pa.int64())], names=["doc_id", "item_id", "score", "start", "end", "rare_seeds"])

        parts.append(docs.select("doc_id", "text").mapInArrow(search, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    out = docs
    for block in _blocks(benchmark):
        known = _with_rarity(docs, block, rare_share)

        def clean(batches, known=known):
            for batch in slices(batches):
                leaking = {r for r, *_ in known.value.leaks(*flat_bytes(batch.column("text")), threshold)}
                yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
