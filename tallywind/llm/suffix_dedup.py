"""Removal of repeated substrings of ``WINDOW`` bytes across all documents, by deep-shallow suffix sorting around sampled anchors.

A byte goes if it lies in a string of 100 bytes that also starts earlier (smaller id, or same document and smaller place); matches never
cross documents, overlaps count, and strings are judged on the input.

Anchors. Of every 51 pieces of 50 bytes in a row, those with the least hash are anchors. Two equal strings of 100 bytes have the same
anchor at the same place, so only anchors (one in some 25 bytes) are shuffled, with a hash of their surroundings (50 bytes on each side).
Classes. Occurrences with equal anchor and surroundings are one class: all but the first are covered with their surroundings. Each task
first reduces its own, so a passage that a third of all documents share gives one row per task.
Groups. Only where one anchor has several classes do the bytes matter. The first occurrences of up to ``GROUP`` classes meet in a task, and
what follows (and what precedes, reversed) is suffix-sorted: multikey quicksort to a shallow depth of two machine words, then blind tries
for the groups that are still tied. The longest common prefixes tell how far each agrees with an earlier one on both sides.
Wide groups. Anchors with more classes, or met too often within one task, are resolved string by string instead: each of the up to 51
strings around such an occurrence goes to the bucket of its 128-bit hash, where all but the first are covered. Nothing is capped.

The texts are written once as a table bucketed by document, which three later joins read without a shuffle. Copies of a whole text are
covered as a whole. Null texts are empty. Null ids count as larger than all others; of rows with equal id the order is that of a hash of
the text; repeated rows are copies of one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import scratch_path, stage

from .exact_dedup import resolve
from .flat import flat_bytes, mix, powers, prefix_hash, slices, span_hash

WINDOW, ANCHOR = 100, 50
SIDE = WINDOW - ANCHOR
GROUP, LOCAL_GROUP = 256, 64
FLUSH, BUCKETS_PER_PARTITION = 1 << 20, 4
LAST = (1 << 63) - 1
SHALLOW = 2  # machine words sorted before the blind tries
COVERED, MEMBER, WIDE, MARK = 0, 1, 2, 3
FOUND = "kind int, h long, ord long, tie long, start long, end long"
_MOST = np.iinfo(np.uint64).max


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w in a row."""
    blocks = np.append(a, np.full(-len(a) % w, _MOST, np.uint64)).reshape(-1, w)
    forth = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(a) - w + 1
    return np.minimum(back[:n], forth[w - 1:w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all documents: hash ``h``, hash of the surroundings ``c``, ``row``, place ``pos`` in the document, and the range ``start``
    to ``end`` of the surroundings."""
    if len(data) < WINDOW:
        return {k: np.zeros(0, t) for k, t in (("h", np.uint64), ("c", np.uint64), ("row", np.int64), ("pos", np.int64), ("start", np.int64), ("end", np.int64))}
    prefix, n = prefix_hash(data), len(data) - ANCHOR + 1
    at = np.arange(n)
    h = span_hash(prefix, at, at + ANCHOR)
    least = _sliding_min(h, SIDE + 1)
    inside = np.repeat(starts[1:], np.diff(starts))[:len(least)] >= np.arange(len(least)) + WINDOW
    seen = np.concatenate([np.zeros(SIDE, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(n - len(least), np.uint64)])
    place = np.flatnonzero(~_sliding_min(~seen, SIDE + 1)[:n] == h)  # the greatest of the minima of the strings around it
    row = np.searchsorted(starts, place, "right") - 1
    low, high = np.maximum(place - SIDE, starts[row]), np.minimum(place + WINDOW, starts[row + 1])
    around = span_hash(prefix, low, high) + mix((place - low).astype(np.uint64) + np.uint64(257) * (high - place).astype(np.uint64))
    base = starts[row]
    return {"h": h[place], "c": second_hash(data, low, high) ^ around, "row": row, "pos": place - base, "start": low - base, "end": high - base}


def second_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], independent of the first: bytes are replaced by random words before they are summed."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * powers(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(total), "down")[starts])


def merged(ord_: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of overlapping or touching ranges of each document."""
    if not len(ord_):
        return ord_, tie, start, end
    order = np.lexsort((start, tie, ord_))
    ord_, tie, start, end = ord_[order], tie[order], start[order], end[order]
    fresh = np.concatenate([[True], (ord_[1:] != ord_[:-1]) | (tie[1:] != tie[:-1])])
    shift = np.cumsum(fresh) * (int(end.max()) + 1)  # documents end to end, so one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    opens = fresh | np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(opens)
    return ord_[first], tie[first], start[first], (reach - shift)[np.append(first[1:], len(start)) - 1]


NAMES = ["h", "c", "ord", "tie", "pos", "start", "end"]


def _first_seen(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The occurrences sorted by class and order, and which are first in their class."""
    order = np.lexsort((x["pos"], x["tie"], x["ord"], x["c"], x["h"]))
    x = {k: v[order] for k, v in x.items()}
    first = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])]) if len(order) else np.zeros(0, bool)
    return x, first


def _pack(x: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of equal byte weight, hashes as differences, compressed."""
    columns = [np.diff(x["h"], prepend=np.uint64(0)), *(x[k].astype(np.int64).view(np.uint64) for k in NAMES[1:])]
    return pa.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(n: int, raw: bytes) -> dict[str, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n * len(NAMES), codec="zstd", asbytes=True), np.uint8).reshape(len(NAMES), 8, n)
    columns = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return {k: c if k in "hc" else c.view(np.int64) for k, c in zip(NAMES, columns)}


def _table(kind: int, ord_, tie, start, end, h=None) -> pa.RecordBatch:
    n = len(ord_)
    h = np.zeros(n, np.int64) if h is None else h.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in (h, ord_, tie, start, end))],
                                      names=["kind", "h", "ord", "tie", "start", "end"])


RUN = "bucket long, n long, run binary"


class _Runs:
    """Collects occurrences in a task and sends what is first here to its bucket; the rest is covered already."""

    def __init__(self, buckets: int, wide: bool):
        self.buckets, self.wide, self.held, self.n = buckets, wide, [], 0

    def add(self, x: dict[str, np.ndarray]):
        self.held.append(x)
        self.n += len(x["h"])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        x, first = _first_seen({k: np.concatenate([h[k] for h in self.held]) for k in NAMES})
        self.held, self.n = [], 0
        rows = []
        late = merged(x["ord"][~first], x["tie"][~first], x["start"][~first], x["end"][~first])
        x = {k: v[first] for k, v in x.items()}
        if self.wide:  # anchors with many classes in this task alone
            opens = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]])) if len(x["h"]) else np.zeros(0, np.int64)
            size = np.diff(np.append(opens, len(x["h"])))
            many = np.repeat(size > LOCAL_GROUP, size)
            if many.any():
                rows += self._send(WIDE, x["ord"][many], x["tie"][many], x["pos"][many], x["pos"][many])
                rows += self._send(MARK, *([x["h"][opens[size > LOCAL_GROUP]].view(np.int64)] * 4))
                x = {k: v[~many] for k, v in x.items()}
        rows += self._send(COVERED, *late)
        to = (x["h"] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cuts = np.searchsorted(to, np.arange(self.buckets + 1, dtype=np.uint64))
        rows += [(b, e - a, _pack({k: v[a:e] for k, v in x.items()})) for b, (a, e) in enumerate(zip(cuts, cuts[1:])) if e > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())],
                                         names=["bucket", "n", "run"])

    def _send(self, kind: int, ord_, tie, start, end) -> list[tuple[int, int, bytes]]:
        """Rows that a bucket only passes on (or, marks, reads): dealt by document, marks by their anchor. ``n`` is negative."""
        if not len(ord_):
            return []
        key = ord_.view(np.uint64) if kind == MARK else mix(ord_.astype(np.int64).view(np.uint64) + mix(tie.astype(np.int64).view(np.uint64)))
        to = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        out = []
        for b in np.unique(to):
            part = np.stack([np.asarray(c, np.int64)[to == b] for c in (ord_, tie, start, end)])
            out.append((int(b), -(4 * part.shape[1] + kind), pa.compress(part.tobytes(), codec="zstd", asbytes=True)))
        return out


def _meet(runs: DataFrame, wide: bool) -> DataFrame:
    """Merge the runs of each bucket: covered ranges, members of narrow groups, occurrences of wide ones."""
    def run(batches):
        bucket, held, marks = None, [], []

        def close():
            if not held:
                return
            x, first = _first_seen({k: np.concatenate([h[k] for h in held]) for k in NAMES})
            yield _table(COVERED, *merged(x["ord"][~first], x["tie"][~first], x["start"][~first], x["end"][~first]))
            if wide:
                x = {k: v[first] for k, v in x.items()}
                opens = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]]))
                size = np.diff(np.append(opens, len(x["h"])))
                marked = np.isin(x["h"][opens].view(np.int64), np.concatenate(marks)) if marks else np.zeros(len(opens), bool)
                many, few = np.repeat((size > GROUP) | marked, size), np.repeat((size > 1) & (size <= GROUP) & ~marked, size)
                yield _table(WIDE, x["ord"][many], x["tie"][many], x["pos"][many], x["pos"][many])
                yield _table(MEMBER, x["ord"][few], x["tie"][few], x["pos"][few], x["pos"][few], x["h"][few])

        for batch in batches:
            for b, n, raw in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("run")):
                if b != bucket:
                    yield from close()
                    bucket, held, marks = b, [], []
                if n > 0:
                    held.append(_unpack(n, raw.as_py()))
                    continue
                count, kind = divmod(-n, 4)
                part = np.frombuffer(pa.decompress(raw.as_py(), decompressed_size=32 * count, codec="zstd", asbytes=True), np.int64).reshape(4, count)
                if kind == MARK:
                    marks.append(part[0])
                else:
                    yield _table(kind, *part)
        yield from close()

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


class BlindTrie:
    """Orders byte strings that already agree on ``skip`` bytes; nodes remember only where they branch and on which byte."""

    def __init__(self, skip: int):
        self.skip, self.root = skip, None  # a leaf is [None, string, its numbers]; a node [place, {byte: child}]

    def insert(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = [None, string, [number]]
            return
        node = self.root
        while node[0] is not None:  # the blind descent: any child will do where the byte is missing
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other, at = node[1], self.skip
        if other == string:
            node[2].append(number)
            return
        while other[at] == string[at]:
            at += 1
        node, parent, byte = self.root, None, None
        while node[0] is not None and node[0] < at:
            parent, byte, node = node, string[node[0]], node[1][string[node[0]]]
        leaf = [None, string, [number]]
        if node[0] == at:
            node[1][string[at]] = leaf
            return
        sample = node
        while sample[0] is not None:
            sample = next(iter(sample[1].values()))
        split = [at, {sample[1][at]: node, string[at]: leaf}]
        if parent is None:
            self.root = split
        else:
            parent[1][byte] = split

    def ordered(self, width: int) -> tuple[list[int], list[int]]:
        """Numbers in the order of their strings, and the common prefix of each with the one before (``skip`` for the first)."""
        numbers, common, stack = [], [], [(self.root, self.skip)]
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                numbers += node[2]
                common += [shared, *[width] * (len(node[2]) - 1)]
            else:
                children = [node[1][b] for b in sorted(node[1], reverse=True)]
                stack += [(c, node[0]) for c in children[:-1]] + [(children[-1], shared)]
        return numbers, common


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings (rows of a uint8 matrix) within their groups, and the common prefix of each with the one before
    in its group: multikey quicksort on ``SHALLOW`` words of eight bytes, all groups at once, then a blind trie per tied group."""
    n, width = strings.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = [np.ascontiguousarray(strings[:, 8 * k:8 * k + 8]).view(">u8").ravel() for k in range(SHALLOW)]
    order = np.lexsort((*reversed(words), group))
    same = group[order][1:] == group[order][:-1]
    common = np.zeros(n, np.int64)
    a, b = strings[order][1:, :8 * SHALLOW], strings[order][:-1, :8 * SHALLOW]
    common[1:] = np.where(same, np.where((a != b).any(1), (a != b).argmax(1), 8 * SHALLOW), 0)
    tied = np.concatenate([[False], same & (common[1:] == 8 * SHALLOW)])
    opens = np.flatnonzero(~tied)
    for low, high in zip(opens, np.append(opens[1:], n)):
        if high - low > 1:
            trie = BlindTrie(8 * SHALLOW)
            for i in order[low:high].tolist():
                trie.insert(strings[i].tobytes(), i)
            numbers, shared = trie.ordered(width)
            order[low:high] = numbers
            common[low + 1:high] = shared[1:]
    return order, common


def _range_minima(common: np.ndarray) -> np.ndarray:
    """Common prefixes of all pairs of a sorted group from those of neighbours."""
    n = len(common)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[i, i + 1:] = np.minimum.accumulate(common[i + 1:])
    return out + out.T


def agreements(group: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor occurrence, how many bytes before and after it lie in a string of ``WINDOW`` bytes that occurs earlier in its group
    (-1, -1 if none): ``before`` holds the bytes before it, nearest first."""
    reach = np.full((2, len(group)), -1, np.int64)
    sides = [deep_shallow(group, s) for s in (before, after)]
    opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for low, high in zip(opens, np.append(opens[1:], len(group))):
        agree = []
        for (order, common), limit in zip(sides, (n_before, n_after)):
            back = np.empty(high - low, np.int64)
            back[order[low:high] - low] = np.arange(high - low)
            full = _range_minima(common[low:high])[back[:, None], back[None, :]]
            agree.append(np.minimum(full, np.minimum(limit[low:high, None], limit[None, low:high])))
        earlier = rank[None, low:high] < rank[low:high, None]
        valid = earlier & (agree[0] + agree[1] >= SIDE)
        for k in (0, 1):
            reach[k, low:high] = np.where(valid, agree[k], -1).max(1)
    return reach[0], reach[1]


def _resolve_groups(contexts: DataFrame) -> DataFrame:
    """``contexts``: h, ord, tie, pos, before, after. Covered ranges of the members of narrow groups."""
    def resolve_held(held):
        h, ord_, tie, pos, before, after = (list(c) for c in zip(*held))
        h, ord_, tie, pos = (np.array(c, np.int64) for c in (h, ord_, tie, pos))
        sizes = [np.array([len(s) for s in side], np.int64) for side in (before, after)]
        padded = [np.frombuffer(b"".join(s.ljust(SIDE, b"\0") for s in side), np.uint8).reshape(-1, SIDE) for side in (before, after)]
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((pos, tie, ord_))] = np.arange(len(h))
        left, right = agreements(h, *padded, *sizes, rank)
        ok = left >= 0
        return _table(COVERED, *merged(ord_[ok], tie[ok], (pos - left)[ok], (pos + ANCHOR + right)[ok]))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("h", "ord", "tie", "pos", "before", "after"))))
            held += rows
            if len(held) > 20_000:  # whole groups only: the last may go on in the next batch
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield resolve_held(held[:cut])
                    held = held[cut:]
        if held:
            yield resolve_held(held)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def _read_contexts(batches):
    for batch in batches:
        h, ord_, tie, pos, before, after = [], [], [], [], [], []
        for text, o, t, found in zip(batch.column("text"), batch.column("ord").to_pylist(), batch.column("tie").to_pylist(), batch.column("found").to_pylist()):
            raw = text.as_py().encode()
            for x in found:
                p = x["start"]
                h.append(x["h"]), ord_.append(o), tie.append(t), pos.append(p)
                before.append(raw[max(p - SIDE, 0):p][::-1]), after.append(raw[p + ANCHOR:p + WINDOW])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (h, ord_, tie, pos)), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                                         names=["h", "ord", "tie", "pos", "before", "after"])


def _string_runs(batches, buckets: int):
    """All strings of ``WINDOW`` bytes around the wide occurrences of each document, as runs."""
    runs = _Runs(buckets, False)
    for batch in slices(batches):
        data, starts = flat_bytes(batch.column("text"))
        if len(data) < WINDOW:
            continue
        found = batch.column("found").to_pylist()
        count = np.array([len(f) for f in found])
        row = np.repeat(np.arange(len(found)), count)
        at = np.array([x["start"] for f in found for x in f], np.int64) + starts[row]
        begin = at[:, None] - np.arange(SIDE + 1)
        row = np.repeat(row, SIDE + 1).reshape(begin.shape)
        fits = (begin >= starts[row]) & (begin + WINDOW <= starts[row + 1])
        begin, once = np.unique(begin[fits], return_index=True)
        row = row[fits][once]
        place = begin - starts[row]
        ids = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row] for k in ("ord", "tie")}
        prefix = prefix_hash(data)
        yield from runs.add({"h": span_hash(prefix, begin, begin + WINDOW), "c": second_hash(data, begin, begin + WINDOW), **ids, "pos": place, "start": place, "end": place + WINDOW})
    yield from runs.flush()


def _anchor_runs(batches, buckets: int):
    runs = _Runs(buckets, True)
    for batch in slices(batches):
        x = anchors(*flat_bytes(batch.column("text")))
        row = x.pop("row")
        ids = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row] for k in ("ord", "tie")}
        yield from runs.add({**x, **ids})
    yield from runs.flush()


def _kept(batches):
    """What is left of each document: ``ord, sha, n_removed, n_spans, kept_sha256``."""
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
            raw = text.as_py().encode()
            n = len(found)
            _, _, start, end = merged(np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([x["start"] for x in found], np.int64), np.array([x["end"] for x in found], np.int64))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist()):
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            removed.append(int((end - start).sum())), spans.append(len(start)), digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                                         names=["ord", "sha", "n_removed", "n_spans", "kept_sha256"])


def _text_table(docs: DataFrame) -> DataFrame:
    """The texts by document (``ord``, ``sha``), bucketed, in the shared folder."""
    spark = docs.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tallywind_texts_{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.unhex(F.sha2(text, 256)).alias("sha"), F.col("doc_id").isNull().alias("no_id"), text.alias("text"))
    (keyed.repartition(n, "ord", "sha").write.option("path", scratch_path(spark, "texts")).option("compression", "zstd").format("parquet")
     .bucketBy(n, "ord", "sha").saveAsTable(name))
    return spark.table(name)


def covered_ranges(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """``ord, tie, start, end``: ranges (perhaps overlapping) that go from the documents of ``firsts`` (``ord, sha, tie``)."""
    buckets = BUCKETS_PER_PARTITION * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = texts.select("ord", "sha", "text")
    runs = mine.join(firsts.hint("shuffle_hash"), ["ord", "sha"]).select("ord", "tie", "text").mapInArrow(lambda b: _anchor_runs(b, buckets), RUN)
    found = stage(_meet(runs, True), "anchors-met")

    def with_text(kind: int) -> DataFrame:
        lists = found.filter(F.col("kind") == kind).groupBy("ord", "tie").agg(F.collect_list(F.struct("h", "start")).alias("found"))
        return mine.join(lists.join(firsts, ["ord", "tie"]).select("ord", "sha", "tie", "found").hint("shuffle_hash"), ["ord", "sha"]).select("ord", "tie", "text", "found")

    contexts = with_text(MEMBER).mapInArrow(_read_contexts, "h long, ord long, tie long, pos long, before binary, after binary")
    narrow = stage(_resolve_groups(contexts), "groups-met")
    strings = with_text(WIDE).mapInArrow(lambda b: _string_runs(b, buckets), RUN)
    wide = stage(_meet(strings, False), "strings-met")
    out = found.filter(F.col("kind") == COVERED)
    for more in (narrow, wide):
        out = out.unionByName(more)
    return out.select("ord", "tie", "start", "end")


def removed_substrings(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    texts = _text_table(docs)
    size = F.octet_length("text").cast("long")
    prints = stage(texts.select(F.col("ord").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("sha").alias("digest"), F.xxhash64("text").alias("proof"),
                                size.alias("chars"), F.spark_partition_id().alias("run"), "no_id"), "text-digests")
    rows = stage(resolve(prints).select("doc_id", "no_id", F.col("digest").alias("sha"), F.col("chars").alias("n_bytes"), (F.col("row") == F.col("keep.row")).alias("first")), "text-groups")
    firsts = rows.filter(F.col("first") & (F.col("n_bytes") >= WINDOW)).select(F.col("doc_id").alias("ord"), "sha")
    shared = firsts.groupBy("ord").agg(F.count("*").alias("n")).filter("n > 1").select("ord", F.lit(1).alias("many"))
    firsts = stage(firsts.join(shared, "ord", "left").select("ord", "sha", F.when(F.col("many") == 1, F.xxhash64("sha")).otherwise(F.lit(0).cast("long")).alias("tie")), "firsts")
    ranges = covered_ranges(texts, firsts).groupBy("ord", "tie").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    ranges = ranges.join(firsts, ["ord", "tie"]).select("ord", "sha", "found")
    cut = texts.select("ord", "sha", "text").join(ranges.hint("shuffle_hash"), ["ord", "sha"]).mapInArrow(
        _kept, "ord long, sha binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["ord", "sha"])
    copy = ~F.col("first") & (F.col("n_bytes") >= WINDOW)
    left = F.col("first") & F.col("n_removed").isNotNull()
    return rows.join(cut, (rows.doc_id == cut.ord) & (rows.sha == cut.sha), "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).when(left, F.col("n_removed")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(copy, F.lit(1)).when(left, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(left, F.col("kept_sha256")).otherwise(F.lower(F.hex(rows.sha))).alias("kept_sha256"))
