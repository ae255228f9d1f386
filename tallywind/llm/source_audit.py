"""Divergence of sources: how differently the sources of a language use its common terms.

Terms are runs of letters and of all characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least ``min_docs`` of its
documents hold. The kept terms are sorted, and each range of them becomes a minimal acyclic transducer in the shared folder, which
maps a term to its ordinal within the range; with the number of terms before the range that is the term's lexicographic ordinal among its
language's. Then the texts are read again and all their terms stream through the transducers, which leaves counts per (language, source,
ordinal). From there on terms are ordinals: they are joined, compared and ranked by them, ties go to the smaller one, and only the
reported ones are spelled again.

If all transducers together have at most ``resident_bytes`` (they are measured), every worker loads them and each occurrence is walked where
its text is. Beyond that the terms of a task are counted first and the counts are shuffled to the owner of the term's range, which walks
them through its own transducer alone; both ways give the same counts.

Sources are compared in cells of two blocks of sources and one of at most ``WIDTH`` ordinals: a cell holds at most ``CELL`` values, gives one sum
for each of its pairs of sources, and the sums are added up. Integers throughout; probabilities are divided as decimals.

Null texts, languages and sources are empty strings. Each row is a document, also if its id repeats or is null. A language without kept
terms gives its pairs of sources the value 0 and no term rows; a language with one source has no pairs. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.session import lookup_side, scratch_path, stage

from .flat import LOWER, flat_bytes, slices, words
from .transducer import Transducer, build

MIN_DOCS, TOP, SMOOTHING, SCALE = 30, 50, 5, 1_000_000_000
SHARD_TERMS, RESIDENT_BYTES, PENDING_ROWS = 200_000, 64 << 20, 400_000
SOURCES, WIDTH, CELL = 256, 512, 2_000_000
PREFIX = 8

# Between terms: all of ASCII but its letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of all rows as binaries, and the row of each."""
    begin, end, before = words(data, starts, _BETWEEN)
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    inside = np.ascontiguousarray(LOWER[data[~_BETWEEN[data]]])
    terms = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)])
    return terms, np.repeat(np.arange(len(starts) - 1), np.diff(before))


class Sums:
    """Adds up rows with equal keys; ``ready`` hands them out when there are many of them, ``rest`` at the end."""

    def __init__(self, keys: list[str], limit: int = PENDING_ROWS):
        self.keys, self.limit, self.tables, self.rows = keys, limit, [], 0

    def add(self, **columns) -> None:
        if len(columns["n"]):
            self.tables.append(pa.table(columns))
            self.rows += len(columns["n"])

    def _merge(self) -> pa.Table | None:
        if not self.tables:
            return None
        merged = pa.concat_tables(self.tables).group_by(self.keys).aggregate([("n", "sum")]).rename_columns([*self.keys, "n"])
        self.tables, self.rows = [merged], len(merged)
        return merged

    def ready(self) -> pa.Table | None:
        if self.rows < 2 * self.limit:
            return None
        merged = self._merge()
        return self.rest() if len(merged) >= self.limit else None

    def rest(self) -> pa.Table | None:
        merged, self.tables, self.rows = self._merge(), [], 0
        return merged


def _summed(batches, keys: list[str], measure):
    """What ``measure(batch)`` counts in the slices of a task, added up by ``keys``."""
    sums = Sums(keys)
    for batch in slices(batches):
        sums.add(**measure(batch))
        if (table := sums.ready()) is not None:
            yield from table.to_batches(max_chunksize=20_000)
    if (table := sums.rest()) is not None:
        yield from table.to_batches(max_chunksize=20_000)


def _coded(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """One code per distinct combination of the columns, for each row, and the combinations."""
    index: dict[tuple, int] = {}
    values = zip(*(batch.column(c).to_pylist() for c in columns))
    return np.fromiter((index.setdefault(v, len(index)) for v in values), np.int64, batch.num_rows), list(index)


def _term_counts(batch: pa.RecordBatch, columns: list[str], once_per_row: bool) -> dict:
    """``columns, term, n``: occurrences, or rows that hold the term."""
    code, groups = _coded(batch, columns)
    terms, row = terms_of(*flat_bytes(batch.column("text")))
    coded = terms.dictionary_encode()
    at, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    if once_per_row:
        first = np.unique(row * size + at)
        row, at = first // size, first % size
    key, n = np.unique(code[row] * size + at, return_counts=True)
    group = key // size
    return {c: pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i, c in enumerate(columns)} | {
        "term": coded.dictionary.take(pa.array(key % size)), "n": n.astype(np.int64)}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` (binary) of the terms that at least ``min_docs`` rows of the language hold."""
    def measure(batches):
        return _summed(batches, ["lang", "term"], lambda batch: _term_counts(batch, ["lang"], True))

    held = docs.select("lang", "text").mapInArrow(measure, "lang string, term binary, n long")
    return stage(held.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term"), "kept-terms")


def prefixes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first bytes of each term as a number, so that numbers compare as the bytes do."""
    out = np.zeros(len(begin), np.uint64)
    for j in range(PREFIX):
        out <<= np.uint64(8)
        more = begin + j < end
        out[more] |= data[begin[more] + j].astype(np.uint64)
    return out


class Vocabulary:
    """The transducers of all languages: one row ``(lang, base, first prefix, terms, bytes, path)`` per range of terms, in order."""

    def __init__(self, shards: list[tuple]):
        self.shards = shards
        self.by_lang: dict[str, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        for lang in dict.fromkeys(s[0] for s in shards):
            mine = [i for i, s in enumerate(shards) if s[0] == lang]
            self.by_lang[lang] = (np.array([shards[i][2] for i in mine], np.uint64), np.array([shards[i][1] for i in mine]), mine)
        self.loaded: dict[int, Transducer] = {}

    def __getstate__(self):
        return self.shards

    def __setstate__(self, shards):
        self.__init__(shards)

    @property
    def nbytes(self) -> int:
        return sum(s[4] for s in self.shards)

    def transducer(self, shard: int, resident: bool) -> Transducer:
        if shard not in self.loaded:
            if not resident:
                self.loaded.clear()
            self.loaded[shard] = Transducer.read(self.shards[shard][5])
        return self.loaded[shard]

    def shard_of(self, lang: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The shard each term would be in; -1 if it sorts before all or the language has none."""
        if lang not in self.by_lang:
            return np.full(len(begin), -1)
        firsts, _, numbers = self.by_lang[lang]
        place = np.searchsorted(firsts, prefixes(data, begin, end), "right") - 1
        return np.where(place >= 0, np.array(numbers)[np.maximum(place, 0)], -1)

    def ordinals(self, shard: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, resident: bool) -> np.ndarray:
        """Lexicographic ordinals, -1 for what is not kept."""
        out = np.full(len(begin), -1, np.int64)
        order = np.argsort(shard, kind="stable")
        numbers, at = np.unique(shard[order], return_index=True)
        for number, mine in zip(numbers, np.split(order, at[1:])):
            if number >= 0:
                found = self.transducer(int(number), resident).ordinals(data, begin[mine], end[mine])
                out[mine] = np.where(found >= 0, found + self.shards[number][1], -1)
        return out

    def term(self, lang: str, ordinal: int, resident: bool) -> bytes:
        _, bases, numbers = self.by_lang[lang]
        shard = numbers[int(np.searchsorted(bases, ordinal, "right")) - 1]
        return self.transducer(shard, resident).term(ordinal - self.shards[shard][1])


def build_vocabulary(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> Vocabulary:
    """Sort the kept terms and build a transducer from each language's part of each range. The driver gets one row per transducer."""
    spark = kept.sparkSession
    folder = scratch_path(spark, "transducers")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // shard_terms))

    def make(batches):
        def close():
            from .files import fresh_name

            t, path = build(terms), fresh_name(folder, "terms", "fst")
            t.write(path)
            return pa.RecordBatch.from_pylist([{"lang": lang, "first": terms[0][:PREFIX].ljust(PREFIX, b"\0"), "terms": len(terms), "bytes": t.nbytes, "path": path}])

        lang, terms = None, []
        for batch in batches:
            for now, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if terms and (now != lang or len(terms) >= shard_terms and term[:PREFIX] != terms[-1][:PREFIX]):
                    yield close()
                    terms = []
                lang = now
                terms.append(term)
        if terms:
            yield close()

    # Ranges and transducers end where the first bytes of the terms change, so that these bytes name the one transducer of any term.
    ordered = kept.withColumn("head", F.substring("term", 1, PREFIX)).repartitionByRange(ranges, "lang", "head").sortWithinPartitions("lang", "term")
    made = ordered.select("lang", "term").mapInArrow(make, "lang string, first binary, terms long, bytes long, path string")
    rows = sorted(((r.lang, bytes(r.first), r.terms, r.bytes, r.path) for r in stage(made, "transducer-list").collect()), key=lambda r: (r[0].encode(), r[1]))
    shards, base, before = [], 0, None
    for lang, first, terms, size, path in rows:
        base = 0 if lang != before else base
        shards.append((lang, base, int.from_bytes(first, "big"), terms, size, path))
        base, before = base + terms, lang
    return Vocabulary(shards)


def recount(docs: DataFrame, vocabulary: Vocabulary, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """``lang, source, ord, n``: all occurrences of kept terms, by streaming the texts through the transducers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one row per range of terms
    keys = ["lang", "source", "ord"]

    def walk_texts(batches):
        def measure(batch):
            code, groups = _coded(batch, ["lang", "source"])
            data, starts = flat_bytes(batch.column("text"))
            data = LOWER[data]
            begin, end, before = words(data, starts, _BETWEEN)
            group = np.repeat(code, np.diff(before))
            langs = np.array([g[0] for g in groups], object)
            found = np.full(len(begin), -1, np.int64)
            for lang in set(langs):
                mine = np.flatnonzero((langs == lang)[group])
                b, e = begin[mine], end[mine]
                found[mine] = shared.value.ordinals(shared.value.shard_of(lang, data, b, e), data, b, e, True)
            known = found >= 0
            size = int(found.max(initial=0)) + 1
            key, n = np.unique(group[known] * size + found[known], return_counts=True)
            return {c: pa.array([g[i] for g in groups], pa.string()).take(pa.array(key // size)) for i, c in enumerate(keys[:2])} | {
                "ord": key % size, "n": n.astype(np.int64)}

        return _summed(batches, keys, measure)

    def count_terms(batches):
        for batch in _summed(batches, ["lang", "source", "term"], lambda batch: _term_counts(batch, ["lang", "source"], False)):
            code, langs = _coded(batch, ["lang"])
            data, starts = flat_bytes(batch.column("term"))
            shard = np.full(batch.num_rows, -1)
            for i, (lang,) in enumerate(langs):
                mine = np.flatnonzero(code == i)
                shard[mine] = shared.value.shard_of(lang, data, starts[mine], starts[mine + 1])
            known = pa.array(shard >= 0)
            yield batch.append_column("shard", pa.array(shard)).filter(known)

    def walk_terms(batches):
        for batch in batches:
            data, starts = flat_bytes(batch.column("term"))
            found = shared.value.ordinals(batch.column("shard").to_numpy(), data, starts[:-1], starts[1:], False)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(found), batch.column("n")], names=[*keys, "n"]).filter(pa.array(found >= 0))

    counted = "lang string, source string, ord long, n long"
    if vocabulary.nbytes <= resident_bytes:
        partial = docs.mapInArrow(walk_texts, counted)
    else:
        owned = docs.mapInArrow(count_terms, "lang string, source string, term binary, n long, shard long")
        partial = owned.repartition("shard").sortWithinPartitions("shard").mapInArrow(walk_terms, counted)
    return stage(partial.groupBy(*keys).agg(F.sum("n").alias("n")), "term-counts")


def _share(count, total, terms):
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly."""
    d = "decimal(20,0)"
    top = (F.lit(SCALE).cast(d) * (count + F.lit(SMOOTHING)).cast(d)).cast("decimal(38,0)")
    return F.call_function("div", top, (total.cast(d) + terms.cast(d) * F.lit(SMOOTHING)).cast("decimal(38,0)")) + 1


def group_totals(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (lang, source) that occurs: terms kept (v), occurrences in the group and the language, share of an unseen term,
    number of the source within its language and number of sources."""
    groups = docs.select("lang", "source").distinct()
    mine = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v")).join(counts.groupBy("lang").agg(F.sum("n").alias("lang_total")), "lang", "left")
    joined = groups.join(mine, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    of_lang = Window.partitionBy("lang")
    return joined.select(
        "*", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(0)).alias("unseen"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"), F.count("*").over(of_lang).alias("sources"))


def _differences(per_block: int):
    def differences(_, table):
        """Sums of |p - p'| over the ordinals of a cell, for each two of its sources, in both directions."""
        col = {c: table.column(c).to_numpy() for c in ("number", "ord", "p", "block", "low", "high", "width", "v")}
        head = {c: int(x[0]) for c, x in col.items()}
        unseen = col["ord"] < 0
        names = dict(zip(col["number"][unseen].tolist(), table.column("source").filter(pa.array(unseen)).to_pylist()))
        width = min(head["width"], head["v"] - head["block"] * head["width"])

        def matrix(block: int):
            mine = col["number"] // per_block == block
            of, which = np.unique(col["number"][mine], return_inverse=True)
            out = np.empty((len(of), width), np.int64)
            base = mine & unseen
            out[np.searchsorted(of, col["number"][base])] = col["p"][base][:, None]
            seen = ~unseen[mine]
            out[which[seen], col["ord"][mine][seen] - head["block"] * head["width"]] = col["p"][mine][seen]
            return of, out

        (a, left), (b, right) = matrix(head["low"]), matrix(head["high"])
        source, item, value = [], [], []
        for i, x in zip(a.tolist(), left):
            sums = np.abs(right - x).sum(axis=1)
            for j, s in zip(b.tolist(), sums.tolist()):
                if i != j:
                    source.append(names[i])
                    item.append(names[j])
                    value.append(s)
        if head["low"] != head["high"]:
            source, item, value = source + item, item + source, value + value
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return differences


def pair_values(counts: DataFrame, totals: DataFrame, per_block: int = SOURCES, cell: int = CELL) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language."""
    width = F.greatest(F.lit(1), F.least(F.lit(WIDTH), (F.lit(cell) / F.least("sources", F.lit(2 * per_block))).cast("long")))
    plan = lookup_side(totals.filter("sources > 1").withColumn("width", width), "audit-groups")
    seen = counts.join(plan, ["lang", "source"]).select(
        "lang", F.lit(None).cast("string").alias("source"), "number", "ord", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "width", "v", "sources",
        F.expr("ord div width").alias("block"))
    # Each source once per block of ordinals, with its share of an unseen term; also where a language keeps none.
    base = plan.select(
        "lang", "source", "number", F.lit(-1).cast("long").alias("ord"), F.col("unseen").alias("p"), "width", "v", "sources",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("(v + width - 1) div width"), F.lit(1).cast("long")) - 1)).alias("block"))
    own = F.expr(f"number div {per_block}")
    rows = seen.unionByName(base).withColumn("other", F.explode(F.expr(f"sequence(0L, (sources - 1) div {per_block})")))
    rows = rows.select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "source", "number", "ord", "p", "width", "v")
    sums = rows.groupBy("lang", "block", "low", "high").applyInArrow(_differences(per_block), "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def marked_terms(counts: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, ord, value, rank``: the kept terms whose share in a group exceeds the language's most."""
    in_lang = counts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "ord")))
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = in_lang.join(lookup_side(totals, "audit-totals"), ["lang", "source"]).select("lang", "source", "ord", (p - q).alias("value")).filter("value > 0")
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")))
    return ranked.filter(F.col("rank") <= top)


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, resident_bytes: int = RESIDENT_BYTES, shard_terms: int = SHARD_TERMS,
                 per_block: int = SOURCES, cell: int = CELL) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` (other sources by distance) and ``term`` (terms a source favours)."""
    docs = _documents(docs)
    kept = kept_terms(docs, min_docs)
    vocabulary = build_vocabulary(kept, shard_terms)
    counts = recount(docs, vocabulary, resident_bytes)
    totals = stage(group_totals(docs, kept, counts), "audit-group-totals")
    resident = vocabulary.nbytes <= resident_bytes
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def spell(batches):
        for batch in batches:
            items = [shared.value.term(lang, o, resident).decode() for lang, o in zip(batch.column("lang").to_pylist(), batch.column("ord").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("ord"), "item", pa.array(items, pa.string()))

    pairs = pair_values(counts, totals, per_block, cell)
    by_distance = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_distance).alias("rank"))
    terms = stage(marked_terms(counts, totals, top).select("lang", "source", "ord", "value", "rank"), "marked-terms")
    if not resident:
        terms = terms.repartitionByRange("lang", "ord").sortWithinPartitions("lang", "ord")
    terms = terms.mapInArrow(spell, "lang string, source string, item string, value long, rank int")
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
