"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A shard has two files. ``.ids``: all ids of its documents, raw little-endian, two bytes each if the vocabulary fits and four otherwise,
each document followed by the end id. ``.mph``: a JSON line with the sizes, then the arrays of the index. Keys are hashed through a
cascade of bit arrays: in each level a key that is alone at its place sets the bit, the others go to the next level; the rank of its bit
is the key's slot. A slot holds a fingerprint of its key (an absent key is refused but for one in 2^32), the number of its first record
and how many records share the key; a table of record starts leads to the ids. A look-up touches the same few words whatever the size.

Documents are range-partitioned by id, so shards are in ascending order of ``doc_id`` and ``start`` is the sum of the shards before plus
the offset within the shard. The rows that tasks commit name the files they wrote, so lost attempts leave nothing that is read.

Null texts are empty documents of one end id. Rows that share an id are all written, as copies 0, 1, ... of one key in the order of their
texts; null ids share the key of the smallest long and come first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.session import scratch_path, stage

from . import files
from .flat import mix, slices
from .token_counts import Kept, Pretokens, is_early, load_tokenizer, parts_of, provable, prove_whole

NULL_KEY = -(1 << 63)
PUNCTUATION = ".,;:!?*#$%&|\"()-"


class Encoder:
    """The ids of texts as packed bytes. Texts are cut, and parts kept, as in ``token_counts``: a proven pre-token is one known id, the
    rest is merged by the library's model, and special strings in a text give their own ids, as the library does by default. A file for
    which that does not hold is encoded by the library, whole texts at a time."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u4" if max(vocabulary.values(), default=0) >= 1 << 16 else "<u2")
        self.exact = provable(path)
        if not self.exact:
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            return
        self.special = {t.content: self._packed([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = {p: self._packed([vocabulary[p]]) for p in prove_whole(path)}
        self.pretokens = Pretokens(self.tokenizer)
        self.merged = Kept(lambda p: self._packed([t.id for t in self.tokenizer.model.tokenize(p)]))
        self.first = Kept(self._part)
        self.later = Kept(self._later)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}{'I' if self.dtype.itemsize == 4 else 'H'}", *ids)

    def _later(self, p: str) -> bytes:
        """A part after its space. A plain word is one pre-token, and ends where punctuation begins."""
        word = p.rstrip(PUNCTUATION)
        if word.isalpha() and is_early(word):
            if len(word) < len(p):
                return self.later[word] + self.first[p[len(word):]]
            letters = self.pretokens.spelled(" " + p)
            return self.whole.get(letters) or self._packed([t.id for t in self.tokenizer.model.tokenize(letters)])
        return self._part(" " + p)

    def _part(self, part: str) -> bytes:
        whole, merged = self.whole, self.merged
        return b"".join([whole.get(p) or merged[p] for p in self.pretokens.of(part)])

    def _plain(self, text: str) -> bytes:
        return b"".join(self.first[start] + b"".join(map(self.later.__getitem__, later)) for start, later in parts_of(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.exact:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        for kept in (self.merged, self.first, self.later):
            kept.trim()
        return [self._whole_text(t) if t else b"" for t in texts]

    def _whole_text(self, text: str) -> bytes:
        if self.splitter is None or not self.splitter.search(text):
            return self._plain(text)
        return b"".join(self.special[t] if i % 2 else self._plain(t) for i, t in enumerate(self.splitter.split(text)))


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder per worker process, so its pieces serve the next task too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class KeyIndex:
    """Minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, below = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(below + np.cumsum(counts) - counts)
            below += int(counts.sum())

    @staticmethod
    def _places(keys: np.ndarray, level: int, n_words: int) -> np.ndarray:
        return mix(keys * np.uint64(2) + np.uint64(1) ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(64 * n_words)

    @classmethod
    def build(cls, keys: np.ndarray) -> "KeyIndex":
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            n_words = max(1, len(left) // 32)
            at = cls._places(mix(left), len(levels), n_words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * n_words)[at.astype(np.int64)] == 1
            bits = np.zeros(n_words, np.uint64)
            np.bitwise_or.at(bits, (at[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[alone] & np.uint64(63)))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some of the keys that are not in the index; the others get any slot."""
        hashed = mix(keys.astype(np.uint64))
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._places(hashed[open_], level, len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            inside = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(inside))[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int) -> list[bytes]:
    """The parts of a shard's index file; records with equal keys stand together."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    copies = np.diff(np.append(first, len(keys)))
    index = KeyIndex.build(keys[first])
    slot = index.slots(keys[first])
    table = np.zeros(len(first), [("print", "<u4"), ("record", "<u4"), ("copies", "<u4")])
    table["print"][slot], table["record"][slot], table["copies"][slot] = fingerprints(keys[first]), first, copies
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = {"width": width, "levels": [len(b) for b in index.levels], "keys": len(first), "records": len(keys)}
    return [json.dumps(head).encode() + b"\n", *(b.astype("<u8").tobytes() for b in index.levels), table.tobytes(), starts.tobytes()]


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        raw = files.read_bytes(path + ".mph")
        line = raw.index(b"\n") + 1
        head, at, levels = json.loads(raw[:line]), line, []
        for n in head["levels"]:
            levels.append(np.frombuffer(raw, "<u8", n, at))
            at += 8 * n
        self.index = KeyIndex(levels)
        self.table = np.frombuffer(raw, [("print", "<u4"), ("record", "<u4"), ("copies", "<u4")], head["keys"], at)
        self.starts = np.frombuffer(raw, "<u8", head["records"] + 1, at + 12 * head["keys"]).astype(np.int64)
        self.dtype = np.dtype(f"<u{head['width']}")
        where, inner = files.open_fs(path + ".ids")
        self.ids = where.open_input_file(inner)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of copies of each key; -1 and 0 if it is absent."""
        slot = self.index.slots(keys)
        entry = self.table[np.maximum(slot, 0)] if len(self.table) else np.zeros(len(keys), self.table.dtype)
        known = (slot >= 0) & (entry["print"] == fingerprints(keys))
        return np.where(known, entry["record"].astype(np.int64), -1), np.where(known, entry["copies"], 0)

    def read(self, record: int) -> np.ndarray:
        start, end = self.starts[record:record + 2]
        self.ids.seek(int(start) * self.dtype.itemsize)
        return np.frombuffer(self.ids.read(int(end - start) * self.dtype.itemsize), self.dtype)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode and write; returns one row per record: ``shard, path, doc_id, copy, n_tokens``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        encoder, shard = encoder_for(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        path = files.fresh_name(folder, f"shard-{shard:06d}", "x")[:-2]
        where, inner = files.open_fs(path + ".ids")
        where.create_dir(inner.rpartition("/")[0], recursive=True)
        keys, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with where.open_output_stream(inner) as out:
            for batch in slices(batches):
                coded = encoder.encode(batch.column("text").to_pylist())
                out.write(b"".join(x for c in coded for x in (c, end)))
                keys.append(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(np.array([len(c) + len(end) for c in coded], np.int64) // encoder.dtype.itemsize)
        key, length = np.concatenate(keys), np.concatenate(lengths)
        if not len(key):
            where.delete_file(inner)
            return
        files.write_bytes(path + ".mph", *index_bytes(key, length, encoder.dtype.itemsize))
        copy = (np.arange(len(key)) - np.searchsorted(key, key, "left")).astype(np.int32)
        for at in range(0, len(key), 100_000):
            part = slice(at, at + 100_000)
            n = len(key[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, np.int32)), pa.array([path] * n), pa.array(key[part]), pa.array(copy[part]), pa.array(length[part])],
                names=["shard", "path", "key", "copy", "n_tokens"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), "text")
    ordered = keyed.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    return stage(ordered.mapInArrow(write, "shard int, path string, key long, copy int, n_tokens long"), "token-keys")


def read_shards(records: DataFrame) -> DataFrame:
    """Look every record up in its shard: ``doc_id, start, n_tokens, ids_crc32``."""
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = stage(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "shard-bases")

    def read(batches):
        opened: dict[str, Shard] = {}
        for batch in batches:
            key, copy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "copy"))
            base, paths = batch.column("base").to_numpy(zero_copy_only=False), np.array(batch.column("path").to_pylist(), object)
            start, n, crc = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for path in dict.fromkeys(paths):
                if path not in opened:
                    opened = {path: Shard(path)}
                shard, mine = opened[path], np.flatnonzero(paths == path)
                record, copies = shard.find(key[mine])
                if (copies <= copy[mine]).any():
                    raise ValueError(f"a key is missing from the index of {path}")
                for i, r in zip(mine, record + copy[mine]):
                    ids = shard.read(r)
                    start[i], n[i], crc[i] = base[i] + shard.starts[r], len(ids), zlib.crc32(ids.astype("<u4").tobytes())
            null = key == NULL_KEY
            yield pa.RecordBatch.from_arrays([pa.array(key, mask=null), pa.array(start), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.select("shard", "path", "key", "copy").join(bases, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and report every document from them."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_shards(write_shards(docs, tokenizer_path))
