"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, and its parts are rebuilt as a tokenizers pipeline: the normaliser (character map, white space, the
``\\u2581`` marker), the pre-tokenizer (words with their marker), the model (byte-pair merges in the order of the pieces' scores, or
unigram scores) with byte fallback, and the decoder. Where no piece of the vocabulary crosses from a visible character to a marker or
touches a line break, words are independent: each distinct word of a task is encoded once, many in one multithreaded batch.

All ids are the rebuilt tokenizer's. Parity: every newly met word is also encoded by the sentencepiece library; where the two differ,
the document's ``parity`` is false. ``round_trip`` tells whether decoding gives the text back (false only if the text
itself has the marker character, or the model's normaliser changes it).

Null or empty texts give no ids and an empty decoded text. Repeated rows get equal results, an empty table an empty one; other columns
are ignored. A text is worked on whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import slices

MARKER = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
CACHE, TOGETHER = 300_000, 500
_RUNS = re.compile(" *[^ ]+| +")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes):
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """The parts of a model file."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @classmethod
    def parse(cls, raw: bytes) -> "PieceModel":
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), trainer.get(40, 0))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces into a third, best score first."""
        normal = {p for p, _, kind in self.pieces if kind == NORMAL}
        ranked = sorted((i for i, p in enumerate(self.pieces) if p[2] == NORMAL), key=lambda i: (-self.pieces[i][1], i))
        words = (self.pieces[i][0] for i in ranked)
        return [(w[:k], w[k:]) for w in words for k in range(1, len(w)) if w[:k] in normal and w[k:] in normal]

    def words_are_independent(self) -> bool:
        return not any(MARKER in p.lstrip(MARKER) or "\n" in p for p, _, kind in self.pieces if kind == NORMAL) and not self.charsmap and not self.squeeze and self.dummy_prefix


def build_tokenizer(model: PieceModel):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unknown_id][0]
    if model.kind == BPE:
        core = models.BPE(vocab=vocabulary, merges=model.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown_id, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARKER)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    if model.words_are_independent():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes and decodes texts; knows on which words the other library differs."""

    def __init__(self, path: str, threads: int = 2):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        with open(path, "rb") as data:  # the model belongs to the installation of every worker, it is no input
            self.model = PieceModel.parse(data.read())
        self.tokenizer = build_tokenizer(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("<u2" if len(self.model.pieces) <= 1 << 16 else "<u4")
        self.starts_word = np.array([p.startswith(MARKER) for p, _, _ in self.model.pieces])
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else (" ⁇ " if kind == UNKNOWN else p.replace(MARKER, " ")).encode() for p, _, kind in self.model.pieces]
        self.split = self.model.words_are_independent()
        self.heads: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.unequal: set[str] = set()
        self.line = np.array(self._alone("\n")[1:], self.dtype).tobytes() if self.split else b""

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_alone(self, known: dict[str, bytes], words: list[str], lead: str) -> None:
        """Encode words one by one after a line break, which nothing is merged with, and ``lead``."""
        texts, skip = [f"\n{lead}{w}" for w in words], len(self._alone("\n"))
        mine = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        for w, a, b in zip(words, mine, self.other.encode(texts, num_threads=1) if texts else []):
            if a.ids != b:
                self.unequal.add(lead + w)
            known[w] = np.array(a.ids[skip:], self.dtype).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Words after a marker, many to a text; those with further spaces alone, and those of a text on which the libraries differ."""
        new = [w for w in words if w not in self.later]
        plain = [w for w in new if w and " " not in w]
        groups = [plain[at:at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for at in range(0, len(groups), 16):
            texts = [" ".join(g) for g in groups[at:at + 16]]
            coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for group, mine, theirs in zip(groups[at:at + 16], coded, self.other.encode(texts, num_threads=1)):
                ids = np.array(mine.ids, self.dtype)
                cuts = np.flatnonzero(self.starts_word[ids]) * self.dtype.itemsize
                if mine.ids == theirs and len(cuts) == len(group):
                    self.later.update(zip(group, map(ids.tobytes().__getitem__, map(slice, cuts.tolist(), [*cuts[1:].tolist(), ids.nbytes]))))
        self._learn_alone(self.later, [w for w in new if w not in self.later], " ")

    @staticmethod
    def _cut(line: str) -> tuple[str | None, list[str]]:
        """What stands before the first marker, if anything, and the words after a marker each."""
        if "  " not in line:
            head, *words = line.split(" ")
            return head or None, words
        runs = _RUNS.findall(line)
        head = runs.pop(0) if runs[0][0] != " " else None
        return head, [w[1:] for w in runs]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, packed, and whether both libraries agree on it."""
        texts = [text or "" for text in texts]
        if not self.split:
            mine = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.other.encode(texts, num_threads=1)
            return [np.array(x, self.dtype).tobytes() for x in mine], [a == b for a, b in zip(mine, theirs)]
        plans = [[self._cut(line) for line in (" " + text.replace(MARKER, " ")).split("\n")] if text else [] for text in texts]
        later = set().union(*(words for plan in plans for _, words in plan))
        if len(self.later) + len(self.heads) > CACHE:  # only what this batch has stays
            self.heads, self.later = {}, {w: x for w in later if (x := self.later.get(w)) is not None}
        self._learn(later)
        self._learn_alone(self.heads, [h for h in {head for plan in plans for head, _ in plan} if h is not None and h not in self.heads], "")
        get, odd = self.later.__getitem__, self.unequal
        coded = [self.line.join((self.heads[head] if head else b"") + b"".join(map(get, words)) for head, words in plan) for plan in plans]
        agree = [not odd or not any(head in odd or any(" " + w in odd for w in words) for head, words in plan) for plan in plans]
        return coded, agree

    def decode(self, packed: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, self.dtype).tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec_for(path: str) -> Codec:
    """One codec per worker process, so that its words serve the next task too."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, token_ids, n_tokens, parity, round_trip``."""
    path = model_path or default_model()

    def run(batches):
        codec = codec_for(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            coded, agree = codec.encode(texts)
            ids = np.frombuffer(b"".join(coded), codec.dtype).astype(np.int32)
            sizes = np.array([len(c) for c in coded]) // codec.dtype.itemsize
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
            back = [codec.decode(c) == (t or "") for c, t in zip(coded, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes.astype(np.int64)), pa.array(agree), pa.array(back)],
                                             names=["doc_id", "token_ids", "n_tokens", "parity", "round_trip"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, token_ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(coded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The texts of ``token_ids``: ``doc_id, text``."""
    path = model_path or default_model()

    def run(batches):
        codec = codec_for(path)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], codec.dtype).tobytes()) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def codec_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_crc32`` (of little-endian unsigned 32-bit ids), ``decoded_sha256, parity, round_trip``."""
    path = model_path or default_model()

    def run(batches):
        codec = codec_for(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            coded, agree = codec.encode(texts)
            back = [codec.decode(c) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(c) // codec.dtype.itemsize for c in coded], pa.int64()),
                 pa.array([zlib.crc32(np.frombuffer(c, codec.dtype).astype("<u4").tobytes()) for c in coded], pa.int64()),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array(agree), pa.array([b == (t or "") for b, t in zip(back, texts)])],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "parity", "round_trip"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_crc32 long, decoded_sha256 string, parity boolean, round_trip boolean")
