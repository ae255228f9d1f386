"""Token counts of whole texts with a shortcut for strings that are one token.

Offline, once per tokenizer: every vocabulary string is given to the tokenizers library as a text of its own. Where its pre-tokenizer
leaves the string whole and the merges end in one token, the string is proven; wherever the pre-tokenizer cuts such a string out of a
text, it counts as one, since merges see nothing but the pre-token. The proven strings (at most the vocabulary) are broadcast.

Per text: special strings are cut out as the library does by default and count as one each. What is between them is cut before each
space that follows a visible character. The byte-level pre-tokenizer always cuts there (no alternative of its pattern has a space after
another visible character, and white space leaves its last space to the next word), so the parts can be counted one by one, and each
distinct part once. A part is split by the pattern of the pre-tokenizer (written out for characters up to U+024F, else by the library
itself); proven pre-tokens count one, the rest is merged by the library's model. Counts are kept between texts, those of at most
``KEEP`` characters and about ``CACHE`` of them.

The proof holds for a byte-level BPE without a normaliser, a prefix space or dropout and with special strings that take nothing from
their neighbours. Any other ``.json`` file, and every ``.model`` file (sentencepiece), is counted by its library over the whole text.

Null texts are empty: no bytes, no tokens. Very long texts are cut and counted in windows of ``WINDOW`` characters that end at such a
cut, so memory stays bounded unless the text has no space. Repeated rows, ids and null ids give a row each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import slices

LIMIT = 1024
KEEP, CACHE, WINDOW = 64, 600_000, 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")
# White space before a space: where none of these occurs, each space follows a visible character or begins the text.
_LATE_SPACES = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_LATE_ASCII = [x for x in _LATE_SPACES if x.isascii()]


def _early_pattern() -> tuple[re.Pattern, re.Pattern]:
    """What has letters beyond U+024F, and the byte-level pattern written out for the letters, numbers and white space up to there."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    space = "\t-\r \x85\xa0"
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile("[^\0-\u024f]"), re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


_LATER, _EARLY = _early_pattern()


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: itself if it is printable Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor already use its cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def provable(path: str) -> bool:
    """Whether the file is a tokenizer for which the shortcut holds."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
        and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def prove_whole(path: str) -> list[str]:
    """Vocabulary strings, in the pre-tokenizer's letters, that encode alone as exactly one token."""
    tokenizer = load_tokenizer(path)
    code = {letter: b for b, letter in enumerate(byte_letters())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    found = []
    for letters in sorted(set(tokenizer.get_vocab(with_added_tokens=False)) - special):
        try:
            text = bytes(code[x] for x in letters).decode()
        except (KeyError, UnicodeDecodeError):  # no text encodes to such a string alone
            continue
        found.append((letters, text))
    whole = []
    for at in range(0, len(found), 10_000):
        part = found[at:at + 10_000]
        for (letters, text), e in zip(part, tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
            if len(e.ids) == 1 and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [letters]:
                whole.append(letters)
    return whole


def windows(text: str, size: int = WINDOW):
    """The text in stretches of about ``size`` characters, cut only before a space that follows a visible character."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Kept(dict):
    """Results that are computed when first asked for; those of long strings are not kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str):
        found = self.compute(key)
        if len(key) <= KEEP:
            self[key] = found
        return found

    def trim(self) -> None:
        """The older half goes when there are too many."""
        if len(self) > CACHE:
            for key in list(islice(self, len(self) // 2)):
                del self[key]


def parts_of(text: str):
    """The text's parts, window by window: the first one of each, and the later ones without the space they begin with."""
    for stretch in windows(text):
        if any(x in stretch for x in (_LATE_ASCII if stretch.isascii() else _LATE_SPACES)):
            parts = _CUT.split(stretch)
            yield parts[0], [p[1:] for p in islice(parts, 1, None)]
        else:
            parts = stretch.split(" ")
            yield parts[0], islice(parts, 1, None)


def is_early(text: str) -> bool:
    """No character beyond U+024F."""
    return text.isascii() or not _LATER.search(text)


class Pretokens:
    """Pre-tokens of a part, in the vocabulary's letters."""

    def __init__(self, tokenizer):
        self.letters = dict(enumerate(byte_letters()))
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def of(self, part: str) -> list[str]:
        if not part:
            return []
        return [*map(self.spelled, _EARLY.findall(part))] if is_early(part) else [p for p, _ in self.cut(part)]

    def spelled(self, pretoken: str) -> str:
        """Its bytes as the vocabulary's letters."""
        return pretoken.encode().decode("latin-1").translate(self.letters)


class ShortcutCounter:
    """Counts by proven strings and merges."""

    def __init__(self, path: str, whole: list[str]):
        self.tokenizer = load_tokenizer(path)
        self.pretokens, self.merge = Pretokens(self.tokenizer), self.tokenizer.model.tokenize
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = frozenset(whole)
        self.merged = Kept(lambda p: len(self.merge(p)))
        self.first = Kept(self._part)
        self.later = Kept(lambda p: self._part(" " + p))

    def _part(self, part: str) -> int:
        return sum(1 if p in self.whole else self.merged[p] for p in self.pretokens.of(part))

    def _plain(self, text: str) -> int:
        return sum(self.first[start] + sum(map(self.later.__getitem__, later)) for start, later in parts_of(text))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self._plain, between))

    def batch(self, texts: list[str | None]) -> list[int]:
        for kept in (self.merged, self.first, self.later):
            kept.trim()
        return [self.count(t) if t else 0 for t in texts]


class LibraryCounter:
    """Counts whole texts by the library that belongs to the file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: map(len, model.encode(texts, num_threads=1))
        else:
            tokenizer = load_tokenizer(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: (len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def batch(self, texts: list[str | None]) -> list[int]:
        return list(self.encode([t or "" for t in texts]))


_counters: dict[str, ShortcutCounter | LibraryCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(tokenizer_path) if provable(tokenizer_path) else None)

    def count(batches):
        counter = _counters.get(tokenizer_path)
        if counter is None:  # one per worker process, so that its parts serve the next task too
            counter = _counters[tokenizer_path] = LibraryCounter(tokenizer_path) if whole.value is None else ShortcutCounter(tokenizer_path, whole.value)
        for batch in slices(batches):
            n = np.array(counter.batch(batch.column("text").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
