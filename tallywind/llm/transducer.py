"""Minimal acyclic transducers: sorted terms as shared states, each term's ordinal as the sum along its path.

States are built from terms in ascending byte order and merged as soon as no later term can change them. A transition adds the number of
terms that sort before those it leads to, so a walk from the root ends with the term's lexicographic ordinal, and a walk the other way
spells the term of an ordinal. In memory a state is a bitmap of its labels; its transitions stand in a row, the place of one is the
number of smaller labels. Many terms are walked at once, one byte of each at a time.
"""

from __future__ import annotations

import json

import numpy as np

from . import files


def build(terms) -> "Transducer":
    """From distinct byte strings in ascending order."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def settle(node: list) -> int:
        key = (node[0], bytes(node[1]), tuple(node[2]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
        return at

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            done = settle(path.pop())
            path[-1][2].append(done)

    path, before = [[False, [], []]], b""
    for term in terms:
        shared = 0
        for x, y in zip(before, term):
            if x != y:
                break
            shared += 1
        close(shared)
        for b in term[shared:]:
            path[-1][1].append(b)
            path.append([False, [], []])
        path[-1][0] = True
        before = term
    close(0)
    root = settle(path[0])

    n = len(states)
    final = np.fromiter((s[0] for s in states), bool, n)
    degree = np.fromiter((len(s[1]) for s in states), np.int64, n)
    first = np.cumsum(degree) - degree
    labels = np.frombuffer(b"".join(s[1] for s in states), np.uint8)
    target = np.fromiter((t for s in states for t in s[2]), np.int64, int(degree.sum()))
    skip, below = np.zeros(len(target), np.int64), [0] * n
    at = 0
    for i, (ends, _, targets) in enumerate(states):  # targets settle before their sources
        total = int(ends)
        for t in targets:
            skip[at] = total
            total += below[t]
            at += 1
        below[i] = total
    return Transducer(root, final, first, labels, target, skip)


class Transducer:
    def __init__(self, root: int, final: np.ndarray, first: np.ndarray, labels: np.ndarray, target: np.ndarray, skip: np.ndarray):
        self.root, self.final, self.first, self.labels, self.target, self.skip = root, final, first, labels, target, skip
        n = len(final)
        degree = np.diff(np.append(first, len(labels)))
        owner = np.repeat(np.arange(n), degree)
        self.bits = np.zeros((n, 4), np.uint64)
        np.bitwise_or.at(self.bits, (owner, labels >> 6), np.uint64(1) << (labels & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.places = first[:, None] + np.cumsum(counts, axis=1) - counts

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.final, self.first, self.labels, self.target, self.skip, self.bits, self.places))

    def ordinals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each data[begin:end], -1 for those that are no term."""
        out = np.full(len(begin), -1, np.int64)
        who, state, total, at = np.arange(len(begin)), np.full(len(begin), self.root), np.zeros(len(begin), np.int64), begin.astype(np.int64)
        while len(who):
            over = at == end[who]
            if over.any():
                last = over & self.final[state]
                out[who[last]] = total[last]
                who, state, total, at = who[~over], state[~over], total[~over], at[~over]
                continue
            label = data[at]
            word, bit = label >> 6, np.uint64(1) << (label & 63).astype(np.uint64)
            bits = self.bits[state, word]
            go = (bits & bit) != 0
            who, state, word, at = who[go], state[go], word[go], at[go] + 1
            edge = self.places[state, word] + np.bitwise_count(bits[go] & (bit[go] - np.uint64(1)))
            total, state = total[go] + self.skip[edge], self.target[edge]
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        state, spelled = self.root, bytearray()
        while not (self.final[state] and ordinal == 0):
            a = self.first[state]
            b = self.first[state + 1] if state + 1 < len(self.first) else len(self.labels)
            edge = a + int(np.searchsorted(self.skip[a:b], ordinal, "right")) - 1
            spelled.append(int(self.labels[edge]))
            ordinal, state = ordinal - int(self.skip[edge]), int(self.target[edge])
        return bytes(spelled)

    _ARRAYS = (("final", "u1"), ("first", "<i8"), ("labels", "u1"), ("target", "<i8"), ("skip", "<i8"))

    def write(self, path: str) -> None:
        head = {"root": self.root, "states": len(self.final), "edges": len(self.labels)}
        files.write_bytes(path, json.dumps(head).encode() + b"\n", *(getattr(self, name).astype(kind).tobytes() for name, kind in self._ARRAYS))

    @classmethod
    def read(cls, path: str) -> "Transducer":
        raw = files.read_bytes(path)
        at = raw.index(b"\n") + 1
        head, arrays = json.loads(raw[:at]), []
        for name, kind in cls._ARRAYS:
            part = np.frombuffer(raw, kind, head["states"] if name in ("final", "first") else head["edges"], at)
            at += part.nbytes
            arrays.append(part.astype(bool) if name == "final" else part)
        return cls(head["root"], *arrays)
