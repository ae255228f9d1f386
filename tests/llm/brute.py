"""Plain versions of the operators, for tests. Documents are (id, text) pairs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[\x20\x09-\x0D]+"
NO_ID = 1 << 63


def order(doc_id):
    return NO_ID if doc_id is None else doc_id


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")))


def exact_groups(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(SPACE, " ", t or "")].append(d)
    out = []
    for text, ids in groups.items():
        keep = min(ids, key=order)
        out += [(d, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    return out


def removed(docs, width=100):
    """(id, bytes, removed, spans, digest) per document."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: order(x[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            piece = raw[i:i + width]
            if piece in seen:
                gone[i:i + width] = b"\1" * width
            seen.add(piece)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def similar(docs, least=0.8):
    """(id, class, links, copies) per document."""
    copies = defaultdict(list)
    for d, t in docs:
        copies[words(t)].append(d)
    sets = {w: ({w[i:i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()) for w in copies}
    parent, links, seen = {w: w for w in copies}, Counter(), defaultdict(list)

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for w, s in sets.items():
        common = Counter(o for g in s for o in seen[g])
        for g in s:
            seen[g].append(w)
        for o, n in common.items():
            if n / (len(s) + len(sets[o]) - n) >= least:
                links[w] += 1
                links[o] += 1
                parent[root(w)] = root(o)
    least_id = {}
    for w, ids in copies.items():
        least_id[root(w)] = min([least_id.get(root(w), (NO_ID + 1, None)), *((order(d), d) for d in ids)], key=lambda x: x[0])
    return [(d, least_id[root(w)][1], links[w], len(ids)) for w, ids in copies.items() for d in ids]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def personal(text):
    """(counts by kind, digest) of the base kinds."""
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if _valid(kind, m[0]))
    return (tuple(sum(f[3] == kind for f in found) for kind in PII),
            hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found).encode()).hexdigest())


def source_audit(rows, min_docs=30, top=50):
    """Rows are (lang, source, text)."""
    held, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        kept = sorted((t for (x, t), n in held.items() if x == lang and n >= min_docs), key=str.encode)
        v = len(kept)
        totals = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 5) // (totals[s] + 5 * v) for s in sources for t in kept}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 5) // (sum(totals.values()) + 5 * v) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(share[s, t] - share[o, t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -value, i + 1) for i, (value, _, o) in enumerate(pairs)]
            terms = sorted((whole[t] - share[s, t], t.encode(), t) for t in kept if counts[lang, s, t] and share[s, t] > whole[t])
            out += [(lang, s, "term", t, -value, i + 1) for i, (value, _, t) in enumerate(terms[:top])]
    return out
