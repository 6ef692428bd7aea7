"""Plain, slow versions of the corpus operators, to compare with."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split((text or "").translate(ASCII_LOWER)) if w]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    """(kind, start, end) of the base, by start and then kind."""
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(docs, k, percent):
    """{doc_id: (n_shingles, smallest id reachable)} of {doc_id: text}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def lm_base(rows):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)} of (doc_id, text) rows."""
    counts = Counter()
    for d, t in rows:
        if d is not None and fold(d) != 1:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in rows:
        tokens = [*words(t), None]
        out[d] = (len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens))
    return out
