"""Plain Python forms of the operators' contracts, row by row, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def private(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for match in re.finditer(pattern, text or ""):
            digits = [int(c) for c in match[0] if c in "0123456789"]
            good = {
                "email": True,
                "ip": all(int(part) <= 255 for part in match[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((match.start(), rank, match.end()))
    spans.sort()
    counts = [sum(rank == k for _, rank, _ in spans) for k in range(4)]
    said = ",".join(f"{PATTERNS[rank][0]}:{a}:{b}" for a, rank, b in spans)
    return (*counts, sha(said), said)


def unigrams(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) per row."""
    counts = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 7) != 2:
            counts.update([*spaced(text), None])
    total, size = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    out = []
    for doc_id, text in rows:
        tokens = [*spaced(text), None]
        score = sum(math.log10((counts[t] + 1) / size) for t in tokens)
        known = sum(counts[t] > 0 for t in tokens)
        out.append((doc_id, remainder(doc_id, 7) == 2, len(tokens), known, total, score))
    return out


def shingles(text, size=4):
    words = spaced(text)
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def near_groups(rows, size=4, share=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [(doc_id, shingles(text, size)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, left) in enumerate(sets):
        for b, right in sets[:k]:
            same = len(left & right)
            if same and 100 * same >= share * (len(left) + len(right) - same):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]
