"""Brute-force versions of the contracts, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def space_words(text):
    return (text or "").encode().translate(LOWER).split()


def letter_words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().translate(LOWER))


def contamination(docs, items):
    """doc_id to (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        words = letter_words(text)
        n = min(13, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[at : at + n])].add("" if item is None else str(item))
    lengths, out = {len(w) for w in windows}, {}
    for doc, text in docs:
        words, hit, found = letter_words(text), set(), set()
        for n in lengths:
            for at in range(len(words) - n + 1):
                if (key := tuple(words[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[key]
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def classes(docs, n=4, percent=85):
    """doc_id to (set size, least doc_id that links reach)."""
    sets = {}
    for doc, text in docs:
        words = space_words(text)
        k = min(n, len(words))
        sets[doc] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text, spans = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def targets(sizes):
    """source to (size, target) for {source: words}; sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        rest, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return {s: (sizes[s], target[s]) for s in order}


def held(doc, n, k):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % n == k


def word_model(docs):
    """doc_id to (held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math

    counts, ends = Counter(), 0
    for doc, text in docs:
        if not held(doc, 5, 1):
            counts.update(space_words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    score = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    return {d: (held(d, 5, 1), len(w := space_words(t)) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n, sum(score(counts[x]) for x in w) + score(ends)) for d, t in docs}
