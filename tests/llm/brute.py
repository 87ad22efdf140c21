"""The contracts, written down plainly for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WHITE = "[ \t\n\x0b\x0c\r]"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[re.sub(WHITE, "", text or "")].append((-len(text or ""), doc))
    out = []
    for doc, text in docs:
        key = re.sub(WHITE, "", text or "")
        keep = min(groups[key])[1]
        out.append((doc, keep, len(groups[key]), doc == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def lines(docs, least=40, enough=5):
    def key(line):
        return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))

    seen = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                seen[key(line)].add(doc)
    out = []
    for doc, text in docs:
        old = (text or "").split("\n")
        new = [x for x in old if not (len(key(x)) >= least and len(seen[key(x)]) >= enough and doc < max(seen[key(x)]))]
        out.append((doc, len(old), len(old) - len(new), "\n".join(new)))
    return sorted(out)


def simhash(docs, n=4, radius=4):
    fps = []
    for _, text in docs:
        w = words(ascii_lower(text or ""))
        shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    ids = [d for d, _ in docs]
    return [(d, f, c) for d, f, c in zip(ids, fps, components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius], ids), strict=True)]


def components(n, links, ids):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if ids[x] > ids[y]:
            x, y = y, x
        root[y] = x
    return [ids[find(i)] for i in range(n)]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Resharing of what is above the caps until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def token_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def pieces(docs, size=1024):
    out = []
    for (doc, _), ids in zip(docs, token_ids([t for _, t in docs], 2), strict=True):
        n = -(-len(ids) // size)
        first = len(ids) - (n - 1) * size
        at = [0, *[first + i * size for i in range(n)]]
        out += [(doc, i, at[i], at[i + 1] - at[i], zlib.crc32(ids[at[i] : at[i + 1]].tobytes())) for i in range(n)]
    return sorted(out)


def check_packing(rows, expected, size=1024):
    """rows: doc_id, piece, start, length, crc, sequence, offset."""
    assert Counter(tuple(r[:5]) for r in rows) == Counter(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r[5]].append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def similarities(docs, n=5):
    """Jaccard similarities of shingle sets, by pairs of places; texts without words are alike."""
    sets = []
    for _, text in docs:
        w = words(ascii_lower(text or ""))
        sets.append({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {""}:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    return {(a, b): k / len((sets[a] | sets[b]) or {""}) for (a, b), k in shared.items()}
