"""Brute-force versions that several tests share."""

from collections import defaultdict

import xxhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= set(over)


def brute_hits(text, items):
    def words(t):
        out = "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isalnum() else " " for c in t or "")
        return [w for w in out.replace(" ", " ").split(" ") if w]
    doc = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i:i + 10]
            for j in range(len(doc) - len(win) + 1):
                if doc[j:j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def brute_lines(rows, min_sites):
    texts = defaultdict(set)
    for _, t, s in rows:
        texts[t or ""].add("" if s is None else "=" + s)
    sites = defaultdict(set)
    for t, s in texts.items():
        for line in t.split("\n"):
            sites[line.strip(" \t\r")].add(min(s))
    gone = {line for line, s in sites.items() if line and len(s) >= min_sites}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\r") not in gone]
        out.append((i, t if t is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)
