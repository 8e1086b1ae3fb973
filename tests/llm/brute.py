"""Plain versions of what the operators compute, for small inputs."""

import math
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, n, threshold):
    """docs: list of (id, text). Component id by position in the list."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_row = docs[i][0] == docs[j][0] and docs[i][0] is not None
            if docs[i][0] is None or docs[j][0] is None:
                continue
            if (both and 100 * both >= threshold * len(sets[i] | sets[j])) or (same_row and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        group = [docs[j][0] for j in range(len(docs)) if find(j) == find(i)]
        out.append(d if not sets[i] or d is None else min(group))
    return out


def repeats(docs, length):
    """docs: list of (id, text). For each the removed mask as a string of 0 and 1."""
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                k = b[i : i + length]
                first[k] = min(first.get(k, d), d)
    out = []
    for d, b in data:
        mask = [0] * len(b)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                mask[i : i + length] = [1] * length
        out.append(mask)
    return out


def rules(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(covered)


def bm25(docs, query, k, strip):
    """docs: list of (id, text); the best k as (score, id)."""
    terms = [Counter(x for x in (v.strip(strip) for v in (t or "").encode().lower().split()) if x) for _, t in docs]
    asked = Counter(x for x in (v.strip(strip) for v in query.encode().lower().split()) if x)
    n, lengths = len(docs), [sum(c.values()) for c in terms]
    mean, df = sum(lengths) / n, Counter(t for c in terms for t in c)
    out = []
    for (d, _), c, size in zip(docs, terms, lengths, strict=True):
        s = sum(q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t, q in asked.items() if t in c)
        if s > 0:
            out.append((-round(s, 6), d))
    return sorted(out)[:k]
