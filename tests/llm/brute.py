"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(t or "")


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op2(docs, k=4):
    sets = {}
    for i, t in docs:
        w = words(lower_az(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    edges = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    comp = components(sets, edges)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def op4(docs, n=13):
    first = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            first[x] = min(i, first.get(x, i))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def targets(sizes):
    """Raise a common level until the budget is met: repeated sharing, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    budget, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
    return target


def op7(docs, items, n=13):
    grams = defaultdict(set)
    for i, t in items:
        w = TOKEN.findall(lower_az(t or ""))
        k = min(n, len(w))
        for j in range(len(w) - k + 1) if w else ():
            grams[tuple(w[j : j + k])].add(i)
    lengths = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = TOKEN.findall(lower_az(t or ""))
        hit, ids = set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if (found := grams.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def crc(i):
    return zlib.crc32(str(i).encode())


def op8_base(docs):
    tokens = {i: words(lower_az(t or "")) + [""] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (crc(i) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def tokens(t):
    return words(lower_az(t or "")) + [""]


def word_counts(docs):
    return dict(Counter(w for _, t in docs for w in tokens(t)))


def class_model(train, test, of, k):
    """Class counts and log10 probabilities of texts, from words' counts and classes; words seen once stand for new ones too."""
    n = np.zeros((k + 1, k + 1))
    once = {w for w, (c, _) in of.items() if c == 1}
    for _, t in train:
        ws = tokens(t)
        for a, b in zip([""] + ws, ws):
            x, y = of[a][1], of[b][1]
            n[x, y] += 1
            n[k, y] += a in once
            n[x, k] += b in once
            n[k, k] += a in once and b in once
    size = np.zeros(k + 1)
    for c, x in of.values():
        size[x] += c
    share = (size + 1) / (size + 1).sum()
    new = max(1, len(once))
    out = []
    for i, t in test:
        ws, total = tokens(t), 0.0
        for a, b in zip([""] + ws, ws):
            x, y = (of[w][1] if w in of else k for w in (a, b))
            total += math.log10((n[x, y] + share[y]) / (n[x].sum() + 1))
            total += math.log10(of[b][0] / size[y] if b in of else 1 / new)
        out.append((i, total))
    return n, out


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower_az(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def op10(rows, least=0.9):
    good = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    edges = []
    if ids:
        m = np.array([good[i] for i in ids])
        a, b = np.nonzero(np.triu(m @ m.T >= least, 1))
        edges = [(ids[x], ids[y]) for x, y in zip(a, b)]
    n = Counter(x for e in edges for x in e)
    comp = components([i for i, _ in rows], edges)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}
