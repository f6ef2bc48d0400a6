"""Plain definitions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def words(text) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text, size: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def near_duplicates(rows: list[tuple], size: int, percent: int = 80) -> dict:
    """id -> (set size, component, kept) over all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def covered(rows: list[tuple], length: int = 100) -> dict:
    """id -> (bytes, spans that start earlier too); rows in order of id, ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b, spans = (text or "").encode(), []
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
            seen.add(s)
        out[i] = (b, [tuple(s) for s in spans])
    return out


def without(b: bytes, spans: list[tuple]) -> bytes:
    keep = bytearray()
    at = 0
    for lo, hi in spans:
        keep += b[at:lo]
        at = hi
    return bytes(keep + b[at:])


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def unigrams(rows: list[tuple], held: dict) -> tuple[dict, int]:
    """id -> (tokens, known, log10 score), and the number of training tokens."""
    tokens = {i: [*words(t), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    unit = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), sum(map(unit, ws))) for i, ws in tokens.items()}, n


def clusters(rows: list[tuple], k: int, rounds: int, prefix: str, dims: int) -> dict:
    """row number -> (cluster, distance); rows are (id, integer vector)."""

    def start(row):
        i, v = row
        return (i is None, hashlib.sha256(f"{prefix}{i}".encode()).hexdigest() if i is not None else "", v)

    centroids = [list(v) for _, v in sorted(rows, key=start)[:k]]
    found = {}
    for left in range(rounds, -1, -1):
        for n, (_, v) in enumerate(rows):
            far = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            found[n] = (far.index(min(far)), min(far))
        for j in range(len(centroids)) if left else ():
            own = [v for n, (_, v) in enumerate(rows) if found[n][0] == j]
            if own:
                centroids[j] = [sum(v[d] for v in own) // len(own) for d in range(dims)]
    return found


def pieces(text) -> list[list[bytes]]:
    lower = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return [re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0A-\x0D]", lower)]


def collocations(rows: list[tuple], least: int, report: int, longest: int = 5) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    out = []
    for lang in {lang or "und" for _, lang in rows}:
        runs = [p for text, own in rows if (own or "und") == lang for p in pieces(text)]
        f = Counter(tuple(p[i : i + m]) for p in runs for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        n, many = sum(map(len, runs)), {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inner = Counter()
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        scored = []
        for p, a in many.items():
            if 100 * inner[p] >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, b" ".join(p), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:report], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def attention_score(p: dict, classes: list[int], shape) -> float:
    """log10 probability of a sequence of classes: each class after those of its window before it, by itself.

    The window of place i begins where the half before that of i begins; before the text stands START.
    """
    total = 0.0
    for i, target in enumerate(classes):
        first = (i // shape.HALF) * shape.HALF - shape.HALF - 1
        seen = [classes[j] if j >= 0 else shape.START for j in range(first, i)]
        h = [p["embed"][c] + p["place"][at] for at, c in enumerate(seen)]
        q = h[-1] @ p["q"]
        weights = [math.exp(q @ (x @ p["k"]) / math.sqrt(shape.WIDTH)) for x in h]
        mixed = sum(w * (x @ p["v"]) for w, x in zip(weights, h)) / sum(weights)
        r = h[-1] + mixed @ p["o"]
        z = r + [max(v, 0.0) for v in r @ p["w1"] + p["b1"]] @ p["w2"]
        high, low = divmod(target, shape.BRANCH)
        top = z @ p["top"] + p["top_bias"]
        inner = z @ p["low"][high] + p["low_bias"][high]
        total += top[high] - math.log(sum(map(math.exp, top))) + inner[low] - math.log(sum(map(math.exp, inner)))
    return total / math.log(10)
