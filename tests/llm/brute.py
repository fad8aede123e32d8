"""Plain Python versions of the operators, without Spark, to hold results against."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact_copies(docs: list[tuple]) -> set[tuple]:
    """(id, keep_id, group_size, kept, sha) of (id, text) with distinct ids."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[lowered(t)].append(i)
    return {(i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(docs: list[tuple], percent: int = 75) -> dict:
    """id -> (set size, smallest id reachable)."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def cut_repeats(docs: list[tuple], window: int = 35) -> dict:
    """id -> (words, removed, kept text), case unchanged."""
    texts = {i: WORD.findall(t or "") for i, t in docs}
    seen = Counter(tuple(w[k : k + window]) for w in texts.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def part(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def _discounts(counts, top: int = 5) -> dict:
    n = Counter(counts)
    common = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, top + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


class Katz:
    """Bigrams over all words, unknown ones as one class."""

    def __init__(self, texts: list[str]):
        self.uni, pairs = Counter(), defaultdict(Counter)
        for t in texts:
            w = [*words(t), "</s>"]
            self.uni.update(w)
            for a, b in zip(["<s>", *w], w):
                pairs[a][b] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        d1, d2 = _discounts(self.uni.values()), _discounts(c for x in pairs.values() for c in x.values())
        mass = sum(c * d1.get(c, 1) for c in self.uni.values())
        total = self.n if mass < self.n - 1e-9 else self.n + 1
        self.p = {w: c * d1.get(c, 1) / total for w, c in self.uni.items()}
        self.unseen = 1 - mass / total
        self.after = {}
        for h, x in pairs.items():
            c, m, s = sum(x.values()), sum(k * d2.get(k, 1) for k in x.values()), sum(self.p[w] for w in x)
            full = 1 - s < 1e-12
            over = c + 1 if c - m < 1e-9 and not full else c
            self.after[h] = ({w: (k if full else k * d2.get(k, 1)) / over for w, k in x.items()}, 0 if full else (1 - m / over) / (1 - s))

    def prob(self, h: str, w: str | None) -> float:
        seen, weight = self.after.get(h, ({}, 1.0))
        return seen[w] if w in seen else weight * self.p.get(w, self.unseen)

    def score(self, text: str) -> tuple[int, int, float, float]:
        w = [*words(text), "</s>"]
        base = sum(math.log10((self.uni[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(x in self.uni for x in w), base, sum(math.log10(self.prob(a, b)) for a, b in zip(["<s>", *w], w))


def water_fill(sizes: list[int], weights: list[float], epochs: float = 3.0) -> list[float]:
    """Clamp, reshare, repeat."""
    left, target, live = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while live:
        share = left / sum(weights[k] for k in live)
        over = [k for k in live if weights[k] * share > epochs * sizes[k]]
        if not over:
            for k in live:
                target[k] = weights[k] * share
            break
        for k in over:
            target[k] = epochs * sizes[k]
            left -= target[k]
        live = [k for k in live if k not in over]
    return target


def mixed(docs: list[tuple], epochs: float = 3.0, seed: int = 11) -> dict:
    """id -> (size, source size, target, times) of (id, text, source) with distinct ids."""
    size = {i: len(words(t)) for i, t, _ in docs}
    of = defaultdict(list)
    for i, _, s in docs:
        of[s].append(i)
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i in of[s]) for s in sources]
    out = {}
    for s, n, target in zip(sources, total, water_fill(total, [k % 3 + 1 for k in range(len(sources))], epochs)):
        whole = math.floor(target / n + 1e-12) if n else 0
        more, upto = target - whole * n, 0
        for i in sorted(of[s], key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()):
            upto += size[i]
            out[i] = (size[i], n, target, (whole + (upto - size[i] / 2 <= more and more > 1e-6)) if size[i] else 0)
    return out


LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def repair_cost(roles: list[str], merge: float = 1, relabel: float = 2, insert: float = 3) -> float:
    """The cheapest repair by relaxing over (turns read, last role) until nothing changes."""
    cost = {(0, "start"): 0.0}
    for k in range(len(roles) + 1):
        for _ in range(5):
            for (at, last), c in list(cost.items()):
                if at == k:
                    for r in LEGAL[last]:
                        cost[k, r] = min(cost.get((k, r), 1e9), c + insert)
        if k < len(roles):
            for (at, last), c in list(cost.items()):
                if at == k:
                    for r in LEGAL["start"] + ("assistant",):
                        step = relabel * (r != roles[k])
                        if r in LEGAL[last]:
                            cost[k + 1, r] = min(cost.get((k + 1, r), 1e9), c + step)
                        if r == last:
                            cost[k + 1, r] = min(cost.get((k + 1, r), 1e9), c + step + merge)
    return min(cost.get((len(roles), r), 1e9) for r in ("assistant", "start"))
