"""Character models with plain dictionaries, to compare with."""

import math
from collections import Counter, defaultdict

from onomast.llm import kneser_ney


def model(texts, order, smoothing):
    """A function of a gram (context and character) that gives the character's probability: interpolated Kneser-Ney, modified or not, or Witten-Bell."""
    top = Counter()
    for x in texts:
        padded = "\1" * (order - 1) + x
        top.update(padded[i : i + order] for i in range(len(x)))
    levels = [top]
    for _ in range(order - 1):
        if smoothing == "wb":
            below = Counter()
            for k, c in levels[0].items():
                below[k[1:]] += c
        else:
            below = Counter(k[1:] for k in levels[0])
        levels.insert(0, below)
    base = 1 / 2 ** kneser_ney.bits_of(order)

    def discount(level):
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 0.75, 0.9] if smoothing == "mkn" else [0.75] * 3
        y = n[0] / (n[0] + 2 * n[1])
        if smoothing == "kn":
            return [y] * 3
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 3 * y]
        return [min(max(x, lo), hi) for x, lo, hi in zip(d, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85))]

    ds = [discount(x) for x in levels]
    followers = []
    for level in levels:
        by = defaultdict(list)
        for g, c in level.items():
            by[g[:-1]].append(c)
        followers.append(by)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else base
        own = followers[k - 1].get(gram[:-1])
        if not own:
            return lower
        c, total = levels[k - 1].get(gram, 0), sum(own)
        if smoothing == "wb":
            return c / (total + len(own)) + len(own) / (total + len(own)) * lower
        d = ds[k - 1]
        left = sum(d[min(x, 3) - 1] for x in own) / total
        return (c - d[min(c, 3) - 1] if c else 0) / total + left * lower

    return p


def entropy(p, text, order, upto=None):
    """Nats a character, with contexts of at most ``upto`` - 1 characters."""
    padded = "\1" * (order - 1) + text
    return -sum(math.log(p(padded[i : i + order][order - (upto or order) :])) for i in range(len(text))) / len(text)


def at(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def deviations(rows, long=256):
    """A function of (group, score, n): deviations above the group's median; rows are (group, score, n), each text once."""
    stats = {}
    for g in {r[0] for r in rows}:
        own = [(s, n) for h, s, n in rows if h == g]
        far = [s for s, n in own if n >= long]
        m, s = (at(far, 0.5), max(0.01, (at(far, 0.75) - at(far, 0.25)) / 1.349)) if far else (at([s for s, _ in own], 0.5), 0.1)
        short = [abs(x - m) * math.sqrt(n) for x, n in own if n < long]
        stats[g] = m, s, max(1.0, (at(short, 0.75) if short else 2.0) / 1.15) ** 2
    return lambda g, score, n: (score - stats[g][0]) / math.sqrt(stats[g][1] ** 2 + stats[g][2] / n)
