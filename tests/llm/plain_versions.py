"""Brute-force versions that several tests share."""

import math
from fractions import Fraction


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else []))


def least_of_group(texts):
    """For each place, the first place that similar texts lead it to."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def tempered(shares, exponent):
    raised = [s**exponent for s in shares]
    return [r / sum(raised) for r in raised]


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def most_repeated(shares, exponent):
    """Passes over the most repeated source when the least repeated one is seen once."""
    passes = [w / s for w, s in zip(tempered(shares, exponent), shares)]
    return max(passes) / min(passes)
