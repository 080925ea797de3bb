"""ProbMinHash signatures, vectorised over the documents of a batch.

A document is a set of 64-bit elements with weights. Element d of weight w arrives as a Poisson
process of rate w whose times and target components are hashes of d; a component keeps the element of
its earliest arrival. Two documents agree in a component with their probability Jaccard similarity.
Arrivals are made in order for all elements at once, up to a horizon; an element stops at its first
arrival beyond it. Documents in which a component is still empty get a further horizon, so
the signature is exact, whatever the first one was.
"""

from __future__ import annotations

import math

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, weights: np.ndarray, edges: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """documents x k elements; a document without elements has zeros. edges: where documents begin, and the end."""
    docs = len(edges) - 1
    sizes = np.diff(edges)
    out = np.zeros((docs, k), np.uint64)
    if not len(elements):
        return out
    total = np.add.reduceat(np.append(weights, 0.0), np.minimum(edges[:-1], len(weights)))
    total = np.where(sizes > 0, total, 1.0)
    best = np.full(docs * k, np.inf)
    owner = np.repeat(np.arange(docs), sizes)
    time = np.zeros(len(elements))
    count = np.zeros(len(elements), np.uint64)
    salted = mix64(elements ^ np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))
    horizon = k * (math.log(k) + 3.0) / total
    pending = np.flatnonzero(sizes > 0)
    flat_out = out.reshape(-1)
    with np.errstate(over="ignore"):
        while len(pending):
            is_pending = np.zeros(docs, bool)
            is_pending[pending] = True
            alive = np.flatnonzero(is_pending[owner])
            while len(alive):
                n = count[alive] + np.uint64(1)
                h = mix64(salted[alive] + n * _GOLD)
                t = time[alive] - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weights[alive]
                within = t <= horizon[owner[alive]]
                # an element beyond the horizon keeps its state: the same arrival comes again if the horizon moves
                alive, t, n = alive[within], t[within], n[within]
                time[alive], count[alive] = t, n
                slot = owner[alive] * k + (mix64(salted[alive] ^ (n * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, slot, t)
                first = best[slot] == t
                flat_out[slot[first]] = elements[alive[first]]
            pending = pending[np.isinf(best.reshape(docs, k)[pending]).any(1)]
            horizon[pending] *= 2
    return out


def bands(signature: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """documents x (k / rows) hashes of the bands."""
    docs, k = signature.shape
    parts = signature.reshape(docs, k // rows, rows)
    with np.errstate(over="ignore"):
        h = mix64(np.arange(1, k // rows + 1, dtype=np.uint64) * _GOLD + np.uint64(seed))[None, :].repeat(docs, 0)
        for r in range(rows):
            h = mix64(h ^ parts[:, :, r]) + _GOLD
    return h.view(np.int64)
