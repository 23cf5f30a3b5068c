"""DartMinHash (Christiani, 2020): weighted MinHash signatures at a cost that hardly grows with the number of coordinates.

Over the plane of weight and rank, darts fall as a Poisson process that only the hash of an element seeds. An element of
weight x owns the strip of weights below x, and a dart there hits. Each dart names a coordinate; the hit of least rank is
the coordinate's value. The plane is cut into regions, dyadic in weight and rank, whose darts can be thrown one region at
a time, so that a set throws only the darts whose rank is low enough to matter: about k (ln k + 2) in all.
"""

from __future__ import annotations

import numpy as np

LOWEST = -6  # the first slab of ranks is [0, 2^LOWEST), the next ones are [2^e, 2^(e+1))
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 30))
    logs = -mean + k * np.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _throw(elements, sets, weights, low: float, high: float, slab: int, seed: int, k: int):
    """The hits of rank in [low, high): for each its cell (set * k + coordinate), rank and identity."""
    cells, ranks, names = [], [], []
    region, bottom, top = 0, 0.0, 1.0
    while True:
        mine = weights > bottom
        if not mine.any():
            break
        e, s, w = (elements, sets, weights) if mine.all() else (elements[mine], sets[mine], weights[mine])
        tag = U((seed * 1_000_003 + (slab - LOWEST) * 257 + region * 65_537 + 1) & 0xFFFFFFFFFFFFFFFF)
        h = mixed(e + mixed(np.array([tag]))[0])
        mean = (high - low) * (top - bottom)
        u = _unit(h)
        some = np.flatnonzero(u >= np.exp(-mean))
        if len(some):
            n = np.searchsorted(_poisson_table(mean), u[some], side="right")
            at = np.repeat(some, n)
            dart = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            name = mixed(h[at] + (dart.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))
            place = mixed(name ^ U(0xA0761D6478BD642F))
            if region:  # in the strip of weights [0, 1) every dart hits a weight of 1 or more
                hit = bottom + (top - bottom) * _unit(mixed(place ^ U(0xE7037ED1A0B428DB))) < w[at]
                at, name, place = at[hit], name[hit], place[hit]
            elif (w < 1).any():
                hit = _unit(mixed(place ^ U(0xE7037ED1A0B428DB))) < w[at]
                at, name, place = at[hit], name[hit], place[hit]
            cells.append(s[at] * k + (name % U(k)).astype(np.int64))
            ranks.append(low + (high - low) * _unit(place))
            names.append(name)
        region, bottom, top = region + 1, top, top * 2
    return cells, ranks, names


def signatures(elements: np.ndarray, sets: np.ndarray, weights: np.ndarray, n_sets: int, k: int, seed: int = 1) -> np.ndarray:
    """The (n_sets, k) identities of the earliest darts. elements: uint64 hashes; sets: which set holds each; weights: above 0. A set without elements gets zeros.

    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity, the sum of least weights
    over the sum of greatest.
    """
    best_rank = np.full(n_sets * k, np.inf)
    best_name = np.zeros(n_sets * k, np.uint64)
    total = np.bincount(sets, weights, n_sets)
    with np.errstate(divide="ignore"):
        need = np.where(total > 0, np.ceil(np.log2(k * (np.log(k) + 2) / np.maximum(total, 1e-300))), LOWEST)
    need = np.maximum(need.astype(np.int64), LOWEST)  # ranks below 2^need are thrown at first
    open_, slab = total > 0, LOWEST
    while open_.any():
        mine = open_[sets]
        e, s, w = elements[mine], sets[mine], weights[mine]
        cells, ranks, names = _throw(e, s, w, 0.0 if slab == LOWEST else 2.0 ** (slab - 1), 2.0**slab, slab, seed, k)
        if cells:
            c, r, n = map(np.concatenate, (cells, ranks, names))
            np.minimum.at(best_rank, c, r)
            won = r == best_rank[c]
            best_name[c[won]] = n[won]
        # a set is done once its ranks are thrown and no coordinate is empty
        empty = np.isinf(best_rank.reshape(n_sets, k)).any(axis=1)
        open_ &= (slab < need) | empty
        slab += 1
    return best_name.reshape(n_sets, k)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of rows coordinates; equal hashes of different bands don't meet."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    h = np.zeros(parts.shape[:2], np.uint64) + mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        h = mixed(h * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h
