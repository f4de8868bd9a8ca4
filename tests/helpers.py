"""Planted data and brute-force answers."""

from __future__ import annotations

import numpy as np

VECTORS = "key bigint, vec array<float>"


def vector_rows(matrix, first=0, key=int):
    return [(key(first + i), [float(x) for x in row]) for i, row in enumerate(matrix)]


def planted(seed=3, dim=16, groups=12, copies=8, spread=0.01, noise=60, hot=120):
    """Tight clusters, unrelated rows, and one vector repeated ``hot`` times."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = [c + spread * rng.normal(size=dim) for c in centres for _ in range(copies)]
    rows += list(rng.normal(size=(noise, dim)))
    rows += [centres[0]] * hot
    matrix = np.array(rows, dtype=np.float32)
    return matrix[rng.permutation(len(matrix))]


def scores(left, right, metric="cosine"):
    left, right = np.asarray(left, dtype=np.float64), np.asarray(right, dtype=np.float64)
    if metric == "cosine":
        left = left / np.linalg.norm(left, axis=1, keepdims=True)
        right = right / np.linalg.norm(right, axis=1, keepdims=True)
    if metric == "l2":
        return np.round(np.linalg.norm(left[:, None] - right[None], axis=2), 6) + 0.0
    return np.round(left @ right.T, 6) + 0.0


def nearest(queries, vectors, k, metric="cosine", exclude_self=False):
    """{(query, rank): (key, score)} with keys equal to row numbers."""
    table = scores(queries, vectors, metric)
    best = {}
    for q, row in enumerate(table):
        order = sorted(range(len(row)), key=lambda i: (row[i] if metric == "l2" else -row[i], i))
        order = [i for i in order if not (exclude_self and i == q)]
        for rank, i in enumerate(order[:k], 1):
            best[q, rank] = (i, row[i])
    return best


def components(links):
    """{node: lowest node of its component}."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}
