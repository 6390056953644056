"""Clustering of small similarity matrices (NumPy): agglomeration, partitions, Louvain."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np

from spanloom.functions import partition
from spanloom.functions.stats import Gaussian

#: How the similarity of a merged cluster to the others follows from those of its two parts.
LINKAGE = {
    "complete": lambda x, y, n, m: np.minimum(x, y),
    "single": lambda x, y, n, m: np.maximum(x, y),
    "average": lambda x, y, n, m: (n * x + m * y) / (n + m),
}

#: A stop looks at the merges so far, the similarity of the next one and the number of clusters.
Stop = Callable[[list, float, int], bool]


def below(threshold: float) -> Stop:
    return lambda history, similarity, clusters: similarity < threshold


def above(threshold: float) -> Stop:
    return lambda history, similarity, clusters: similarity > threshold


def negative(history: list, similarity: float, clusters: int) -> bool:
    return similarity < 0


def at_most(wanted: int) -> Stop:
    return lambda history, similarity, clusters: clusters <= wanted


def past_maximum(history: list, similarity: float, clusters: int) -> bool:
    """The next merge is worse than the one before: similarities have had their maximum."""
    return bool(history) and similarity < history[-1][1]


def agglomerate(
    similarity: np.ndarray, linkage: str = "average", threshold: float = -np.inf, clusters: int = 1, allowed: Callable[[list[int], list[int]], bool] | None = None,
    stops: tuple[Stop, ...] = (),
) -> list[tuple[list[int], float]]:
    """History of merges (members of both clusters, similarity), best pair first.

    It ends before a merge that a stop refuses or that is below the threshold, at ``clusters``
    clusters, or when ``allowed`` forbids every pair. The matrix of clusters is updated at each
    merge, never computed anew.
    """
    n = len(similarity)
    between = np.array(similarity, dtype=float)
    between[np.tril_indices(n)] = -np.inf
    between = np.maximum(between, between.T)
    np.fill_diagonal(between, -np.inf)
    barred = np.zeros((n, n), bool)
    groups, history = {i: [i] for i in range(n)}, []
    while len(groups) > max(1, clusters):
        open_ = np.where(barred, -np.inf, np.triu(between, 1) + np.tril(np.full((n, n), -np.inf)))
        i, j = divmod(int(open_.argmax()), n)
        best = float(open_[i, j])
        if best == -np.inf:
            break
        if allowed is not None and not allowed(groups[i], groups[j]):
            barred[i, j] = True
            continue
        if best < threshold or any(stop(history, best, len(groups)) for stop in stops):
            break
        row = LINKAGE[linkage](between[i], between[j], len(groups[i]), len(groups[j]))
        between[i], between[:, i] = row, row
        between[j], between[:, j], between[i, i] = -np.inf, -np.inf, -np.inf
        barred[i], barred[:, i] = False, False
        groups[i] = sorted(groups[i] + groups.pop(j))
        history.append((groups[i], best))
    return history


def replay(n: int, history: list[tuple[list[int], float]], steps: int | None = None) -> np.ndarray:
    """Cluster (smallest member) of each item after some merges."""
    label = np.arange(n)
    for members, _ in history[:steps]:
        label[members] = min(members)
    return label


def bic_clustering(sets: list[np.ndarray], penalty: float = 3.5, diagonal: bool = False, work: list | None = None) -> np.ndarray:
    """Merge the pair with the largest negative description gain until none is negative.

    Pairs wait in a queue by gain. A merge makes a new model, which is compared with the others once;
    pairs of models that are gone are dropped when they come up. So all merges together compare
    fewer than twice the pairs there were. ``work`` gets each comparison.
    """
    models = {i: Gaussian.fit(x, diagonal) for i, x in enumerate(sets)}
    age, label, queue = dict.fromkeys(models, 0), np.arange(len(sets)), []

    def compare(i: int, j: int) -> None:
        gain = models[i].bic(models[j], penalty)
        if work is not None:
            work.append((i, j))
        if gain < 0:
            heappush(queue, (gain, i, j, age[i], age[j]))

    for i in models:
        for j in range(i):
            compare(j, i)
    while queue:
        _, i, j, then_i, then_j = heappop(queue)
        if age.get(i) != then_i or age.get(j) != then_j:
            continue
        models[i] = models[i].merge(models.pop(j))
        age[i] += 1
        del age[j]
        label[label == j] = i
        for k in models:
            if k != i:
                compare(min(i, k), max(i, k))
    return label


def correlation_value(weight: np.ndarray, label: np.ndarray) -> float:
    """Sum of pair weights inside clusters."""
    same = np.triu(label[:, None] == label[None, :], 1)
    return float(weight[same].sum())


def correlation_clustering(weight: np.ndarray, must: np.ndarray | None = None, cannot: np.ndarray | None = None) -> np.ndarray:
    """Partition that maximises the pair weights inside clusters; see ``partition.solve`` for its gap."""
    return partition.solve(weight, must, cannot).label


def modularity(adj: np.ndarray, label: np.ndarray) -> float:
    m2 = adj.sum()
    if m2 == 0:
        return 0.0
    k = adj.sum(axis=1)
    same = label[:, None] == label[None, :]
    return float(((adj - np.outer(k, k) / m2) * same).sum() / m2)


def louvain(adj: np.ndarray) -> list[np.ndarray]:
    """Communities of every level, finest first: local moves, then the graph of communities."""
    levels, own = [], np.arange(len(adj))
    graph = adj.astype(float)
    while True:
        n, m2, k = len(graph), graph.sum(), graph.sum(axis=1)
        label, total = np.arange(n), k.copy()
        moved, any_move = True, False
        while moved and m2 > 0:
            moved = False
            for i in range(n):
                links = np.bincount(label, weights=np.where(np.arange(n) == i, 0.0, graph[i]), minlength=n)
                total[label[i]] -= k[i]
                gain = links - total * k[i] / m2
                to = int(np.argmax(np.where(links > 0, gain, -np.inf))) if links.any() else label[i]
                if gain[to] > gain[label[i]] + 1e-12:
                    label[i], moved, any_move = to, True, True
                total[label[i]] += k[i]
        if not any_move:
            return levels or [own]
        _, label = np.unique(label, return_inverse=True)
        own = label[own]
        levels.append(own.copy())
        size = label.max() + 1
        fold = np.zeros((n, size))
        fold[np.arange(n), label] = 1
        graph = fold.T @ graph @ fold
