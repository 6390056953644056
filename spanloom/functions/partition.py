"""Partitions of a weighted graph that maximise the weights inside clusters, with a proven gap.

``solve`` keeps hard constraints as constraints: items that must share a cluster are merged first,
pairs that must not are never joined, and items of one exclusive group are such pairs. It returns
the best partition found and an upper bound: conflicting cycles (a negative pair whose ends are
linked by positive ones) are packed greedily for the bound, items are then placed one by one, and a
branch whose bound is not above the best value is cut. When ``nodes`` branches are used up, the
largest bound of an open branch remains as the stated gap.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np


@dataclass(frozen=True)
class Partition:
    label: np.ndarray  # smallest item of each item's cluster
    value: float  # weights inside clusters, constraints apart
    bound: float  # no partition that keeps the constraints is worth more
    broken: tuple[tuple[int, int], ...] = ()  # pairs kept together by must links although they must not be

    @property
    def gap(self) -> float:
        return max(0.0, self.bound - self.value)


def merged(n: int, must: np.ndarray | None) -> np.ndarray:
    """Smallest item that must links reach, for each item."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if must is not None:
        for i, j in np.argwhere(np.triu(must | must.T, 1)):
            a, b = find(int(i)), find(int(j))
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], int)


def forbidden(n: int, cannot: np.ndarray | None = None, exclusive: np.ndarray | None = None) -> np.ndarray:
    """Pairs that must not share a cluster. ``exclusive``: a group for each item, below 0 for none."""
    no = np.zeros((n, n), bool) if cannot is None else (cannot | cannot.T)
    if exclusive is not None:
        g = np.asarray(exclusive)
        no = no | ((g[:, None] == g[None, :]) & (g[:, None] >= 0))
    no = no.copy()
    np.fill_diagonal(no, False)
    return no


def packed_cycles(w: np.ndarray, no: np.ndarray) -> float:
    """A lower bound of what any partition loses (positive weights that are cut, negative ones that
    are joined): edge-disjoint shares of cycles with one repulsive pair, shortest cycles first."""
    n = len(w)
    pull = np.maximum(w, 0.0)
    pull[no] = 0.0
    push = np.where(no, np.inf, np.maximum(-w, 0.0))
    np.fill_diagonal(pull, 0.0)
    np.fill_diagonal(push, 0.0)
    total = 0.0
    pairs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(push > 0, 1))]
    near = _near(pull)
    for longest in (2, 3, n):
        for i, j in pairs:
            while push[i, j] > 1e-12:
                path = _path(pull, near, i, j, longest)
                if path is None:
                    break
                share = min(push[i, j], min(pull[a, b] for a, b in zip(path, path[1:], strict=False)))
                for a, b in zip(path, path[1:], strict=False):
                    pull[a, b] -= share
                    pull[b, a] -= share
                    if pull[a, b] < 1e-12:
                        pull[a, b] = pull[b, a] = 0.0
                    if pull[a, b] <= 1e-12:
                        near[a] &= ~(1 << b)
                        near[b] &= ~(1 << a)
                push[i, j] -= share
                push[j, i] = push[i, j]
                total += share
    return total


def _near(pull: np.ndarray) -> list[int]:
    """For each item the items it is linked to, as the bits of a number."""
    n = len(pull)
    rows = np.packbits(pull > 1e-12, axis=1, bitorder="little") if n else ()
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def _path(pull: np.ndarray, near: list[int], i: int, j: int, longest: int) -> list[int] | None:
    """Fewest positive links from i to j, ``longest`` at most; ``near`` has the links of ``pull``."""
    if longest == 2:
        both = near[i] & near[j]
        if both:
            k = int(np.minimum(pull[i], pull[j]).argmax())
            return [i, k, j]
        return [i, j] if near[i] >> j & 1 else None
    came, line, seen = {i: i}, deque([(i, 0)]), 1 << i
    while line:
        at, far = line.popleft()
        if far == longest:
            return None
        new = near[at] & ~seen
        seen |= new
        while new:
            low = new & -new
            k = low.bit_length() - 1
            came[k] = at
            if k == j:
                path = [j]
                while path[-1] != i:
                    path.append(came[path[-1]])
                return path[::-1]
            line.append((k, far + 1))
            new ^= low
    return None


def joined(w: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Greedy start: join the two clusters with the largest positive total that may be joined."""
    n = len(w)
    sums, bar, label = np.where(no, 0.0, w).astype(float), no.copy(), np.arange(n)
    np.fill_diagonal(sums, 0.0)
    live = np.ones(n, bool)
    while True:
        open_ = np.where(bar | ~live[:, None] | ~live[None, :], -np.inf, sums)
        np.fill_diagonal(open_, -np.inf)
        if not n or open_.max() <= 0:
            return label
        i, j = sorted(divmod(int(open_.argmax()), n))
        label[label == j] = i
        sums[i] += sums[j]
        sums[:, i] = sums[i]
        bar[i] |= bar[j]
        bar[:, i] = bar[i]
        live[j] = False


def improved(w: np.ndarray, no: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Move single items and join clusters while the value grows and no constraint breaks."""
    n, label = len(w), label.copy()
    moved = True
    while moved:
        moved = False
        for i in range(n):
            others = np.arange(n) != i
            gains = {}
            for c in set(label[others].tolist()):
                own = (label == c) & others
                if not no[i, own].any():
                    gains[c] = float(w[i, own].sum())
            free = next(c for c in range(n) if not (label[others] == c).any())
            gains[free] = 0.0
            to = max(gains, key=lambda c: (gains[c], -c))
            if gains[to] > gains.get(int(label[i]), 0.0) + 1e-12:
                label[i], moved = to, True
        one = (label[:, None] == np.unique(label)[None, :]).astype(float)
        again = joined(one.T @ w @ one, one.T @ no @ one > 0)
        if len(set(again.tolist())) < len(again):
            label, moved = again[one.argmax(axis=1)], True
    return label


def inside(w: np.ndarray, label: np.ndarray) -> float:
    return float(w[np.triu(label[:, None] == label[None, :], 1)].sum())


def solve(w: np.ndarray, must: np.ndarray | None = None, cannot: np.ndarray | None = None, exclusive: np.ndarray | None = None, nodes: int = 20_000) -> Partition:
    """Best partition of symmetric weights found within ``nodes`` branches, and its bound."""
    n = len(w)
    w = np.array(w, dtype=float)
    np.fill_diagonal(w, 0.0)
    no, root = forbidden(n, cannot, exclusive), merged(n, must)
    broken = tuple((int(i), int(j)) for i, j in np.argwhere(np.triu(no & (root[:, None] == root[None, :]), 1)))
    heads, of = np.unique(root, return_inverse=True)
    one = np.zeros((n, len(heads)))
    one[np.arange(n), of] = 1.0
    small, bar = one.T @ w @ one, (one.T @ no @ one) > 0
    fixed = float(np.trace(small)) / 2
    np.fill_diagonal(small, 0.0)
    np.fill_diagonal(bar, False)
    value, bound, label = fixed, fixed, np.zeros(len(heads), int)
    for part in _parts(small, bar):
        own, most = _search(small[np.ix_(part, part)], bar[np.ix_(part, part)], nodes)
        label[part] = part[own]
        value += inside(small[np.ix_(part, part)], own)
        bound += most
    first: dict[int, int] = {}
    whole = label[of]
    for i, c in enumerate(whole.tolist()):
        first.setdefault(c, i)
    return Partition(np.array([first[c] for c in whole.tolist()], int), value, max(bound, value), broken)


def _parts(w: np.ndarray, no: np.ndarray) -> list[np.ndarray]:
    """Items that positive links connect: no best partition joins what they do not."""
    root = merged(len(w), (w > 0) & ~no)
    return [np.flatnonzero(root == r) for r in np.unique(root)]


def _search(w: np.ndarray, no: np.ndarray, nodes: int) -> tuple[np.ndarray, float]:
    """(first item of each item's cluster, bound) of one connected part."""
    n = len(w)
    if n == 1:
        return np.zeros(1, int), 0.0
    # heavy items first: their places decide most
    order = np.argsort(-np.abs(w).sum(axis=1), kind="stable")
    w, no = w[np.ix_(order, order)], no[np.ix_(order, order)]
    most = float(np.triu(np.where(no, 0.0, np.maximum(w, 0.0)), 1).sum())
    best = improved(w, no, joined(w, no))
    loss = most - inside(np.where(no, 0.0, w), best)
    rest: dict[int, float] = {n: 0.0}

    def later(i: int) -> float:
        """What the items from i on lose among themselves, at least."""
        if i not in rest:
            rest[i] = packed_cycles(w[i:, i:], no[i:, i:])
        return rest[i]

    low = later(0)
    pull, push = np.where(no, 0.0, np.maximum(w, 0.0)), np.where(no, np.inf, np.maximum(-w, 0.0))
    # a branch: its bound, items placed (negative), serial number, what they cost, their clusters
    heap, made, left = [(low, 0, 0, 0.0, ())], 0, nodes
    while heap and heap[0][0] < loss - 1e-9 and left > 0:
        _, i, _, paid, places = heappop(heap)
        i = -i
        left -= max(1, n // 20)
        # cost of each item from i on in each cluster (the last one: alone): pull if apart, push if together
        placed, count = np.array(places, int), max(places, default=-1) + 1
        apart = pull[i:, :i].sum(axis=1)
        costs = np.column_stack([apart - pull[i:, :i][:, placed == c].sum(axis=1) + push[i:, :i][:, placed == c].sum(axis=1) for c in range(count)] + [apart])
        for c in np.flatnonzero(np.isfinite(costs[0])).tolist():
            new = costs[1:] + pull[i + 1 :, i][:, None]
            new[:, c] = costs[1:, c] + push[i + 1 :, i]
            if c == count:
                new = np.column_stack((new, costs[1:, c] + pull[i + 1 :, i]))
            here = paid + costs[0, c]
            after = here + later(i + 1) + new.min(axis=1).sum()
            if after >= loss - 1e-9:
                continue
            if i + 1 == n:
                loss, best = here, np.array((*places, c))
            else:
                made += 1
                heappush(heap, (after, -(i + 1), made, here, (*places, c)))
    low = min(loss, heap[0][0]) if heap else loss
    back = np.empty(n, int)
    back[order] = best
    first_of = {c: int(np.flatnonzero(back == c)[0]) for c in set(back.tolist())}
    return np.array([first_of[c] for c in back.tolist()], int), most - low


@dataclass(frozen=True)
class Centers:
    center: np.ndarray  # the open item each item goes to, itself if it is open
    value: float  # open items times fee, plus the costs of the others
    bound: float  # no choice costs less

    @property
    def gap(self) -> float:
        return max(0.0, self.value - self.bound)


def _prices(cost: np.ndarray, fee: np.ndarray) -> tuple[float, np.ndarray]:
    """Dual ascent: prices that items would pay, raised in turn while no closed item could be opened
    from what it would be offered. Their sum is a lower bound; slack is what an item lacks to open."""
    price = cost.min(axis=0)
    if not np.isfinite(price).all():
        return np.inf, fee
    slack, rising = fee.astype(float).copy(), True
    while rising:
        rising = False
        for j in np.argsort(price, kind="stable"):
            near = cost[:, j] <= price[j] + 1e-12
            beyond = cost[~near, j]
            rise = min(slack[near].min(), beyond.min() - price[j] if len(beyond) else np.inf)
            if rise > 1e-9 and np.isfinite(rise):
                price[j] += rise
                slack[near] -= rise
                rising = True
    return float(price.sum()), slack


def _total(cost: np.ndarray, open_: np.ndarray, fee: float) -> float:
    return fee * int(open_.sum()) + float(cost[open_].min(axis=0).sum()) if open_.any() else np.inf


def _thinned(cost: np.ndarray, open_: np.ndarray, fee: float) -> np.ndarray:
    """Close, open or exchange items while that costs less."""
    open_, better = open_.copy(), True
    while better:
        better, now = False, _total(cost, open_, fee)
        swaps = [(k,) for k in range(len(cost))] + [(a, b) for a in np.flatnonzero(open_).tolist() for b in np.flatnonzero(~open_).tolist()]
        for flip in swaps:
            other = open_.copy()
            other[list(flip)] ^= True
            if (worth := _total(cost, other, fee)) < now - 1e-12:
                open_, better = other, True
                break
    return open_


def centers(cost: np.ndarray, fee: float = 1.0, nodes: int = 2_000) -> Centers:
    """Choose items to open, each for ``fee``; every item goes to itself (free) or to an open one it may
    go to (finite ``cost[open, item]``). Dual ascent gives bounds, branches open or close one item."""
    n = len(cost)
    cost = np.array(cost, dtype=float)
    np.fill_diagonal(cost, 0.0)
    best = _thinned(cost, np.ones(n, bool), fee)
    value = _total(cost, best, fee)

    def look(choice: tuple[int, ...]) -> tuple[float, np.ndarray]:
        own = np.where((np.array(choice) == 0)[:, None], np.inf, cost)
        forced = np.array(choice) == 1
        low, slack = _prices(own, np.where(forced, 0.0, fee))
        return low + fee * int(forced.sum()), slack

    start = (-1,) * n
    low, slack = look(start)
    heap, used = [(low, 0, start, slack)], 0
    while heap and heap[0][0] < value - 1e-9 and used < nodes:
        low, _, choice, slack = heappop(heap)
        taken = np.array(choice)
        tight = (slack <= 1e-9) & (taken != 0)
        found = _thinned(cost, tight if tight.any() else np.ones(n, bool), fee)
        if (worth := _total(cost, found, fee)) < value - 1e-12:
            value, best = worth, found
        undecided = np.flatnonzero(taken < 0)
        if not len(undecided):
            continue
        k = int(undecided[np.argmin(slack[undecided])])
        for to in (1, 0):
            used += 1
            child = (*choice[:k], to, *choice[k + 1 :])
            bound, left = look(child)
            if bound < value - 1e-9:
                heappush(heap, (max(bound, low), used, child, left))
    low = min(value, heap[0][0]) if heap else value
    at = np.flatnonzero(best)
    return Centers(at[cost[at].argmin(axis=0)], value, low)
