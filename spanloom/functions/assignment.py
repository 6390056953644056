"""Maximum-weight assignment in NumPy, for small matrices inside grouped UDFs."""

from __future__ import annotations

import numpy as np


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight assignment, by shortest augmenting paths.

    Rows are added one at a time; each grows a tree of tight edges from its row, with potentials
    kept so that reduced costs stay non-negative, until a free column is reached.
    """
    if weight.size == 0:
        return []
    cost = weight.max() - np.asarray(weight, dtype=float)
    flipped = cost.shape[0] > cost.shape[1]
    if flipped:
        cost = cost.T
    n, m = cost.shape
    row_pot, col_pot, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        slack, via = np.full(m, np.inf), np.full(m, -1)
        done, row, at, reach = np.zeros(m, bool), new, -1, 0.0
        while True:
            offer = reach + cost[row] - row_pot[row] - col_pot
            better = ~done & (offer < slack)
            slack[better], via[better] = offer[better], at
            at = int(np.argmin(np.where(done, np.inf, slack)))
            reach, done[at] = slack[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        inside = done & (owner >= 0)
        row_pot[new] += reach
        row_pot[owner[inside]] += reach - slack[inside]
        col_pot[done] -= reach - slack[done]
        while via[at] >= 0:  # hand columns on along the path
            owner[at] = owner[via[at]]
            at = via[at]
        owner[at] = new
    pairs = [(int(r), int(c)) for c, r in enumerate(owner) if r >= 0]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)
