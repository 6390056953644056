"""Numbers for models: Gaussians, mixtures, log-likelihood ratios, normal quantiles (NumPy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution, by bisection on erf's series-free form."""
    from math import erf, sqrt

    lo, hi = np.full(np.shape(p), -9.0), np.full(np.shape(p), 9.0)
    cdf = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))
    for _ in range(60):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def logsumexp(a: np.ndarray, b: np.ndarray | float = 1.0, axis: int | None = None) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(b * np.exp(a - top), axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis=axis) if axis is not None else float(out.reshape(-1)[0])


@dataclass
class Gaussian:
    """Count, mean and covariance (a vector of variances if diagonal); merging is exact."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, diagonal: bool = False) -> Gaussian:
        mean = x.mean(axis=0)
        d = x - mean
        return cls(len(x), mean, (d * d).mean(axis=0) if diagonal else d.T @ d / len(x))

    @property
    def diagonal(self) -> bool:
        return self.cov.ndim == 1

    def merge(self, other: Gaussian) -> Gaussian:
        n = self.n + other.n
        mean = (self.n * self.mean + other.n * other.mean) / n
        outer = (lambda v: v * v) if self.diagonal else (lambda v: np.outer(v, v))
        cov = sum(g.n * (g.cov + outer(g.mean - mean)) for g in (self, other)) / n
        return Gaussian(n, mean, cov)

    def log_det(self) -> float:
        return float(np.log(self.cov).sum()) if self.diagonal else float(np.linalg.slogdet(self.cov)[1])

    def bic(self, other: Gaussian, penalty: float = 3.5) -> float:
        """Gain in description length of keeping both apart: positive means different."""
        both, d = self.merge(other), len(self.mean)
        free = 2 * d if self.diagonal else d * (d + 1) / 2 + d
        return both.n * both.log_det() - self.n * self.log_det() - other.n * other.log_det() - penalty * free * np.log(both.n)

    def divergence(self, other: Gaussian) -> float:
        d = self.mean - other.mean
        if self.diagonal:
            return float((d * d / np.sqrt(self.cov * other.cov)).sum())
        both = np.linalg.inv(self.cov) * np.linalg.inv(other.cov)
        return float(d @ (np.sign(both) * np.sqrt(np.abs(both))) @ d)


@dataclass
class Mixture:
    """Diagonal Gaussian mixture, grown by splitting and refitted by EM."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean[None]
        ll = -0.5 * ((d * d / self.var).sum(axis=2) + np.log(2 * np.pi * self.var).sum(axis=1))
        return ll + np.log(self.weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        return logsumexp(self.log_parts(x), axis=1)

    def moments(self, x: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of r, r x and r x x over the rows for each component; sums of parts add up."""
        n, first, second = np.zeros(len(self.weight)), np.zeros_like(self.mean), np.zeros_like(self.mean)
        for i in range(0, len(x), chunk):
            y = x[i : i + chunk]
            parts = self.log_parts(y)
            r = np.exp(parts - logsumexp(parts, axis=1)[:, None])
            n, first, second = n + r.sum(axis=0), first + r.T @ y, second + r.T @ (y * y)
        return n, first, second

    def moved(self, n: np.ndarray, first: np.ndarray, second: np.ndarray, origin: np.ndarray, floor: float = 1e-4, adapt: str = "wmv", relevance: float = 0.0) -> Mixture:
        """The model after one step from its moments; ``relevance`` holds means back at ``origin``."""
        n = n + 1e-10
        mean = first / n[:, None]
        if "m" in adapt:
            a = (n / (n + relevance))[:, None]
            new = a * mean + (1 - a) * origin
        else:
            new = self.mean
        var = np.maximum(floor, second / n[:, None] - 2 * new * mean + new * new) if "v" in adapt else self.var
        return Mixture(n / n.sum() if "w" in adapt else self.weight, new, var)

    def em(self, x: np.ndarray, steps: int = 10, floor: float = 1e-4, adapt: str = "wmv", relevance: float = 0.0) -> Mixture:
        """EM steps; ``adapt`` names the parameters that move, ``relevance`` holds means back."""
        g = Mixture(self.weight.copy(), self.mean.copy(), self.var.copy())
        for _ in range(steps):
            g = g.moved(*g.moments(x), self.mean, floor, adapt, relevance)
        return g

    def split(self, components: int) -> Mixture:
        """The heaviest components in two each, up to ``components`` in all."""
        k = min(len(self.weight), components - len(self.weight))
        order = np.argsort(-self.weight, kind="stable")
        split, keep = order[:k], order[k:]
        shift = 0.8 * np.sqrt(self.var[split])
        return Mixture(
            np.concatenate([self.weight[keep], self.weight[split] / 2, self.weight[split] / 2]),
            np.concatenate([self.mean[keep], self.mean[split] - shift, self.mean[split] + shift]),
            np.concatenate([self.var[keep], self.var[split], self.var[split]]),
        )

    @classmethod
    def grow(cls, x: np.ndarray, components: int, steps: int = 10) -> Mixture:
        g = cls(np.ones(1), x.mean(axis=0)[None], np.maximum(x.var(axis=0), 1e-4)[None])
        while len(g.weight) < components:
            g = g.split(components).em(x, steps)
        return g


def viterbi(log_emit: np.ndarray, log_move: np.ndarray, log_start: np.ndarray) -> np.ndarray:
    """Most likely state sequence."""
    n, k = log_emit.shape
    best, back = log_start + log_emit[0], np.zeros((n, k), int)
    for t in range(1, n):
        step = best[:, None] + log_move
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + log_emit[t]
    path = np.empty(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing least squares fit: pooled neighbours."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, n, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, u[2] + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.empty(0)


@dataclass
class ScoreRatio:
    """Score -> log-likelihood ratio (clamped to the fitted range) -> posterior."""

    x: np.ndarray
    llr: np.ndarray
    prior: float

    @classmethod
    def from_histogram(cls, centers: np.ndarray, target: np.ndarray, other: np.ndarray, kind: str = "isotonic") -> ScoreRatio:
        """From counts of target and other scores in bins."""
        ok = (target > 0) & (other > 0)
        x, t, o = centers[ok], target[ok], other[ok]
        raw = np.log(t / target.sum()) - np.log(o / other.sum())
        if kind == "linear":
            slope, cut = np.polyfit(x, raw, 1, w=np.sqrt(t + o)) if len(x) > 1 else (0.0, float(raw.mean()))
            fitted = slope * x + cut
        else:
            fitted = isotonic(raw, (t + o).astype(float))
        return cls(x, fitted, float(target.sum() / (target.sum() + other.sum())))

    def ratio(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.llr)

    def posterior(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + (1 - self.prior) / self.prior * np.exp(-self.ratio(s)))
