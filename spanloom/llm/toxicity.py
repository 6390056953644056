"""Cumulative-link ordinal regression on sparse text features: words and
beginnings of words.

Grades 0 (clean), 1, 2, 3 (by rising density of words that mark toxic texts) are predicted by
one weight vector and three ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k). The
result is the expected grade, the probability of any toxicity and the verdict. Labels are binary, so
only grade 0 against the rest is learnt from labels; the order of grades 1 to 3 restates densities
that the features hold as well.

Fitting uses a bounded sample: the ``fit_rows`` labelled documents that come first in hash order
of their ids. Word statistics of the sample are counted in Spark; only the ``vocabulary`` words
with the largest G-test and the sample's counts of these reach the driver. Scoring covers whole
texts of all documents, in Arrow batches with one dictionary look-up a word.

Edge cases: null and empty texts have no features and grade near 0; labels that are null or
without a document do not take part; of labels that repeat an id the largest counts, of documents that
repeat one the text with the smallest hash; without any labelled toxic document nothing is toxic;
repeated rows give repeated rows; an empty table gives an empty result; other columns are kept
apart by selecting id and text first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize

GRADES = 4
#: ASCII letters fall to lower case, other ASCII characters but digits become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


#: Lengths in bytes of the word beginnings that are features beside the words: stems take endings.
STEMS = (4, 5, 6)


def terms(found: list[bytes]) -> list[bytes]:
    """Words and their beginnings; a beginning is marked by a sign that no word has."""
    return found + [b"^" + w[:k] for k in STEMS for w in found if len(w) >= k]


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # a word's log count, then log density
    thresholds: np.ndarray

    def tail(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def features(hits: Counter, n_words: int, size: int) -> tuple[list[int], list[float]]:
    """Sparse features of the vocabulary words in one text: log count, and log density."""
    at = [i for i in sorted(hits)]
    dense = [float(np.log1p(100.0 * hits[i] / n_words)) for i in at]
    return at + [size + i for i in at], [float(np.log1p(hits[i])) for i in at] + dense


def fit_thresholds(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, size: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam, all rows in each step."""
    where = np.concatenate([np.full(len(a), r) for r, (a, _) in enumerate(rows)] + [np.empty(0)]).astype(np.int64)
    cols = np.concatenate([np.asarray(a) for a, _ in rows] + [np.empty(0)]).astype(np.int64)
    vals = np.concatenate([np.asarray(v) for _, v in rows] + [np.empty(0)])
    n, k = len(rows), GRADES - 1
    # thresholds are a first one and positive gaps, so they stay ordered
    par = np.concatenate([np.zeros(2 * size), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, gaps = par[: 2 * size], np.exp(par[2 * size + 1 :])
        theta = par[2 * size] + np.concatenate([[0.0], gaps.cumsum()])
        s = np.bincount(where, weights=vals * w[cols], minlength=n)
        cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -40, 40)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-9)
        slope = cdf * (1 - cdf)
        d_theta = np.zeros((n, k))
        upper, lower = grades < k, grades > 0
        r = np.arange(n)
        d_theta[r[upper], grades[upper]] += (slope[r[upper], grades[upper]] / p[upper])
        d_theta[r[lower], grades[lower] - 1] -= (slope[r[lower], grades[lower] - 1] / p[lower])
        d_s = -d_theta.sum(axis=1)
        g_w = np.bincount(cols, weights=vals * d_s[where], minlength=2 * size) / n - l2 * w
        g_t = d_theta.sum(axis=0) / n
        g_gap = np.array([g_t[i + 1 :].sum() for i in range(k - 1)]) * gaps
        g = np.concatenate([g_w, [g_t.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return par[: 2 * size], par[2 * size] + np.concatenate([[0.0], np.exp(par[2 * size + 1 :]).cumsum()])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple[bytes, int]] = []
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            out += [(w, toxic) for w in set(terms(words(text.as_py())))]
        w, t = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch([pa.array(w, pa.binary()), pa.array(t, pa.int64())], names=["word", "toxic"])


def _hits(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, times = [], [], []
            for text in b.column("text"):
                found = words(text.as_py())
                hits = Counter(vocabulary[w] for w in terms(found) if w in vocabulary)
                n.append(len(found))
                at.append(list(hits))
                times.append(list(hits.values()))
            kinds = pa.list_(pa.int64())
            yield pa.record_batch([b.column("toxic"), pa.array(n, pa.int64()), pa.array(at, kinds), pa.array(times, kinds)], names=["toxic", "n", "at", "times"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, vocabulary: int = 400) -> Model:
    """Train on the first ``fit_rows`` labelled documents in hash order of their ids, one row an id."""
    chosen = labels.where("toxic is not null AND doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text")
    own = texts.join(F.broadcast(chosen), "doc_id")  # bounded by fit_rows ids; documents that repeat one are reduced to one
    sample = materialize(own.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"), "toxic-sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos:
        return Model({}, np.zeros(0), np.full(GRADES - 1, 40.0))
    seen = sample.mapInArrow(_distinct_words, "word binary, toxic long").groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.sum("toxic").alias("t")).where("c >= 3")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    gain = part(t, c * pos / n) + part(c - t, c * (n - pos) / n) + part(pos - t, (n - c) * pos / n) + part(n - pos - (c - t), (n - c) * (n - pos) / n)
    best = seen.select("word", gain.alias("g"), (F.log((t + 0.5) / (pos + 1)) - F.log((c - t + 0.5) / (n - pos + 1))).alias("odds")).orderBy(F.desc("g"), "word").limit(vocabulary).collect()
    index = {bytes(r["word"]): i for i, r in enumerate(best)}
    marks = {i for i, r in enumerate(best) if r["odds"] > 2}
    rows = sorted(sample.mapInArrow(_hits(index), "toxic long, n long, at array<long>, times array<long>").collect())
    density = np.array([100.0 * sum(k for i, k in zip(r["at"], r["times"], strict=True) if i in marks) / max(1, r["n"]) for r in rows])
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    cuts = np.quantile(density[toxic > 0], [1 / 3, 2 / 3])
    grades = np.where(toxic > 0, 1 + (density > cuts[0]).astype(np.int64) + (density > cuts[1]), 0)
    x = [features(Counter(dict(zip(r["at"], r["times"], strict=True))), max(1, r["n"]), len(index)) for r in rows]
    weights, thresholds = fit_thresholds(x, grades, len(index))
    return Model(index, weights, thresholds)


def _sums(model: Model, texts: pa.Array) -> tuple[list[int], list[int], np.ndarray]:
    """Words, vocabulary hits and w.x of every text."""
    size, w = len(model.vocabulary), model.weights
    index = {k: i for k, i in model.vocabulary.items() if k[:1] != b"^"}
    stems = {k: {x[1:]: i for x, i in model.vocabulary.items() if x[:1] == b"^" and len(x) == k + 1} for k in STEMS}
    n, marks, sums = [], [], []
    for text in texts:
        found = words(text.as_py())
        hits = Counter([index[x] for x in found if x in index])
        for k, known in stems.items():
            if known:
                hits.update([known[x[:k]] for x in found if x[:k] in known])
        at, val = features(hits, max(1, len(found)), size)
        n.append(len(found))
        marks.append(sum(hits.values()))
        sums.append(float(sum(w[i] * x for i, x in zip(at, val, strict=True))))
    return n, marks, np.array(sums, dtype=np.float64)


def _score(model: Model):
    names = ["doc_id", "n_words", "n_marks", "p_toxic", "severity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, marks, s = _sums(model, b.column(1))
            tail = model.tail(s)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.int64()), pa.array(tail[:, 0]), pa.array(tail.sum(axis=1))], names=names)

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_marks, p_toxic, severity (expected grade), grade, toxic, kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(_score(model), "doc_id long, n_words long, n_marks long, p_toxic double, severity double")
    return scored.select(
        "*", F.rint("severity").cast("int").alias("grade"), (F.col("p_toxic") >= threshold).alias("toxic"), (F.col("p_toxic") < threshold).alias("kept")
    )


def _keep_clean(model: Model, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = model.tail(_sums(model, b.column(text_at))[2])[:, 0] < threshold
            yield b.filter(pa.array(clean))

    return run


def clean_rows(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The whole rows of ``docs`` that are not toxic, in one pass and without a join."""
    return docs.mapInArrow(_keep_clean(model, threshold, docs.columns.index(text_col)), docs.schema)
