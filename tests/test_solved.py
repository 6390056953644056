"""Partitions with constraints and gaps, centers, objectives, lag means, gathers, the logistic fit."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import clustering as fc
from spanloom.functions import partition
from spanloom.functions.segment import SlidingWindow
from spanloom.functions.stats import Gaussian
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import errors as er
from spanloom.operators import feature as fe
from spanloom.operators import graph as gr
from spanloom.plans import programs as pr

LINKS = "uri string, row string, col string, value double"
EDGES = "uri string, src string, dst string, probability double"


def matrix(n, seed, whole=False):
    r = np.random.default_rng(seed)
    w = np.triu(r.integers(-9, 10, (n, n)) if whole else r.normal(size=(n, n)), 1).astype(float)
    return w + w.T


def all_partitions(n):
    def go(label):
        if len(label) == n:
            yield label
            return
        for c in range(max(label, default=-1) + 2):
            yield from go([*label, c])

    return go([])


def best_by_enumeration(w, no):
    """Depth first over all partitions that keep the constraints."""
    n = len(w)

    def go(i, label, value):
        if i == n:
            return value
        top = -np.inf
        for c in range(max(label, default=-1) + 2):
            mates = [j for j in range(i) if label[j] == c]
            if not no[i, mates].any():
                top = max(top, go(i + 1, [*label, c], value + w[i, mates].sum()))
        return top

    return go(0, [], 0.0)


def breaks(label, no):
    return bool((no & (label[:, None] == label[None, :])).any())


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9])
def test_small_partitions_are_proven_best(n):
    for seed in range(6):
        w = matrix(n, seed, seed % 2 > 0)
        no = np.random.default_rng(seed + 50).random((n, n)) < 0.2
        no = np.triu(no, 1) | np.triu(no, 1).T
        found = partition.solve(w, cannot=no)
        assert found.value == pytest.approx(best_by_enumeration(w, no)) and found.gap < 1e-6 and not found.broken
        assert not breaks(found.label, no) and found.value == pytest.approx(partition.inside(w, found.label))


def test_twelve_items_equal_enumeration():
    """All 4.2 million partitions of twelve items, as a sum over subsets: the best of a set is the best
    cluster of its first item plus the best of the rest."""
    for seed in range(4):
        n, w = 12, matrix(12, seed)
        worth = np.zeros(1 << n)
        for s in range(1, 1 << n):
            i = s.bit_length() - 1
            worth[s] = worth[s ^ (1 << i)] + sum(w[i, j] for j in range(i) if s >> j & 1)
        best = np.zeros(1 << n)
        for s in range(1, 1 << n):
            i = s.bit_length() - 1
            rest, top, sub = s ^ (1 << i), -np.inf, s ^ (1 << i)
            while True:
                top = max(top, worth[sub | (1 << i)] + best[rest ^ sub])
                if not sub:
                    break
                sub = (sub - 1) & rest
            best[s] = top
        found = partition.solve(w)
        assert found.value == pytest.approx(best[-1]) and found.gap < 1e-6


@pytest.mark.parametrize("n", [15, 24, 40])
def test_large_partitions_keep_constraints_and_state_a_gap(n):
    w, r = matrix(n, n), np.random.default_rng(n)
    must, no = np.zeros((n, n), bool), np.zeros((n, n), bool)
    must[0, 1] = must[1, 2] = must[5, 6] = True
    for i, j in r.integers(3, n, (n, 2)):
        if i != j and {i, j} != {5, 6}:
            no[i, j] = no[j, i] = True
    group = np.where(np.arange(n) % 5 == 4, 0, -1)
    found = partition.solve(w, must, no, group, nodes=500)
    assert len(set(found.label[:3])) == 1 and found.label[5] == found.label[6] and not breaks(found.label, no)
    assert len(set(found.label[group == 0])) == (group == 0).sum()
    assert found.bound >= found.value == pytest.approx(partition.inside(w, found.label))
    more = partition.solve(w, must, no, group, nodes=3_000)
    assert more.value >= found.value - 1e-9 and more.bound <= found.bound + 1e-9
    free = partition.solve(w, must, no, group, nodes=0)
    assert free.bound >= more.value - 1e-9


def test_contradictions_are_reported():
    must, no = np.zeros((4, 4), bool), np.zeros((4, 4), bool)
    must[0, 1] = must[1, 2] = True
    no[0, 2] = no[2, 3] = True
    found = partition.solve(np.ones((4, 4)) - np.eye(4), must, no)
    assert found.broken == ((0, 2),) and list(found.label) == [0, 0, 0, 3]


def test_planted_clusters_need_no_branches():
    w = np.full((200, 200), -1.0)
    for a in range(0, 200, 10):
        w[a : a + 10, a : a + 10] = 1.0
    found = partition.solve(w, nodes=0)
    assert found.gap == 0 and list(found.label) == [i // 10 * 10 for i in range(200)]


def test_correlation_in_spark(spark):
    """Components of twelve items against all their partitions; missing pairs, constraints, both orders of a pair."""
    rows, want = [], {}
    for k, uri in enumerate(["a", "b"]):
        w = matrix(11, k + 7, True)
        rows += [(uri, f"x{j:02d}", f"x{i:02d}", float(w[i, j])) if (i + j) % 2 else (uri, f"x{i:02d}", f"x{j:02d}", float(w[i, j])) for i in range(11) for j in range(i + 1, 11)]
        want[uri] = partition.solve(w).value
    df = spark.createDataFrame([*rows, ("c", "p", "q", -1.0)], LINKS)
    found = cl.correlation(df)
    got = {r.uri: r.worth for r in cl.worth(df, found).collect()}
    assert got == pytest.approx({**want, "c": 0.0}) and {r.gap for r in found.collect()} == {0.0} and found.count() == 24
    hard = spark.createDataFrame([("a", "x", "y", 5.0, 0), ("a", "y", "z", 5.0, 0), ("a", "x", "z", 0.0, -1), ("a", "z", "w", -3.0, 1)], LINKS + ", hard int")
    by = {r.item: r.cluster for r in cl.correlation(hard).collect()}
    assert by["x"] != by["z"] == by["w"] and by["y"] in (by["x"], by["z"])


def test_mining_keeps_exclusions_above_ten_items(spark):
    """Certain exclusions hold however strong the other evidence is, and contradictions are counted."""
    r = random.Random(4)
    names = [f"track|s|{i}.0|{i + 1}.0|{i}" for i in range(16)] + ["identity|A", "identity|B"]
    edges = [("u", a, b, round(0.05 + 0.9 * r.random(), 3)) for a, b in itertools.combinations(names, 2)]
    apart = {("identity|A", "identity|B"), *((names[i], names[i + 1]) for i in range(0, 16, 2))}
    edges = [(u, a, b, 0.0 if (a, b) in apart or (b, a) in apart else p) for u, a, b, p in edges]
    found = {x.item: x for x in gr.mine(spark.createDataFrame(edges, EDGES)).collect()}
    assert all(found[a].cluster != found[b].cluster for a, b in apart) and {x.broken for x in found.values()} == {0}
    edges += [("v", "track|s|1|2|1", "identity|A", 1.0), ("v", "track|s|1|2|1", "identity|B", 1.0), ("v", "identity|A", "identity|B", 0.0)]
    assert {x.broken for x in gr.mine(spark.createDataFrame(edges, EDGES)).where("uri = 'v'").collect()} == {1}


@pytest.mark.parametrize("n", [1, 4, 9])
def test_centers_against_all_subsets(n):
    for seed in range(6):
        r = np.random.default_rng(seed)
        c = np.triu(r.random((n, n)), 1)
        c = c + c.T
        c[c > 0.5] = np.inf
        np.fill_diagonal(c, 0)
        best = min(len(s) + c[list(s)].min(axis=0).sum() for k in range(1, n + 1) for s in itertools.combinations(range(n), k))
        found = partition.centers(c)
        assert found.value == pytest.approx(best) and found.gap < 1e-9
        opened = set(found.center.tolist())
        assert found.value == pytest.approx(len(opened) + sum(c[k, j] for j, k in enumerate(found.center)))


def test_thirty_items_around_few_centers():
    """Every choice of up to three centers of thirty items."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 0.08, (10, 2)) for m in (0, 1, 2)])
    c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    c[c > 0.9] = np.inf
    best = min(len(s) + c[list(s)].min(axis=0).sum() for k in (1, 2, 3) for s in itertools.combinations(range(30), k))
    found = partition.centers(c, nodes=4_000)
    assert found.value == pytest.approx(best) and found.gap < 1e-9 and len(set(found.center)) == 3


def test_centers_in_spark(spark):
    df = spark.createDataFrame([("u", "a", "b", 0.9), ("u", "b", "c", 0.8), ("u", "a", "c", 0.1), ("u", "d", "e", 0.2), ("v", "a", "b", 0.7)], LINKS)
    by = {(r.uri, r.item): (r.center, r.gap) for r in cl.centers(df, 0.5).collect()}
    assert by["v", "a"][0] in ("a", "b") and by == {("u", "a"): ("b", 0), ("u", "b"): ("b", 0), ("u", "c"): ("b", 0), ("u", "d"): ("d", 0), ("u", "e"): ("e", 0), **{("v", x): (by["v", "a"][0], 0) for x in "ab"}}


@pytest.mark.parametrize("kind", ["probability", "log", "weighted", "large", "small", "modularity"])
def test_objectives_against_all_partitions(spark, kind):
    r = random.Random(kind)
    items = "abcdef"
    p = {(x, y): round(0.05 + 0.9 * r.random(), 3) for x, y in itertools.combinations(items, 2) if (x, y) != ("b", "e")}
    long = {x: float(1 + i) for i, x in enumerate(items)}
    edges = spark.createDataFrame([("u", x, y, q) for (x, y), q in p.items()], EDGES)
    weights, more = gr.objective(edges, kind, 0.4, spark.createDataFrame([("u", x, v) for x, v in long.items()], "uri string, item string, duration double"), "max")
    found = {x.item: x.cluster for x in cl.correlation(weights, **more).collect()}
    degree = {x: sum(q for pair, q in p.items() if x in pair) for x in items}
    t = sum(degree.values())

    def value(cluster):
        total = 0.0
        for x, y in itertools.combinations(items, 2):
            q, same = p.get((x, y)), cluster[x] == cluster[y]
            if kind == "modularity":
                total += same * 2 * ((q or 0) / t - degree[x] * degree[y] / t**2)
            elif kind in ("large", "small"):
                total += same * (1 if kind == "large" else -1)
            elif q is not None and kind == "log":
                total += 0.6 * np.log(q) if same else 0.4 * np.log(1 - q)
            elif q is not None:
                w = max(long[x], long[y]) if kind == "weighted" else 1
                total += w * (0.4 * q if same else 0.6 * (1 - q))
        return total

    best = max(value(dict(zip(items, c, strict=True))) for c in all_partitions(6))
    assert value(found) == pytest.approx(best)
    with pytest.raises(ValueError):
        gr.objective(edges, "unknown")


def test_bic_queue_merges_as_before_and_compares_less():
    r = np.random.default_rng(8)
    sets = [r.normal(3 * (i % 4), 1, (40, 2)) for i in range(24)]
    models, label = {i: Gaussian.fit(x) for i, x in enumerate(sets)}, np.arange(24)
    while len(models) > 1:
        gain, i, j = min((models[i].bic(models[j], 3.5), i, j) for i in models for j in models if i < j)
        if not gain < 0:
            break
        models[i] = models[i].merge(models.pop(j))
        label[label == j] = i
    work = []
    assert list(fc.bic_clustering(sets, work=work)) == list(label) and len(work) < 24 * 23


def test_lag_average_against_bins(spark):
    r = random.Random(2)
    rows = lambda n: [(u, float(s), s + r.choice([0.4, 1.0, 7.3]), str(i)) for u in "uv" for i, s in enumerate(r.sample(range(40), n))]
    a, b = rows(9), rows(8)
    model = {k: round(r.random(), 3) for k in range(-6, 7) if k != 2}
    schema = "uri string, start double, end double, track string"
    bins = lambda s, e: range(int(np.floor(s / 0.5)), int(np.ceil(e / 0.5)))
    for future in (False, True):
        want = {}
        for (u, s, e, x), (w, p, q, y) in itertools.product(a, b):
            lags = [t - v for v in bins(s, e) for t in bins(p, q)] if u == w else []
            known = [model[k] for k in lags if k in model and (k >= 0 or not future) and abs(k) <= 6]
            if known:
                want[u, x, y] = np.mean(known)
        table = spark.createDataFrame([(k, v) for k, v in model.items()] + [(9, 1.0)], "lag long, probability double")
        got = gr.lag_average(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), table, 3.0, 0.5, future, bins=10.0)
        assert {(x.uri, x.a_track, x.b_track): x.probability for x in got.collect()} == pytest.approx(want)


def test_gather_repeats_the_last_frame(spark):
    frames = spark.createDataFrame([(u, i, [float(i)]) for u in "ab" for i in range(6)], "uri string, frame long, vec array<double>")
    focus = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 3.0), ("a", 4.0, 9.0), ("c", 0.0, 4.0), ("b", -3.0, 2.0)], "uri string, start double, end double")
    got = [(r.uri, r.position, r.vec[0]) for r in fe.gather(frames, focus, SlidingWindow(1.0, 1.0)).orderBy("uri", "position").collect()]
    assert got == [("a", i, x) for i, x in enumerate([0.0, 1.0, 4.0, 5.0, 5.0, 5.0])] + [("b", 0, 0.0), ("b", 1, 1.0)]
    inside = fe.crop(frames, focus, SlidingWindow(1.0, 1.0))
    assert {(r.uri, r.frame) for r in inside.collect()} == {(u, int(x)) for u, _, x in got}


def test_logistic_fit_recovers_its_curve(spark):
    true = (1.7, 0.6, 2.0, 0.8)
    x = np.linspace(-3, 8, 60)
    y = (1 + true[1] * np.exp(-true[0] * (x - true[2]))) ** (-1 / true[3])
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    found = ca.fit_generalized_logistic(points, (1.0, 1.0, 1.0, 1.0))
    fit = (1 + found[1] * np.exp(-found[0] * (x - found[2]))) ** (-1 / found[3])
    assert np.abs(fit - y).max() < 1e-4
    with pytest.raises(ValueError):
        ca.fit_generalized_logistic(points.limit(0), true)
    r = np.random.default_rng(1)
    samples = spark.createDataFrame([(float(v), 1) for v in r.normal(2, 1, 3000)] + [(float(v), 0) for v in r.normal(-1, 1, 3000)] + [(float("nan"), 1)], "score double, target int")
    bins = ca.logistic_points(samples).orderBy("x").collect()
    assert 10 < len(bins) < 50 and bins[0].y < 0.2 and bins[-1].y > 0.8
    model = ca.fit_generalized_logistic(ca.logistic_points(samples), (1.0, 1.0, 0.5, 1.0))
    out = ca.apply_generalized_logistic(spark.createDataFrame([(0.5,), (-9.0,), (9.0,)], "score double"), model).select(F.collect_list("posterior").alias("p")).first().p
    assert abs(out[0] - 0.5) < 0.1 and out[1] < 0.05 and out[2] > 0.95


def test_lag_queries_join_runs_not_bins(spark):
    """Long segments: as the bins spell out, with a plan that neither explodes bins nor broadcasts a side."""
    import math

    A, B = "uri string, start double, end double, track string, label string", 4
    a = [("u", 0.0, 95.0, "1", "x"), ("u", 90.0, 130.0, "2", "x"), ("u", 40.0, 61.0, "3", "y"), ("w", 0.0, 10.0, "4", "y")]
    b = [("u", 20.0, 75.0, "5", "x"), ("u", 150.0, 171.0, "6", "y"), ("u", 55.0, 60.0, "7", "y"), ("v", 0.0, 10.0, "8", "y")]
    grid = lambda rows, j: {(r[0], r[j], t) for r in rows for t in range(math.floor(r[1] / 10), math.ceil(r[2] / 10))}
    counts = {}
    for u, x, t in grid(a, 4):
        for w, y, s in grid(b, 4):
            if u == w and abs(s - t) <= B:
                n, m = counts.get(s - t, (0, 0))
                counts[s - t] = (n + 1, m + (x == y))
    want = {lag: m / n for lag, (n, m) in counts.items()}
    da, db = spark.createDataFrame(a, A), spark.createDataFrame(b, A)
    model = gr.lag_fit(da, db, 40.0, 10.0)
    got = {r["lag"]: r["probability"] for r in model.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    best = {}
    for u, x, t in grid(a, 3):
        for w, y, s in grid(b, 3):
            if u == w and 0 <= s - t <= B:
                best[(u, x, y)] = max(best.get((u, x, y), 0.0), want[s - t])
    edges = gr.lag_edges(da, db, model, 40.0, 10.0, future=True)
    assert {(r["uri"], r["a_track"], r["b_track"]): r["probability"] for r in edges.collect()} == {k: got[max((x for x in got if want[x] == p), key=lambda x: got[x])] for k, p in best.items()}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString() for df in (model, edges, gr.lag_average(da, db, model, 40.0, 10.0))]
    assert all("BroadcastExchange" not in p and "BroadcastHashJoin" not in p for p in plans[1:])
    assert "collect_set" not in plans[0]


def test_large_objective_joins_items_that_only_constraints_name(spark):
    """d may not meet c and has no other edge: it still joins a and b, which edges do not say."""
    rows = [("u", "a", "b", 0.5), ("u", "c", "d", 0.0), ("u", "b", "c", 0.0)]
    weights, more = gr.objective(spark.createDataFrame(rows, EDGES), "large")
    found = {r["item"]: r["cluster"] for r in cl.correlation(weights, **more).collect()}
    assert found["a"] == found["b"] and found["c"] != found["d"] and found["b"] != found["c"]
    assert found["d"] == found["a"]


def test_large_uris_are_cut_into_components_with_the_same_result(spark, monkeypatch):
    r = random.Random(5)
    pairs = [(u, x, y) for u in ("u", "v", None) for x, y in itertools.combinations([f"{g}{i}" for g in "abc" for i in range(4)], 2)]
    rows = [(u, x, y, float(r.randint(-3, 6) if x[0] == y[0] else -1), 1 if (x, y) == ("a0", "a1") else -1 if (x, y) == ("b0", "b1") else 0) for u, x, y in pairs]
    weights = spark.createDataFrame(rows, f"{LINKS}, hard int")
    near = weights.select("uri", "row", "col", (F.col("value") / 8).alias("value"))
    seen = []
    for size in (4_000, 3):
        monkeypatch.setattr(cl, "SMALL", size)
        parts = [cl.correlation(weights), cl.centers(near, 0.6), cl.components(weights.where("value > 2"))]
        seen.append([sorted(map(repr, df.collect())) for df in parts])
        assert len(seen[-1][0]) == len(seen[-1][1]) == 36
    # items of a null uri stay in either way, but links of one are followed in small groups only
    assert [[x for x in part if "uri=None" not in x] for part in seen[0]] == [[x for x in part if "uri=None" not in x] for part in seen[1]]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_counts_rows_once(spark):
    from spanloom.operators import timeline as tl

    df = lambda *rows: spark.createDataFrame(rows, "uri string, start double, end double")
    a, twice, other = df(("u", 0.0, 1.0), (None, 1.0, 2.0)), df(("u", 0.0, 1.0), ("u", 0.0, 1.0), (None, 1.0, 2.0)), df(("u", 0.0, 1.0), (None, 1.0, 3.0))
    assert [tl.equal(a, x).first()["equal"] for x in (a, twice, other)] == [True, False, False] and not tl.equal(twice, a).first()["equal"]
    assert "replicaterows" not in plan_of(tl.equal(a, other)).lower()


def test_shipping_pairs_come_from_counted_sets(spark):
    from spanloom.plans import solved

    assert plan_of(solved._shipping(spark, "/root/testdata/sf0.001")).count("Join ") == 1  # with the totals of a flag; orders are not joined


def test_pruning_takes_one_pass(spark):
    rows = [("u", f"identity|{x}", f"track|{t}", p) for t in "12" for x, p in (("a", 0.2), ("b", 0.9), ("c", 0.9), ("d", 0.1))]
    rows += [("u", "identity|a", "identity|b", 0.0), ("u", "track|1", "track|2", 0.5)]
    pruned = gr.prune_identities(spark.createDataFrame(rows, EDGES), 2)
    assert {tuple(r) for r in pruned.collect()} == {r for r in rows if r[3] in (0.9, 0.0, 0.5)}
    assert "Join" not in plan_of(pruned)


def test_assignments_are_streamed_by_uri(spark):
    from spanloom.operators import mapping as mp

    rows = [(u, r, c, float((n * 7 + i * 3 + j * 5) % 11)) for n, u in enumerate([None, *map(str, range(40))]) for i, r in enumerate("ab") for j, c in enumerate("xy")]
    found = mp.assignment_of(spark.createDataFrame(rows, LINKS))
    assert "FlatMapGroupsInPandas" not in plan_of(found)
    got = {}
    for r in found.collect():
        got.setdefault(r["uri"], set()).add((r["left"], r["right"]))
    for u in {r[0] for r in rows}:
        w = {(r[1], r[2]): r[3] for r in rows if r[0] == u}
        worth = lambda pairs: sum(w[p] for p in pairs)  # noqa: E731, B023
        assert worth(got[u]) == max(w["a", "x"] + w["b", "y"], w["a", "y"] + w["b", "x"])


def test_mine_solves_each_uri_once(spark):
    """Clusters get their names without a second run of the solver."""
    edges = [("u", "identity|A", "track|1", 1.0), ("u", "track|1", "track|2", 0.9), ("u", "track|3", "track|4", 0.9), ("u", "identity|B", "track|5", 1.0), ("u", "track|5", "track|6", 0.8)]
    found = gr.mine(spark.createDataFrame(edges, EDGES))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1
    names = {x.item: x.identity for x in found.collect()}
    assert names == {"identity|A": "A", "track|1": "A", "track|2": "A", "track|3": None, "track|4": None, "identity|B": "B", "track|5": "B", "track|6": "B"}


def test_regression_matches_equal_pieces_once(monkeypatch):
    """Pieces with the same rows share one assignment."""
    calls, real = [], er.assign
    monkeypatch.setattr(er, "assign", lambda w: calls.append(1) or real(w))
    rows = [("u", float(t), t + 1.0, kind, ref, hyp, side) for t in range(50) for side, kind, ref, hyp in (("new", "miss", "same-a", None), ("old", "correct", "same-a", "same-a"))]
    names = ["uri", "start", "end", "kind", "ref", "hyp", "side"]
    out = [r for b in er._compare(iter([pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=names)])) for r in b.to_pylist()]
    assert len(calls) == 1 and [(r["start"], r["label"], r["ref"]) for r in out] == [(float(t), "regression", "same-a") for t in range(50)]


def test_overlap_removal_joins_no_pieces(spark):
    """A sweep counts tracks: equal names are tracks of their own, one without a name counts for one."""
    rows = [("u", 0.0, 4.0, "a", "x"), ("u", 3.0, 6.0, "a", "y"), ("u", 8.0, 9.0, "b", "x"), ("v", 0.0, 2.0, None, "x"), ("v", 1.0, 3.0, "c", "x"), ("v", 2.5, 5.0, None, "y"), ("v", 4.0, 6.0, None, "y"), ("v", 5.0, 5.5, None, "z"), ("w", 0.0, 1.0, "a", "x")]
    ref = spark.createDataFrame(rows, "uri string, start double, end double, track string, label string")
    out = pr.without_overlap(ref)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_set") == 0
    # v: of the rows without a name one does not count beside others
    assert sorted({tuple(r) for r in out.collect()}) == [("u", 0.0, 3.0), ("u", 4.0, 9.0), ("v", 0.0, 6.0), ("w", 0.0, 1.0)]
