"""Bins, checks, models, agglomeration, hidden states, mappings, formats."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import clustering as fc
from spanloom.functions.segment import SlidingWindow
from spanloom.functions.stats import Mixture, ScoreRatio
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import feature as fe
from spanloom.operators import graph as gr
from spanloom.operators import mapping as mp
from spanloom.operators import metrics as me
from spanloom.operators import tagging as tg
from spanloom.operators import timeline as tl
from spanloom.plans import programs as pr
from spanloom.sources import models, text

ROW = "uri string, start double, end double, track string, label string"


def rows(spark, seed, uris=("a", None), n=120):
    r = random.Random(seed)
    out = []
    for u in uris:
        for i in range(n):
            s = r.randrange(0, 500)
            out.append((u, float(s), float(s + r.choice([0, 1, 5, 40])), str(i), r.choice("xyz")))
    return spark.createDataFrame(out + out[:3], ROW)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_bins_change_no_result(spark, how):
    """One uri holds all rows, or none does (null)."""
    for uris in (("a",), ("a", None)):
        a, b = rows(spark, 1, uris), rows(spark, 2, uris, 15)
        plain = tl.overlap_join(a, b, how=how)
        assert plain.count() > 10
        for bins in (7.0, 1000.0):
            assert same(plain, tl.overlap_join(a, b, how=how, bins=bins))


def test_bins_in_metrics_and_taggers(spark):
    a, b = rows(spark, 1, ("a",)), rows(spark, 2, ("a",), 30)
    assert same(me.detection(a, b), me.detection(a, b, bins=20.0)) and same(me.identification(a, b), me.identification(a, b, bins=20.0))
    assert same(tg.argmax_annotation(a, b), tg.argmax_annotation(a, b, bins=20.0)) and same(tg.conservative(a, b), tg.conservative(a, b, bins=20.0))
    assert same(tl.crop(a, b, "strict"), tl.crop(a, b, "strict", bins=20.0))
    assert tl.bin_width(a) is None and 0 < tl.bin_width(a, rows=10) < 500 and tl.bin_width(a.limit(0)) is None


def test_tagger_check(spark):
    a = rows(spark, 1, ("a",))
    tg.check(a, a)
    tg.check(a, tl.timeline(a), labelled=False)
    for source, target in ((tl.timeline(a), a), (a, tl.timeline(a)), (a, rows(spark, 1, ("b",)))):
        with pytest.raises(ValueError):
            tg.check(source, target)
    for tagger in (tg.direct, tg.conservative, tg.argmax_timeline, tg.argmax_annotation, tg.by_mapping):
        with pytest.raises(ValueError):
            tagger(tl.timeline(a), a)
    for tagger in (tg.conservative, tg.argmax_annotation, tg.by_mapping):
        with pytest.raises(ValueError):
            tagger(a, tl.timeline(a))


def test_several_matches_are_an_error(spark):
    a = rows(spark, 1, ("a", "b")).withColumn("modality", F.lit("m"))
    with pytest.raises(ValueError):
        text.select_one(a)
    assert text.select_one(a, "a").count() > 0 and text.select_one(a, "c").count() == 0


def test_wilcoxon_equals_ranks(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 9, 40).astype(float), r.integers(1, 12, 40).astype(float)
    d = (a - b)[a != b]
    size = np.abs(d)
    rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    n, w = len(d), min(rank[d > 0].sum(), rank[d < 0].sum())
    ties = np.unique(size, return_counts=True)[1]
    z = (w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    from math import erf, sqrt

    got = me.wilcoxon(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double"))
    assert got == pytest.approx(1 + erf(z / sqrt(2)))


def naive(similarity, linkage):
    groups, out = [[i] for i in range(len(similarity))], []
    join = {"complete": np.min, "average": np.mean, "single": np.max}[linkage]
    while len(groups) > 1:
        pairs = [(-join(similarity[np.ix_(a, b)]), a, b) for a, b in itertools.combinations(groups, 2)]
        s, a, b = min(pairs, key=lambda p: round(p[0], 9))
        groups.remove(b)
        groups[groups.index(a)] = sorted(a + b)
        out.append((sorted(a + b), -s))
    return out


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
def test_agglomeration_equals_recomputed_linkage(linkage):
    r = np.random.default_rng(4)
    x = r.random((12, 12))
    x = (x + x.T) / 2
    got, want = fc.agglomerate(x, linkage), naive(x, linkage)
    assert [m for m, _ in got] == [m for m, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert len(fc.agglomerate(x, linkage, stops=(fc.at_most(5),))) == 7
    low = want[4][1]
    assert all(s >= low for _, s in fc.agglomerate(x, linkage, stops=(fc.below(low),)))
    assert fc.agglomerate(-np.abs(x), linkage, stops=(fc.negative,)) == []
    apart = fc.agglomerate(x, linkage, allowed=lambda a, b: not {0, 1} <= set(a + b))
    assert fc.replay(12, apart)[0] != fc.replay(12, apart)[1]


def test_constraints(spark):
    a = spark.createDataFrame([("u", 0.0, 5.0, "1", "a"), ("u", 3.0, 6.0, "2", "b"), ("u", 7.0, 8.0, "3", "c"), ("u", 50.0, 60.0, "4", "d")], ROW)
    pairs = lambda df: {(r.row, r.col) for r in df.collect()}
    assert pairs(cl.apart(a)) == {("a", "b"), ("b", "a")}
    assert pairs(cl.not_contiguous(a, 1.0)) == {(x, y) for x, y in itertools.permutations("abcd", 2)} - {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_louvain_mapper(spark):
    a = spark.createDataFrame([("u", 0.0, 10.0, "1", "a"), ("u", 10.0, 20.0, "2", "b"), ("u", 30.0, 40.0, "3", "c")], ROW)
    b = spark.createDataFrame([("u", 0.0, 19.0, "1", "x"), ("u", 19.0, 20.0, "2", "y"), ("u", 31.0, 40.0, "3", "z"), ("u", 30.0, 31.0, "4", "w")], ROW)
    for options in ({}, {"normalize": True}):
        got = {tuple(r.left): set(r.right) for r in mp.louvain_mapper(a, b, **options).collect() if "c" in r.left}
        assert got == {("c",): {"w", "z"}}
    every = mp.louvain_mapper(a, b, overlap=True).collect()
    assert sorted(x for r in every for x in r.left) == ["a", "b", "c"] and sorted(x for r in every for x in r.right) == ["w", "x", "y", "z"]


def _frames(spark, labels, seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([("u", i, [float(v) for v in r.normal(3.0 * (x == "s"), 1.0, 2)], x) for i, x in enumerate(labels)], "uri string, frame long, vec array<double>, label string")


def test_hidden_states(spark):
    labels = ["n"] * 60 + ["s"] * 80 + ["n"] * 60 + ["s"] * 40
    frames = _frames(spark, labels)
    scored = fe.frame_scores(frames, fe.collect_mixtures(fe.train_mixtures(frames, 1)))
    states, start, move = fe.fit_transitions(scored, 5)
    assert states == ["n", "s"] and np.allclose(np.exp(move).sum(axis=1), 1) and np.exp(move).diagonal().min() > 0.9 and np.exp(start)[0] > 0.9
    runs = sorted((r["first"], r["stop"], r["label"]) for r in fe.decode(scored, model=(states, start, move)).collect())
    assert [x[2] for x in runs] == ["n", "s", "n", "s"] and runs[0][0] == 0 and runs[-1][1] == 240 and all(a[1] == b[0] for a, b in itertools.pairwise(runs))
    w = SlidingWindow(1.0, 1.0)
    got = fe.activity(frames, frames, w, 1, shortest=5.0).where("label = 's'").orderBy("start").collect()
    assert len(got) == 2 and abs(got[0].start - 60) <= 3 and abs(got[0].end - 140) <= 3
    assert fe.turns_within(frames, spark.createDataFrame([("u", 50.0, 150.0)], "uri string, start double, end double"), w, 20, 0.5).count() >= 1
    tracks = spark.createDataFrame([("u", 70.0, 120.0, "t")], "uri string, start double, end double, track string")
    who = {r.label: r.score for r in fe.identify(frames, tracks, w, frames, 1, open_set=False).collect()}
    assert who["s"] > 0.99


def test_majority_equals_median():
    r = np.random.default_rng(3)
    path = (r.random(50) < 0.4).astype(int)
    for reach in (0, 1, 4):
        padded = np.pad(path, reach, mode="symmetric")
        want = [int(np.median(padded[i : i + 2 * reach + 1])) for i in range(50)]
        assert fe.majority(path, reach).tolist() == want


def test_models_come_back(spark, tmp_path):
    ratio = ScoreRatio(np.array([0.0, 1.0]), np.array([-1.0, 2.0]), 0.3)
    models.save_ratio(spark, ratio, str(tmp_path / "r"), "test")
    back = models.load_ratio(spark, str(tmp_path / "r"))
    assert back.prior == 0.3 and back.x.tolist() == [0.0, 1.0] and back.llr.tolist() == [-1.0, 2.0]
    mix = {"a": Mixture(np.array([0.5, 0.5]), np.array([[0.0, 1.0], [2.0, 3.0]]), np.ones((2, 2)))}
    models.save_mixtures(spark, mix, str(tmp_path / "m"))
    assert models.load_mixtures(spark, str(tmp_path / "m"))["a"].mean.tolist() == mix["a"].mean.tolist()
    with pytest.raises(Exception, match="exist"):
        models.save_ratio(spark, ratio, str(tmp_path / "r"))


def test_similarity_training_and_calibrated_edges(spark):
    r = random.Random(1)
    tracks = spark.createDataFrame([("u", float(i), i + 1.0, f"t{i}", "ab"[i % 2]) for i in range(30)], ROW)
    pairs = [("u", f"t{i}", f"t{j}", (0.7 if (i - j) % 2 == 0 else 0.3) + r.uniform(-0.3, 0.3)) for i, j in itertools.combinations(range(30), 2)]
    matrix = spark.createDataFrame(pairs, "uri string, row string, col string, value double")
    model = pr.train_track_similarity(matrix, tracks, bins=10)
    assert np.all(np.diff(model.llr) >= 0) and model.llr[-1] > model.llr[0]
    edges = gr.intra_edges(matrix, tracks.where("track <> 't0'"), model)
    assert edges.count() == 29 * 28 // 2 and edges.where("probability < 0 OR probability > 1").count() == 0
    named = pr.diarize(matrix, tracks.withColumn("label", F.col("track")), model)
    assert named.select("label").distinct().count() < 30
    scores = tracks.withColumn("score", F.lit(0.6)).unionByName(tracks.withColumn("label", F.lit("z")).withColumn("score", F.lit(0.2)))
    assert gr.identification_edges(scores, tracks, model, 1).count() == 30 and gr.identification_edges(scores, tracks, model).count() == 60
    hyp = tracks.withColumn("label", F.concat("label", (F.floor(F.col("start") / 10)).cast("string")))
    names = sorted(r.label for r in hyp.select("label").distinct().collect())
    sims = spark.createDataFrame([("u", x, y, (0.8 if x[0] == y[0] else 0.3) + r.uniform(-0.35, 0.35)) for x, y in itertools.permutations(names, 2) for _ in range(8)], "uri string, row string, col string, value double")
    assert pr.train_similarity(sims, tracks, hyp, bins=5).prior == pytest.approx(6 / 15)
    assert ca.cluster_links(tracks, hyp).where("value = 1").count() == 6


def test_track_list(spark, tmp_path):
    (tmp_path / "x.lst").write_text("show_a.avi\n12\n13\n\nshow_b.avi\n7\n")
    got = sorted(map(tuple, text.read_track_list(spark, str(tmp_path / "x.lst")).collect()))
    assert got == [("show_a", "12"), ("show_a", "13"), ("show_b", "7")]
    assert pr.parse_threshold("-oo") == float("-inf") and pr.parse_threshold("P") == "posterior" and pr.parse_threshold("0.5") == 0.5
