"""Golden values of small fixtures, invariants, and every SQL-checked query at the smallest scale."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import clustering as fc
from spanloom.functions.assignment import assign
from spanloom.functions.segment import Seg, SlidingWindow, clock, parse_clock
from spanloom.functions.stats import Gaussian, Mixture, isotonic, normal_quantile, viterbi
from spanloom.operators import annotation as an
from spanloom.operators import clustering as cl
from spanloom.operators import errors as er
from spanloom.operators import feature as fe
from spanloom.operators import mapping as mp
from spanloom.operators import metrics as me
from spanloom.operators import scores as sc
from spanloom.operators import timeline as tl
from spanloom.plans import programs as pr
from spanloom.plans import queries as plans
from spanloom.sources import binary, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def segs(spark, *rows, uri="u"):
    return spark.createDataFrame([(uri, float(a), float(b)) for a, b in rows], "uri string, start double, end double")


def labelled(spark, *rows):
    return spark.createDataFrame([("u", float(a), float(b), t, x) for a, b, t, x in rows], "uri string, start double, end double, track string, label string")


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_segment_expressions(spark):
    s = [Seg(F.lit(float(a)), F.lit(float(a + 2))) for a in range(1, 6)]
    x = s[1]
    row = spark.range(1).select(
        F.array(*[x.intersects(y) for y in s]), F.array(*[y.overlaps(F.lit(5.0)) for y in s]), F.array(*[x.hull(y).end for y in s]), x.gap(s[4]).start, x.gap(s[4]).end,
        F.array(*[Seg(F.lit(2.0), F.lit(6.0)).contains(y) for y in s]), Seg(F.lit(1.0), F.lit(1.0 + 1e-6)).filled(), Seg(F.lit(1.0), F.lit(1 + 2e-6)).filled(),
        Seg(F.lit(1.0), F.lit(3.0)).text(), clock(F.lit(3723.5)), parse_clock(F.lit("01:02:03,500")), x.duration(), x.middle(),
    ).first()
    assert row[0] == [True, True, True, False, False]
    assert row[1] == [False, False, True, True, True] and row[2] == [4, 4, 5, 6, 7] and (row[3], row[4]) == (4, 5)
    assert row[5] == [False, True, True, True, False] and row[6] is False and row[7] is True
    assert row[8] == "[1.000 --> 3.000]" and row[9] == "01:02:03.500" and row[10] == 3723.5 and row[11] == 2 and row[12] == 3


def test_sliding_window(spark):
    assert len(SlidingWindow(0.03, 0.01, 0.0, 0.1)) == 10
    with pytest.raises(ValueError):
        len(SlidingWindow())
    with pytest.raises(ValueError):
        SlidingWindow(0.0)


def test_timelines(spark):
    t = segs(spark, (0, 1), (0.5, 3), (6, 8), (4, 4))
    assert spans(tl.islands(t)) == [(0, 3), (6, 8)] and spans(tl.extent(t)) == [(0, 8)]
    assert spans(tl.cells(t)) == [(0, 0.5), (0.5, 1), (1, 3), (6, 8)]
    assert spans(tl.gaps(t)) == [(3, 6)] and spans(tl.gaps(t, segs(spark, (0, 10)))) == [(3, 6), (8, 10)]
    assert tl.duration(t).first().duration == 5
    assert spans(tl.cells(segs(spark, (0, 1), (1, 2), (2, 3), (2, 4), (6, 7)))) == [(0, 1), (1, 2), (2, 3), (3, 4), (6, 7)]
    f = segs(spark, (0, 2), (1, 3), (4, 6))
    focus = segs(spark, (2, 5))
    assert spans(tl.crop(f, focus, "loose")) == [(1, 3), (4, 6)] and spans(tl.crop(f, focus, "strict")) == []
    assert spans(tl.crop(f, focus)) == [(2, 3), (4, 5)] and spans(tl.crop(f, focus, bins=1.5)) == [(2, 3), (4, 5)]
    assert spans(tl.kth(f, -1)) == [(4, 6)]
    with pytest.raises(NotImplementedError):
        tl.crop(f, focus, "other")


def test_timeline_invariants(spark):
    r = random.Random(2)
    rows = [(f"u{i % 4}", a := float(r.randrange(60)), a + r.randrange(9)) for i in range(120)]
    t = spark.createDataFrame(rows, "uri string, start double, end double")
    isl = tl.islands(t)
    assert sorted(isl.collect()) == sorted(tl.islands(isl).collect()) == sorted(tl.islands(t, bins=5.0).collect())
    cover, hole = {x.uri: x.duration for x in tl.duration(t).collect()}, {x.uri: x.duration for x in tl.duration(tl.gaps(t)).collect()}
    for e in tl.extent(t).collect():
        assert cover[e.uri] + hole.get(e.uri, 0) == e.end - e.start
    assert sorted(tl.islands(tl.cells(t)).collect()) == sorted(isl.collect())
    pairs = {(a, b) for a in rows for b in rows if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]) - 1e-6}
    for bins in (None, 4.0):
        got = {((x.uri, x.a_start, x.a_end), (x.uri, x.b_start, x.b_end)) for x in tl.overlap_join(t, t, bins=bins).collect()}
        assert got == pairs


def test_annotations(spark):
    ab = labelled(spark, (0, 10, "a", "Alice"), (8, 20, "b", "Bob"))
    assert an.argmax(ab).first().label == "Bob" and an.argmax(ab, segs(spark, (22, 23))).count() == 0
    sp = labelled(spark, (0, 10, "1", "Alice"), (14, 20, "2", "Alice"), (10, 15, "3", "Bob"), (23, 30, "4", "Bob"))
    assert {r.label: r.duration for r in an.label_durations(sp).collect()} == {"Alice": 16, "Bob": 12}
    clipped = an.crop(labelled(spark, (0, 10, "x", "A"), (0, 10, "y", "B")), segs(spark, (2, 4), (2, 4)), prefix="t")
    assert sorted((r.start, r.end, r.label) for r in clipped.collect()) == [(2, 4, "A"), (2, 4, "A"), (2, 4, "B"), (2, 4, "B")]
    assert len({r.track for r in clipped.collect()}) == 4
    again = an.upsert(ab, labelled(spark, (0, 10, "a", "Carol")))
    assert sorted(r.label for r in again.collect()) == ["Bob", "Carol"]


def test_scores(spark):
    rows = [("u", 0.0, 1.0, "s1", x, s) for x, s in zip("ABC", (0.1, 0.2, 0.3))] + [("u", 0.0, 1.0, "s2", x, s) for x, s in zip("ABC", (0.4, 0.3, 0.2))] + [("u", 2.0, 3.0, "s1", x, s) for x, s in zip("ABC", (0.2, 0.1, 0.3))]
    s = spark.createDataFrame(rows, "uri string, start double, end double, track string, label string, score double")
    assert sorted((r.start, r.track, r.label) for r in sc.nbest(s, 1).collect()) == [(0, "s1", "C"), (0, "s2", "A"), (2, "s1", "C")]
    assert all(r.is_unknown == (r.start == 0 and r.track == "s1" or r.start == 2) for r in sc.to_annotation(s, posterior=True).collect())
    assert sc.from_wide(sc.to_wide(s, ["A", "B", "C"]), ["A", "B", "C"]).count() == 9


def test_mappers(spark):
    a = labelled(spark, (0, 1, "1", "a"), (1, 3, "2", "b"), (2.2, 3, "3", "c"))
    b = labelled(spark, (0, 1, "1", "A"), (1, 2, "2", "B"), (2, 2.5, "3", "C"))
    pairs = lambda df: {r.left: r.right for r in df.collect()}
    assert pairs(mp.conservative_mapper(a, b)) == {"a": "A", "c": "C"} and pairs(mp.conservative_mapper(b, a)) == {"A": "a", "B": "b"}
    assert pairs(mp.argmax_mapper(a, b)) == {"a": "A", "b": "B", "c": "C"} and pairs(mp.argmax_mapper(b, a)) == {"A": "a", "B": "b", "C": "b"}
    assert pairs(mp.hungarian_mapper(a, b)) == {"a": "A", "b": "B", "c": "C"}
    face = labelled(spark, (0, 4, "1", "p1"), (4, 15, "1", "p1"), (4, 15, "2", "p2"), (15, 17, "1", "p2"), (15, 17, "2", "p3"), (17, 25, "1", "p1"), (23, 30, "1", "p2"))
    voice = labelled(spark, (0, 10, "1", "Alice"), (14, 20, "2", "Alice"), (10, 15, "3", "Bob"), (23, 30, "4", "Bob"))
    assert pairs(mp.hungarian_mapper(face, voice)) == {"p1": "Alice", "p2": "Bob"}


def test_assignment_is_best():
    r = np.random.default_rng(1)
    for n, m in itertools.product((1, 2, 3, 5), (1, 2, 4, 5)):
        for _ in range(8):
            w = r.integers(0, 20, (n, m)).astype(float)
            big, small = (w, m) if n >= m else (w.T, n)
            best = max(sum(big[p[k], k] for k in range(small)) for p in itertools.permutations(range(len(big)), small))
            pairs = assign(w)
            assert len(pairs) == min(n, m) and sum(w[i, j] for i, j in pairs) == best


def test_segmentation_metrics(spark):
    ref = segs(spark, (0, 1), (1, 2), (2, 4))
    rate = lambda df: [r.rate for r in df.collect() if r.uri == "/all"][0]
    assert rate(me.segmentation_coverage(ref, segs(spark, (0, 4)))) == 1.0
    assert rate(me.segmentation_coverage(ref, segs(spark, (0, 3), (3, 4)))) == 0.75
    assert rate(me.segmentation_purity(ref, segs(spark, (0, 1), (1, 2), (2, 3), (3, 4)))) == 1.0
    assert rate(me.segmentation_purity(ref, segs(spark, (0, 4)))) == 0.5
    assert me.pk(ref, segs(spark, (0, 4))).first().rate == 0
    assert me.pk(ref, segs(spark, (0, 3), (3, 4))).first().rate == pytest.approx(1 / 3)


def test_every_probe_is_made(spark):
    def probes(ref, hyp):
        first = lambda side, t: next((n for n, (s, e) in enumerate(side) if s <= t <= e), None)
        k, lo, hi = sum(e - s for s, e in hyp) / len(hyp) / 2, ref[0][0], max(e for _, e in ref)
        for i in itertools.takewhile(lambda i: i < hi - k, itertools.count(lo)):
            yield [first(side, t) for side in (ref, hyp) for t in (i, i + k)]

    def turns(df):
        out = {}
        for r in df.select("uri", "start", "end").where("end > start").distinct().collect():
            out.setdefault(r.uri, []).append((r.start, r.end))
        return {u: sorted(x) for u, x in out.items()}

    cross = lambda a, b: (-1 if b is None else b) - (-1 if a is None else a)
    same = {"k_pk": lambda a, b, c, d: (a == b) == (c == d), "k_windowdiff": lambda a, b, c, d: cross(a, b) == cross(c, d)}
    ref, hyp = turns(plans.T(spark, SF)), turns(plans.TH(spark, SF))
    for name, f in same.items():
        got = {r.uri: r.rate for r in plans.queries()[name](spark, SF).collect()}
        hits = {u: [f(*x) for x in probes(ref[u], hyp[u])] for u in ref if u in hyp}
        want = {u: sum(x) / len(x) for u, x in hits.items() if x}
        assert len(got) > 5 and got == pytest.approx(want)


def test_mining_sees_every_score(spark):
    from spanloom.plans import views as v

    r = v.ann_unk(spark, SF)
    rows = lambda df: sorted(map(tuple, df.select("uri", "start", "end", "track", "label", "is_unknown").collect()))
    assert rows(plans.queries()["p_mine"](spark, SF)) == rows(pr.mine(r, scores=v.scores(spark, SF), names=r, alpha=0.7))


def test_shortest_paths_reach_the_end_of_a_chain(spark):
    from spanloom.operators import graph as gr

    rows = [("u", f"n{i:02}", f"n{i + 1:02}", 0.99) for i in range(12)] + [("u", "n00", "n12", 0.5), ("u", "x", "y", 0.9)]
    got = gr.shortest_paths(spark.createDataFrame(rows, "uri string, src string, dst string, probability double"), spark.createDataFrame([("u", "n00")], "uri string, item string"))
    assert {r["item"]: r.probability for r in got.collect()} == pytest.approx({f"n{i:02}": 0.99**i for i in range(13)})


def test_metric_identities(spark):
    from spanloom.plans import views as v

    r, h = v.ann_ref(spark, SF), v.ann_hyp(spark, SF)
    for row in me.identification(r, h).collect():
        assert row.correct + row.confusion + row.miss == pytest.approx(row.total)
    zero = me.identification(r, r).where("uri = '/all'").first()
    assert zero.rate == 0
    der = {x.uri: x.rate for x in me.diarization(r, an.translate_by(h, lambda c: F.concat(F.lit("x"), c))).collect()}
    ier = {x.uri: x.rate for x in me.identification(r, an.translate_by(h, lambda c: F.concat(F.lit("x"), c))).collect()}
    assert all(der[u] <= ier[u] + 1e-9 for u in der)
    total = sum(x.duration for x in er.diff_durations(r, h).collect() if x.kind != "false alarm")
    assert total == pytest.approx(me.identification(r, h).where("uri = '/all'").first().total)


def test_mixtures_use_every_frame(spark):
    r = np.random.default_rng(2)
    data = {"a": np.concatenate([r.normal(-3, 1, (4000, 2)), r.normal(3, 2, (3000, 2))]), "b": r.normal(1, 1, (50, 2)), None: r.normal(0, 1, (20, 2))}
    rows = [("u", i, x.tolist(), k) for k, xs in data.items() for i, x in enumerate(xs)]
    frames = spark.createDataFrame(rows, "uri string, frame long, vec array<double>, label string").repartition(5)
    for n in (1, 3):
        got = fe.collect_mixtures(fe.train_mixtures(frames, n))
        assert set(got) == set(data)
        for k, xs in data.items():
            want = Mixture.grow(xs, n)
            assert all(np.allclose(a, b, atol=1e-6) for a, b in ((got[k].weight, want.weight), (got[k].mean, want.mean), (got[k].var, want.var)))
    base = Mixture.grow(np.concatenate(list(data.values())), 2)
    moved = fe.collect_mixtures(fe.adapt_mixtures(frames, base))
    assert all(np.allclose(moved[k].mean, base.em(xs, 1, adapt="m", relevance=16.0).mean, atol=1e-9) for k, xs in data.items())


def test_statistics():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 3)), r.normal(1, 2, size=(70, 3))
    for diagonal in (False, True):
        g, whole = Gaussian.fit(x, diagonal).merge(Gaussian.fit(y, diagonal)), Gaussian.fit(np.concatenate([x, y]), diagonal)
        assert np.allclose(g.mean, whole.mean) and np.allclose(g.cov, whole.cov)
    assert Gaussian.fit(x).bic(Gaussian.fit(y), 1.0) > 0 > Gaussian.fit(x[:25]).bic(Gaussian.fit(x[25:]), 3.5)
    assert abs(normal_quantile(np.array([0.975]))[0] - 1.959964) < 1e-5
    assert list(isotonic(np.array([1.0, 3, 2, 4]), np.ones(4))) == [1, 2.5, 2.5, 4]
    data = np.concatenate([r.normal(-4, 1, (300, 1)), r.normal(4, 1, (300, 1))])
    assert np.allclose(np.sort(Mixture.grow(data, 2, 20).mean.ravel()), [-4, 4], atol=0.3)
    emit = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1]]))
    assert list(viterbi(emit, np.log(np.array([[0.9, 0.1], [0.1, 0.9]])), np.log([0.5, 0.5]))) == [0, 0, 0]
    assert abs(me.t_quantile(0.95, 10) - 1.812461) < 1e-3


def test_clustering_functions():
    r = np.random.default_rng(3)
    for _ in range(5):
        w = np.triu(r.integers(-5, 6, (6, 6)).astype(float), 1)
        w += w.T
        best = max(fc.correlation_value(w, np.array(p)) for p in itertools.product(range(6), repeat=6) if all(p[i] <= i for i in range(6)))
        assert fc.correlation_value(w, fc.correlation_clustering(w)) == best
    two = np.kron(np.eye(2), np.ones((4, 4))) - np.eye(8)
    two[0, 4] = two[4, 0] = 0.5
    label = fc.louvain(two)[-1]
    assert len(set(label[:4])) == 1 and len(set(label)) == 2 and fc.modularity(two, label) > 0.4
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.3], [0.1, 0.3, 1]])
    assert list(fc.replay(3, fc.agglomerate(s, "complete", 0.2))) == [0, 0, 2]
    assert list(fc.replay(3, fc.agglomerate(s, "single", 0.2))) == [0, 0, 0]


def test_components(spark):
    rows = [("u", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30] + [("v", "b", "a")]
    got = {(r.uri, r.item): r.component for r in cl.components(spark.createDataFrame(rows, "uri string, row string, col string")).collect()}
    assert got["u", "n030"] == "n000" and got["u", "n060"] == "n031" and got["v", "b"] == "a"


@pytest.mark.parametrize("name", ["mdtm", "ann", "repere", "ref", "repere_scores", "etf0", "tvm", "uem"])
def test_text_formats(spark, tmp_path, name):
    rows = [("u1", 0.5, 2.25, "0", "A", 0.5, "speaker"), ("u1", 3.0, 4.0, "1", "speaker#1", 0.25, "speaker"), ("u2", 0.0, 1.5, "0", "B", 1.0, "speaker")]
    df = spark.createDataFrame(rows, "uri string, start double, end double, track string, label string, score double, modality string")
    text.write(df, str(tmp_path / f"x.{name}"), name)
    back = text.read(spark, str(tmp_path / f"x.{name}"), name)
    cols = [c for c in ("uri", "start", "end", "label", "score") if c in back.columns]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, df.select(*cols).collect()))
    if "is_unknown" in back.columns:
        assert {r.label for r in back.where("is_unknown").collect()} == {"speaker#1"}


def test_other_sources(spark, tmp_path):
    srt = tmp_path / "a.srt"
    srt.write_text("1\n00:00:01,500 --> 00:00:02,750\nhello\n\n2\n00:01:00,000 --> 00:01:01,000\nbye\n")
    assert spans(text.read_srt(spark, str(srt), "u")) == [(1.5, 2.75), (60.0, 61.0)]
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "f.plp").write_bytes(np.array([2, 3, 1, 3], "<i4").tobytes() + x.tobytes())
    got = binary.read_plp(spark, str(tmp_path / "f.plp")).orderBy("frame").collect()
    assert [r.vec for r in got] == x.tolist() and got[0].uri == "f"
    (tmp_path / "g.raw").write_bytes(x.tobytes())
    assert binary.read_raw(spark, str(tmp_path / "g.raw"), "<f4", 3).count() == 4
    trs = tmp_path / "t.trs"
    trs.write_text('<Trans><Episode><Section type="report" startTime="0" endTime="9"><Turn speaker="s1 s2" startTime="0" endTime="4">a</Turn><Turn startTime="4" endTime="9">b</Turn></Section></Episode></Trans>')
    out = binary.read_trs(spark, str(trs), "u")
    assert out["status"].count() == 1 and sorted(r.label for r in out["speaker"].collect()) == ["s1", "s2"]
    with pytest.raises(ValueError):
        text.by_extension("x.unknown")
    assert text.template("/a/[URI].txt", uri="z") == "/a/z.txt"


def test_programs(spark, tmp_path):
    from spanloom.plans import views as v

    r, h = v.ann_ref(spark, SF), v.ann_hyp(spark, SF)
    ev = pr.evaluate(r, {"a": h, "b": r}, ["detection", "identification"], v.uem(spark, SF), skip_overlap=True).cache()
    assert {x.hypothesis: x.combined for x in pr.report(ev).where("metric = 'identification'").collect()}["b"] == 0
    assert 0 <= pr.significance(ev, "identification", "a", "b") <= 1
    pr.write_csv(ev, str(tmp_path / "out"), ["detection", "identification"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("uri = '/all'").count() == 2


def test_streaming_islands_equal_batch(spark, tmp_path):
    from spanloom.plans import views as v
    from spanloom.streaming import incremental as inc

    ref = v.ann_ref(spark, SF).select("uri", "label", "start", "end").where("label IN ('click', 'view')")
    # one later segment of another key lets timers end the islands of all keys
    last = spark.createDataFrame([("clock", "tick", 1e9, 1e9 + 1)], "uri string, label string, start double, end double")
    rows = ref.unionByName(last).orderBy("start").toPandas()
    src = tmp_path / "in"
    os.makedirs(src)
    for i in range(4):
        part = rows.iloc[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        part.to_parquet(src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (i + 1, i + 1))
    stream = spark.readStream.schema("uri string, label string, start double, end double").option("maxFilesPerTrigger", 1).parquet(str(src))
    def go():
        q = inc.islands(stream, 0.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert go() == 1  # the clock's own island
    rows.iloc[:5].to_parquet(src / "late.parquet")  # late rows start no islands anew
    os.utime(src / "late.parquet", (9, 9))
    assert go() == 1
    got = spark.read.parquet(str(tmp_path / "out")).where("start < 1e9")
    want = tl.islands(ref, ("uri", "label"))
    assert sorted(map(tuple, got.select("uri", "label", "start", "end").collect())) == sorted(map(tuple, want.select("uri", "label", "start", "end").collect()))


def norm(x):
    return round(float(x), 6) + 0.0 if isinstance(x, float) else [norm(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    cols = sorted(want.columns)
    got = plans.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    a = sorted((norm(tuple(r)) for r in got.select(*cols).collect()), key=repr)
    b = sorted((norm(r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert a == b
