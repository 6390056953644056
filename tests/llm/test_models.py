"""Link graph, audio, ordinal regression, pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import audio, toxicity, url_graph
from spanloom.llm.audio import from_wav
from spanloom.llm.common import table

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_urls(spark):
    urls = ["http://A.Example.org/en/12", "https://example.org/es/?q", "http://org/x", "http://notorg/x", "http://x.com/fr/1", "http://x.com/de/1", "nothing", None, "http://u@h:80#f", "http://example.org", "a://b.ORG/es/1", "http://z.example.org/es/a/b?c#d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "cast(null as string) html", "1 AS host", "2 AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(pages).collect()}
    assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == ("example.org", "/es/", "example.org/es/", "block")
    assert got[2] == ("org", "/x", "org/", "allow")
    assert got[3][:3] == ("notorg", "/x", None)
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][:3] == ("u@h:80", "", None)
    assert got[9][:3] == ("example.org", "", None)
    assert got[10][2:] == ("org/", "allow")
    assert got[11] == ("z.example.org", "/es/a/b", "example.org/es/", "block")
    assert url_graph.judge(pages.limit(0)).count() == 0


def walk(edges, seeds, damping=0.85, rounds=300):
    """Dense walk; what is at hosts without links goes back to the seeds."""
    total = {}
    for s, _, n in edges:
        total[s] = total.get(s, 0) + n
    whole, now = sum(seeds.values()), dict(seeds)
    for _ in range(rounds):
        lost = sum(x for h, x in now.items() if h not in total)
        new = {h: x * (1 - damping + damping * lost / whole) for h, x in seeds.items()}
        for s, d, n in edges:
            new[d] = new.get(d, 0) + damping * now.get(s, 0) * n / total[s]
        now = new
    return now


def test_propagation_equals_dense_walk(spark):
    link = lambda *hs: "".join(f'<a href="{h}">x</a>' for h in hs)
    rows = [
        (0, "http://good.org/", link("http://n1.net/a", "//n2.net/b", "/local")),
        (1, "http://n1.net/", link("http://n2.net/", "https://N3.net?x")),
        (2, "http://n4.net/", link("http://bad.com/de/x", "http://n5.net/")),
        (3, "http://n5.net/", link("http://n4.net/")),
        (4, "http://bad.com/de/", link("http://n1.net/")),
        (5, "http://n3.net/", None),
        (6, "http://n2.net/p", link("http://n2.net/q")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = [tuple(r) for r in url_graph.host_edges(pages).collect()]
    assert ("good.org", "n2.net", 1) in edges and ("n1.net", "n3.net", 1) in edges and len(edges) == 8
    got = {r.host: r for r in url_graph.judge(pages, damping=0.5).collect()}
    trust = walk(edges, {"good.org": 1.0}, 0.5)
    distrust = walk([(d, s, n) for s, d, n in edges], {"bad.com": 1.0}, 0.5)
    for h, r in got.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=2e-6)
        assert r.distrust == pytest.approx(distrust.get(h, 0), abs=2e-6)
    assert got["n4.net"].verdict == "block" and got["n5.net"].verdict == "block" and got["n1.net"].verdict == "allow"


def test_scores_have_one_scale(spark):
    """An unrelated link elsewhere changes no score; hubs are split without a change; far hosts are reached."""
    rows = [(0, "http://good.org/", None), (1, "http://far.net/", None)]
    cols = "page_id long, url string, html string"
    linked = [(1, "http://far.net/", '<a href="http://other.net/">x</a>')]
    for extra in ([rows[1]], linked, linked * 3):
        got = {r.host: r for r in url_graph.judge(spark.createDataFrame([rows[0], *extra], cols), damping=0.5).collect()}
        assert got["good.org"].trust == pytest.approx(1.0) and got["far.net"].distrust == 0.0
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">x</a>' * 3) for i in range(12)]
    hub = [(100 + i, f"http://leaf{i}.net/", '<a href="http://h0.net/a">x</a>') for i in range(7)]
    blocked = [(99, "http://x.com/de/", None), (98, "http://h12.net/", '<a href="http://x.com/de/">x</a>'), (97, None, "x" * 100_000 + '<a href="http://x.com/">')]
    pages = spark.createDataFrame([*chain, *hub, *blocked], cols)
    edges = url_graph.host_edges(pages)
    seeds = spark.createDataFrame([("x.com", 0.0, 1.0)], "host string, trust double, distrust double")
    one, two = ({tuple(r) for r in url_graph.propagate(edges, seeds, 0.5, hub=n).select("host", F.round("distrust", 12)).collect()} for n in (2, 100_000))
    assert one == two and len(one) == 21
    want = walk([(d, s, n) for s, d, n in (tuple(r) for r in edges.collect())], {"x.com": 1.0}, 0.5)
    assert all(x == pytest.approx(want[h], abs=2e-6) for h, x in one) and min(want.values()) > 0
    assert {r.verdict for r in url_graph.judge(pages, damping=0.5).collect() if r.host.startswith(("h", "leaf"))} == {"block"}


def test_base_moves_relative_links(spark):
    html = '<base target="x" href="http://b.net/dir/"><a href="p/q">x</a><a HREF=/r>y</a><a href="#top">z</a><a href="mailto:a@c.net">m</a><a href="http://d.net">d</a>'
    pages = spark.createDataFrame([(1, "http://a.net/", html), (2, "http://a.net/", None)], "page_id long, url string, html string")
    assert sorted(map(tuple, url_graph.host_edges(pages).collect())) == [("a.net", "b.net", 3), ("a.net", "d.net", 1)]


def test_media_are_stored(spark, odd_docs):
    import glob

    import pyarrow.parquet as pq

    docs = odd_docs.unionByName(table(spark, SF, "documents"), allowMissingColumns=True)
    media, found = audio.store(docs)
    texts = sorted((r.text or "").encode() for r in docs.select("text").collect())
    files = glob.glob(media._stored_at.removeprefix("file://") + "/*.parquet")
    stored = [from_wav(m.as_py())[1] for f in files for m in pq.read_table(f)["media"]]
    assert sorted(stored) == sorted(t.ljust(max(576, -(-len(t) // 576) * 576), b"\xff") for t in texts)
    files = glob.glob(found._stored_at.removeprefix("file://") + "/*.parquet")
    kept = [x.as_py() for f in files for x in pq.read_table(f)["patches"]]
    assert len(kept) == len(texts) and all(audio.unpack_patches(x)[0].shape[1:] == (64, 32) for x in kept)
    none = spark.createDataFrame([(1, 0, None)], audio.MEDIA)
    assert tuple(audio.digests(audio.features(none)).first()) == (1, 0, *[None] * 6)


def test_resampler_equals_direct_convolution():
    p = audio.Params()
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, 777).astype(np.float32)
    n = p.taps * p.up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(p.up, p.down)) / max(p.up, p.down) * p.up * np.hamming(n)
    stuffed = np.zeros(len(x) * p.up)
    stuffed[:: p.up] = x
    want = np.convolve(stuffed, h)[: len(stuffed)][:: p.down]
    got = audio.resample(x, p)
    assert np.allclose(got[: len(want)], want[: len(got)], atol=1e-4)
    frame = got[p.hop : p.hop + p.frame] * np.hanning(p.frame)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(p.frame // 2 + 1), np.arange(p.frame)) / p.frame) @ frame
    mel = np.log(np.abs(dft) ** 2 @ audio._mel_filters(p) + 1e-6)
    assert np.allclose(audio.log_mel(got, p)[1], mel, atol=1e-3)


def test_audio_round_trip(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    for d in (docs, odd_docs):
        rows = audio.digests(audio.features(audio.encode_texts(d))).collect()
        texts = sorted(((r.text or "").encode() for r in d.collect()))
        assert len(rows) == len(texts) and sorted(r.n_bytes for r in rows) == sorted(map(len, texts))
        shas = {}
        for t in texts:
            size = max(576, -(-len(t) // 576) * 576)
            p = t.ljust(size, b"\xff")
            shas[hashlib.sha256(p).hexdigest()] = (len(t), size, zlib.crc32(p[-32:]))
        assert all(shas[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32) for r in rows)
        assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in rows}) == len({r.payload_sha256 for r in rows})
        assert sorted(map(tuple, audio.digest_texts(d).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert audio.features(audio.encode_texts(no_docs)).count() == 0 and audio.digest_texts(no_docs).count() == 0


def test_audio_signal():
    p = audio.Params()
    t = np.arange(16_000) / p.rate
    tone = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    y = audio.resample(tone, p)
    assert len(y) == 10_000
    spectrum = np.abs(np.fft.rfft(y[200:9800] * np.hanning(9600)))
    assert abs(np.argmax(spectrum) * p.out_rate / 9600 - 1000) < 3
    alias = audio.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32), p)
    assert np.abs(alias[200:-200]).max() < 0.05 * np.abs(y[200:-200]).max()
    direct = audio.resample(tone, p, block=64)
    assert np.allclose(direct, y, atol=1e-6)
    loud = tone * np.where((t > 0.3) & (t < 0.6), 1.0, 0.01).astype(np.float32)
    mel = audio.log_mel(audio.resample(loud, p), p)
    found = audio.segments(mel, audio.Params(high=0.9, low=0.72))
    assert len(found) == 1 and abs(found[0][0] - 0.3) < 0.05 and abs(found[0][1] - 0.6) < 0.05
    patches, spans = audio.unpack_patches(audio.pack_patches(mel, p))
    assert patches.shape[1:] == (p.patch, p.mels) and np.array_equal(patches.reshape(-1, p.mels)[: len(mel)], mel.astype(np.float16))
    assert spans[-1][1] == pytest.approx(len(mel) * p.hop / p.out_rate)


def test_toxicity_held_out(spark, odd_docs, no_docs):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    train = labels.where("pmod(xxhash64(doc_id, 1), 2) = 0")
    model = toxicity.fit(docs, train)
    assert np.all(np.diff(model.thresholds) > 0)
    held = toxicity.score(docs, model).join(labels.where("pmod(xxhash64(doc_id, 1), 2) = 1").selectExpr("doc_id", "toxic AS y"), "doc_id").select("n_words", "severity", "toxic", "y").collect()
    hit = [r for r in held if r.toxic and r.y]
    assert len(hit) >= 0.7 * sum(r.y for r in held)
    assert sum(r.toxic and not r.y for r in held) <= 0.02 * len(held)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 8 and not any(r.toxic for r in odd)
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(no_docs, labels)
    assert not any(r.toxic for r in toxicity.score(odd_docs, none).collect())
    assert toxicity.clean_rows(odd_docs, model).columns == odd_docs.columns


def test_ordinal_fit_recovers_thresholds():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (6000, 3)).astype(float)
    w, theta = np.array([2.0, -1.0, 0.5]), np.array([0.5, 1.5, 3.0])
    grades = (x @ w + r.logistic(size=6000))[:, None] > theta[None, :]
    y = grades.sum(axis=1)
    rows = [([i for i in range(3) if a[i]], [1.0 for i in range(3) if a[i]]) for a in x]
    got, cuts = toxicity.fit_thresholds(rows, y, 3, steps=1500, l2=0.0)
    assert np.allclose(got[:3], w, atol=0.2) and np.allclose(cuts, theta, atol=0.2)


def test_pipeline(spark, odd_docs):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    docs_columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, "t")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[4] > 0
    odd = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        assert name == "packing" or out.columns == docs_columns
        odd = corpus_pipeline.materialize(out, "t")
        # null, empty and repeated texts count once among near duplicates, and not at all in the mix
        assert odd.count() == {"toxicity": 8, "near duplicates": 6}.get(name, odd.count())
    assert odd.count() > 0
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.materialize(stage(spark, empty, SF), "t")
    assert empty.count() == 0


def test_toxicity_sample_is_bounded_by_ids(spark):
    """Ids that very many documents repeat, labels that repeat or are null: one row an id is fitted."""
    from spanloom.llm import toxicity

    rows = [(i, "calm words about the sea and the sky " * 3 if i % 2 else "vile foul nasty words about the sea " * 3) for i in range(60)]
    docs = spark.createDataFrame([*rows, *[(1, f"vile foul nasty {i}") for i in range(3000)], (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1 - i % 2) for i in range(60)], *[(i, 1 - i % 2) for i in range(30)], (1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    seen = []
    keep = toxicity.materialize
    toxicity.materialize = lambda df, name: seen.append(keep(df, name)) or seen[-1]
    try:
        model = toxicity.fit(docs, labels, fit_rows=50)
    finally:
        toxicity.materialize = keep
    assert 45 <= seen[0].count() <= 50
    out = {r.doc_id: r.toxic for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(out[i] == (i % 2 == 0) for i in range(60))
