"""WARC, mixing, packing."""

import gzip
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import cube_mix, packing, warc
from spanloom.llm.common import table

SF = "/root/testdata/sf0.001"


def files(root):
    import glob

    return {p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(root.removeprefix("file://") + "/*.gz")}


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (2, "http://b/\n%", big), (3, None, "é" * 600), (4, "http://c/", None), (5, "u", "tiny"), (6, "u", "tiny"), (None, "n", big), (7, "r", "y" * 1000), (7, "r", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS shard")
    rows += [(8, "http://a/b%20c", "z"), (9, " urn:null", "z"), (10, "urn:null", "z" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS shard")
    roots = [f"file://{tmp_path}/{i}" for i in range(2)]
    for i, root in enumerate(roots):
        warc.write(pages.repartition(1 + 3 * i), root, shard_bytes=4000, file_bytes=300)
    assert files(roots[0]) == files(roots[1]) and len(files(roots[0])) > 3
    got = sorted(map(tuple, warc.read(spark, roots[0]).collect()), key=repr)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = []
    for i, (p, u, h) in enumerate(rows):
        h = h or ""
        ref = {1: 2, None: 2}.get(p) if h == big else (7 if i == 8 else None)
        want.append((p, u, "revisit" if ref else "response", len(h.encode()), sha(h), ref, None if ref else bytearray(h.encode())))
    assert got == sorted(want, key=repr)
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in files(roots[0]).values())
    heads = [dict(x.split(": ", 1) for x in m.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for b in files(roots[0]).values() for m in warc.members(__import__("io").BytesIO(b))]
    pages_only = [h for h in heads if h["WARC-Type"] != "warcinfo"]
    assert len(heads) - len(pages_only) == len(files(roots[0])) and len(pages_only) == len(rows)
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) and any(h["WARC-Target-URI"] == "http://a/b%20c" for h in pages_only)
    for h in pages_only:
        if h["WARC-Type"] == "revisit":
            first = ids[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["X-Page-ID"] == h["X-Refers-To-Page-ID"] and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"file://{tmp_path}/nothing")
    empty = f"file://{tmp_path}/none"
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_shards_hold_equal_bytes(spark):
    """No cap on their number; a third of the rows without an id is cut too; both look-ups agree."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS page_id", "id", "concat('page ', id, repeat('x', cast(id % 90 AS int))) AS html")
    pid = F.coalesce("page_id", F.lit(warc.NULL_ID))
    keyed = rows.select(warc.sort_key(pid, F.sha1("html")).alias("key"), F.length("html").cast("long").alias("n"), "id")
    starts = warc.shard_starts(keyed, 400, rows_per_range=500)
    one, n = warc.with_shard(keyed, starts)
    two, m = warc.with_shard(keyed, starts, lookup=5)
    assert n == m > 300 and {(r.id, r.shard) for r in one.collect()} == {(r.id, r.shard) for r in two.collect()}
    held = one.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(held) == n and max(r.n for r in held) < 400 + 110


def test_cube_mix_totals(spark):
    docs = table(spark, SF, "documents")
    rows = cube_mix.mix(docs, block=16).collect()
    again = cube_mix.mix(docs.repartition(5), block=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
    want = waterfill({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s]) and rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r["size"] for r in rs)
        ratio = want[s] / rs[0].source_size
        docs_taken = sum(r.taken / r["size"] for r in rs if r["size"])
        assert abs(docs_taken - ratio * len(rs)) <= 3


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = sum(w[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else left * w[s] / rest for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over
        left -= sum(2 * sizes[s] for s in over)


def test_cube_mix_odd(spark, odd_docs, no_docs):
    rows = cube_mix.mix(odd_docs).collect()
    assert len(rows) == 8 and all(r.taken <= 2 * r["size"] for r in rows)
    assert {r.source for r in rows} == {None, "a", "b", "c"}
    assert cube_mix.mix(no_docs).count() == 0
    assert sum(r.taken for r in cube_mix.mix(odd_docs.where("doc_id = 2")).collect()) == 0


def check_packing(docs, rows, limit):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        for i, (s, n) in enumerate(packing.cut(len(ids), limit)):
            want.append((r.doc_id, i, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n]))))
    assert sorted(want, key=repr) == sorted((tuple(r)[:5] for r in rows), key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for got in by.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= limit
    return len(by), sum(r.length for r in rows)


def test_packing(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    used, tokens = check_packing(docs, packing.best_fit(docs).collect(), 1024)
    assert used <= plain_best_fit([r.length for r in packing.pieces(docs).collect()], 1024) and used <= 1.02 * tokens / 1024 + 1
    check_packing(odd_docs, packing.best_fit(odd_docs, limit=64).collect(), 64)
    assert packing.best_fit(no_docs).count() == 0


def plain_best_fit(lengths, limit):
    """Sequences that best-fit decreasing needs, one piece at a time."""
    from bisect import bisect_left, insort

    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else limit
        if room > n:
            insort(rooms, room - n)
        else:
            rooms.insert(0, 0)
    return len(rooms)


def test_no_more_sequences_than_best_fit(spark):
    lengths = [r.length for r in packing.pieces(table(spark, "/root/testdata/sf0.01", "documents")).collect()]
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    used = sum(n for _, n in packing.pack(hist))
    assert used <= plain_best_fit(lengths, 1024) and used <= sum(lengths) / 1024 + 3


def test_pack_near_bound():
    import random

    r = random.Random(3)
    hist = defaultdict(int)
    for _ in range(4000):
        hist[min(1024, max(1, int(r.lognormvariate(5.5, 0.9))))] += 1
    runs = packing.pack(dict(hist))
    got = defaultdict(int)
    for lengths, n in runs:
        assert sum(lengths) <= 1024
        for x in lengths:
            got[x] += n
    assert got == hist
    assert sum(n for _, n in runs) <= 1.01 * sum(k * n for k, n in hist.items()) / 1024 + 1


def test_patterns_cover_large_pieces():
    import random

    r = random.Random(5)
    for n in (6000, 60_000):
        hist = defaultdict(int)
        for _ in range(n):
            hist[min(1024, max(1, int(r.lognormvariate(5.5, 0.9))))] += 1
        large = {k: c for k, c in hist.items() if 128 < k < 1024}
        groups = packing._groups(large, 64)
        counts = [sum(c for _, c in g) for g in groups]
        used, left = packing.configurations([g[0][0] for g in groups], counts, 1024)
        assert all(sum(groups[g][0][0] * k for g, k in p.items()) <= 1024 for p, _ in used)
        assert [sum(p.get(g, 0) * t for p, t in used) + x for g, x in enumerate(left)] == counts
        assert sum(left) <= 64 * 7 and sum(left) <= 0.05 * sum(counts)


def test_added_token_has_its_id(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"foo {mark} bar", mark, f"{mark}{mark} x", f"a  b{mark}", "no mark <|endoftext| here", f"one{mark}two \n{mark}  ", "plain words", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (50256 in ids) == (mark in (t or ""))
        want.append((i, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    assert sorted(map(tuple, packing.pieces(docs).collect())) == want


def test_grouped_patterns_against_best_fit():
    """Finer groups bring the patterns to plain best fit's number of sequences, to a thousandth at most."""
    import random

    count = lambda runs: sum(n for _, n in runs)
    r = random.Random(1)
    for draw in (lambda: r.randint(1, 256), lambda: min(256, 1 + int(r.lognormvariate(4, 0.9))), lambda: r.randint(60, 200), lambda: r.choice([90, 100, 130, 170])):
        hist = defaultdict(int)
        for _ in range(3000):
            hist[draw()] += 1
        runs = packing.pack(hist, 256)
        held = defaultdict(int)
        for lengths, n in runs:
            assert sum(lengths) <= 256
            for x in lengths:
                held[x] += n
        assert held == hist and count(runs) <= 1.001 * count(packing.scheme(hist, 256, 64, 1.0, True)) + 1
    # groups of one length, split by cardinality, are one size again
    assert packing._groups({90: 10, 100: 7}, 64) == [[(100, 1)] * 7, [(90, 1)] * 10]
