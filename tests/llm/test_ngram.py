"""The similarity join against all pairs."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ngram_join
from spanloom.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            c = len(sets[i] & sets[j])
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies():
    """Groups that mutate a few words of a base, chains of edits, shared passages, tiny texts."""
    import random

    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = r.choices(vocab, k=r.choice([12, 60, 150]))
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    chain = r.choices(vocab, k=120)
    for _ in range(30):
        rows.append((len(rows), " ".join(chain)))
        chain[r.randrange(120)] = f"n{len(rows)}"
    passage = " ".join(r.choices(vocab, k=50))
    for _ in range(30):
        rows.append((len(rows), passage + " " + " ".join(r.choices(vocab, k=r.choice([3, 8, 40])))))
    for n in (1, 2, 3, 4, 5, 6, 10):
        for _ in range(4):
            rows.append((len(rows), " ".join(r.choices(vocab[:3], k=n))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "rare"), [(3, 90, 16), (5, 80, 2), (2, 60, 3)])
def test_join_equals_all_pairs(spark, width, percent, rare):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.classes(df, width, percent, rare).collect()), key=repr)
    assert got == brute(rows, width, percent)


def templates(spark, n):
    """Pages of one long template with words of their own: none links with another."""
    import random

    r = random.Random(9)
    frame = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join([*frame[:200], *[f"o{i}_{j}" for j in range(30 if i % 2 else 31)], *frame[200:]])) for i in range(n)]
    rows += [(n + i, " ".join([*frame[:200], *[f"f{j}" for j in range(30)], *frame[200:], f"v{i % 3}"])) for i in range(9)]  # a class that links
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_templates_cost_no_pairs(spark, monkeypatch):
    seen = []
    cross = ngram_join._cross

    def counted(rows, percent):
        asks = rows.where("probe").join(ngram_join._meeting_bands(rows, percent), ["key", "nb", "rb"])
        held = rows.groupBy("key", F.col("nb").alias("to_nb"), F.col("rb").alias("to_rb")).agg(F.count(F.lit(1)).alias("c"))
        seen.append(asks.join(held, ["key", "to_nb", "to_rb"]).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        return cross(rows, percent)

    monkeypatch.setattr(ngram_join, "_cross", counted)
    for n in (300, 1200):
        df = templates(spark, n)
        got = {r.doc_id: r.component_id for r in ngram_join.classes(df, 3, 90).collect()}
        assert got == {i: i if i < n else n for i in range(n + 9)}
    assert seen[1] <= 4 * max(seen[0], 300), seen


def test_equal_first_hash_of_different_sets(spark, monkeypatch):
    """Sets whose first hashes collide stay apart."""
    plain = ngram_join.sets_of
    same = lambda *a, **k: plain(*a, **k).withColumn("s1", F.when(F.col("n") == 2, F.lit(7).cast("long")).otherwise(F.col("s1")))
    monkeypatch.setattr(ngram_join, "sets_of", lambda docs, key, *a: (same if key == "k" and "rk" in str(docs.schema) else plain)(docs, key, *a))
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, "e f g h"), (5, "x y z"), (6, None)]
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_join_on_documents(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], 3, 90)
    assert sorted(map(tuple, ngram_join.classes(docs, 3, 90).collect()), key=repr) == want
    kept = {r.doc_id for r in ngram_join.representatives(docs, 3, 90).collect()}
    assert kept == {c for _, _, c in want}
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.classes(odd_docs, 3, 90).collect()), key=repr) == brute(odd, 3, 90)
    assert ngram_join.representatives(odd_docs).columns == odd_docs.columns
    assert ngram_join.classes(no_docs).count() == 0


@pytest.mark.parametrize(("percent", "rare"), [(90, 16), (80, 4), (60, 2)])
def test_linked_sets_share_a_combination(percent, rare):
    """Whatever frequent tokens two sets lack of each other, a link leaves them a key in common."""
    r = np.random.default_rng(percent)
    df_of = r.integers(rare + 1, 3 * rare**2, 100_000)
    for _ in range(1500):
        n = int(2 ** r.uniform(0, 9))
        both = r.choice(100_000, size=2 * n, replace=False)
        # the largest numbers of tokens on either side that still link
        lost, more = int(r.integers(0, n)), 0
        while 100 * (n - lost) < percent * n:
            lost -= 1
        while 100 * (n - lost) >= percent * (n + more + 1) and more < n:
            more += 1
        a, b = both[:n], np.r_[both[lost:n], both[n : n + more]]
        keys = []
        for s in (a, b):
            s = s[np.lexsort((s, df_of[s]))]
            rows = pa.record_batch(
                [pa.array([1]), pa.array([len(s)]), pa.array([[{"df": int(df_of[t]), "tok": int(t)} for t in s]])], names=["sid", "n", "shared"]
            )
            got = pa.Table.from_batches(ngram_join._signatures(percent, rare)(iter([rows])))
            assert len(got) <= 40 * (len(s) + 1)
            keys.append({*zip(got["kind"].to_pylist(), got["key"].to_pylist(), strict=True)})
        assert keys[0] & keys[1], (n, lost, more)


def templated(pages, template=400, drawn=60, of=7, seed=9):
    """Pages of one template whose other words are drawn from very few: what tells them apart is frequent."""
    import random

    r = random.Random(seed)
    head = " ".join(f"t{i}" for i in range(template))
    return [(i, f"{head} " + " ".join(r.choice("abcdefghij"[:of]) for _ in range(drawn))) for i in range(pages)]


def test_templated_pages_verify_few_pairs(spark, monkeypatch):
    """Verified pairs follow the pages and their combinations, not the square of the pages; copies with a few changes are still found."""
    counts = {}
    for n in (150, 600):
        rows = templated(n)
        for i in range(0, 40, 2):
            words = rows[i][1].split()
            words[420 + i % 20] = "zz"
            rows.append((1000 + i, " ".join(words)))
        tried = []
        verify = ngram_join._verify
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "_verify", lambda pairs, sets, percent: (tried.append(pairs.count()), verify(pairs, sets, percent))[1])
            got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 90)
        counts[n] = sum(tried)
    # a bucket of few sets is compared with one of them, so a page costs no more pairs than it has combinations
    assert counts[600] < 45 * 620 and counts[150] < 45 * 170


def test_sketches_bound_differences(spark):
    """Sketches never differ in more bits than sets in tokens, whatever the sizes."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(-(2**62), 2**62, n) for n in (1, 40, 900, 4000)]
    sets += [np.concatenate((s[: len(s) - len(s) // 9], rng.integers(-(2**62), 2**62, 5))) for s in sets]
    batch = pa.record_batch([pa.array(range(len(sets)), pa.int64()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["sid", "toks"])
    out = next(iter(ngram_join._sketches(iter([batch]))))
    words = np.array([out.column(f"g{i}").to_numpy() for i in range(ngram_join.SKETCH)]).T
    for i, j in combinations(range(len(sets)), 2):
        bits = sum(int(x).bit_count() for x in (words[i] ^ words[j]).view(np.uint64))
        assert bits <= len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
    assert sum(int(x).bit_count() for x in words[1].view(np.uint64)) > 30
