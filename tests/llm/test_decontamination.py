"""Winnowing against a plain search of all stretches."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from spanloom.llm import decontamination, queries
from spanloom.llm.common import Scratch, table

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    met |= found
        met.discard(None)
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed=5):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "é", "x1", "Ça", "die", "0", "word", "日本"]
    text = lambda n: draw.choice([" ", "-", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([1, 3, 9, 10, 11, 14, 40]) if i % 4 else 12)) for i in range(20)]
    items = [x for x in items if len(words(x[1])) > 2] + [(50, None), (51, " .,"), (9, text(12)), (None, text(12)), (60, "a a a a a a a a a a a a")]
    docs = [(i, text(draw.randrange(0, 60))) for i in range(80)]
    for i in range(40):
        w = words(draw.choice(items)[1])
        cut = w[draw.randrange(3) :][: draw.randrange(8, 30)]
        docs.append((200 + i, text(draw.randrange(12)) + " " + " ".join(cut).upper() + "! " + text(draw.randrange(12))))
    docs += [(1, None), (2, ""), (None, items[0][1]), (7, docs[100][1]), (7, docs[100][1]), (3, "A-a " * 3000), (4, text(20_000))]
    return docs, items


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_small_words_and_short_items(spark, most):
    """Few distinct words, so that stretches repeat; with and without the filter in the scan; extra columns."""
    docs, items = made()
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "2 AS n_words", "'x' AS id").repartition(5)
    b = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS length", "'y' AS stretch")
    got = sorted((tuple(r) for r in decontamination.decontaminate(d, b, most).select(*COLUMNS).collect()), key=repr)
    want = plain(docs, items)
    assert got == want and 0 < sum(w[5] for w in want) < len(want)


def test_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in table(spark, sf, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = plain(docs, items)
    assert sorted((tuple(r) for r in queries.op13_benchmark_winnowing(spark, sf).select(*COLUMNS).collect()), key=repr) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_benchmark_winnowing']})").fetchall(), key=repr) == want


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b")], DOCS)
    assert [tuple(r)[:4] for r in decontamination.decontaminate(docs, none).collect()] == [(1, 2, 0, 0)]
    assert decontamination.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


@pytest.mark.parametrize("length", range(1, 11))
def test_every_shared_stretch_has_a_common_print(length):
    draw = np.random.default_rng(length)
    for few in (3, 1000):
        shared = draw.integers(1, few + 1, length).astype(np.uint64)
        sides = [np.concatenate((draw.integers(1, few + 1, n).astype(np.uint64), shared, draw.integers(1, few + 1, m).astype(np.uint64))) for n, m in ((3, 20), (17, 0))]
        prints = []
        for n, side in zip((3, 17), sides, strict=True):
            own, first, last = decontamination.winnow(side, length)
            assert first[0] == 0 and last[-1] == len(side) - length and (first[1:] == last[:-1] + 1).all()
            prints.append(own[np.searchsorted(first, n, "right") - 1])
        assert prints[0] == prints[1]


def test_prints_stay_few(spark):
    """About two of seven words are kept, and a document of one word over and over keeps a steady rate."""
    own, first, _ = decontamination.winnow(np.random.default_rng(1).integers(0, 2**63, 70_000).astype(np.uint64), 10)
    assert 0.25 < len(own) / 70_000 < 0.32
    prints, stretches = decontamination.index(spark.createDataFrame([(1, "a " * 500), (2, "a " * 700)], ITEMS), Scratch())
    assert prints.count() == 1 and stretches.count() == 2
