"""Rule ledger, hash tree, chat collapse."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import chat_collapse, hash_tree, quality_rules
from spanloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_ledger_equals_brute_force(spark, odd_docs):
    for docs in (odd_docs.select("doc_id", "text", "bits", "_t"), table(spark, SF, "documents")):
        got = {(r.doc_id, r.n_words): r for r in quality_rules.ledger(docs).collect()}
        for r in docs.select("doc_id", "text").collect():
            m = measures(r.text)
            g = got[(r.doc_id, m[0])]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == m
            assert bool(g.bits & 1) == (m[0] < 50) and bool(g.bits & 2) == (100 * m[4] > 50 * m[0])


def test_policies_read_bits_only(spark, no_docs):
    book = quality_rules.ledger(table(spark, SF, "documents"))
    kept = quality_rules.apply_policy(book).where("kept").count()
    rows = {r.rule: r for r in quality_rules.ablation(book).collect()}
    assert set(rows) == set(quality_rules.RULE_NAMES)
    for k, name in enumerate(quality_rules.RULE_NAMES):
        only = book.where(F.col("bits") == 1 << k).count()
        assert rows[name].failing_only == only and rows[name].kept_without == kept + only
    assert quality_rules.apply_policy(quality_rules.ledger(no_docs)).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(no_docs)).count() == len(quality_rules.RULE_NAMES)


def test_most_prose_is_kept(spark):
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1"), "doc_id")
    kept = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert kept.where("kept or n_words < 50").count() >= 0.97 * kept.count()


def test_hash_tree_equals_plain_python(spark):
    """Every shard drawn again without Spark."""
    import hashlib
    import math

    def straw(key, node, weight):
        bits = int(hashlib.md5(f"{key}/{node}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2.0**52) / weight

    def descend(key, tree):
        region = min(tree, key=lambda g: straw(key, g, sum(sum(s.values()) for s in tree[g].values())))
        rack = min(tree[region], key=lambda k: straw(key, k, sum(tree[region][k].values())))
        return min(tree[region][rack], key=lambda s: straw(key, f"s{s}", tree[region][rack][s]))

    tree = hash_tree.even_tree()
    for r in hash_tree.place(table(spark, SF, "documents")).collect():
        assert (r.shard, r.grown_shard) == (descend(r.doc_id, tree), descend(r.doc_id, hash_tree.grow(tree)))


def test_hash_tree_placement(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    got = hash_tree.place(docs, rows_per_bucket=20).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and slots
    odd = hash_tree.place(odd_docs).collect()
    assert len(odd) == 8 and len({(r.shard, r.slot) for r in odd}) == 8
    assert hash_tree.place(no_docs).count() == 0


def test_hash_tree_weights_confine_movement(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = hash_tree.even_tree(16)
    new = {g: {k: dict(s) for k, s in racks.items()} for g, racks in old.items()}
    new["g1"]["k3"][15] = 3.0
    both = hash_tree.with_shard(hash_tree.with_shard(keys, "k", old, "a"), "k", new, "b").collect()
    region = lambda s: s // 8
    moved = [r for r in both if r.a != r.b]
    assert moved and all(region(r.b) == 1 for r in moved)
    assert all(r.b // 4 == 3 for r in moved if region(r.a) == 1)
    share = sum(r.b == 15 for r in both) / 4000
    assert abs(share - 3 / 18) < 0.03


def test_chat_collapse(spark):
    rows = [
        (1, 0, "user", "a"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"),
        (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 5, "user", "c"),
        (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"),
        (5, 0, "user", "a"), (5, 1, "assistant", "x"),
        (6, 0, None, None),
        (None, 0, "user", ""), (None, None, "user", "z"),
        (7, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS k", "2 AS a")
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered.count("<|im_start|>")) for r in chat_collapse.collapse(turns).collect()}
    assert got == {3: (3, 2, 3), 5: (2, 1, 2), 6: (1, 1, 1), None: (2, 1, 2), 7: (2, 1, 2)}
    assert chat_collapse.collapse(turns.limit(0)).count() == 0
