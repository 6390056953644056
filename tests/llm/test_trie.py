"""Conversation prefix trie against a plain trie."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm import conversation_trie, queries
from spanloom.llm.common import Scratch, table

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs):
    """The trie of {conv_id: [(role, text), ...]}, one node after another."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below = [walk(x) for x in children.get(p, [])]
        leaves, saved = sum(x[0] for x in below) or 1, own + sum(x[1] for x in below)
        ended = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(below), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


def made(n=160, seed=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(400), n):
        kind = draw.random()
        for t in range(1 if kind < 0.1 else draw.randrange(1, 14)):
            text = draw.choice(["a", "b", None, ""]) if kind < 0.8 else "é" * draw.randrange(3)
            rows.append((c, None if t == 0 and kind > 0.9 else t, draw.choice(["user", None, ""]), text))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 3])
def test_contract_with_short_blocks(spark, block):
    """Blocks of three turns chain over three levels; ids, roles and texts are null or empty; extra columns."""
    rows = made()
    df = spark.createDataFrame([*rows, (None, 0, "user", "x")], SCHEMA).selectExpr("*", "1 AS d", "2 AS len", "'x' AS digest", "3 AS n")
    assert got(conversation_trie.prefix_trie(df, block)) == plain(rebuild(rows))


def test_many_equal_and_one_long(spark):
    """Thousands of conversations end at one node; one conversation is very long and has long texts."""
    rows = [(100 * c, 0, "user", "same") for c in range(1500)] + [(7, t, "user", "y" * (t % 50)) for t in range(900)] + [(8, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    convs, result = rebuild(rows), got(conversation_trie.prefix_trie(df, 64))
    assert result == _flat(convs) and max(r[1] for r in result) == len(convs[7])


def _flat(convs):
    """``plain`` without recursion, for deep tries: sums go up from the deepest node."""
    nodes = {}
    for c, turns in convs.items():
        digest = hashlib.sha256()
        nodes.setdefault((0, digest.digest()), [None, [], 0, []])[1].append(c)
        path = (0, digest.digest())
        for d, (role, text) in enumerate(turns, 1):
            digest.update(repr((role, text)).encode())
            key = (d, digest.digest())
            nodes.setdefault(key, [path, [], len(text), []])[1].append(c)
            path = key
        nodes[path][3].append(c)
    kids, leaves, saved = {}, {}, {}
    for key in sorted(nodes, key=lambda k: -k[0]):
        up, members, size, _ = nodes[key]
        leaves[key] = leaves.get(key, 0) or 1
        saved[key] = saved.get(key, 0) + (len(members) - 1) * (size if up else 0)
        if up:
            kids[up] = kids.get(up, 0) + 1
            leaves[up], saved[up] = leaves.get(up, 0) + leaves[key], saved.get(up, 0) + saved[key]
    rows = [
        (min(m), k[0], min(nodes[up][1]) if up else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())
        for k, (up, m, _, e) in nodes.items()
    ]
    return sorted(rows, key=repr)


def test_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rebuild(rows))
    assert want == _flat(rebuild(rows))
    assert got(queries.op12_conversation_trie(spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_conversation_trie']})").fetchall()
    assert sorted(sql, key=repr) == want


def test_no_conversations(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = spark.createDataFrame([(1, 0)], "conv_id long, n long")
    none = spark.createDataFrame([], "conv_id long, d long, len int, t binary")
    assert [tuple(r)[:7] for r in conversation_trie.trie(none, turnless, Scratch()).collect()] == [(1, 0, None, 1, 0, 1, 0)]


def test_suffix_sums(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    out = {(r.k, r["at"]): r.v for r in conversation_trie.suffix_sums(rows, "k", "at", ["v"], 16).collect()}
    assert all(v == len(range(a, 200, 3)) for (_, a), v in out.items()) and len(out) == 200
