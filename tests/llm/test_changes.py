"""Sequenced change applier against a plain version of its rules."""

import datetime
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import queries, sequenced_changes
from spanloom.llm.common import Scratch, ranked, table

SF = "/root/testdata/sf0.001"
SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"
EPOCH = datetime.date(1970, 1, 1)


def plain(rows):
    """The rules, one row after another: {change_id: (client, status, batch, missed, city, cents, current)}."""
    rows = set(rows)
    seqs = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda s: (s is not None, s)))} for c, v in seqs.items()}
    cut = {b: [] for b in range(1, 13)}
    for change, client, seq, op, at, _, _, city, balance in rows:
        if at is None or change is None or zlib.crc32(str(change).encode()) % 11 == 0:
            continue
        day = (at.date() - EPOCH).days + 9 * (zlib.crc32(str(change).encode()) % 4)
        b = max(1, min(12, 1 + math.floor((day - 19723) * 12 / 160)))
        cut[b].append((day, change, client, rank[client][seq], op, city, balance))
    state, out, largest, last = {}, {}, None, {}

    def go(client, b, horizon):
        s = state[client]
        while s["held"]:
            n = min(s["held"])
            if n != s["next"] and (horizon is None or min(r[0] for r in s["held"].values()) + 3 > horizon):
                return
            day, change, _, _, op, city, balance = s["held"].pop(n)
            missed, s["next"] = n - s["next"], n + 1
            if op == "D":
                s["city"] = s["balance"] = None
            elif op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"] = s["city"] if city is None else city
                s["balance"] = s["balance"] if balance is None else balance
            cents = None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5)
            out[change] = [client, "applied", b, missed, s["city"], cents, False]
            last[client] = (change, op)

    for b in range(1, 14):
        for client in state:
            go(client, b, math.inf if b == 13 else largest)
        for r in sorted(cut.get(b, []), key=lambda r: r[:2]):
            s = state.setdefault(r[2], {"next": 1, "held": {}, "city": None, "balance": None})
            if r[3] in s["held"] or r[3] < s["next"]:
                out[r[1]] = [r[2], "rejected", b, 0, None, None, False]
            else:
                s["held"][r[3]] = r
                go(r[2], b, None)
        largest = max([x for x in [largest, *(r[0] for r in cut.get(b, []))] if x is not None], default=None)
    for change, op in last.values():
        out[change][6] = op != "D"
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {r.change_id: (r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current) for r in rows}
    assert len(found) == len(rows)
    return found


def made(seed, clients=12, n=400):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        client = None if draw.random() < 0.05 else 7 if draw.random() < 0.4 else draw.randrange(clients)
        at = None if draw.random() < 0.03 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=draw.randrange(-40, 24 * 150))
        city, balance = draw.choice([None, "", "a", "é"]), draw.choice([None, 0.005, -3.125, 1e6 / 3])
        rows.append((i, client, draw.choice([None, *range(-3, n // 6)]), draw.choice(["I", "U", "U", "D", None, "x"]), at, None, None, city, balance))
    return rows + rows[: n // 8]


def test_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "client_changes").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    want = plain(rows)
    assert got(queries.op11_sequenced_changes(spark, SF)) == want
    assert {w[1] for w in want.values()} == {"applied", "rejected"} and any(w[3] for w in want.values()) and len({w[2] for w in want.values()}) > 8


def test_odd_rows_and_small_blocks(spark):
    """Null clients and numbers, repeated rows, unknown ops, empty batches in between, extra columns;
    blocks of few numbers, so that a client's held rows lie in many of them."""
    rows = [r for r in made(2) if r[4] is None or r[4].month < 2 or r[4].month > 4]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS batch", "2 AS slot", "3 AS n", "4 AS day")
    got_rows, want = got(sequenced_changes.apply_all(df, block=5, keys_per_slot=20, clients_per_slot=4)), plain(rows)
    assert got_rows == want and len({w[2] for w in want.values()}) < 12 and any(w[3] for w in want.values())


def test_empty_table(spark):
    assert sequenced_changes.apply_all(spark.createDataFrame([], SCHEMA), batches=1).count() == 0


def test_ranks_over_ranges(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("g"), (F.col("id") * 7 % 2000).alias("v"))
    got = ranked(rows, ["g"], ["v"], "k", Scratch()).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.v, r.k))
    assert len(got) == 2000 and all([k for _, k in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


@pytest.mark.parametrize("frames", [1, 3])
def test_first_arrivals_by_chunks(frames):
    """The smallest (day, change_id) of a number is new, whatever chunk it comes in."""
    import pandas as pd

    rows = [(0, 0, 1, 1, 5, c, "U", None, None, pd.Timestamp(0)) for c in (3, 1, 2)] + [(0, 0, 1, 2, 4, 9, "U", "x", 1.0, pd.Timestamp(0))]
    stage = sequenced_changes.FirstArrivals()
    kept = []
    stage.seen = type("Seen", (), {"exists": lambda s: bool(kept), "get": lambda s: iter(kept), "appendValue": lambda s, v: kept.append(v)})()
    cuts = [rows[i::frames] for i in range(frames)]
    out = pd.concat(stage.handleInputRows((0,), (pd.DataFrame(c, columns=sequenced_changes.FIELDS) for c in cuts), None))
    assert sorted(out[~out.again].change_id) == [1, 9] and sorted(out[out.again].change_id) == [2, 3]
    out = pd.concat(stage.handleInputRows((0,), iter([pd.DataFrame(rows, columns=sequenced_changes.FIELDS)]), None))
    assert out.again.all() and len(out) == 4


def test_stores_of_a_start_are_closed(spark):
    """The stores of a start stay in memory only while it runs."""
    jvm = spark._jvm
    store = jvm.org.apache.spark.util.Utils.classForName("org.apache.spark.sql.execution.streaming.state.StateStore$", True, False)
    field = next(f for f in store.getDeclaredFields() if f.getName().endswith("loadedProviders"))
    field.setAccessible(True)
    loaded = field.get(store.getField("MODULE$").get(None))
    before = loaded.size()
    rows = [(i, i % 5, i // 5, "I", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), "s", "t", "c", 1.0) for i in range(40)]
    assert sequenced_changes.apply_all(spark.createDataFrame(rows, SCHEMA), batches=2).count() > 0
    assert loaded.size() <= before


def test_current_comes_from_the_state(spark):
    """The applier itself tells which row is its client's last applied one, also where that was applied
    long before the last batch, only as the gap was given up at the end, or for a null client."""
    rows = [(1, 1, 1, 1, "I", 1), (2, 1, 2, 1, "U", 1), (3, 2, 1, 1, "I", 1), (4, 2, 2, 9, "D", 3), (5, 3, 1, 1, "I", 1), (6, 3, 4, 9, None, 3), (7, None, 1, 5, "I", 2), (8, 1, 2, 9, "U", 3)]
    df = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "change_id long, client_id long, n long, day long, op string, batch int, city string, balance double")
    done = sequenced_changes.apply_changes(df, 3, F.col("day"), F.col("batch"), clients_per_slot=1).collect()
    found = {r.change_id: (r.client_id, r.n, r.status, r.batch, r.missed, r.current) for r in done}
    assert len(done) == 8 and {k for k, v in found.items() if v[5]} == {2, 6, 7}
    assert found[2] == (1, 2, "applied", 1, 0, True) and found[6] == (3, 4, "applied", 4, 2, True) and found[4][2:] == ("applied", 3, 0, False) and found[8][2] == "rejected"


def test_a_start_shrinks_the_heap(spark, monkeypatch):
    """A heap that has grown is small again once its executor begins a start, and every start does that."""
    sizes, collect = [], sequenced_changes.shrink_heaps

    def measured(session):
        jvm = session._jvm
        filled = [jvm.java.util.ArrayList(100_000_000) for _ in range(4)]
        for rows in filled:
            rows.trimToSize()
        before = jvm.java.lang.Runtime.getRuntime().totalMemory()
        collect(session)
        sizes.append((before, jvm.java.lang.Runtime.getRuntime().totalMemory()))

    monkeypatch.setattr(sequenced_changes, "shrink_heaps", measured)
    rows = [(i, i % 5, i // 5, "I", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), "s", "t", "c", 1.0) for i in range(40)]
    assert sequenced_changes.apply_all(spark.createDataFrame(rows, SCHEMA), batches=2).count() > 0
    assert len(sizes) == 2 and all(after < before - 500_000_000 for before, after in sizes)
