"""Sequenced change applier: two chained ``transformWithState`` stages over numbered changes.

Changes of a client are numbered 1, 2, ... and may come late, twice or not at all. The first stage
is keyed by (client, n) and passes the first arrival of a number on as new, every other one as a
repeat; numbers of a large client are spread over all tasks. The second stage is keyed by client:
it holds new rows, applies those whose turn it is, rejects what comes after a gap was given up, and
gives gaps up by event time: once the watermark, the largest day of earlier batches, is ``patience``
days past the oldest row a client holds, its next number jumps to the smallest it holds.

A call to the state from Python is a round trip of 0.3 to 0.8 ms, so one call for each key is out
of reach. Keys are therefore dealt to slots by their hash, and a slot's state has its keys inside:
the first stage keeps lists of (client, n), the second a table of clients and, in blocks of
``BLOCK`` numbers, the rows they hold. Only one block is open at a time for a client, so a large
client that waits at a gap does not fill memory. The number of slots follows the counted rows.

Within a batch the order of new rows cannot change a result (numbers are unique by then and jumps
happen between batches), so the second stage needs no sort; the first one compares (day, change_id).

Every batch is a new start of the query on one checkpoint; its sink is exactly-once. A batch without
rows is a file without rows, on which timers still fire. With the last batch comes one closing row
for each slot; once its rows are done, all clients give up their gaps, as one more batch.

Spark 4.1 leaves half a megabyte of native memory behind for every store a start opens, which nothing frees
before the executor ends. The heap that the preparation or an earlier start has grown to would stay beside
it, mostly empty, so the executors' heaps are collected, and shrink, before every start.

The last row applied of each client waits in the state until a later one is applied, or the closing row
comes: then it is known whether it is the client's current one, and no join over all rows has to find it.

Edge cases: equal rows count once, in all columns of the table; null clients are one client; null
``seq`` is a number of its own, the smallest; rows without ``valid_at`` or ``change_id`` vanish after
numbering; rows that tie in day and change_id are told apart by op, city and balance; an unknown op
is applied and changes nothing; a balance that is not a number counts as null; days before the first
batch go to it; other columns only serve to tell rows apart; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from spanloom.llm.common import Scratch, delete, ranked, shared_dir

DAY_MS = 86_400_000
BLOCK = 4096  # numbers of a client that are held in one state entry
KEYS_PER_SLOT = 4096  # (client, n) keys of a slot of the first stage
CLIENTS_PER_SLOT = 512  # clients of a slot of the second stage
CLOSING = "closing"

FED = "slot2 long, slot1 long, client long, n long, day long, change_id long, op string, city string, balance double, at timestamp"
NEW = f"{FED}, again boolean"
OUT = "slot long, client long, n long, op string, change_id long, status string, batch int, missed long, city string, balance double, current boolean"
FIELDS = [c.split()[0] for c in FED.split(", ")]
HELD = ["client", "n", "day", "change_id", "op", "city", "balance"]
HELD_SCHEMA = pa.schema([*[(c, pa.int64()) for c in HELD[:4]], ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64())])
LAST = [("op", pa.string()), ("change_id", pa.int64()), ("batch", pa.int64()), ("missed", pa.int64())]  # of the row applied last: its n is next - 1
HEAD_SCHEMA = pa.schema([("client", pa.int64()), ("next", pa.int64()), ("city", pa.string()), ("balance", pa.float64()), *LAST])
NEW_CLIENT = [1, *[None] * (len(HEAD_SCHEMA) - 2)]
INDEX_SCHEMA = pa.schema([("client", pa.int64()), ("block", pa.int64()), ("day", pa.int64())])


def _packed(columns: list, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[list]:
    return [c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns]


def _columns(frame: pd.DataFrame, names: list[str]) -> list[list]:
    """Columns as Python lists; what is not a number or a text is None."""
    out = []
    for name in names:
        values = frame[name].tolist()
        out.append([None if v is None or v != v else v for v in values] if name in ("op", "city", "balance") else values)
    return out


class FirstArrivals(StatefulProcessor):
    """First stage: new or again, for rows of one slot of (client, n) keys."""

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "clients binary, numbers binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: set = set()
        if self.seen.exists():
            for clients, numbers in self.seen.get():
                known.update(zip(memoryview(clients).cast("q").tolist(), memoryview(numbers).cast("q").tolist(), strict=True))
        first: dict[tuple, tuple] = {}
        for frame in rows:
            again = []
            for row in zip(*_columns(frame, FIELDS[:-1]), frame["at"].tolist(), strict=True):
                k = (row[2], row[3])
                if row[6] == CLOSING:
                    first[(None, row[0])] = row
                elif k in known:
                    again.append(row)
                elif k not in first:
                    first[k] = row
                elif _order(row) < _order(first[k]):
                    again.append(first[k])
                    first[k] = row
                else:
                    again.append(row)
            if again:
                yield self._frame(again, True)
        fresh = [k for k in first if k[0] is not None]
        if fresh:
            pack = lambda i: pa.array([k[i] for k in fresh], pa.int64()).buffers()[1].to_pybytes()[: 8 * len(fresh)]
            self.seen.appendValue((pack(0), pack(1)))
        if first:
            yield self._frame(list(first.values()), False)

    @staticmethod
    def _frame(rows: list[tuple], again: bool) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=FIELDS)
        for c in ("op", "city"):
            frame[c] = frame[c].astype(object)
        return frame.assign(balance=frame["balance"].astype("float64"), again=again)

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """(day, change_id), then what else tells rows apart, nulls first."""
    return row[4:6] + tuple((v is not None, v if v is not None else 0) if i else (v is not None, v or "") for i, v in ((0, row[6]), (0, row[7]), (1, row[8])))


class Sequencer(StatefulProcessor):
    """Second stage: hold, apply, reject and skip, for the clients of one slot."""

    def __init__(self, batch: int, patience: int, block: int = BLOCK):
        self.batch, self.patience, self.block = batch, patience, block

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "batch int, timer long, clients binary, index binary")
        self.held = handle.getMapState("held", "block long", "rows binary")

    # -- state of the slot: clients {client: [next, city, balance, *LAST]}, index {client: {block: earliest day}}

    def _load(self) -> None:
        self.clients, self.index, self.open, self.dirty = {}, {}, {}, set()
        self.seen_batch, self.timer = 0, -1
        if self.head.exists():
            self.seen_batch, self.timer, clients, index = self.head.get()
            self.clients = {c: list(rest) for c, *rest in zip(*_unpacked(bytes(clients)), strict=True)}
            for client, block, day in zip(*_unpacked(bytes(index)), strict=True):
                self.index.setdefault(client, {})[block] = day

    def _store(self) -> None:
        for block in list(self.open):
            self._shut(block)
        days = [min(blocks.values()) for blocks in self.index.values()]
        if days and self.timer != (due := (min(days) + self.patience) * DAY_MS - 1):
            self.handle.registerTimer(due)  # fires once the watermark is past it: at min(days) + patience
            self.timer = due
        heads = [list(self.clients), *([v[i] for v in self.clients.values()] for i in range(len(NEW_CLIENT)))]
        flat = [(c, b, d) for c, blocks in self.index.items() for b, d in blocks.items()]
        self.head.update((self.batch, self.timer, _packed(heads, HEAD_SCHEMA), _packed([[x[i] for x in flat] for i in range(3)], INDEX_SCHEMA)))

    def _block(self, block: int) -> dict:
        """Rows held in a block: {client: {n: (day, change_id, op, city, balance)}}."""
        if block not in self.open:
            rows: dict = {}
            if self.held.containsKey((block,)):
                for client, n, *rest in zip(*_unpacked(bytes(self.held.getValue((block,))[0])), strict=True):
                    rows.setdefault(client, {})[n] = tuple(rest)
            self.open[block] = rows
        return self.open[block]

    def _shut(self, block: int) -> None:
        rows = self.open.pop(block)
        if block not in self.dirty:
            return
        self.dirty.discard(block)
        flat = [(client, n, *rest) for client, own in rows.items() for n, rest in own.items()]
        if flat:
            self.held.updateValue((block,), (_packed([list(c) for c in zip(*flat, strict=True)], HELD_SCHEMA),))
        elif self.held.containsKey((block,)):
            self.held.removeKey((block,))

    def _release(self, client: int, current: bool, out: list) -> None:
        """Give out the row of a client that was applied last, if there is one that waits."""
        after, city, balance, op, change, batch, missed = state = self.clients[client]
        if change is not None:
            out.append((client, after - 1, op, change, "applied", batch, missed, city, balance, current and op != "D"))
            state[4] = None

    def _drain(self, client: int, horizon: float, batch: int, out: list) -> None:
        """Apply what is next; while the oldest row is due at ``horizon``, jump to the smallest number."""
        state, blocks = self.clients[client], self.index.get(client, {})
        order = sorted(blocks)
        later = [math.inf] * (len(order) + 1)
        for i in range(len(order) - 1, -1, -1):
            later[i] = min(later[i + 1], blocks[order[i]])
        for i, block in enumerate(order):
            if later[i] + self.patience > horizon and state[0] // self.block != block:
                return
            rows = self._block(block)[client]
            numbers = sorted(rows)
            oldest, low = [0.0] * len(numbers), later[i + 1]
            for j in range(len(numbers) - 1, -1, -1):
                low = oldest[j] = min(low, rows[numbers[j]][0])
            done = 0
            for j, n in enumerate(numbers):
                if n != state[0] and oldest[j] + self.patience > horizon:
                    break
                day, change, op, city, balance = rows.pop(n)
                self._release(client, False, out)
                missed, state[0] = n - state[0], n + 1
                if op == "D":
                    state[1] = state[2] = None
                elif op == "I":
                    state[1], state[2] = city, balance
                elif op == "U":
                    state[1] = state[1] if city is None else city
                    state[2] = state[2] if balance is None else balance
                state[3:] = op, change, batch, missed
                done += 1
            if done:
                self.dirty.add(block)
            if rows:
                blocks[block] = min(r[0] for r in rows.values())
                return
            del self._block(block)[client], blocks[block]
            if i and len(self.open) > 8:
                self._shut(block)
        self.index.pop(client, None)

    def _give_up(self, horizon: float, batch: int, out: list) -> None:
        for client in [c for c, blocks in self.index.items() if min(blocks.values()) + self.patience <= horizon]:
            self._drain(client, horizon, batch, out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out: list = []
        if self.seen_batch < self.batch:
            self._give_up(timerValues.getCurrentWatermarkInMs() // DAY_MS, self.batch, out)
        touched, closing = set(), False
        for frame in rows:
            pending: dict[int, list] = {}
            for row in zip(*_columns(frame, [*HELD, "again"]), strict=True):
                client, n, op, again = row[0], row[1], row[4], row[7]
                if op == CLOSING:
                    closing = True
                elif again or n < self.clients.setdefault(client, [*NEW_CLIENT])[0]:
                    out.append((client, n, op, row[3], "rejected", self.batch, 0, None, None, False))
                else:
                    pending.setdefault(n // self.block, []).append(row)
            for block, new in pending.items():
                held = self._block(block)
                self.dirty.add(block)
                for client, n, *rest, _ in new:
                    held.setdefault(client, {})[n] = tuple(rest)
                    blocks = self.index.setdefault(client, {})
                    blocks[block] = min(blocks.get(block, rest[0]), rest[0])
                    touched.add(client)
                if len(self.open) > 8:
                    self._shut(block)
            if len(out) >= 20_000:
                yield self._frame(key, out)
                out = []
        for client in touched:
            if self.clients[client][0] // self.block in self.index.get(client, ()):
                self._drain(client, -math.inf, self.batch, out)
        if closing:
            self._give_up(math.inf, self.batch + 1, out)
            for client in self.clients:
                self._release(client, True, out)
        self._store()
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list = []
        if self.seen_batch < self.batch:
            self._give_up(timerValues.getCurrentWatermarkInMs() // DAY_MS, self.batch, out)
            self._store()
        if out:
            yield self._frame(key, out)

    def _frame(self, key, out: list) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        frame = pd.DataFrame(out, columns=names[1:])
        frame = frame.assign(slot=int(key[0]), balance=frame["balance"].astype("float64"))
        for c in ("op", "city", "status"):
            frame[c] = frame[c].astype(object)
        return frame[names]

    def close(self) -> None:
        pass


def numbered(changes: DataFrame, store) -> DataFrame:
    """Distinct changes with n, the dense rank of seq in its client; ranges of a client apart."""
    rows = store(changes.distinct(), "changes")
    rank = ranked(rows.select("client_id", "seq").distinct(), ["client_id"], ["seq"], "n", store).alias("r")
    own = rows.select("change_id", "client_id", "seq", "op", "valid_at", "city", F.col("balance").cast("double").alias("balance")).alias("l")
    same = F.col("l.client_id").eqNullSafe(F.col("r.client_id")) & F.col("l.seq").eqNullSafe(F.col("r.seq"))
    return own.join(rank, same).select("l.*", "r.n")


def _slots(rows: DataFrame, keys_per_slot: int, clients_per_slot: int) -> tuple[int, int]:
    """Slots of both stages, from counted rows and clients; at least one a shuffle partition."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, clients = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("client_id")).first()
    return max(least, -(-n // keys_per_slot)), max(least, -(-clients // clients_per_slot))


def apply_changes(
    rows: DataFrame, batches: int, day, batch, patience: int = 3, keys_per_slot: int = KEYS_PER_SLOT, clients_per_slot: int = CLIENTS_PER_SLOT, block: int = BLOCK
) -> DataFrame:
    """What becomes of each numbered change: change_id, client_id, n, op, status, batch, missed, city,
    balance, current (the last applied one of its client and no deletion). ``rows`` holds change_id,
    client_id, n, op, city, balance; ``day`` and ``batch`` are columns over it, ``batch`` from 1 to
    ``batches`` and never falling as ``day`` grows."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/spanloom/sequenced-{uuid.uuid4().hex}"
    one, two = _slots(rows, keys_per_slot, clients_per_slot)
    null = F.col("client_id").isNull()
    deal = lambda n, *c: F.when(null, -1 - F.pmod(F.xxhash64(*c), F.lit(n))).otherwise(F.pmod(F.xxhash64("client_id", *c), F.lit(n)))
    facts = rows.select(
        deal(two, F.lit(0)).alias("slot2"), deal(one, "n").alias("slot1"), F.coalesce(F.col("client_id").cast("long"), F.lit(0)).alias("client"),
        F.col("n").cast("long").alias("n"), day.cast("long").alias("day"), F.col("change_id").cast("long").alias("change_id"),
        "op", "city", "balance", F.timestamp_seconds(day.cast("long") * 86_400).alias("at"), batch.cast("int").alias("batch"),
    )
    facts.write.partitionBy("batch").parquet(f"{root}/cut")
    cut = spark.read.schema(f"{FED}, batch int").parquet(f"{root}/cut")
    closing = spark.range(-two, two).select(
        F.col("id").alias("slot2"), F.col("id").alias("slot1"), F.lit(0).cast("long").alias("client"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("day"), F.lit(0).cast("long").alias("change_id"), F.lit(CLOSING).alias("op"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("double").alias("balance"), F.lit("2261-01-01").cast("timestamp").alias("at"),
    )
    for b in range(1, batches + 1):
        fed = cut.where(F.col("batch") == b).drop("batch")
        (fed if b < batches else fed.unionByName(closing)).write.mode("append").parquet(f"{root}/feed")
        start(spark, root, b, patience, block)
    for used in ("cut", "feed", "state"):
        delete(spark, f"{root}/{used}")
    done = spark.read.schema(OUT).parquet(f"{root}/applied")
    return done.withColumn("client_id", F.when(F.col("slot") >= 0, F.col("client"))).drop("slot", "client")


def shrink_heaps(spark: SparkSession) -> None:
    """Collect the heaps of all executors, which makes them give unused memory back: a task a core, all at once."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def start(spark: SparkSession, root: str, batch: int, patience: int, block: int = BLOCK) -> StreamingQuery:
    """One start of the query on its checkpoint, ended: it took the files of ``feed`` it had not seen."""
    shrink_heaps(spark)
    session = spark.newSession()
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of the many small stores reserves megabytes
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",  # every state variable has a buffer of its own
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start is one batch: its stores are of no use to the next start
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # one file less for each store and start
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # timers belong to the next batch
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    for k, v in conf.items():
        session.conf.set(k, v)
    fed = session.readStream.schema(FED).parquet(f"{root}/feed").withWatermark("at", "0 seconds")
    new = fed.groupBy("slot1").transformWithStateInPandas(FirstArrivals(), NEW, "Append", "EventTime", eventTimeColumnName="at")
    done = new.groupBy("slot2").transformWithStateInPandas(Sequencer(batch, patience, block), OUT, "Append", "EventTime")
    sink = done.writeStream.format("parquet").option("path", f"{root}/applied").option("checkpointLocation", f"{root}/state")
    query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_all(changes: DataFrame, batches: int = 12, first_day: int = 19_723, days: int = 160, **sizes) -> DataFrame:
    """The contract's query: lateness and loss drawn from change_id, ``batches`` cuts of ``days`` days.
    ``sizes`` go to ``apply_changes``."""
    scratch = Scratch()
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    rows = numbered(changes, scratch).where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    day = F.unix_date(F.col("valid_at").cast("date")) + 9 * (h % 4)
    rows = scratch(rows.withColumn("day", day).drop("valid_at", "seq"), "numbered")
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days)))
    done = apply_changes(rows, batches, F.col("day"), batch, **sizes)
    scratch.drop()
    cents = F.floor(F.col("balance") * 100 + F.lit(0.5)).cast("long").alias("cents")
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", cents, "current")
