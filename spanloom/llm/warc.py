"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (page id, payload digest): running sums of payload bytes in that order
give every shard its first key, so shards hold ``shard_bytes`` each whatever the size of the table,
and the sums depend on the pages alone, not on how Spark dealt them. Inside a shard records are
written as one gzip member each; a file is rolled once its compressed size reaches a limit and
starts with a warcinfo record. Headers, record ids and digests are made anew from the payload, so
the same pages give the same bytes. A task writes each file under a temporary name and moves it
when it is whole; a task that runs twice puts the same bytes in the place of the first ones. The
list of files comes last, as a manifest that counts only once Spark has committed it.

Equal payloads of at least ``dedup_bytes`` bytes are stored once: the row with the largest page
id is the response, the others are revisit records that keep the HTTP header (whose
Content-Length is the full payload's), the payload digest and the id of the record they refer to.

Edge cases: null html is an empty payload, a null url is written as ``urn:null``; line breaks in
urls are escaped, and a url that a header line cannot hold as it is also stands in a header of its
own, in base64; null page ids sort first and lose to any other id; rows repeated with the same page
id and payload give one response and revisits of it (one task streams them); an empty table gives
an empty manifest; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import delete, exists, materialize, shared_dir

NULL_ID = -(2**63)
MANIFEST = "shard int, seq int, path string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sort_key(pid: Column, digest: Column) -> Column:
    """(page id, digest) as text that sorts alike: the id moved to the positive range, in hex."""
    return F.concat(F.lpad(F.hex(pid.bitwiseXOR(F.lit(NULL_ID))), 16, "0"), digest)


def shard_starts(rows: DataFrame, target_bytes: int, rows_per_range: int = 1_000_000) -> DataFrame:
    """(shard, key): the first key of every shard, from rows (key, n).

    Keys are summed, dealt to ranges and stored; only one row a range is ever brought together, to
    add up the bytes before it. A shard is a whole multiple of ``target_bytes`` of running sum.
    """
    per = rows.groupBy("key").agg(F.sum("n").alias("n"))
    ranges = max(1, -(-rows.count() // rows_per_range))
    dealt = materialize(per.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "warc-keys")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("bytes"))
    start = F.coalesce(F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("key")) - F.col("n")
    placed = dealt.withColumn("inside", inside).join(parts.select("part", start.alias("start")), "part")
    starts = materialize(placed.groupBy(F.expr(f"(start + inside) div {int(target_bytes)}").alias("at")).agg(F.min("key").alias("key")), "warc-shards")
    delete(rows.sparkSession, dealt._stored_at)
    return starts


def with_shard(rows: DataFrame, starts: DataFrame, lookup: int = 1_000_000) -> tuple[DataFrame, int]:
    """Add ``shard``, numbered from 0 in key order, and the number of shards.

    Up to ``lookup`` starts (56 bytes each) every task looks keys up; beyond that, keys and starts
    are sorted together once and only the keys' shards are joined back.
    """
    n = starts.count()
    if n <= 1:
        return rows.withColumn("shard", F.lit(0)), 1
    if n <= lookup:
        firsts = rows.sparkSession.sparkContext.broadcast(np.array(sorted(r["key"] for r in starts.collect()), "S56"))

        @F.pandas_udf("int")
        def find(key: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(0, np.searchsorted(firsts.value, key.to_numpy().astype("S56"), "right") - 1).astype(np.int32), index=key.index)

        return rows.withColumn("shard", find("key")), n
    marks = starts.select("key", F.lit(1).alias("m")).unionByName(rows.select("key", F.lit(0).alias("m")).distinct())
    dealt = materialize(marks.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "warc-marks")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("m").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    place = F.sum("m").over(W.partitionBy("part").orderBy("key", F.desc("m")).rowsBetween(W.unboundedPreceding, 0))
    shards = dealt.withColumn("place", place).join(parts, "part").where("m = 0").select("key", (F.col("c") + F.col("place") - 1).cast("int").alias("shard"))
    return rows.join(shards, "key"), n


def resolve(rows: DataFrame, dedup_bytes: int) -> DataFrame:
    """(pid, digest, refers): for payloads stored once, the id of the row that stores them."""
    large = rows.where(F.col("n") >= dedup_bytes)
    stored = large.groupBy("digest").agg(F.max("pid").alias("refers"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return large.join(stored, "digest").select("pid", "digest", "refers")


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def record_id(tag: str, digest: bytes, nth: int) -> str:
    """Fixed by the page, the payload and the place among the page's records of that payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{tag} {digest.hex()} {nth}')}>"


def _tag(pid: int) -> str:
    return "null" if pid == NULL_ID else str(pid)


def record(pid: int, url: str | None, digest: bytes, payload: bytes, refers: int | None, nth: int = 0) -> bytes:
    """One WARC record; ``refers`` makes it a revisit."""
    target = "urn:null" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(_tag(pid), digest, nth)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("X-Page-ID", _tag(pid)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
    ]
    if url is not None and (target != url or url == "urn:null" or url != url.strip()):
        headers.append(("X-Target-URI", base64.b64encode(url.encode()).decode()))
    if refers is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(_tag(refers), digest, 0)),
            ("X-Refers-To-Page-ID", _tag(refers)),
        ]
        return _block(headers, http)
    return _block([*headers, ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(http + payload).digest()).decode())], http + payload)


def info(name: str) -> bytes:
    """The record a file starts with."""
    body = b"software: spanloom\r\nformat: WARC File Format 1.1\r\n"
    where = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{where}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


class _Roller:
    """Writes the files of one shard: temporary name, then the final one (what an earlier attempt
    left there goes first: not every file system renames onto a file)."""

    def __init__(self, root: str, shard: int, limit: int, level: int):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.shard, self.limit, self.level = shard, limit, level
        self.seq, self.out, self.done = 0, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.final = f"{self.base}/shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.base}/_temporary/{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0
            self._put(info(os.path.basename(self.final)))
        self._put(raw)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, raw: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = z.compress(raw) + z.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
                self.fs.delete_file(self.final)
            self.fs.move(self.temp, self.final)
            self.done.append((self.shard, self.seq, os.path.basename(self.final), self.size, self.records, self.sha.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def _write_shards(root: str, limit: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, refers, stored, nth = None, None, None, False, 0
        done: list[tuple] = []
        for b in batches:
            for shard, pid, digest, kind, ref, url, html in zip(*(b.column(n).to_pylist() for n in ("shard", "pid", "digest", "kind", "refers", "url", "html")), strict=True):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(root, shard, limit, level)
                if (pid, digest) != last:
                    last, refers, stored, nth = (pid, digest), None, False, 0
                if kind == 0:  # where this payload is stored
                    refers = ref
                    continue
                own = refers is None or (refers == pid and not stored)
                stored = True
                roller.add(record(pid, url, bytes.fromhex(digest), (html or "").encode(), None if own else refers, nth))
                nth += 1
        if roller is not None:
            roller.close()
            done += roller.done
        names = [f.strip().split()[0] for f in MANIFEST.split(",")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*done, strict=True)) if done else [[] for _ in names]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def write(pages: DataFrame, root: str, shard_bytes: int = 16 << 20, file_bytes: int = 4 << 20, dedup_bytes: int = 1000, level: int = 4) -> DataFrame:
    """Write pages under ``root`` (a file system URI) and return the manifest.

    The html crosses the network once, to its shard. What a payload's other rows refer to comes
    along in rows of its own that sort just before the page's.
    """
    slim = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("pid"),
        F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"),
        "url",
        "html",
    )
    key = sort_key(F.col("pid"), F.col("digest"))
    facts = materialize(slim.select("pid", "digest", "n"), "warc-facts")
    starts = shard_starts(facts.select(key.alias("key"), (F.col("n") + 400).alias("n")), shard_bytes)
    gone = F.lit(None)
    known = resolve(facts, dedup_bytes).distinct()
    both = known.select(key.alias("key"), "pid", "digest", F.lit(0).alias("kind"), "refers", gone.cast("string").alias("url"), gone.cast("string").alias("html")).unionByName(
        slim.select(key.alias("key"), "pid", "digest", F.lit(1).alias("kind"), gone.cast("long").alias("refers"), "url", "html")
    )
    numbered, shards = with_shard(both, starts)
    dealt = numbered.drop("key").repartitionById(min(shards, 100_000), F.expr(f"shard % {min(shards, 100_000)}")).sortWithinPartitions("shard", "pid", "digest", "kind", "url")
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    listed = materialize(dealt.mapInArrow(_write_shards(root, file_bytes, level), MANIFEST), "warc-manifest")
    listed.write.json(f"{root}/manifest")
    for path in (f"{root}/_temporary", facts._stored_at, starts._stored_at):
        delete(pages.sparkSession, path)
    return listed


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed; one at a time in memory."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            if parts:
                raise ValueError("the last record is cut off")
            return
        parts.append(z.decompress(chunk))
        rest = b""
        if z.eof:
            yield b"".join(parts)
            rest, parts, z = z.unused_data, [], zlib.decompressobj(31)


def parse(raw: bytes) -> tuple | None:
    """The row of one page record; a response's payload digest is computed again and compared."""
    head, _, body = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if h["WARC-Type"] == "warcinfo":
        return None
    body = body[: int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
    as_id = lambda x: None if x is None or x == "null" else int(x)
    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not match its digest")
    url = None if h["WARC-Target-URI"] == "urn:null" else h["WARC-Target-URI"]
    if "X-Target-URI" in h:
        url = base64.b64decode(h["X-Target-URI"]).decode()
    return as_id(h["X-Page-ID"]), url, h["WARC-Type"], size, digest.hex(), as_id(h.get("X-Refers-To-Page-ID")), payload if h["WARC-Type"] == "response" else None


def _read_files(root: str, payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in members(f):
                        row = parse(raw)
                        if row is None:
                            continue
                        rows.append(row if payloads else (*row[:6], None))
                        held += len(raw) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of all files that the manifest under ``root`` lists; without a committed manifest
    there is nothing to read."""
    if not exists(spark, f"{root}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no committed manifest under {root}")
    files = spark.read.schema(MANIFEST).json(f"{root}/manifest").select("path")
    n = max(1, 2 * files.count())
    return files.repartition(n, "path").mapInArrow(_read_files(root, payloads), RECORDS)


def fresh_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spanloom/warc-{uuid.uuid4().hex}"
