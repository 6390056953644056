"""Benchmark decontamination by winnowing.

Of the k-word grams in every stretch of ``length`` words the one with the smallest hash is kept
(the leftmost of equal ones), so a stretch that a document shares with a test item keeps the same
gram in both, and every shared stretch of ``length`` words has a common fingerprint. A document's
fingerprints are joined with those of the items; what is left is extended to the stretches that
chose the gram, and stretches are joined as texts, so a hash that collides costs time, not
correctness. Each stretch belongs to one fingerprint: rows stay in proportion to words, however
often a passage repeats. Items of fewer words are one stretch of that many; documents are then
winnowed once more for each such number of words.

The items' fingerprints are also a filter inside the scan while there are at most ``FILTER`` of
them (counted; 8 bytes each); beyond that, all fingerprints of documents go to the join.

Edge cases: a null or empty text has no words and hits nothing; an item without words has no
stretch; items of one id count once, items without an id hit words but are neither counted nor
listed; rows that repeat an id are separate results; empty tables give an empty result or no hits;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import Scratch, materialize

LENGTH = 10
FILTER = 4_000_000
CACHE = 400_000
FOUND = "array<struct<length:int,print:long,at:long,span:string>>"
KIND = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("at", pa.int64()), ("span", pa.string())]))

#: Bytes of a UTF-8 text: A-Z become a-z; ASCII digits, letters and what is not ASCII stay; the rest parts words.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = found
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


def winnow(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print, first, last): a kept gram's hash, and the first and last start of the stretches that keep it."""
    k = -(-length // 2)
    if len(hashes) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    n = len(hashes) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    seen = np.lib.stride_tricks.sliding_window_view(grams, length - k + 1)
    kept = seen.argmin(axis=1) + np.arange(len(seen))
    first = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1])))
    last = np.concatenate((first[1:], [len(kept)])) - 1
    return grams[kept[first]].view(np.int64), first, last


def _scan(lengths: list[int] | None, known: Callable[[], dict] | None):
    """Rows (id, n_words, found) of rows (id, text). ``lengths``: of the stretches, or that of each
    text itself, up to ``LENGTH``. ``known``: gives the fingerprints of each length that matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, wanted = _Hashes(), known() if known else None
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                own: list[dict] = []
                for length in lengths if lengths is not None else [min(LENGTH, len(words))] * bool(words):
                    prints, first, last = winnow(hashes, length)
                    keep = np.arange(len(prints)) if wanted is None else _among(prints, wanted[length])
                    for p, a, b in zip(prints[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                        own.append({"length": length, "print": p, "at": a, "span": b" ".join(words[a : b + length]).decode()})
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, KIND)], names=["id", "n_words", "found"])

    return run


def _among(prints: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(wanted, prints)
    at[at == len(wanted)] = 0
    return np.flatnonzero(wanted[at] == prints) if len(wanted) else np.zeros(0, np.int64)


def _scanned(df: DataFrame, key: str, text: str, lengths: list[int] | None, known=None) -> DataFrame:
    slim = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(_scan(lengths, known), f"id {kind}, n_words long, found {FOUND}")


def _stretches(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, length, start, stretch) of rows (keys, length, at, span)."""
    words = F.split("span", " ")
    each = F.transform(F.sequence(F.lit(0), F.size(words) - F.col("length")), lambda i: F.struct((F.col("at") + i).alias("start"), F.concat_ws(" ", F.slice(words, i + 1, F.col("length"))).alias("stretch")))
    return spans.select(*keys, "length", F.explode(each).alias("s")).select(*keys, "length", "s.start", "s.stretch")


def index(items: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """(length, print) and (length, stretch, item_id) of the items, each once."""
    flat = store(_scanned(items, "item_id", "text", None).select("id", F.explode("found").alias("f")).select("id", "f.*"), "item-prints")
    prints = store(flat.select("length", "print").distinct(), "prints")
    return prints, store(_stretches(flat, "id").select("length", "stretch", F.col("id").alias("item_id")).distinct(), "stretches")


def hits(docs: DataFrame, items: DataFrame, store, most: int = FILTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words), and of rows that hit: (row, start, length) and (row, item_id)."""
    prints, stretches = index(items, store)
    spark = docs.sparkSession
    sizes = {r["length"]: r["count"] for r in prints.groupBy("length").count().collect()}  # ten rows at most
    known = None
    if sum(sizes.values()) <= most:
        wanted = {n: np.zeros(0, np.int64) for n in sizes}
        for n, own in prints.toPandas().groupby("length"):
            wanted[int(n)] = np.sort(own["print"].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(wanted)
        known = lambda: sent.value
    scanned = _scanned(docs, "doc_id", "text", sorted(sizes), known)
    rows = store(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    spans = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").join(prints, ["length", "print"], "left_semi")
    met = store(_stretches(spans, "row").join(stretches, ["length", "stretch"]), "met")
    return rows.select("row", F.col("id").alias("doc_id"), "n_words"), met.select("row", "start", "length").distinct(), met.select("row", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, most: int = FILTER) -> DataFrame:
    """The contract's query: words hit and items met, for every document."""
    scratch = Scratch()
    rows, spots, met = hits(docs, items, scratch, most)
    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spots.withColumn("_new", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("_new").alias("n_hit"))
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    named = met.groupBy("row").agg(names.alias("items"))
    full = rows.join(hit, "row", "left").join(named, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    done = full.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
    done = materialize(done, "decontaminated")
    scratch.drop()
    return done
