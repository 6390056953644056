"""Best-fit packing by a linear grouping scheme.

Token counts are whole numbers up to the sequence length, so a histogram of piece lengths, at
most ``limit`` rows whatever the size of the corpus, is all the packing has to see:

1. large lengths are sorted and cut into groups of equal cardinality; each length is rounded up
   to its group's longest;
2. patterns of the few rounded sizes that cover all large pieces are chosen by column generation:
   a price for every group, a knapsack for the pattern worth most, until none is worth a sequence;
3. the actual lengths take the places of the rounded ones, longest first; the last place of a
   pattern takes the longest that fits, which gives back what rounding up has cost;
4. small lengths, and the large ones left when the uses of patterns are rounded down, go best-fit,
   longest first, whole runs of equal sequences at a time;
5. a few choices of the number of groups and of where large lengths begin are tried, the one with
   the fewest sequences is taken.

The result is a list of runs: "the n pieces of length l from rank r on go to n sequences from s
on, at offset o". Pieces find their run by their rank among the pieces of their length.

Edge cases: a null or empty text is the end token alone; longer documents are cut from their end
so that only the first piece may be shorter; repeated rows are packed once each; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import materialize

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_coders: dict = {}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


#: Marks that end a word and never join letters.
MARKS = ".,;:!?"


class _Coder(dict):
    """Little-endian token ids of words that follow a space; keeps up to ``most`` of them.

    The vocabulary's pre-split never joins across the start of a space that follows another
    character, so a text without double spaces can be cut before every space. Arrow splits a
    batch and numbers its distinct words; only those are looked up or encoded, and NumPy strings
    the ids together. A text that holds an added token of the vocabulary is split there first.
    """

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.added = added_tokens(path)
        encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.encode_added = encoding.encode
        self.encode, self.piece, self.most = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece, most

    def raw(self, text: str) -> bytes:
        if any(mark in text for mark in self.added):
            return _packed(self.encode_added(text, allowed_special="all"))
        return _packed(self.encode(text))

    def __missing__(self, word: str) -> bytes:
        # letters after a space are one stretch for the pattern; a last mark after them is the next
        if word.isalpha():
            found = _packed(self.piece(b" " + word.encode()))
        elif word[:-1].isalpha() and word[-1] in MARKS:
            found = _packed([*self.piece(b" " + word[:-1].encode()), *self.piece(word[-1].encode())])
        else:
            found = self.raw(" " + word)
        if len(self) < self.most and len(word) < 40:
            self[word] = found
        return found

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end token, in a row; where each text ends."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "  ")
        for mark in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), pattern=" ")
        flat, ends = lists.flatten().dictionary_encode(), np.asarray(lists.value_lengths()).cumsum()
        words = flat.dictionary.to_pylist()
        firsts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        codes = np.asarray(flat.indices).astype(np.int64)
        heads = [t.as_py() if o.as_py() else words[codes[f]] for t, o, f in zip(texts, odd, firsts, strict=True)]
        values = [*map(self.__getitem__, words), *map(self.raw, heads), end.to_bytes(4, "little")]
        codes[firsts] = len(words) + np.arange(len(firsts))
        codes = np.insert(codes, ends, len(values) - 1)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start, ids = size.cumsum() - size, np.frombuffer(b"".join(values), "<u4")
        n = size[codes]
        stop = n.cumsum()
        return ids[np.repeat(start[codes] - (stop - n), n) + np.arange(n.sum())], stop[ends + np.arange(len(ends))]


#: The pattern that splits a text before merges (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def added_tokens(path: str) -> dict[str, int]:
    """Tokens beside the ranks: those of the tokenizer file of the same name, none without one."""
    full = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(full):
        return {}
    with open(full) as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def coder(path: str) -> _Coder:
    """One coder a process."""
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def ranks_path() -> str:
    """The default vocabulary: the public byte-level BPE, as ranks (the ids of byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the rest first."""
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def _tokenize(path: str, limit: int, slice_bytes: int = 4 << 20):
    names = [f.strip().split()[0] for f in PIECES.split(",")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).cumsum()
            lo = 0
            while lo < b.num_rows:  # some megabytes of text at a time, one document at least
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + slice_bytes, "right")))
                ids, stops = code.batch(texts.slice(lo, hi - lo), END_ID)
                out: list[list] = [[] for _ in names]
                at = 0
                for doc_id, stop in zip(docs[lo:hi], stops.tolist(), strict=True):
                    own = memoryview(ids[at:stop]).cast("B")
                    for i, (start, length) in enumerate(cut(stop - at, limit)):
                        row = (doc_id, i, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]))
                        for c, x in zip(out, row, strict=True):
                            c.append(x)
                    at = stop
                lo = hi
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """The pieces of all documents with their lengths and checksums."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(_tokenize(path or ranks_path(), limit), PIECES)


# --- the packing of a histogram -------------------------------------------------------------


def _groups(hist: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of (nearly) equal cardinality; a length may be split."""
    total = sum(hist.values())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = size
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            if room == 0:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
    whole: list[list[tuple[int, int]]] = []
    for g in out:  # neighbours that round up to one size are one size
        if g and whole and whole[-1][0][0] == g[0][0]:
            whole[-1] += g
        elif g:
            whole.append(g)
    return whole


def _best_pattern(sizes: np.ndarray, price: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of groups that fits ``room`` and is worth most: a knapsack, one more piece at a time."""
    caps = np.arange(room + 1)
    rest = caps[:, None] - sizes
    value, choices = np.zeros(room + 1), []
    for _ in range(room // int(sizes.min())):
        worth = np.where(rest >= 0, value[np.maximum(rest, 0)] + price, -1.0)
        g = worth.argmax(axis=1)
        better = worth[caps, g] > value + 1e-12
        if not better.any():
            break
        value = np.where(better, worth[caps, g], value)
        choices.append(np.where(better, g, -1))
    found: dict[int, int] = defaultdict(int)
    cap = room
    for choice in reversed(choices):
        if (g := int(choice[cap])) >= 0:
            found[g] += 1
            cap -= int(sizes[g])
    return dict(found)


def configurations(sizes: list[int], counts: list[int], limit: int, rounds: int = 5000) -> tuple[list[tuple[dict[int, int], int]], list[int]]:
    """Patterns of the rounded sizes, how often each is used, and the counts left uncovered.

    The configuration program by column generation: the simplex method starts with sequences of
    one size each; the basis prices the groups, the pattern worth most enters, until none is worth
    more than a sequence. Every basis covers all counts. Uses are rounded down, so what is left is
    less than one sequence of each basic pattern, at most as many patterns as groups.
    """
    size, left = np.array(sizes), np.array(counts, dtype=np.int64)
    basis = [{g: limit // int(n)} for g, n in enumerate(size)]
    inverse = np.diag([1.0 / p[g] for g, p in enumerate(basis)])
    uses = inverse @ left
    for _ in range(rounds):
        price = np.maximum(inverse.sum(axis=0), 0.0)
        best = _best_pattern(size, price, limit)
        if sum(price[g] * k for g, k in best.items()) <= 1 + 1e-6:
            break
        column = inverse[:, list(best)] @ np.array(list(best.values()), float)
        up = column > 1e-9
        ratio = np.where(up, uses / np.where(up, column, 1.0), np.inf)
        out = int(ratio.argmin())
        uses, most = np.maximum(uses - ratio[out] * column, 0.0), ratio[out]
        uses[out], basis[out] = most, best
        inverse[out] /= column[out]
        column[out] = 0.0
        inverse -= np.outer(column, inverse[out])
    used = []
    for pattern, n in zip(basis, np.floor(uses + 1e-6).astype(np.int64), strict=True):
        times = min([int(n), *(int(left[g]) // k for g, k in pattern.items())])
        if times > 0:
            used.append((pattern, times))
            for g, k in pattern.items():
                left[g] -= k * times
    return used, [int(x) for x in left]


def _substitute(grouped: list[list[tuple[int, int]]], used: list[tuple[dict[int, int], int]], limit: int) -> tuple[list[list], list[tuple[int, int]]]:
    """Runs [lengths, count] of sequences with actual lengths in the places of rounded ones, and what has none.

    Each place takes the longest length left that is not above its rounded size; the last one
    takes the longest that fits, so it gets back what rounding up has cost the others.
    """
    left: dict[int, int] = defaultdict(int)
    for g in grouped:
        for length, n in g:
            left[length] += n
    lengths = sorted(left)
    runs: list[list] = []
    for pattern, times in used:
        places = [grouped[g][0][0] for g in sorted(pattern) for _ in range(pattern[g])]
        while times and lengths:
            chosen: dict[int, int] = defaultdict(int)
            got: list[int] = []
            for i, size in enumerate(places):
                room = limit - sum(got)
                at = bisect_right(lengths, room if i == len(places) - 1 else min(room, size))
                while at and left[lengths[at - 1]] <= chosen[lengths[at - 1]]:
                    at -= 1
                if not at:
                    break
                got.append(lengths[at - 1])
                chosen[got[-1]] += 1
            if not got:
                break
            n = min([times, *(left[x] // k for x, k in chosen.items() if k)])
            for x, k in chosen.items():
                left[x] -= n * k
                if not left[x]:
                    lengths.remove(x)
            runs.append([got, n])
            times -= n
    return runs, [(x, left[x]) for x in lengths]


def _best_fit(runs: list[list], rest: dict[int, int], limit: int) -> list[list]:
    """Add lengths to runs, longest first, each to the fullest sequences it fits; new ones where it fits none."""
    by_room: dict[int, list] = defaultdict(list)  # room -> runs with that much left
    rooms: list[int] = []

    def put(run: list) -> None:
        room = limit - sum(run[0])
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(run)

    for r in runs:
        put(r)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = next((r for r in rooms if r >= length), None)
            if room is None:
                fit = limit // length
                full, part = divmod(n, fit)
                if full:
                    put([[length] * fit, full])
                if part:
                    put([[length] * part, 1])
                n = 0
                continue
            run = by_room[room].pop()
            if not by_room[room]:
                rooms.remove(room)
            each = room // length
            bins = min(run[1], n // each)
            if bins:
                put([run[0] + [length] * each, bins])
                n -= bins * each
                run = [run[0], run[1] - bins]
            elif n:  # fewer left than fill one sequence
                put([run[0] + [length] * n, 1])
                run = [run[0], run[1] - 1]
                n = 0
            if run[1]:
                put(run)
    return [r for room in rooms for r in by_room[room]]


def scheme(hist: dict[int, int], limit: int, groups: int, small: float, crowded: bool) -> list[list]:
    """One run of the grouping scheme: patterns for lengths above ``small * limit``, best fit for the
    others and for what the patterns leave. ``crowded`` uses patterns of many pieces first, else
    those of the longest."""
    hist = {int(k): int(n) for k, n in hist.items() if n}
    runs: list[list] = [[[limit], hist.pop(limit)]] if limit in hist else []
    rest = {k: n for k, n in hist.items() if k <= small * limit}
    filled: list[list] = []
    if len(rest) < len(hist):
        grouped = _groups({k: n for k, n in hist.items() if k > small * limit}, groups)
        used, _ = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], limit)
        used.sort(key=lambda u: (-sum(u[0].values()) if crowded else 0, sorted(u[0])))
        filled, bare = _substitute(grouped, used, limit)
        for length, n in bare:
            rest[length] = rest.get(length, 0) + n
    return runs + _best_fit(filled, rest, limit)


#: (groups, share of a sequence above which a length is large). More groups round up less and cost more
#: of the driver's time: 64 groups a tenth of a second, 512 (two lengths each, at most) some ten seconds.
SETTINGS = ((64, 1 / 3), (64, 1 / 4), (128, 1 / 3), (256, 1 / 3), (512, 1 / 3))
#: No finer groups are tried once this share above the least number of sequences is reached.
NEAR = 0.003


def pack(hist: dict[int, int], limit: int = 1024, settings: tuple[tuple[int, float], ...] = SETTINGS, near: float = NEAR) -> list[list]:
    """Runs [lengths of one sequence, number of such sequences] that hold the whole histogram: the
    fewest sequences of the settings tried, which get finer until the tokens' own bound is near."""
    least = -(-sum(int(k) * int(n) for k, n in hist.items()) // limit)
    best, fewest = [], None
    for g, small in settings:
        for crowded in (True, False):
            runs = scheme(hist, limit, g, small, crowded)
            total = sum(n for _, n in runs)
            if fewest is None or total < fewest:
                best, fewest = runs, total
        large = {k: n for k, n in hist.items() if small * limit < k < limit}
        if fewest <= least * (1 + near) or all(len({x for x, _ in part}) == 1 for part in _groups(large, g)):
            break  # near enough, or no length is rounded any more
    return best


def place_runs(runs: list[list]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> (first rank, count, first sequence, pieces a sequence takes, offset) runs, ranks gapless."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, n in runs:
        offset = 0
        for length in lengths:
            out[length].append((ranks[length], n, sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return out


def assign(made: DataFrame, limit: int = 1024, rows_per_bucket: int = 25_000) -> DataFrame:
    """Add sequence_id and offset to (materialized) pieces."""
    spark = made.sparkSession
    hist = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = place_runs(pack(hist, limit))
    # ranks within a length: buckets by hash, their counts added up; a length's buckets follow its count
    buckets = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(hist.items()) for x in (k, -(-n // rows_per_bucket))]), F.col("length")) if hist else F.lit(1)
    rows = made.withColumn("_h", F.xxhash64("doc_id", "piece", "start", "ids_crc32")).withColumn("_b", F.pmod(F.col("_h"), buckets.cast("long")).cast("long"))
    counts = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece"))
    ranked = rows.withColumn("_r", rank).join(starts, ["length", "_b"]).withColumn("_rank", F.col("_s") + F.col("_r") - 1)
    # a run starts at its first rank: the last start not above a rank, found among a length's runs
    table = spark.createDataFrame(
        [(k, [(a, s, o) for a, _, s, o in sorted(v)]) for k, v in runs.items()],
        "length long, runs array<struct<a: long, s: long, o: long>>",
    )
    hit = F.element_at(F.filter("runs", lambda x: x["a"] <= F.col("_rank")), -1)
    found = ranked.join(F.broadcast(table), "length").withColumn("_hit", hit)  # at most ``limit`` rows, runs bounded by the lengths
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_hit.s") + F.col("_rank") - F.col("_hit.a")).alias("sequence_id"),
        F.col("_hit.o").alias("offset"),
    )


def best_fit(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack all documents: one row a piece."""
    return assign(materialize(pieces(docs, limit, path), "pack-pieces"), limit)
