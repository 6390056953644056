"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents link when the
Jaccard similarity of their sets reaches ``similarity``; the join returns classes of linked
documents without ever spelling out the pairs of a class.

1. *Equal sets* (by two 64-bit hashes) are one representative from here on, whatever their number.
2. *Sampling cut.* Shingles whose hash is in a fixed part of the hash range are counted exactly.
   A set with more shingles of its own there than a link may leave unshared links with nothing.
3. *Classes of tokens.* Among the sets left, all shingles are counted. Those of one set alone
   are dropped (their number is kept), the others are ordered rare first. A set's prefix ends
   where what follows could no longer hold enough shared shingles.
4. *Rare tokens* (at most ``rare`` sets) in a prefix are indexed one by one: a bucket has a fixed
   bound.
5. *Frequent tokens* fall into classes by their count: those of at most ``rare`` squared sets are
   indexed by pairs, the others by triples. A set whose prefix reaches frequent tokens has it
   extended until any tokens a partner may lack still leave it a whole combination. Combinations of
   all tokens of a prefix would grow with its k-th power, so a hash deals each class to about as many
   cells as linked sets can differ in tokens, and only tokens of one cell are combined: about two
   pairs or five triples for each token that may differ. The number of cells follows from the binary
   digits of the larger size; sets near a power of two are indexed for both numbers.
   Pairs that share a rare token have met by it already; all others share frequent tokens only,
   which bounds what they can share. A bucket's sets are compared with its member that has the
   fewest other tokens; where that leaves several classes in one bucket, the sets outside its
   largest class are compared with the sets of other classes, if the bound allows a link. The
   bound says how large a partner a set can reach, so a bucket's sets are dealt to bands of size
   and reach, and only bands that can hold partners are joined: pages that share a template and
   differ too much to link cost no pairs. Where they differ in frequent tokens, which that bound does
   not see, sketches of parities tell how many tokens two sets differ in at least: the join compares
   ``SKETCH`` words of such a pair, and only pairs that may still link are verified.
6. *Verification* counts shared shingles exactly; classes are the components of the links.

Edge cases: texts without words (null, empty, white space) have no set and link with nothing;
fewer words than a shingle give the whole sequence as the one shingle; repeated rows and ids get
one row each and the same class; null ids are never a class id unless all of a class are null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, materialize

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    """Hashes of words; forgets all once it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M3
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, width: int, words: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a lower-cased UTF-8 text."""
    found = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], dtype=np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, len(h) if len(h) < width else width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mix(out * M1 + h[i : len(h) - k + 1 + i]) + M2
        out = _mix(out)
    return np.unique(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(width: int, keep: float, names: list[str]):
    """Batches of (key, text) -> key, n, s1, s2 and the shingles below ``keep`` of the hash range."""
    edge = np.uint64(min(2**64 - 1, int(keep * 2.0**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            at = 0
            texts = b.column(1)
            while at < b.num_rows:
                n, s1, s2, toks, first, held = [], [], [], [], at, 0
                while at < b.num_rows and held < 4 << 20:
                    raw = (texts[at].as_py() or "").encode()
                    s = shingles(raw, width, words)
                    body = s.tobytes()
                    n.append(len(s))
                    s1.append(xxhash.xxh3_64_intdigest(body, 1))
                    s2.append(xxhash.xxh3_64_intdigest(body, 2))
                    toks.append(s[: int(np.searchsorted(s, edge, "right"))])
                    held += len(raw)
                    at += 1
                stops = np.cumsum([0] + [len(t) for t in toks]).astype(np.int32)
                flat = np.concatenate(toks) if toks else np.empty(0, np.uint64)
                yield pa.record_batch(
                    [b.column(0).slice(first, at - first), pa.array(n, pa.int64()), _signed(np.array(s1, np.uint64)), _signed(np.array(s2, np.uint64)), pa.ListArray.from_arrays(pa.array(stops), _signed(flat))],
                    names=names,
                )

    return run


def sets_of(docs: DataFrame, key: str, text: str, width: int, keep: float = 1.0) -> DataFrame:
    names = [key, "n", "s1", "s2", "toks"]
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(_sets(width, keep, names), f"{key} {kind}, n long, s1 long, s2 long, toks array<long>")


def _least_shared(n: Column, percent: int) -> Column:
    """A link shares at least ``similarity`` of the larger set, so of either set."""
    return F.ceil(n * percent / 100.0)


#: Most tokens of one combination.
WIDEST = 3


def _cells(bits: int, percent: int) -> tuple[int, int, int]:
    """(least shared, cells of a token class, widest combination) for pairs whose larger set has
    ``bits`` binary digits in its size: all cells together may hold one token less than a
    combination each and still fewer tokens than a link shares."""
    least = -(-percent * 2 ** (bits - 1) // 100)
    widest = next(w for w in range(WIDEST, 0, -1) if w * (w - 1) // 2 < least)
    room = (least - 1) // max(1, widest * (widest - 1) // 2)
    return least, max(1, min(room, 3 * (100 - percent) * 2**bits // 400)), widest


def _combined(tok: np.ndarray, df: np.ndarray, spare: int, cells: int, widest: int, rare: int) -> np.ndarray:
    """Combinations of a prefix of ``tok`` (in the common order), of which a partner may lack ``spare``.

    A token's class, by its count, says how many tokens its combinations have; a hash deals the
    class to cells, and a combination stays in its cell. The prefix is extended until its cells
    hold ``spare`` + 1 tokens beyond one less than a combination each: whichever the partner lacks,
    some cell keeps a whole combination. Of two sets, the prefix that ends first decides.
    """
    k = np.minimum(widest, 2 + np.searchsorted(rare ** np.arange(2, widest), df))
    with np.errstate(over="ignore"):
        cell = k * cells + (_mix(tok * M2) % np.uint64(cells)).astype(np.int64)
        value = _mix(tok + M1)
    by = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[by], prepend=-1))
    before = np.empty(len(tok), np.int64)  # tokens of the same cell that precede it
    before[by] = np.arange(len(tok)) - np.repeat(starts, np.diff(np.append(starts, len(tok))))
    end = int(np.searchsorted(np.cumsum(before >= k - 1), spare + 1)) + 1
    by = by[by < end]
    k, before, value = k[by], before[by], value[by]
    found = []
    for w in range(1, widest + 1):
        at = np.flatnonzero(k == w)
        reach = int(before[at].max(initial=0))
        for back in combinations(range(1, reach + 1), w - 1):
            i = at[before[at] >= back[-1]] if back else at
            total = value[i]
            for d in back:
                total = total + value[i - d]
            found.append(total)
    return np.concatenate(found)


def _signatures(percent: int, rare: int):
    """Rows (sid, n, shared) -> keys to index a set by: kind 1 rare tokens, above it combinations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        held = 0

        def emit(kind: int, keys: np.ndarray, sid: int, n: int, own: int) -> None:
            nonlocal held
            held += len(keys)
            for c, v in zip(out, (np.full(len(keys), kind), keys, np.full(len(keys), sid), np.full(len(keys), n), np.full(len(keys), own)), strict=True):
                c.append(v.astype(np.int64))

        def flush() -> pa.RecordBatch:
            nonlocal held
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            held = 0
            for c in out:
                c.clear()
            return pa.record_batch([pa.array(c) for c in flat], names=["kind", "key", "sid", "n", "own"])

        for b in batches:
            for sid, n, shared in zip(b.column("sid").to_pylist(), b.column("n").to_pylist(), b.column("shared"), strict=True):
                rows = shared.values.flatten()
                df, tok = np.asarray(rows[0]), np.asarray(rows[1])
                own = n - len(tok)
                prefix = n - -(-percent * n // 100) + 1
                if own >= prefix:
                    continue
                order = np.lexsort((tok, df))
                df, tok = df[order], tok[order]
                head = tok[: prefix - own]
                few = int(np.searchsorted(df, rare, "right"))
                emit(1, head[:few], sid, n, own)
                if len(head) > few:
                    # pairs that share a rare token meet by it, so here rare tokens count as unshared too
                    for bits in range(n.bit_length(), (100 * n // percent).bit_length() + 1):
                        least, cells, widest = _cells(bits, percent)
                        spare = len(tok) - few - max(least, -(-percent * n // 100))
                        if spare >= 0:
                            with np.errstate(over="ignore"):
                                keys = _mix(_combined(tok[few:].view(np.uint64), df[few:], spare, cells, widest, rare) + np.uint64(bits) * M3)
                            emit(1 + bits, keys.view(np.int64), sid, n, own)
                if held > 500_000:
                    yield flush()
            yield flush()

    return run


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and the shingles each set has alone leave room for a link."""
    na, nb, oa, ob = (F.col(f"{x}.{c}") for x, c in ((a, "n"), (b, "n"), (a, "own"), (b, "own")))
    most = F.least(na - oa, nb - ob)
    return (100 + percent) * most >= percent * (na + nb)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return two.select("a", "b", "na", "nb", shared.alias("c")).where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def components(links: DataFrame, rounds: int = 40, keep=materialize) -> DataFrame:
    """(sid, comp) for all ends of links: the smallest sid of the component.

    Alternating large and small stars: each round points every vertex's neighbours at its
    smallest one; the number of rounds grows with the logarithm of the longest path.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars0")
    seen = None
    for i in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"stars{i + 1}")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("sid"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("comp")).unionByName(roots)


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("sid"))
    return rows.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


#: Keys of a set that its rows carry; a pair that meets in more than these may come up again.
LEAD = 64


#: Bits of a sketch, in words of 64.
SKETCH = 16


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, g0, g1, ...) of (sid, toks): each token flips one bit, so two sets differ in at least as
    many tokens as their sketches in bits."""
    for b in batches:
        bits = np.zeros((b.num_rows, 64 * SKETCH), np.uint8)
        for row, toks in zip(bits, b.column("toks"), strict=True):
            with np.errstate(over="ignore"):
                at = _mix(np.asarray(toks.values).view(np.uint64) + M2) % np.uint64(64 * SKETCH)
            row[:] = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pa.record_batch([b.column("sid"), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH))], names=["sid", *(f"g{i}" for i in range(SKETCH))])


def _near(a: str, b: str, percent: int) -> Column:
    """The tokens that only one of both sets has, as far as sketches and lone tokens tell, allow a link."""
    apart = F.col(f"{a}.own") + F.col(f"{b}.own")
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"{a}.g{i}").bitwiseXOR(F.col(f"{b}.g{i}")))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _open_buckets(tagged: DataFrame, sets: DataFrame, percent: int, keep) -> DataFrame:
    """The rows of buckets that hold several classes, with ``probe``, ``lead``, ``reach``, bands and sketches.

    Buckets of the same sets are one bucket: pages of one template share very many combinations.
    Members of a bucket's largest class need no comparison with each other, so only the others
    probe. ``lead`` holds the smallest ``LEAD`` open keys of the set; every pair has its first
    shared key in common, so taking it there only loses nothing. ``reach`` restates the bound of
    ``_may_link``: a and b may link only if reach(a) >= percent * n(b) and reach(b) >= percent * n(a).
    Sets that reach no size at all go; ``nb`` and ``rb`` are bands of half a percent.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    mark = [F.sum(wide(F.xxhash64(F.lit(i), "sid"))).alias(f"m{i}") for i in range(2)]
    held = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), *mark)
    mixed = held.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("rows"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1"))
    mixed = mixed.where("classes > 1").groupBy("rows", "m0", "m1").agg(F.min(F.struct("key", "top")).alias("k")).select("k.key", "k.top")
    rows = tagged.join(mixed.select("key", F.col("top.comp").alias("top")), "key").withColumn("probe", F.col("comp") != F.col("top")).drop("top")
    rows = rows.withColumn("reach", (100 + percent) * (F.col("n") - F.col("own")) - percent * F.col("n")).where(F.col("reach") >= percent)
    band = lambda c: F.floor(F.log(c) * 200).cast("int")
    rows = keep(rows.withColumns({"nb": band("n"), "rb": band("reach")}), "ngram-open")
    lead = rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAD).alias("lead"))
    drawn = sets.join(lead.select("sid"), "sid", "left_semi").select("sid", "toks").mapInArrow(_sketches, "sid long, " + ", ".join(f"g{i} long" for i in range(SKETCH)))
    return keep(rows.join(lead.join(drawn, "sid"), "sid"), "ngram-lead")


def _meeting_bands(rows: DataFrame, percent: int) -> DataFrame:
    """(key, nb, rb, to_nb, to_rb): bands of probes and bands that can hold partners of theirs.

    Bands are counted first: a bucket has a bounded number of them, whatever its size.
    """
    bands = rows.groupBy("key", "nb", "rb").agg(F.min("n").alias("n"), F.max("reach").alias("reach"), F.max("probe").alias("probe"))
    a, b = bands.where("probe").alias("a"), bands.alias("b")
    can = (F.col("a.reach") >= percent * F.col("b.n")) & (F.col("b.reach") >= percent * F.col("a.n"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & can).select("a.key", "a.nb", "a.rb", F.col("b.nb").alias("to_nb"), F.col("b.rb").alias("to_rb"))


def _cross(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of open rows of different classes that may link, each taken at one key."""
    asks = rows.where("probe").join(_meeting_bands(rows, percent), ["key", "nb", "rb"])
    x, y = asks.alias("a"), rows.alias("b")
    # of two probes the smaller sid asks; a pair is taken at the first key that both sets lead with
    once = ~F.col("b.probe") | (F.col("a.sid") < F.col("b.sid"))
    met = F.array_min(F.array_intersect("a.lead", "b.lead"))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.to_nb") == F.col("b.nb")) & (F.col("a.to_rb") == F.col("b.rb"))
    return x.join(y, same & (F.col("a.comp") != F.col("b.comp")) & once & _may_link("a", "b", percent) & _near("a", "b", percent) & (met.isNull() | (met == F.col("a.key"))))


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(5), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def _join(docs: DataFrame, width: int, percent: int, rare: int, id_col: str, text_col: str, lookup: int = 1_000_000) -> DataFrame:
    """doc_id, rk, n, comp (null for rows without a set), component_id."""
    tables = Scratch()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("rk"))
    keep = min(1.0, 2.5 * (1 - percent / 100))
    head = base.select(F.struct("doc_id", "rk").alias("k"), "text")
    first = tables(sets_of(head, "k", "text", width, keep).select("k.doc_id", "k.rk", "n", "s1", "s2", "toks"), "ngram-sets")
    filled = first.where("n > 0")

    # 1, 2: distinct sets, and how many sampled shingles each has alone
    distinct = tables(filled.groupBy("s1", "s2").agg(F.min("rk").alias("rk"), F.max("n").alias("n")), "ngram-distinct")
    # the first hash names a set, unless different sets share it: then a hash of both does
    clash = distinct.groupBy("s1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s1", F.lit(True).alias("clash"))
    if clash.isEmpty():
        named = lambda df: df.withColumn("sid", F.col("s1"))
    else:
        named = lambda df: df.join(clash, "s1", "left").withColumn("sid", F.when(F.col("clash"), F.xxhash64("s1", "s2")).otherwise(F.col("s1")))
    filled, distinct = named(filled), named(distinct)
    per_token = filled.select("sid", F.explode("toks").alias("tok")).groupBy("tok").agg(F.min("sid").alias("sid"), F.max("sid").alias("other"))
    alone = per_token.where("sid = other").groupBy("sid").agg(F.count(F.lit(1)).alias("own"))
    left = tables(
        distinct.join(alone, "sid", "left")
        .where(F.coalesce("own", F.lit(0)) <= F.col("n") - _least_shared(F.col("n"), percent))
        .select("rk", F.col("sid").alias("want")),
        "ngram-left",
    )

    # 3: all shingles of the sets left
    # few sets are looked up in memory; beyond ``lookup`` rows (16 bytes each) both sides are exchanged
    few = left.count() <= lookup
    again = base.join(F.broadcast(left) if few else left, "rk").select(F.col("want").alias("k"), "text")
    full = tables(sets_of(again, "k", "text", width).select(F.col("k").alias("sid"), "n", "toks"), "ngram-full")
    long = full.select("sid", F.explode("toks").alias("tok"))
    common = long.groupBy("tok").agg(F.count(F.lit(1)).alias("df"), F.min("sid").alias("l"), F.max("sid").alias("h")).where("l <> h").select("tok", "df")
    shared = long.join(common, "tok").groupBy("sid").agg(F.collect_set(F.struct("df", "tok")).alias("shared"))
    sizes = full.groupBy("sid").agg(F.max("n").alias("n"))
    sets = tables(sizes.join(shared, "sid"), "ngram-shared")
    shingled = sets.select("sid", "n", F.transform("shared", lambda x: x["tok"]).alias("toks"))
    keys = tables(sets.mapInArrow(_signatures(percent, rare), "kind long, key long, sid long, n long, own long"), "ngram-keys")

    # 4: rare tokens, every pair of a bucket of at most ``rare`` sets
    single = keys.where("kind = 1")
    a, b = single.alias("a"), single.alias("b")
    rare_pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & _may_link("a", "b", percent))
    # 5: frequent combinations, every set of a bucket with its pivot
    combos = keys.where("kind > 1")
    met = combos.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    combos = combos.join(met, "key").select("key", "sid", "n", "own")
    combos = tables(combos, "ngram-combos")
    pivots = combos.groupBy("key").agg(F.min(F.struct("own", "sid", "n")).alias("p"), F.max("sid").alias("h"), F.min("sid").alias("l")).where("l <> h")
    pivots = pivots.select("key", "p.sid", "p.n", "p.own")
    stars = combos.alias("a").join(pivots.alias("b"), "key").where((F.col("a.sid") != F.col("b.sid")) & _may_link("a", "b", percent))
    pick = lambda df: df.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"))
    tried = tables(pick(rare_pairs).unionByName(pick(stars)).distinct(), "ngram-pairs")
    links = tables(_verify(tried, shingled, percent), "ngram-links")
    comps = None if links.isEmpty() else tables(components(links, keep=tables), "ngram-comps")

    # buckets that still hold several classes: their sets of different classes are compared
    if not combos.isEmpty():
        more = pick(_cross(_open_buckets(_labelled(combos, comps), shingled, percent, tables), percent)).distinct().join(tried, ["a", "b"], "left_anti")
        links2 = tables(_verify(more, shingled, percent), "ngram-links2")
        if not links2.isEmpty():
            links = links.unionByName(links2)
            comps = tables(components(links, keep=tables), "ngram-comps2")

    # 6: ids
    by_set = filled.groupBy("sid").agg(F.min("doc_id").alias("low"))
    labelled = _labelled(by_set, comps)
    ids = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    with_ids = labelled.select("sid", "comp").join(ids, "comp")
    done = filled.select("doc_id", "rk", "n", "sid").join(with_ids, "sid").select("doc_id", "rk", "n", "comp", "component_id")
    bare = first.where("n = 0").select("doc_id", "rk", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    found = tables(done.unionByName(bare), "ngram-found")
    tables.drop(found)
    return found


def classes(docs: DataFrame, width: int = 5, percent: int = 80, rare: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the class) for every row."""
    joined = _join(docs, width, percent, rare, id_col, text_col)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, rare: int = 16) -> DataFrame:
    """One document of each class, the one with the smallest id; rows that repeat id and text count
    as one. Documents without words link with nothing and stay."""
    joined = _join(docs, width, percent, rare, "doc_id", "text")
    heads = joined.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "rk")).alias("h")).select("h.rk")
    keep = materialize(heads.unionByName(joined.where("comp is null").select("rk").distinct()), "ngram-heads")
    # whole rows travel as one column, so that no name of theirs can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _row_key("doc_id", "text").alias("rk"))
    return keyed.join(keep, "rk", "left_semi").dropDuplicates(["rk"]).select("row.*")
