"""Queries over the star-schema tables, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.segment import Seg, SlidingWindow
from spanloom.operators import annotation as an
from spanloom.operators import errors as er
from spanloom.operators import mapping as mp
from spanloom.operators import matrix as mx
from spanloom.operators import metrics as me
from spanloom.operators import scores as sc
from spanloom.operators import tagging as tg
from spanloom.operators import timeline as tl
from spanloom.plans import views as v

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- SQL building blocks, independent of the Spark side -------------------------------------------

BASE = """
ref AS (SELECT * FROM (SELECT user_id::VARCHAR AS uri, date_diff('second', TIMESTAMP '2024-01-01', ts)::DOUBLE AS s,
  date_diff('second', TIMESTAMP '2024-01-01', ts) + round(value * 100) * 6 AS e, event_id::VARCHAR AS track, event_id AS i,
  event_type AS label FROM events) WHERE e - s > 1e-6),
hyp AS (SELECT uri, s + (i % 7) * 600.0 AS s, e + (i % 7) * 600.0 AS e, track, i,
  CASE WHEN i % 5 = 0 THEN 'view' ELSE label END AS label FROM ref WHERE i % 11 <> 0),
uem AS (SELECT uri, (a * 86400)::DOUBLE AS s, (b * 86400)::DOUBLE AS e FROM (SELECT DISTINCT user_id::VARCHAR AS uri FROM events),
  (VALUES (5, 12), (15, 25)) AS w(a, b)),
turns AS (SELECT conv_id::VARCHAR AS uri, e - n AS s, e, turn::VARCHAR AS track, turn, label FROM (SELECT conv_id, turn, role AS label,
  length(text)::DOUBLE AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::DOUBLE AS e FROM conversations)),
tjoin AS (SELECT uri, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN turn % 3 <> 2 THEN 1 ELSE 0 END)
  OVER (PARTITION BY uri ORDER BY s, e, turn ROWS UNBOUNDED PRECEDING) AS g FROM turns) GROUP BY uri, g),
types AS (SELECT * FROM (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5)) AS t(label, j)),
sco AS (SELECT uri, s, e, track, i, t.label, ((i * 7919 + j * 104729 + i * j * 31) % 1000) / 1000.0::DOUBLE AS score FROM ref, types t)
"""
OVL = "greatest(a.s, b.s) < least(a.e, b.e) - 1e-6"


def s_islands(src: str, keys: str = "uri") -> str:
    prev = f"max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    flags = f"SELECT {keys}, s, e, CASE WHEN s - {prev} <= 1e-6 THEN 0 ELSE 1 END AS new FROM {src} WHERE e - s > 1e-6"
    ids = f"SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ({flags})"
    return f"(SELECT {keys}, min(s) AS s, max(e) AS e FROM ({ids}) GROUP BY {keys}, g)"


def s_cells(src: str) -> str:
    cuts = f"SELECT uri, s AS t FROM {src} UNION SELECT uri, e FROM {src}"
    pieces = f"SELECT uri, t AS s, lead(t) OVER (PARTITION BY uri ORDER BY t) AS e FROM ({cuts})"
    return f"""(SELECT p.uri, p.s, p.e FROM ({pieces}) p WHERE p.e - p.s > 1e-6 AND EXISTS
      (SELECT 1 FROM {s_islands(src)} i WHERE i.uri = p.uri AND i.s <= (p.s + p.e) / 2 AND i.e >= (p.s + p.e) / 2))"""


def s_co(r: str, c: str) -> str:
    return f"""(SELECT g.uri, g.row, g.col, coalesce(k.value, 0.0) AS value FROM
      (SELECT a.uri, a.label AS row, b.label AS col FROM (SELECT DISTINCT uri, label FROM {r}) a JOIN (SELECT DISTINCT uri, label FROM {c}) b USING (uri)) g
      LEFT JOIN (SELECT a.uri, a.label AS row, b.label AS col, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS value
        FROM {s_islands(r, 'uri, label')} a JOIN {s_islands(c, 'uri, label')} b ON a.uri = b.uri AND {OVL} GROUP BY ALL) k USING (uri, row, col))"""


def s_labels(r: str, h: str) -> str:
    """Pieces of both sides with counts of every label."""
    return f"""cel AS (SELECT * FROM {s_cells(f'(SELECT uri, s, e FROM {r} UNION ALL SELECT uri, s, e FROM {h})')}),
    cnt AS (SELECT a.uri, a.s, a.e, b.label, sum(b.r) AS r, sum(1 - b.r) AS h FROM cel a JOIN
      (SELECT uri, s, e, label, 1 AS r FROM {r} UNION ALL SELECT uri, s, e, label, 0 FROM {h}) b ON a.uri = b.uri AND {OVL} GROUP BY ALL)"""


def s_gaps(src: str, focus: str) -> str:
    """Pieces of the focus islands, cut at all boundaries, that no segment covers; merged again."""
    f = s_islands(focus)
    cuts = f"""SELECT f.uri, f.s AS fs, f.e AS fe, t FROM {f} f, LATERAL (SELECT f.s AS t UNION SELECT f.e UNION
      SELECT x.s FROM {src} x WHERE x.uri = f.uri AND x.s > f.s AND x.s < f.e UNION SELECT x.e FROM {src} x WHERE x.uri = f.uri AND x.e > f.s AND x.e < f.e)"""
    pieces = f"SELECT uri, t AS s, lead(t) OVER (PARTITION BY uri, fs, fe ORDER BY t) AS e FROM ({cuts})"
    bare = f"(SELECT p.* FROM ({pieces}) p WHERE p.e - p.s > 1e-6 AND NOT EXISTS (SELECT 1 FROM {src} x WHERE x.uri = p.uri AND greatest(x.s, p.s) < least(x.e, p.e) - 1e-6))"
    return s_islands(bare)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[name] = f
        if sql is not None:
            # text that starts with further named queries continues the list of views
            SQL[name] = f"WITH {BASE} {sql}" if sql.lstrip().startswith("SELECT") else f"WITH {BASE}, {sql}"
        return f

    return add


def se(prefix: str = "") -> str:
    return f'{prefix}s AS "start", {prefix}e AS "end"'


R, H, U, T, TH, S = v.ann_ref, v.ann_hyp, v.uem, v.turns, v.turns_hyp, v.scores

# --- A, B: expressions ---------------------------------------------------------------------------


@query(
    "a_segment_expressions",
    """SELECT a.track AS track, b.track AS other, a.e - a.s AS duration, (a.s + a.e) * 0.5 AS middle, a.s <= b.s AND a.e >= b.e AS contains,
    greatest(a.s, b.s) AS i_start, least(a.e, b.e) AS i_end, greatest(a.s, b.s) < least(a.e, b.e) - 1e-6 AS intersects,
    least(a.s, b.s) AS u_start, greatest(a.e, b.e) AS u_end, least(a.e, b.e) AS g_start, greatest(a.s, b.s) AS g_end, b.s BETWEEN a.s AND a.e AS overlaps,
    printf('[%.3f --> %.3f]', a.s, a.e) AS text FROM ref a JOIN ref b ON a.uri = b.uri AND b.i = a.i + 15""",
)
def _(spark, d):
    r = R(spark, d)
    a, b = r.select("uri", *[F.col(c).alias("a_" + c) for c in r.columns[1:]]), r.select("uri", *[F.col(c).alias("b_" + c) for c in r.columns[1:]])
    x, y = Seg.of("a_"), Seg.of("b_")
    pairs = a.withColumn("n", F.col("a_track").cast("long") + 15).join(b.withColumn("n", F.col("b_track").cast("long")), ["uri", "n"])
    return pairs.select(
        F.col("a_track").alias("track"), F.col("b_track").alias("other"), x.duration().alias("duration"), x.middle().alias("middle"), x.contains(y).alias("contains"),
        x.intersection(y).start.alias("i_start"), x.intersection(y).end.alias("i_end"), x.intersects(y).alias("intersects"), x.hull(y).start.alias("u_start"), x.hull(y).end.alias("u_end"),
        x.gap(y).start.alias("g_start"), x.gap(y).end.alias("g_end"), x.overlaps(y.start).alias("overlaps"), x.text().alias("text"),
    )


WIN = SlidingWindow(duration=3600.0, step=1800.0)


@query(
    "b_window_frames",
    """SELECT track, first, n, CASE WHEN first = 0 THEN 0.0 ELSE (first - 0.5) * 1800 + 1800 END::DOUBLE AS "start",
    ((first - 0.5) * 1800 + 1800 + n * 1800)::DOUBLE AS "end" FROM (SELECT track, greatest(0, fs) AS first, fe - greatest(0, fs) AS n FROM
    (SELECT track, round_even((s - 1800) / 1800, 0)::BIGINT AS fs, round_even((e - 1800) / 1800, 0)::BIGINT AS fe FROM ref))""",
)
def _(spark, d):
    first, n = WIN.to_range(Seg.of())
    r = R(spark, d).select("track", first.alias("first"), n.alias("n"))
    seg = WIN.to_segment(F.col("first"), F.col("n"))
    return r.select("track", "first", "n", seg.start.alias("start"), seg.end.alias("end"))


@query("b_window_positions", 'SELECT i::BIGINT AS i, (i * 1800)::DOUBLE AS "start", (i * 1800 + 3600)::DOUBLE AS "end" FROM range(0, 48) AS r(i)')
def _(spark, d):
    w = SlidingWindow(3600.0, 1800.0, 0.0, 86_400.0)
    pos = w.position(F.col("i"))
    return spark.range(1).select(F.explode(w.positions().cast("array<long>")).alias("i")).select("i", pos.start.alias("start"), pos.end.alias("end"))


# --- C: timelines --------------------------------------------------------------------------------


@query("c_timeline_set", f"SELECT DISTINCT uri, {se()} FROM ref")
def _(spark, d):
    return tl.timeline(R(spark, d))


@query("c_kth_segment", f"SELECT uri, {se()} FROM (SELECT DISTINCT uri, s, e, dense_rank() OVER (PARTITION BY uri ORDER BY s, e) AS k FROM ref) WHERE k = 4")
def _(spark, d):
    return tl.kth(tl.timeline(R(spark, d)), 3)


@query("c_rank", f"SELECT uri, {se()}, row_number() OVER (PARTITION BY uri ORDER BY s, e) - 1 AS rank FROM (SELECT DISTINCT uri, s, e FROM ref)")
def _(spark, d):
    return tl.ranked(tl.timeline(R(spark, d))).withColumn("rank", F.col("rank").cast("long"))


@query("c_union", f"SELECT uri, {se()} FROM (SELECT uri, s, e FROM ref UNION SELECT uri, s, e FROM hyp)")
def _(spark, d):
    return tl.union(R(spark, d), H(spark, d))


@query("c_containment", "SELECT h.uri, bool_and(r.uri IS NOT NULL) AS contained FROM (SELECT DISTINCT uri, s, e FROM hyp) h LEFT JOIN (SELECT DISTINCT uri, s, e FROM ref) r USING (uri, s, e) GROUP BY 1".replace("SELECT h.uri", "SELECT uri"))
def _(spark, d):
    return tl.covers(tl.timeline(R(spark, d)), tl.timeline(H(spark, d)))


@query("c_overlap_join", f"SELECT a.uri, a.track AS left_track, b.track AS right_track, least(a.e, b.e) - greatest(a.s, b.s) AS common FROM ref a JOIN hyp b ON a.uri = b.uri AND {OVL}")
def _(spark, d):
    both = Seg.of("a_").intersection(Seg.of("b_"))
    return tl.overlap_join(R(spark, d), H(spark, d)).select("uri", F.col("a_track").alias("left_track"), F.col("b_track").alias("right_track"), (both.end - both.start).alias("common"))


@query("c_overlap_join_orders", """SELECT a.uri, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS days FROM o a JOIN o b ON a.uri = b.uri AND a.k < b.k AND greatest(a.s, b.s) < least(a.e, b.e) - 1e-6 GROUP BY 1""")
def _(spark, d):
    o = v.orders_iv(spark, d)
    both = Seg.of("a_").intersection(Seg.of("b_"))
    pairs = tl.overlap_join(o, o, extra=F.col("a_track").cast("long") < F.col("b_track").cast("long"))
    return pairs.groupBy("uri").agg(F.count(F.lit(1)).alias("pairs"), F.sum(both.end - both.start).alias("days"))


ORDERS = """o AS (SELECT o_custkey::VARCHAR AS uri, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS s,
  date_diff('day', DATE '1992-01-01', last::DATE)::DOUBLE AS e, o_orderkey AS k, o_orderpriority AS label
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE last::DATE > o_orderdate::DATE)"""
SQL["c_overlap_join_orders"] = f"WITH {ORDERS} SELECT a.uri, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS days FROM o a JOIN o b ON a.uri = b.uri AND a.k < b.k AND {OVL} GROUP BY 1"


@query("c_range_probe", f"SELECT uri, track, {se()} FROM ref WHERE greatest(s, 864000.0) < least(e, 950400.0) - 1e-6")
def _(spark, d):
    return tl.probe(R(spark, d), 864_000.0, 950_400.0).select("uri", "track", "start", "end")


@query("c_stab", f"SELECT uri, track, {se()} FROM ref WHERE s <= 1000000 AND e >= 1000000")
def _(spark, d):
    return tl.stab(R(spark, d), 1_000_000.0).select("uri", "track", "start", "end")


@query("c_crop_loose", f"SELECT DISTINCT a.uri, {se('a.')} FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL}")
def _(spark, d):
    return tl.crop(tl.timeline(R(spark, d)), U(spark, d), "loose")


@query("c_crop_strict", f"SELECT DISTINCT a.uri, {se('a.')} FROM ref a JOIN uem b ON a.uri = b.uri AND b.s <= a.s AND b.e >= a.e")
def _(spark, d):
    return tl.crop(tl.timeline(R(spark, d)), U(spark, d), "strict")


@query("c_crop_intersection", f'SELECT DISTINCT a.uri, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL}')
def _(spark, d):
    return tl.crop(tl.timeline(R(spark, d)), U(spark, d))


@query("c_crop_mapping", f'SELECT a.uri, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end", count(DISTINCT (a.s, a.e)) AS origins FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL} GROUP BY 1, 2, 3')
def _(spark, d):
    return tl.crop_mapping(tl.timeline(R(spark, d)), U(spark, d)).select("uri", "start", "end", F.size("origin").cast("long").alias("origins"))


@query("c_extent", 'SELECT uri, min(s) AS "start", max(e) AS "end" FROM ref GROUP BY 1')
def _(spark, d):
    return tl.extent(R(spark, d))


@query("c_islands", f"SELECT uri, {se()} FROM {s_islands('ref')}")
def _(spark, d):
    return tl.islands(R(spark, d), bins=7 * v.DAY)


@query("c_duration", f"SELECT uri, sum(e - s) AS duration FROM {s_islands('ref')} GROUP BY 1")
def _(spark, d):
    return tl.duration(R(spark, d))


@query("c_gaps", f"SELECT uri, {se()} FROM {s_gaps('ref', '(SELECT uri, min(s) AS s, max(e) AS e FROM ref GROUP BY 1)')}")
def _(spark, d):
    return tl.gaps(R(spark, d))


@query("c_gaps_focus", f"SELECT uri, {se()} FROM {s_gaps('ref', 'uem')}")
def _(spark, d):
    return tl.gaps(R(spark, d), U(spark, d))


@query("c_cells", f"SELECT uri, {se()} FROM {s_cells('ref')}")
def _(spark, d):
    return tl.cells(R(spark, d))


# --- D: annotations ------------------------------------------------------------------------------


@query("d_crop_intersection", f'SELECT a.uri, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end", a.track, a.label FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL}')
def _(spark, d):
    return an.crop(R(spark, d), U(spark, d)).select("uri", "start", "end", "track", "label")


@query("d_crop_strict", f"SELECT a.uri, {se('a.')}, a.track, a.label FROM ref a WHERE EXISTS (SELECT 1 FROM uem b WHERE a.uri = b.uri AND b.s <= a.s AND b.e >= a.e)")
def _(spark, d):
    return an.crop(R(spark, d), U(spark, d), "strict")


@query("d_count_segments", "SELECT uri, count(DISTINCT (s, e)) AS n FROM ref GROUP BY 1")
def _(spark, d):
    return an.count_segments(R(spark, d))


@query("d_retrack", f"SELECT uri, {se()}, (row_number() OVER (PARTITION BY uri ORDER BY s, e, track) - 1)::VARCHAR AS track, label FROM ref")
def _(spark, d):
    return an.retrack(R(spark, d))


@query("d_labels", "SELECT DISTINCT uri, label FROM ref")
def _(spark, d):
    return an.labels(R(spark, d))


@query("d_subset", f"SELECT uri, {se()}, track, label FROM ref WHERE label NOT IN ('view', 'click')")
def _(spark, d):
    return an.subset(R(spark, d), ["view", "click"], invert=True)


@query("d_label_islands", f"SELECT uri, label, {se()} FROM {s_islands('ref', 'uri, label')}")
def _(spark, d):
    return an.label_islands(R(spark, d))


@query("d_chart_percent", f"SELECT uri, label, duration / sum(duration) OVER (PARTITION BY uri) AS duration, row_number() OVER (PARTITION BY uri ORDER BY duration DESC, label) AS rank FROM (SELECT uri, label, sum(e - s) AS duration FROM {s_islands('ref', 'uri, label')} GROUP BY 1, 2)")
def _(spark, d):
    return an.chart(R(spark, d), percent=True).withColumn("rank", F.col("rank").cast("long"))


@query("d_argmax_focus", f"SELECT uri, label, duration FROM (SELECT uri, label, sum(e - s) AS duration, row_number() OVER (PARTITION BY uri ORDER BY sum(e - s) DESC, label) AS n FROM {s_islands(f'(SELECT a.uri, a.label, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL})', 'uri, label')} GROUP BY 1, 2) WHERE n = 1")
def _(spark, d):
    return an.argmax(R(spark, d), U(spark, d))


@query("d_argmax_known_first", f"SELECT uri, label, duration FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY w DESC, label) AS n FROM (SELECT *, CASE WHEN label = 'error' THEN duration - max(duration) OVER (PARTITION BY uri) ELSE duration END AS w FROM (SELECT uri, label, sum(e - s) AS duration FROM {s_islands('ref', 'uri, label')} GROUP BY 1, 2))) WHERE n = 1")
def _(spark, d):
    return an.argmax(v.ann_unk(spark, d), known_first=True)


@query("d_translate", f"SELECT uri, {se()}, track, CASE label WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' ELSE label END AS label FROM ref")
def _(spark, d):
    table = spark.createDataFrame([("view", "seen"), ("click", "seen")], "left string, right string")
    return an.translate(R(spark, d), table)


@query("d_anonymize", f"SELECT uri, {se()}, track, printf('Inconnu_%05d', dense_rank() OVER (PARTITION BY uri ORDER BY label)) AS label, true AS is_unknown FROM ref")
def _(spark, d):
    return an.anonymize_labels(R(spark, d))


@query("d_anonymize_tracks", f"SELECT uri, {se()}, track, printf('Inconnu_%05d', row_number() OVER (PARTITION BY uri ORDER BY s, e, track)) AS label, true AS is_unknown FROM ref")
def _(spark, d):
    return an.anonymize_tracks(R(spark, d))


@query("d_smooth", f"SELECT uri, {se()}, (row_number() OVER (PARTITION BY uri ORDER BY label, s) - 1)::VARCHAR AS track, label FROM {s_islands('ref', 'uri, label')}")
def _(spark, d):
    return an.smooth(R(spark, d))


@query("d_json", "SELECT uri, count(*) AS tracks FROM ref GROUP BY 1")
def _(spark, d):
    rows = an.to_json(R(spark, d), "web")
    return rows.select("uri", F.size(F.from_json("json", "tracks array<struct<track:string>>")["tracks"]).cast("long").alias("tracks"))


# --- E: scores -----------------------------------------------------------------------------------


@query("e_rank", f"SELECT uri, {se()}, track, label, score, row_number() OVER (PARTITION BY uri, track ORDER BY score DESC, label) - 1 AS rank FROM sco")
def _(spark, d):
    return sc.rank(S(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("e_nbest", f"SELECT uri, {se()}, track, label, score FROM (SELECT *, row_number() OVER (PARTITION BY uri, track ORDER BY score DESC, label) AS n FROM sco) WHERE n <= 2")
def _(spark, d):
    return sc.nbest(S(spark, d), 2)


@query("e_to_annotation", f"SELECT uri, {se()}, track, CASE WHEN low THEN printf('Inconnu_%05d', row_number() OVER (PARTITION BY uri, low ORDER BY s, e, track)) ELSE label END AS label, low AS is_unknown FROM (SELECT *, score < 0.7 AS low, row_number() OVER (PARTITION BY uri, track ORDER BY score DESC, label) AS n FROM sco) WHERE n = 1")
def _(spark, d):
    return sc.to_annotation(S(spark, d), 0.7)


@query("e_crop", f"SELECT a.uri, {se('a.')}, a.track, a.label, a.score FROM sco a WHERE EXISTS (SELECT 1 FROM uem b WHERE a.uri = b.uri AND b.s <= a.s AND b.e >= a.e)")
def _(spark, d):
    return sc.crop(S(spark, d), U(spark, d))


@query("e_pivot", "SELECT uri, track, max(score) FILTER (label = 'click') AS click, max(score) FILTER (label = 'error') AS error, max(score) FILTER (label = 'purchase') AS purchase, max(score) FILTER (label = 'signup') AS signup, max(score) FILTER (label = 'view') AS view FROM sco GROUP BY 1, 2")
def _(spark, d):
    return sc.to_wide(S(spark, d), list(v.EVENT_TYPES)).drop("start", "end")


# --- F, G: matrices and mappings -----------------------------------------------------------------


@query("f_cooccurrence", f"SELECT uri, row, col, value FROM {s_co('ref', 'hyp')}")
def _(spark, d):
    return mx.cooccurrence(R(spark, d), H(spark, d))


@query("f_tfidf", f"SELECT uri, row, col, value / greatest(1e-6, sum(value) OVER (PARTITION BY uri, col)) * ln(nd::DOUBLE / greatest(1, hits)) AS value FROM (SELECT *, (SELECT count(DISTINCT label) FROM hyp h WHERE h.uri = k.uri) AS nd, count(*) FILTER (value > 0) OVER (PARTITION BY uri, row) AS hits FROM {s_co('ref', 'hyp')} k)")
def _(spark, d):
    return mx.tfidf(R(spark, d), H(spark, d), log=True)


@query("f_argmax", f"SELECT uri, row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY uri, row ORDER BY value DESC, col) AS n FROM {s_co('ref', 'hyp')}) WHERE n = 1")
def _(spark, d):
    return mx.argmax(mx.cooccurrence(R(spark, d), H(spark, d)), 1)


@query("g_argmax_mapper", f"SELECT uri, row AS \"left\", col AS \"right\" FROM (SELECT *, row_number() OVER (PARTITION BY uri, row ORDER BY value DESC, col) AS n FROM {s_co('ref', 'hyp')}) WHERE n = 1 AND value > 0")
def _(spark, d):
    return mp.argmax_mapper(R(spark, d), H(spark, d))


S_FEW = "(SELECT * FROM {} WHERE i % 9 = 0)"


@query("g_conservative_mapper", f"SELECT uri, row AS \"left\", min(col) AS \"right\" FROM {s_co(S_FEW.format('ref'), S_FEW.format('hyp'))} WHERE value > 0 GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, d):
    # a ninth of the events: with all of them every label meets several others
    few = lambda df: df.where(F.col("track").cast("long") % 9 == 0)
    return mp.conservative_mapper(few(R(spark, d)), few(H(spark, d)))


@query("g_hungarian_mapper")
def _(spark, d):
    return mp.hungarian_mapper(R(spark, d), H(spark, d))


@query("g_expected_mapping", 'SELECT coalesce(a.uri, b.uri) AS uri, a.label AS "left", b.label AS "right" FROM (SELECT DISTINCT uri, label FROM ref) a FULL JOIN (SELECT DISTINCT uri, label FROM hyp) b ON a.uri = b.uri AND a.label = b.label')
def _(spark, d):
    return mp.expected(R(spark, d), H(spark, d))


# --- J: tagging ----------------------------------------------------------------------------------


@query("j_direct", f"SELECT a.uri, {se('a.')}, b.track, b.label FROM (SELECT * FROM uem) a JOIN ref b ON a.uri = b.uri AND {OVL}")
def _(spark, d):
    return tg.direct(R(spark, d), U(spark, d))


@query("j_conservative", f"SELECT h.uri, {se('h.')}, h.track, CASE WHEN t.n = 1 AND m.lo = m.hi THEN m.lo ELSE h.label END AS label FROM hyp h JOIN (SELECT uri, s, e, count(DISTINCT track) AS n FROM hyp GROUP BY ALL) t ON h.uri = t.uri AND h.s = t.s AND h.e = t.e LEFT JOIN (SELECT a.uri, a.s, a.e, min(b.label) AS lo, max(b.label) AS hi FROM (SELECT DISTINCT uri, s, e FROM hyp) a JOIN ref b ON a.uri = b.uri AND {OVL} GROUP BY ALL) m ON h.uri = m.uri AND h.s = m.s AND h.e = m.e")
def _(spark, d):
    return tg.conservative(R(spark, d), H(spark, d))


BEST = f"""(SELECT uri, s, e, label, k FROM (SELECT d.*, row_number() OVER (PARTITION BY uri, s, e ORDER BY dur DESC, label) AS k, room FROM
  (SELECT uri, ts AS s, te AS e, label, sum(e - s) AS dur FROM {s_islands(f'(SELECT a.uri, a.s AS ts, a.e AS te, b.label, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM (SELECT DISTINCT uri, s, e FROM hyp) a JOIN ref b ON a.uri = b.uri AND {OVL})', 'uri, ts, te, label')} GROUP BY ALL) d
  JOIN (SELECT a.uri, a.s, a.e, max(n) AS room FROM (SELECT DISTINCT uri, s, e FROM hyp) a JOIN (SELECT uri, s, e, count(DISTINCT track) AS n FROM ref GROUP BY ALL) b ON a.uri = b.uri AND {OVL} GROUP BY ALL) USING (uri, s, e)) WHERE k <= room)"""


@query("j_argmax_timeline", f"SELECT uri, {se()}, (k - 1)::VARCHAR AS track, label FROM {BEST}")
def _(spark, d):
    return tg.argmax_timeline(R(spark, d), H(spark, d))


@query("j_argmax_annotation", f"SELECT h.uri, {se('h.')}, h.track, coalesce(b.label, h.label) AS label FROM (SELECT *, row_number() OVER (PARTITION BY uri, s, e ORDER BY track) AS k FROM hyp) h LEFT JOIN {BEST} b ON h.uri = b.uri AND h.s = b.s AND h.e = b.e AND h.k = b.k")
def _(spark, d):
    return tg.argmax_annotation(R(spark, d), H(spark, d))


@query("j_argmax_tagger", f"SELECT h.uri, {se('h.')}, h.track, coalesce(m.col, h.label) AS label FROM hyp h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, row ORDER BY value DESC, col) AS n FROM {s_co('hyp', 'ref')}) WHERE n = 1 AND value > 0) m ON h.uri = m.uri AND h.label = m.row")
def _(spark, d):
    return tg.by_mapping(R(spark, d), H(spark, d), mp.argmax_mapper)


@query("j_hungarian_tagger")
def _(spark, d):
    return tg.by_mapping(R(spark, d), H(spark, d))


# --- K: metrics ----------------------------------------------------------------------------------

ALL = "GROUP BY ROLLUP (uri)"
U_ALL = "coalesce(uri, '/all') AS uri"


@query("k_detection_error", f"{s_labels('ref', 'hyp')}, per AS (SELECT uri, e - s AS d, count(*) FILTER (r > 0) AS nr, count(*) FILTER (h > 0) AS nh FROM cnt GROUP BY uri, s, e), p AS (SELECT {U_ALL}, sum(d * greatest(0, nr - nh)) AS miss, sum(d * greatest(0, nh - nr)) AS false_alarm, sum(d * nr) AS total FROM per {ALL}) SELECT *, CASE WHEN total <> 0 THEN (miss + false_alarm) / total WHEN miss + false_alarm = 0 THEN 0.0 ELSE 1.0 END AS rate FROM p")
def _(spark, d):
    return me.detection(R(spark, d), H(spark, d))


def s_ident(r: str, h: str) -> str:
    return f"{s_labels(r, h)}, per AS (SELECT uri, e - s AS d, sum(least(r, h)) AS c, sum(r) AS nr, sum(h) AS nh FROM cnt GROUP BY uri, s, e), p AS (SELECT {U_ALL}, sum(d * c) AS correct, sum(d * (least(nr, nh) - c)) AS confusion, sum(d * greatest(0, nr - nh)) AS miss, sum(d * greatest(0, nh - nr)) AS false_alarm, sum(d * nr) AS total, sum(d * nh) AS retrieved FROM per {ALL})"


@query("k_identification_error", f"{s_ident('ref', 'hyp')} SELECT *, CASE WHEN total <> 0 THEN (confusion + miss + false_alarm) / total WHEN confusion + miss + false_alarm = 0 THEN 0.0 ELSE 1.0 END AS rate FROM p")
def _(spark, d):
    return me.identification(R(spark, d), H(spark, d))


@query("k_identification_quality", f"{s_ident('(SELECT * FROM ref WHERE label <> ' + chr(39) + 'error' + chr(39) + ')', 'hyp')}, q AS (SELECT uri, correct, retrieved, total AS relevant, CASE WHEN retrieved <> 0 THEN correct / retrieved WHEN correct = 0 THEN 1.0 END AS precision, CASE WHEN total <> 0 THEN correct / total WHEN correct = 0 THEN 1.0 END AS recall FROM p) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f_measure FROM q")
def _(spark, d):
    return me.identification_quality(v.ann_unk(spark, d), H(spark, d))


@query("k_diarization_error")
def _(spark, d):
    return me.diarization(R(spark, d), H(spark, d))


def s_purity(r: str, h: str) -> str:
    return f"p AS (SELECT {U_ALL}, sum(best) AS correct, sum(dur) AS total FROM (SELECT uri, row AS label, max(value) AS best FROM {s_co(h, r)} GROUP BY 1, 2) JOIN (SELECT uri, label, sum(e - s) AS dur FROM {s_islands(h, 'uri, label')} GROUP BY 1, 2) USING (uri, label) {ALL}) SELECT *, correct / total AS rate FROM p"


@query("k_purity", s_purity("ref", "hyp"))
def _(spark, d):
    return me.purity(R(spark, d), H(spark, d))


@query("k_coverage", s_purity("hyp", "ref"))
def _(spark, d):
    return me.coverage(R(spark, d), H(spark, d))


def s_homogeneity(r: str, h: str) -> str:
    return f"k AS (SELECT * FROM {s_co(r, h)}), t AS (SELECT uri, sum(value) AS t FROM k GROUP BY 1), en AS (SELECT uri, -sum(p / t * ln(p / t)) AS entropy FROM (SELECT uri, row, sum(value) AS p FROM k GROUP BY 1, 2) JOIN t USING (uri) WHERE p > 0 GROUP BY 1), ce AS (SELECT uri, -sum(value / t * ln(value / h)) AS cross_entropy FROM (SELECT *, sum(value) OVER (PARTITION BY uri, col) AS h FROM k) JOIN t USING (uri) WHERE value > 0 GROUP BY 1) SELECT *, CASE WHEN entropy <> 0 THEN 1 - cross_entropy / entropy WHEN cross_entropy = 0 THEN 1.0 ELSE 0.0 END AS rate FROM en JOIN ce USING (uri)"


@query("k_homogeneity", s_homogeneity("ref", "hyp"))
def _(spark, d):
    return me.homogeneity(R(spark, d), H(spark, d))


@query("k_completeness", s_homogeneity("hyp", "ref"))
def _(spark, d):
    return me.completeness(R(spark, d), H(spark, d))


def s_segcov(r: str, h: str) -> str:
    return f"p AS (SELECT {U_ALL}, sum(best) AS correct, sum(d) AS total FROM (SELECT a.uri, a.e - a.s AS d, max(least(a.e, b.e) - greatest(a.s, b.s)) AS best FROM (SELECT DISTINCT uri, s, e FROM {r} WHERE e > s) a JOIN (SELECT DISTINCT uri, s, e FROM {h} WHERE e > s) b ON a.uri = b.uri AND {OVL} GROUP BY a.uri, a.s, a.e) {ALL}) SELECT *, correct / total AS rate FROM p"


@query("k_segmentation_coverage", s_segcov("turns", "tjoin"))
def _(spark, d):
    return me.segmentation_coverage(T(spark, d), TH(spark, d))


@query("k_segmentation_purity", s_segcov("tjoin", "turns"))
def _(spark, d):
    return me.segmentation_purity(T(spark, d), TH(spark, d))


def s_probes(value: str) -> str:
    first = lambda src, t: f"(SELECT min(n) FROM {src} x WHERE x.uri = p.uri AND {t} BETWEEN x.s AND x.e)"
    return f"""rr AS (SELECT uri, s, e, row_number() OVER (PARTITION BY uri ORDER BY s, e) - 1 AS n FROM (SELECT DISTINCT uri, s, e FROM turns WHERE e > s)),
    hh AS (SELECT uri, s, e, row_number() OVER (PARTITION BY uri ORDER BY s, e) - 1 AS n FROM (SELECT DISTINCT uri, s, e FROM tjoin WHERE e > s)),
    kk AS (SELECT uri, dur / n / 2 AS k FROM (SELECT uri, sum(e - s) AS dur FROM {s_islands('hh')} GROUP BY 1) JOIN (SELECT uri, count(*) AS n FROM hh GROUP BY 1) USING (uri)),
    p AS (SELECT uri, k, s + unnest(range(0, ceil(e - k - s)::BIGINT)) AS i FROM (SELECT uri, min(s) AS s, max(e) AS e FROM rr GROUP BY 1) JOIN kk USING (uri) WHERE s < e - k),
    x AS (SELECT uri, {first('rr', 'p.i')} AS r0, {first('rr', 'p.i + p.k')} AS r1, {first('hh', 'p.i')} AS h0, {first('hh', 'p.i + p.k')} AS h1 FROM p)
    SELECT uri, avg(({value})::INT::DOUBLE) AS rate FROM x GROUP BY 1"""


@query("k_pk", s_probes("(r0 IS NOT DISTINCT FROM r1) = (h0 IS NOT DISTINCT FROM h1)"))
def _(spark, d):
    return me.pk(T(spark, d), TH(spark, d))


@query("k_windowdiff", s_probes("coalesce(r1, -1) - coalesce(r0, -1) = coalesce(h1, -1) - coalesce(h0, -1)"))
def _(spark, d):
    return me.windowdiff(T(spark, d), TH(spark, d))


@query("k_global_error")
def _(spark, d):
    return me.global_error(R(spark, d), H(spark, d), tl.timeline(U(spark, d)))


@query("k_mapping_accuracy")
def _(spark, d):
    r, h = R(spark, d), H(spark, d)
    return mp.accuracy(mp.complete(mp.hungarian_mapper(r, h), r, h), mp.expected(r, h))


@query("k_cluster_agreement")
def _(spark, d):
    rows = R(spark, d).select("uri", "track", F.col("label").alias("expected")).join(H(spark, d).select("uri", "track", F.col("label").alias("found")), ["uri", "track"])
    out = mp.cluster_agreement(rows)
    return out.select("uri", *[F.round(c, 8).alias(c) for c in out.columns if c != "uri"])


# --- S: error analysis ---------------------------------------------------------------------------


@query("s_diff_durations", f"{s_labels('ref', 'hyp')}, per AS (SELECT uri, e - s AS d, sum(least(r, h)) AS c, sum(r) AS nr, sum(h) AS nh FROM cnt GROUP BY uri, s, e), x AS (SELECT uri, 'correct' AS kind, sum(d * c) AS duration FROM per GROUP BY 1 UNION ALL SELECT uri, 'confusion', sum(d * (least(nr, nh) - c)) FROM per GROUP BY 1 UNION ALL SELECT uri, 'miss', sum(d * greatest(0, nr - nh)) FROM per GROUP BY 1 UNION ALL SELECT uri, 'false alarm', sum(d * greatest(0, nh - nr)) FROM per GROUP BY 1) SELECT uri, kind, duration FROM x WHERE duration > 0")
def _(spark, d):
    return er.diff_durations(R(spark, d), H(spark, d))


@query("s_regression")
def _(spark, d):
    r = R(spark, d)
    return er.regression(r, H(spark, d), an.crop(r, U(spark, d), "loose"))


@query("s_segmentation_errors")
def _(spark, d):
    return er.segmentation_errors(T(spark, d), TH(spark, d))


# --- the flagship --------------------------------------------------------------------------------


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and identification error of the disturbed annotation, by user and in total."""
    r, h = R(spark, sf_dir), H(spark, sf_dir)
    det = me.detection(r, h).select("uri", F.col("rate").alias("detection"))
    return det.join(me.identification(r, h).select("uri", F.col("rate").alias("identification")), "uri")


Q["flagship_error_rates"] = error_rates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from spanloom.plans import checked, extra, more, solved

    return {**Q, **more.Q, **extra.Q, **checked.Q, **solved.Q}


def oracle_sql() -> dict[str, str]:
    from spanloom.plans import checked, extra, more, solved

    return {**SQL, **more.SQL, **extra.SQL, **checked.SQL, **solved.SQL}

