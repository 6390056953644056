"""Queries for the rest of the operators: equality, edits, look-ups, matrices, mappings, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.segment import Seg, SlidingWindow
from spanloom.operators import annotation as an
from spanloom.operators import clustering as cl
from spanloom.operators import feature as fe
from spanloom.operators import graph as gr
from spanloom.operators import mapping as mp
from spanloom.operators import matrix as mx
from spanloom.operators import scores as sc
from spanloom.operators import tagging as tg
from spanloom.operators import timeline as tl
from spanloom.plans import views as v
from spanloom.plans.queries import BASE, OVL, s_co, s_islands, se
from spanloom.sources import text as tx

Q: dict = {}
SQL: dict[str, str] = {}
R, H, U, S, T = v.ann_ref, v.ann_hyp, v.uem, v.scores, v.turns


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = f"WITH {BASE} {sql}" if sql.lstrip().startswith("SELECT") else f"WITH {BASE}, {sql}"
        return f

    return add


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- A, B ----------------------------------------------------------------------------------------


def s_clock(t: str) -> str:
    ms = f"floor({t} * 1000 + 0.5)::BIGINT"
    return f"CASE WHEN {ms} >= 86400000 THEN printf('%d:', {ms} // 86400000) ELSE '' END || printf('%02d:%02d:%02d.%03d', {ms} // 3600000 % 24, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("a_segment_pretty", f"SELECT track, '[' || {s_clock('s')} || ' --> ' || {s_clock('e')} || ']' AS pretty FROM ref")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R(spark, d).select("track", Seg.of().pretty().alias("pretty"))


@query("a_segment_json", """SELECT track, json_extract(j, '$.start')::DOUBLE AS json_start, json_extract(j, '$.end')::DOUBLE AS json_end FROM (SELECT track, json_object('start', s, 'end', e) AS j FROM ref)""")
def _(spark, d):
    back = F.from_json("j", "start double, end double")
    return R(spark, d).select("track", Seg.of().json().alias("j")).select("track", back["start"].alias("json_start"), back["end"].alias("json_end"))


@query("b_window_lengths", "SELECT d AS duration, ceil(86400.0 / d)::BIGINT AS n FROM (VALUES (600.0::DOUBLE), (7000.0), (86400.0), (90000.0)) AS t(d)")
def _(spark, d):
    return spark.createDataFrame([(x, len(SlidingWindow(x, x, 0.0, 86_400.0))) for x in (600.0, 7000.0, 86_400.0, 90_000.0)], "duration double, n long")


@query("b_window_of_frames", 'SELECT i::BIGINT AS i, (i * 160 - 256) / 16000.0::DOUBLE AS "start", (i * 160 + 256) / 16000.0::DOUBLE AS "end" FROM range(0, 50) AS r(i)')
def _(spark, d):
    pos = SlidingWindow.of_frames(512, 160, 16_000.0).position(F.col("id"))
    return spark.range(50).select(F.col("id").alias("i"), pos.start.alias("start"), pos.end.alias("end"))


# --- C -------------------------------------------------------------------------------------------


@query("c_add", f"SELECT uri, {se()} FROM (SELECT uri, s, e FROM ref UNION SELECT DISTINCT uri, 0.0, 60.0 FROM ref)")
def _(spark, d):
    r = tl.timeline(R(spark, d))
    return tl.union(r, tl.one_segment(r, 0.0, 60.0))


@query("c_equal", "SELECT * FROM (VALUES ('same', true), ('shifted', false)) AS t(pair, equal)")
def _(spark, d):
    r, h = tl.timeline(R(spark, d)), tl.timeline(H(spark, d))
    return tl.equal(r, r).withColumn("pair", F.lit("same")).unionByName(tl.equal(r, h).withColumn("pair", F.lit("shifted")))


@query("c_index", "SELECT uri, rank FROM (SELECT uri, s, e, row_number() OVER (PARTITION BY uri ORDER BY s, e) - 1 AS rank, min(i) OVER (PARTITION BY uri, s, e) AS i FROM (SELECT uri, s, e, min(i) AS i FROM ref GROUP BY ALL)) WHERE s = (SELECT min(s) FROM ref) AND e = (SELECT min(e) FROM ref WHERE s = (SELECT min(s) FROM ref))")
def _(spark, d):
    r = tl.timeline(R(spark, d))
    start, end = r.agg(F.min(F.struct("start", "end")).alias("x")).select("x.*").first()
    return _long(tl.index_of(r, start, end), "rank")


@query("c_crop_segment", f'SELECT DISTINCT uri, greatest(s, 864000.0) AS "start", least(e, 950400.0) AS "end" FROM ref WHERE greatest(s, 864000.0) < least(e, 950400.0) - 1e-6')
def _(spark, d):
    r = tl.timeline(R(spark, d))
    return tl.crop(r, tl.one_segment(r, 864_000.0, 950_400.0))


@query("c_crop_binned", f'SELECT DISTINCT a.uri, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL}')
def _(spark, d):
    return tl.crop(tl.timeline(R(spark, d)), U(spark, d), bins=v.DAY)


@query("c_crop_origins", f'SELECT a.uri, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end", a.s AS origin_start, a.e AS origin_end FROM (SELECT DISTINCT uri, s, e FROM ref) a JOIN uem b ON a.uri = b.uri AND {OVL}')
def _(spark, d):
    rows = tl.crop_mapping(tl.timeline(R(spark, d)), U(spark, d)).select("uri", "start", "end", F.explode("origin").alias("o"))
    return rows.select("uri", "start", "end", F.col("o.start").alias("origin_start"), F.col("o.end").alias("origin_end"))


@query("c_mapped", 'SELECT DISTINCT uri, s + 10 AS "start", e - 600 AS "end" FROM ref WHERE e - 600 - s - 10 > 1e-6')
def _(spark, d):
    return tl.mapped(R(spark, d), F.col("start") + 10, F.col("end") - 600)


@query("c_empty", f"SELECT count(*) AS n, false AS filled FROM (SELECT * FROM ref LIMIT 0)")
def _(spark, d):
    return tl.empty(R(spark, d)).agg(F.count(F.lit(1)).alias("n")).withColumn("filled", F.col("n") > 0)


@query("c_json", f"SELECT DISTINCT uri, {se()} FROM ref")
def _(spark, d):
    rows = tl.to_json(R(spark, d)).select("uri", F.explode(F.from_json("json", "array<struct<start:double,end:double>>")).alias("s"))
    return rows.select("uri", "s.start", "s.end")


@query("c_describe", f'SELECT uri, n, "start", "end", duration FROM (SELECT uri, count(DISTINCT (s, e)) AS n, min(s) AS "start", max(e) AS "end" FROM ref GROUP BY 1) JOIN (SELECT uri, sum(e - s) AS duration FROM {s_islands("ref")} GROUP BY 1) USING (uri)')
def _(spark, d):
    return tl.describe(R(spark, d))


# --- D -------------------------------------------------------------------------------------------

FIRST_DAY = "e <= 86400"


@query("d_upsert", f"SELECT uri, {se()}, track, CASE WHEN i % 4 = 0 THEN 'changed' ELSE label END AS label FROM ref")
def _(spark, d):
    r = R(spark, d)
    return an.upsert(r, r.where(F.col("track").cast("long") % 4 == 0).withColumn("label", F.lit("changed")))


@query("d_delete_tracks", f"SELECT uri, {se()}, track, label FROM ref WHERE i % 4 <> 0")
def _(spark, d):
    r = R(spark, d)
    return an.delete(r, r.where(F.col("track").cast("long") % 4 == 0).select(*an.KEY))


@query("d_delete_segments", f"SELECT uri, {se()}, track, label FROM ref WHERE (uri, s, e) NOT IN (SELECT (uri, s, e) FROM ref WHERE label = 'view')")
def _(spark, d):
    r = R(spark, d)
    return an.delete(r, an.label_timeline(r, "view"))


@query("d_from_rows", f"SELECT uri, {se()}, 'x' AS track, max(label) AS label FROM ref GROUP BY uri, s, e")
def _(spark, d):
    return an.annotation(R(spark, d).withColumn("track", F.lit("x")))


@query("d_equal", "SELECT * FROM (VALUES ('same', true), ('relabelled', false)) AS t(pair, equal)")
def _(spark, d):
    r = R(spark, d)
    other = an.translate_by(r, lambda x: F.concat(x, F.lit("!")))
    return tl.equal(r, an.scan(r)).withColumn("pair", F.lit("same")).unionByName(tl.equal(r, other).withColumn("pair", F.lit("relabelled")))


@query("d_contains", "SELECT uri, bool_and(i % 11 <> 0) AS contained FROM ref GROUP BY 1")
def _(spark, d):
    r = R(spark, d)
    return tl.covers(an.segments(r.where(F.col("track").cast("long") % 11 != 0)), an.segments(r))


@query("d_crop_loose", f"SELECT a.uri, {se('a.')}, a.track, a.label FROM ref a WHERE EXISTS (SELECT 1 FROM uem b WHERE a.uri = b.uri AND {OVL})")
def _(spark, d):
    return an.crop(R(spark, d), U(spark, d), "loose")


@query("d_tracks_of", "x AS (SELECT s, e FROM ref ORDER BY i LIMIT 1) SELECT uri, list_sort(list(DISTINCT track)) AS tracks FROM ref JOIN x USING (s, e) GROUP BY 1")
def _(spark, d):
    r = R(spark, d)
    at = r.agg(F.min_by(F.struct("start", "end"), F.col("track").cast("long")).alias("x")).select("x.*").first()
    return an.tracks_of(r, at[0], at[1])


@query("d_has_track", "x AS (SELECT s, e, track FROM ref ORDER BY i LIMIT 1) SELECT uri, bool_or(r.s = x.s AND r.e = x.e AND r.track = x.track) AS has_track FROM ref r, x GROUP BY 1")
def _(spark, d):
    r = R(spark, d)
    at = r.agg(F.min_by(F.struct("start", "end", "track"), F.col("track").cast("long")).alias("x")).select("x.*").first()
    return an.has_track(r, at[0], at[1], at[2])


@query("d_track_by_name", f"SELECT uri, {se()}, track, label FROM ref WHERE track = '12'")
def _(spark, d):
    return an.track_by_name(R(spark, d), "12")


@query("d_new_track", f"SELECT a.uri, greatest(a.s, b.s) AS \"start\", least(a.e, b.e) AS \"end\", count(*) AS tracks FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL} GROUP BY 1, 2, 3")
def _(spark, d):
    rows = an.crop(R(spark, d).withColumn("track", F.lit("same")), U(spark, d), prefix="T")
    return rows.groupBy("uri", "start", "end").agg(F.count_distinct("track").alias("tracks"))


@query("d_labels_of", f"SELECT uri, {se()}, list_sort(list(DISTINCT label)) AS labels FROM ref GROUP BY uri, s, e")
def _(spark, d):
    return an.labels_of(R(spark, d))


@query("d_label_timeline", f"SELECT DISTINCT uri, {se()} FROM ref WHERE label = 'purchase'")
def _(spark, d):
    return an.label_timeline(R(spark, d), "purchase")


@query("d_label_duration", f"SELECT uri, label, sum(e - s) AS duration FROM {s_islands('ref', 'uri, label')} GROUP BY 1, 2")
def _(spark, d):
    return an.label_durations(R(spark, d))


@query("d_known_labels", "SELECT DISTINCT uri, label FROM ref WHERE label <> 'error'")
def _(spark, d):
    return an.labels(v.ann_unk(spark, d), unknown=False)


@query("d_json_tracks", f"SELECT uri, {se()}, track, label FROM ref")
def _(spark, d):
    one = "array<struct<segment:struct<start:double,end:double>,track:string,label:string>>"
    rows = an.to_json(R(spark, d), "web").select(F.explode(F.from_json("json", f"tracks {one}")["tracks"]).alias("t"), F.from_json("json", "uri string")["uri"].alias("uri"))
    return rows.select("uri", "t.segment.start", "t.segment.end", "t.track", "t.label")


@query("d_co_iter", f"SELECT a.uri, a.label AS a_label, b.label AS b_label, count(*) AS n FROM ref a JOIN hyp b ON a.uri = b.uri AND {OVL} GROUP BY ALL")
def _(spark, d):
    return an.co_iter(R(spark, d), H(spark, d), bins=7 * v.DAY).groupBy("uri", "a_label", "b_label").agg(F.count(F.lit(1)).alias("n"))


# --- E -------------------------------------------------------------------------------------------


@query("e_mean_of_repeats", f"SELECT uri, {se()}, track, label, avg(score) AS score FROM (SELECT * FROM sco UNION ALL SELECT uri, s, e, track, i, label, 0.5 FROM sco WHERE i % 3 = 0) GROUP BY ALL")
def _(spark, d):
    s = S(spark, d)
    again = s.where(F.col("track").cast("long") % 3 == 0).withColumn("score", F.lit(0.5))
    odd = s.limit(5).withColumn("score", F.lit(float("nan")))
    return sc.scores(s.unionByName(again).unionByName(odd))


@query("e_wide_and_back", f"SELECT uri, {se()}, track, label, score FROM sco")
def _(spark, d):
    names = list(v.EVENT_TYPES)
    return sc.from_wide(sc.to_wide(S(spark, d), names), names).select("uri", "start", "end", "track", "label", "score")


@query("e_track_scores", f"SELECT uri, {se()}, track, max(score) FILTER (label = 'click') AS click, count(*) AS n FROM sco GROUP BY ALL")
def _(spark, d):
    return sc.track_scores(S(spark, d)).select("uri", "start", "end", "track", F.col("scores")["click"].alias("click"), F.size("scores").cast("long").alias("n"))


@query("e_rank_inverted", f"SELECT uri, {se()}, track, label, score, row_number() OVER (PARTITION BY uri, track ORDER BY score, label) - 1 AS rank FROM sco")
def _(spark, d):
    return _long(sc.rank(S(spark, d), invert=True), "rank")


@query("e_subset", f"SELECT uri, {se()}, track, label, score FROM sco WHERE label IN ('click', 'view')")
def _(spark, d):
    return sc.subset(S(spark, d), ["click", "view"])


@query("e_mapped", f"SELECT uri, {se()}, track, label, 2 * score + 1 AS score FROM sco")
def _(spark, d):
    return sc.mapped(S(spark, d), lambda x: 2 * x + 1)


@query("e_apply", f"SELECT uri, {se()}, track, label, score - (SELECT max(score) FROM sco t WHERE t.uri = sco.uri) AS score FROM sco")
def _(spark, d):
    return sc.apply_matrix(S(spark, d), lambda pdf: pdf.assign(score=pdf["score"] - pdf["score"].max()))


@query("e_posterior", f"SELECT uri, {se()}, track, low AS is_unknown, CASE WHEN low THEN '?' ELSE label END AS label FROM (SELECT *, score < 1 - sum(score) OVER (PARTITION BY uri, track) AS low, row_number() OVER (PARTITION BY uri, track ORDER BY score DESC, label) AS n FROM (SELECT uri, s, e, track, label, score / 4 AS score FROM sco)) WHERE n = 1")
def _(spark, d):
    out = sc.to_annotation(sc.mapped(S(spark, d), lambda x: x / 4), posterior=True)
    return out.withColumn("label", F.when(F.col("is_unknown"), F.lit("?")).otherwise(F.col("label")))


# --- F, G ----------------------------------------------------------------------------------------


def _co(spark, d):
    return mx.cooccurrence(R(spark, d), H(spark, d))


CO = s_co("ref", "hyp")


@query("f_shape", f"SELECT uri, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols FROM {CO} GROUP BY 1")
def _(spark, d):
    return mx.shape(_co(spark, d))


@query("f_values", f"SELECT uri, row, col, value FROM {CO} WHERE value > 0")
def _(spark, d):
    return mx.values(_co(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value"))))


@query("f_argmin", f"SELECT uri, row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY uri, col ORDER BY value, row) AS n FROM {CO}) WHERE n = 1")
def _(spark, d):
    return mx.argmin(_co(spark, d), 0)


@query("f_argmax_cell", f"SELECT uri, row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY value DESC, row, col) AS n FROM {CO}) WHERE n = 1")
def _(spark, d):
    return mx.argmax(_co(spark, d))


@query("f_negative", f"SELECT uri, row, col, -value AS value FROM {CO}")
def _(spark, d):
    return mx.negative(_co(spark, d))


@query("f_transpose", f"SELECT uri, col AS row, row AS col, value FROM {CO}")
def _(spark, d):
    return mx.transpose(_co(spark, d))


@query("f_subset", f"SELECT uri, row, col, value FROM {CO} WHERE row IN ('click', 'view') AND col = 'view'")
def _(spark, d):
    return mx.subset(_co(spark, d), ["click", "view"], ["view"])


@query("f_without", f"SELECT uri, row, col, value FROM {CO} WHERE row <> 'click' AND col <> 'view'")
def _(spark, d):
    return mx.without(_co(spark, d), "click", "view")


@query("f_above", f"SELECT uri, row, col, value > 3600 AS value FROM {CO}")
def _(spark, d):
    return mx.above(_co(spark, d), 3600.0)


@query("f_tfidf_plain", f"SELECT uri, row, col, value / greatest(1e-6, sum(value) OVER (PARTITION BY uri, col)) AS value FROM {CO}")
def _(spark, d):
    return mx.tfidf(R(spark, d), H(spark, d), idf=False)


ARG = f"(SELECT uri, row AS l, col AS r FROM (SELECT *, row_number() OVER (PARTITION BY uri, row ORDER BY value DESC, col) AS n FROM {CO}) WHERE n = 1 AND value > 0)"


def _arg(spark, d):
    return mp.argmax_mapper(R(spark, d), H(spark, d))


@query("g_repeated", f'SELECT uri, r AS "right", count(*) AS n FROM {ARG} GROUP BY 1, 2 HAVING count(*) > 1')
def _(spark, d):
    return mp.repeated(_arg(spark, d), "right")


@query("g_complete", f'm AS (SELECT * FROM {ARG}) SELECT uri, l AS "left", r AS "right" FROM m UNION ALL SELECT DISTINCT uri, label, NULL FROM ref WHERE (uri, label) NOT IN (SELECT (uri, l) FROM m) UNION ALL SELECT DISTINCT uri, NULL, label FROM hyp WHERE (uri, label) NOT IN (SELECT (uri, r) FROM m)')
def _(spark, d):
    return mp.complete(_arg(spark, d), R(spark, d), H(spark, d))


@query("g_to_dict", f"SELECT uri, count(*) AS n, max(r) FILTER (l = 'click') AS click FROM {ARG} GROUP BY 1")
def _(spark, d):
    return mp.to_dict(_arg(spark, d)).select("uri", F.size("mapping").cast("long").alias("n"), F.col("mapping")["click"].alias("click"))


@query("g_partition", f"m AS (SELECT *, dense_rank() OVER (PARTITION BY uri ORDER BY l, r) AS c FROM {ARG}) SELECT uri, 'left' AS side, l AS label, c AS cluster FROM m UNION ALL SELECT uri, 'right', r, c FROM m")
def _(spark, d):
    return _long(mp.partition(_arg(spark, d)), "cluster")


@query("g_within_blocks", f"""b AS (SELECT DISTINCT uri, label, CASE WHEN label < 'p' THEN 'x' ELSE 'y' END AS k FROM (SELECT uri, label FROM ref UNION ALL SELECT uri, label FROM hyp)),
  c AS (SELECT c.* FROM {CO} c JOIN b x ON x.uri = c.uri AND x.label = c.row JOIN b y ON y.uri = c.uri AND y.label = c.col WHERE x.k = y.k)
  SELECT uri, row AS "left", col AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY uri, row ORDER BY value DESC, col) AS n FROM c) WHERE n = 1 AND value > 0""")
def _(spark, d):
    r, h = R(spark, d), H(spark, d)
    names = r.select("uri", "label").unionByName(h.select("uri", "label")).distinct().withColumn("block", F.when(F.col("label") < "p", "x").otherwise("y"))
    init = names.withColumn("side", F.lit("left")).unionByName(names.withColumn("side", F.lit("right")))
    return mp.within_blocks(r, h, init, mp.argmax_mapper)


# --- H, J ----------------------------------------------------------------------------------------


@query("h_segments", 'SELECT vec_id AS frame, vec_id::DOUBLE AS "start", vec_id + 1.5::DOUBLE AS "end" FROM embeddings')
def _(spark, d):
    return fe.segments(v.frames(spark, d), SlidingWindow(1.5, 1.0)).select("frame", "start", "end")


@query("h_on_timeline", "t AS (SELECT s, e, row_number() OVER (ORDER BY s, e) - 1 AS frame FROM (SELECT DISTINCT s, e FROM turns WHERE uri = (SELECT min(uri) FROM turns) AND e > s)) SELECT vec_id AS frame, label::VARCHAR AS label, s AS \"start\", e AS \"end\" FROM embeddings JOIN t ON vec_id = frame")
def _(spark, d):
    t = T(spark, d)
    one = t.agg(F.min("uri")).first()[0]
    frame = tl.timeline(t.where(F.col("uri") == one)).withColumn("uri", F.lit("emb"))
    return fe.on_timeline(v.frames(spark, d), frame).select("frame", "label", "start", "end")


@query("h_violations", "SELECT vec_id AS frame FROM embeddings WHERE vec_id % 50 < 2")
def _(spark, d):
    odd = F.when(F.col("frame") % 50 == 0, F.slice("vec", 1, 3)).when(F.col("frame") % 50 == 1, F.transform("vec", lambda x: x * float("nan"))).otherwise(F.col("vec"))
    return fe.violations(v.frames(spark, d).withColumn("vec", odd)).select("frame")


# --- L: formats ----------------------------------------------------------------------------------


def _round_trip(df: DataFrame, name: str) -> DataFrame:
    fmt = tx.FORMATS[name]
    return tx.parse(tx.lines(df, fmt), fmt)


@query("l_ann_round_trip", f"SELECT uri, {se()}, track, label, 'speaker' AS modality FROM ref")
def _(spark, d):
    return _round_trip(R(spark, d), "ann").select("uri", "start", "end", "track", "label", "modality")


@query("l_seg_round_trip", """SELECT uri, label, CASE WHEN f = 0 THEN 0.0 ELSE (f - 0.5) * 0.01 + 0.015 END::DOUBLE AS "start", ((f - 0.5) * 0.01 + 0.015 + n * 0.01)::DOUBLE AS "end" FROM
  (SELECT uri, label, f, g - f AS n FROM (SELECT uri, label, greatest(0, round_even((s - 0.015) / 0.01, 0))::BIGINT AS f, round_even((e - 0.015) / 0.01, 0)::BIGINT AS g FROM turns WHERE e > s))""")
def _(spark, d):
    return _round_trip(T(spark, d).where(Seg.of().filled()), "seg").select("uri", "label", "start", "end")


@query("l_repere_round_trip", f"SELECT uri, {se()}, label, 'head' AS modality FROM ref")
def _(spark, d):
    return _round_trip(R(spark, d).withColumn("modality", F.lit("head")), "repere").select("uri", "start", "end", "label", "modality")


@query("l_repere_scores_round_trip", f"SELECT uri, {se()}, label, score FROM sco")
def _(spark, d):
    return _round_trip(S(spark, d), "repere_scores").select("uri", "start", "end", "label", "score")


@query("l_ref_round_trip", f"SELECT uri, {se()}, (row_number() OVER (PARTITION BY uri ORDER BY s, e, label) - 1)::VARCHAR AS track, label FROM ref")
def _(spark, d):
    return _round_trip(R(spark, d), "ref").select("uri", "start", "end", "track", "label")


@query("l_tvm_round_trip", f"SELECT uri, {se()}, track, label, score, 'head' AS modality FROM sco")
def _(spark, d):
    return _round_trip(S(spark, d), "tvm").select("uri", "start", "end", "track", "label", "score", "modality")


@query("l_tvt_round_trip", f"SELECT uri, row, col, value FROM {CO}")
def _(spark, d):
    m = _co(spark, d).withColumns({"start": F.lit(0.0), "end": F.lit(1.0)})
    return tx.matrix_of(_round_trip(m, "tvt"))


@query("l_lst", "SELECT DISTINCT label AS value FROM ref")
def _(spark, d):
    names = R(spark, d).select(F.col("label").alias("value")).distinct()
    blank = spark.createDataFrame([("  ",)], "value string")
    return tx.parse(names.select(F.concat(F.lit(" "), "value").alias("value")).unionByName(blank), tx.FORMATS["lst"])


@query("l_idx_frame_times", "t AS (SELECT i AS frame, max(CASE WHEN i % 7 = 3 THEN i - 2 ELSE i END * 0.04) OVER (ORDER BY i) AS t FROM range(0, 200) AS r(i)), m AS (SELECT median(x) AS m FROM (SELECT lead(t) OVER (ORDER BY frame) - t AS x FROM t)) SELECT frame, round(t - m / 2, 9) AS \"start\", round(t + m / 2, 9) AS \"end\" FROM t, m")
def _(spark, d):
    i = F.col("id")
    at = F.when(i % 7 == 3, i - 2).otherwise(i) * 0.04
    lines = spark.range(200).select(F.concat_ws(" ", i.cast("string"), F.lit("I"), (i * 100).cast("string"), at.cast("string")).alias("value"))
    out = tx.frame_times(tx.parse(lines, tx.FORMATS["idx"]))
    return out.select("frame", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query("l_custom_columns", f"SELECT uri, {se()}, label FROM ref")
def _(spark, d):
    fmt = tx.custom({"label": 0, "uri": 1, "start": 2, "end": 3}, split=";")
    lines = R(spark, d).select(F.concat_ws(";", "label", "uri", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    return tx.parse(lines, fmt).select("uri", "start", "end", "label")


@query("l_select_one", f"SELECT uri, {se()}, label FROM ref WHERE uri = (SELECT min(uri) FROM ref)")
def _(spark, d):
    r = R(spark, d).withColumn("modality", F.lit("web"))
    one = r.agg(F.min("uri")).first()[0]
    return tx.select_one(r, one, "web").select("uri", "start", "end", "label")


@query("l_pronounced", "SELECT DISTINCT uri, label AS name FROM ref WHERE label <> 'error'")
def _(spark, d):
    text = F.when(F.col("label") == "error", F.lit("nobody")).otherwise(F.concat(F.lit("so <pers="), "label", F.lit("> said")))
    return R(spark, d).select("uri", F.explode(tx.pronounced(text)).alias("name")).distinct()


# --- O, P: constraints and edges -----------------------------------------------------------------


@query("c_pairwise", f'SELECT * FROM (SELECT uri, {se()}, lead(s) OVER w AS next_start, lead(e) OVER w AS next_end FROM (SELECT DISTINCT uri, s, e FROM ref) WINDOW w AS (PARTITION BY uri ORDER BY s, e)) WHERE next_start IS NOT NULL')
def _(spark, d):
    return tl.pairwise(R(spark, d))


@query("o_apart", f"SELECT uri, row, col FROM {s_co('ref', 'ref')} WHERE row <> col AND value > 3600")
def _(spark, d):
    return cl.apart(R(spark, d), 3600.0)


@query("o_not_contiguous", """n AS (SELECT DISTINCT uri, label FROM ref) SELECT a.uri, a.label AS row, b.label AS col FROM n a JOIN n b ON a.uri = b.uri AND a.label <> b.label
  WHERE NOT EXISTS (SELECT 1 FROM ref x JOIN ref y ON x.uri = y.uri WHERE x.uri = a.uri AND x.label = a.label AND y.label = b.label AND greatest(x.s, y.s) - least(x.e, y.e) <= 600)""")
def _(spark, d):
    return cl.not_contiguous(R(spark, d), 600.0)


GRID = "SELECT DISTINCT uri, label, track, unnest(range(floor(s / 1800)::BIGINT, ceil(e / 1800)::BIGINT)) AS t FROM"


@query("p_lag_edges", f"""x AS ({GRID} ref), y AS ({GRID} hyp), m AS (SELECT l.lag, avg((x.label = y.label)::INT) AS p FROM (SELECT DISTINCT uri, label, t FROM x) x, range(-4, 5) AS l(lag), (SELECT DISTINCT uri, label, t FROM y) y WHERE x.uri = y.uri AND x.t + l.lag = y.t GROUP BY 1)
  SELECT x.uri, x.track AS a_track, y.track AS b_track, max(p) AS probability FROM x, m, y WHERE m.lag >= 0 AND x.uri = y.uri AND x.t + m.lag = y.t GROUP BY 1, 2, 3""")
def _(spark, d):
    r, h = R(spark, d), H(spark, d)
    return gr.lag_edges(r, h, gr.lag_fit(r, h, 7200.0, 1800.0), 7200.0, 1800.0, future=True)


@query("g_louvain_mapper")
def _(spark, d):
    return mp.louvain_mapper(R(spark, d), H(spark, d))
