"""More queries: features, formats, statistics, calibration, clustering, graphs, programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.segment import SlidingWindow
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import feature as fe
from spanloom.operators import graph as gr
from spanloom.operators import matrix as mx
from spanloom.operators import timeline as tl
from spanloom.plans import programs as pr
from spanloom.plans import views as v
from spanloom.plans.queries import BASE, OVL, s_cells, s_co, s_gaps, s_islands, s_labels, se
from spanloom.sources import text as tx

Q: dict = {}
SQL: dict[str, str] = {}
R, H, U = v.ann_ref, v.ann_hyp, v.uem
FRAME = SlidingWindow(1.0, 1.0)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = f"WITH {BASE} {sql}" if sql.lstrip().startswith("SELECT") else f"WITH {BASE}, {sql}"
        return f

    return add


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- H, M: features and statistics ---------------------------------------------------------------


@query("h_crop_frames", "SELECT vec_id AS frame, label::VARCHAR AS label FROM embeddings WHERE vec_id BETWEEN 10 AND 19 OR vec_id BETWEEN 50 AND 99")
def _(spark: SparkSession, d: str) -> DataFrame:
    focus = spark.createDataFrame([("emb", 10.2, 20.7), ("emb", 50.0, 80.0), ("emb", 70.0, 100.1)], "uri string, start double, end double")
    return fe.crop(v.frames(spark, d), focus, FRAME).select("frame", "label")


@query("h_describe", "SELECT 'emb' AS uri, max(vec_id) + 1 AS frames, max(len(embedding)) AS dimension FROM embeddings")
def _(spark, d):
    return fe.describe(v.frames(spark, d), FRAME).select("uri", "frames", F.col("dimension").cast("long").alias("dimension"))


@query("h_warp")
def _(spark, d):
    return fe.warp(v.frames(spark, d), 51)


@query("m_gaussians", "SELECT label::VARCHAR AS label, dim::BIGINT AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2")
def _(spark, d):
    return _r6(fe.gaussians(v.frames(spark, d), ["label"]).withColumn("dim", F.col("dim").cast("long")), "mean", "var")


CURVE = """(SELECT frame, sum((ml - mr) ** 2 / sqrt(vl * vr)) AS y FROM (SELECT frame, avg(x) OVER l AS ml, avg(x) OVER r AS mr, var_pop(x) OVER l AS vl, var_pop(x) OVER r AS vr, count(*) OVER l AS nl, count(*) OVER r AS nr
  FROM (SELECT vec_id AS frame, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
  WINDOW l AS (PARTITION BY dim ORDER BY frame ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY dim ORDER BY frame ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) WHERE nl = 30 AND nr = 30 GROUP BY 1)"""


@query("m_divergence_curve", f"SELECT 'emb' AS uri, frame, round(y, 6) AS y FROM {CURVE}")
def _(spark, d):
    return _r6(fe.divergence_curve(v.frames(spark, d), 30), "y")


@query("m_change_points")
def _(spark, d):
    return fe.change_points(v.frames(spark, d), 30)


@query("m_periodic", """SELECT uri, s + i * 86400 AS "start", least(s + (i + 1) * 86400, e) AS "end" FROM (SELECT uri, s, e, unnest(range(0, ceil((e - s) / 86400)::BIGINT)) AS i FROM (SELECT uri, min(s) AS s, max(e) AS e FROM ref GROUP BY 1))""")
def _(spark, d):
    return fe.periodic(R(spark, d), v.DAY)


@query("m_mixtures")
def _(spark, d):
    return fe.train_mixtures(v.frames(spark, d), 2)


@query("m_viterbi")
def _(spark, d):
    frames = v.frames(spark, d)
    return fe.decode(fe.frame_scores(frames, fe.collect_mixtures(fe.train_mixtures(frames, 1))), stay=0.9)


@query("n_identification")
def _(spark, d):
    frames = v.frames(spark, d)
    models = fe.collect_mixtures(fe.train_mixtures(frames, 1))
    tracks = frames.groupBy("uri", F.floor(F.col("frame") / 20).alias("t")).agg(F.min("frame").cast("double").alias("start"), (F.max("frame") + 1.0).alias("end")).withColumn("track", F.col("t").cast("string")).drop("t")
    return fe.posteriors(fe.track_scores(fe.frame_scores(frames, models), tracks, FRAME), open_set=False)


# --- N: calibration ------------------------------------------------------------------------------


@query("n_histogram", "c AS (SELECT n_chars::DOUBLE AS score, quality AS target FROM documents JOIN labels USING (doc_id)), m AS (SELECT min(score) AS lo, (max(score) - min(score)) / 20 AS w FROM c) SELECT least(19, floor((score - lo) / w))::INT AS bin, count(*) FILTER (target = 1) AS target, count(*) FILTER (target = 0) AS other FROM c, m GROUP BY 1")
def _(spark, d):
    return ca.histogram(v.calib(spark, d), 20)


@query("n_posterior")
def _(spark, d):
    rows = v.calib(spark, d)
    return ca.apply(rows, ca.fit(rows, 20)).withColumns({c: F.round(c, 9) for c in ("llr", "posterior")})


@query("n_linear_llr")
def _(spark, d):
    return ca.linear_llr(v.calib(spark, d))


@query("n_duration_priors", f"SELECT label, d / sum(d) OVER () AS prior FROM (SELECT label, sum(e - s) AS d FROM {s_islands('ref', 'uri, label')} GROUP BY 1)")
def _(spark, d):
    return ca.duration_priors(R(spark, d))


@query("n_authentication", "SELECT s.uri, s.label, s.score, (s.label = r.label)::INT AS target FROM sco s JOIN ref r USING (uri, track)")
def _(spark, d):
    return ca.authentication_samples(v.scores(spark, d), R(spark, d))


@query("n_cluster_links", f"p AS (SELECT uri, row, count(*) AS n, min(col) AS main FROM {s_co('hyp', 'ref')} WHERE value > 0 GROUP BY 1, 2) SELECT a.uri, a.row AS row, b.row AS col, CASE WHEN a.n > 1 OR b.n > 1 THEN 0 WHEN a.main = b.main THEN 1 ELSE -1 END AS value FROM p a JOIN p b ON a.uri = b.uri AND a.row < b.row")
def _(spark, d):
    return ca.cluster_links(R(spark, d), H(spark, d))


# --- O: clustering -------------------------------------------------------------------------------


def _links(spark, d):
    """Shared seconds of pairs of labels."""
    return mx.cooccurrence(R(spark, d), R(spark, d)).where("row < col AND value > 0")


@query("o_agglomerative")
def _(spark, d):
    return cl.agglomerative(_links(spark, d), "average", 3600.0, missing=0.0)


@query("o_history")
def _(spark, d):
    return cl.history(_links(spark, d), "complete", missing=0.0)


@query("o_components", f"k AS (SELECT uri, row, col FROM {s_co('ref', 'ref')} WHERE row < col AND value > 40000), e AS (SELECT uri, row AS a, col AS b FROM k UNION SELECT uri, col, row FROM k), w AS (SELECT uri, a, a AS r FROM e UNION SELECT w.uri, w.a, e.b FROM w JOIN e ON w.uri = e.uri AND w.r = e.a) SELECT uri, a AS item, min(r) AS component FROM w GROUP BY 1, 2")
def _(spark, d):
    return cl.components(_links(spark, d).where("value > 40000").select("uri", "row", "col"))


SQL["o_components"] = SQL["o_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("o_correlation")
def _(spark, d):
    return cl.correlation(_links(spark, d).withColumn("value", F.col("value") - 20_000.0)).select("uri", "item", "cluster")


@query("o_louvain")
def _(spark, d):
    return cl.louvain(_links(spark, d))


@query("o_modularity", f"k AS (SELECT uri, row, col, value FROM {s_co('ref', 'ref')} WHERE row < col AND value > 0), c AS (SELECT uri, substr(row, 1, 1) AS a, substr(col, 1, 1) AS b, value FROM k), g AS (SELECT uri, x, sum(value) AS kk FROM (SELECT uri, a AS x, value FROM c UNION ALL SELECT uri, b, value FROM c) GROUP BY 1, 2), t AS (SELECT uri, sum(kk) AS m2 FROM g GROUP BY 1), q AS (SELECT uri, sum((kk / m2) ** 2) AS r FROM g JOIN t USING (uri) GROUP BY 1), i AS (SELECT uri, sum(CASE WHEN a = b THEN value ELSE 0 END) / sum(value) AS i FROM c GROUP BY 1) SELECT uri, round(i - r, 9) AS modularity FROM i JOIN q USING (uri)")
def _(spark, d):
    names = R(spark, d).select("uri", F.col("label").alias("item")).distinct().withColumn("cluster", F.substring("item", 1, 1))
    return cl.modularity(_links(spark, d), names).withColumn("modularity", F.round("modularity", 9))


@query("o_bic")
def _(spark, d):
    return cl.bic(v.frames(spark, d))


# --- P: identity graphs --------------------------------------------------------------------------


@query("p_track_constraints", f"SELECT a.uri, a.track AS left_track, b.track AS right_track FROM ref a JOIN ref b ON a.uri = b.uri AND a.i < b.i AND {OVL}")
def _(spark, d):
    e = gr.track_constraints(R(spark, d))
    x, y = F.substring_index("src", "|", -1), F.substring_index("dst", "|", -1)
    first = x.cast("long") < y.cast("long")
    return e.select("uri", F.when(first, x).otherwise(y).alias("left_track"), F.when(first, y).otherwise(x).alias("right_track"))


@query("p_identity_constraints", "n AS (SELECT DISTINCT uri, label FROM ref) SELECT a.uri, 'identity|' || a.label AS src, 'identity|' || b.label AS dst, 0.0::DOUBLE AS probability FROM n a JOIN n b ON a.uri = b.uri AND a.label < b.label")
def _(spark, d):
    return gr.identity_constraints(gr.from_annotation(R(spark, d)))


@query("p_cooccurrence_fit", f"{s_labels('ref', 'hyp')}, p AS (SELECT uri, e - s AS d, sum(r) AS na, sum(h) AS nb, count(*) FILTER (r > 0 AND h > 0) AS n FROM cnt GROUP BY uri, s, e) SELECT na::BIGINT AS na, nb::BIGINT AS nb, sum(d) AS seconds, least(1 - 1e-6, sum(d * n) / sum(d * least(na, nb))) AS probability FROM p WHERE na > 0 AND nb > 0 GROUP BY 1, 2")
def _(spark, d):
    return gr.cooccurrence_fit(R(spark, d), H(spark, d))


@query("p_lag_fit")
def _(spark, d):
    return gr.lag_fit(R(spark, d), H(spark, d), 7200.0, 1800.0)


@query("p_contract")
def _(spark, d):
    r = R(spark, d)
    out = gr.contract(gr.merge(gr.from_scores(v.scores(spark, d)), gr.from_annotation(r.where(F.col("label") != "error"))))
    return out.withColumn("probability", F.round(F.col("probability") + 1e-9, 6))  # means of thousandths: ties are frequent


@query("p_prune_identities", "SELECT uri, track, 'identity|' || label AS identity, score FROM (SELECT *, row_number() OVER (PARTITION BY uri, track ORDER BY score DESC, label) AS n FROM sco) WHERE n <= 2")
def _(spark, d):
    e = gr.prune_identities(gr.from_scores(v.scores(spark, d)), 2)
    return e.select("uri", F.substring_index("dst", "|", -1).alias("track"), F.col("src").alias("identity"), F.col("probability").alias("score"))


@query("p_mine")
def _(spark, d):
    r = v.ann_unk(spark, d)
    return pr.mine(r, scores=v.scores(spark, d), names=r, alpha=0.7)


# --- L, R: formats and programs ------------------------------------------------------------------


@query("l_mdtm_round_trip", f"SELECT uri, {se()}, label FROM ref")
def _(spark, d):
    fmt = tx.FORMATS["mdtm"]
    return tx.parse(tx.lines(R(spark, d), fmt), fmt).select("uri", "start", "end", "label")


@query("l_etf0_round_trip", f"SELECT uri, {se()}, track, label, score FROM sco")
def _(spark, d):
    fmt = tx.FORMATS["etf0"]
    return tx.parse(tx.lines(v.scores(spark, d), fmt), fmt).select("uri", "start", "end", "track", "label", "score")


@query("l_uem_round_trip", f"SELECT uri, {se()} FROM uem")
def _(spark, d):
    fmt = tx.FORMATS["uem"]
    return tx.parse(tx.lines(U(spark, d), fmt), fmt)


@query("r_stats", "n AS (SELECT 'ref' AS file, uri, count(DISTINCT label) AS n FROM ref GROUP BY ALL UNION ALL SELECT 'hyp', uri, count(DISTINCT label) FROM hyp GROUP BY ALL) SELECT file, min(n) AS min, max(n) AS max, round(exp(avg(ln(n))), 9) AS geometric, avg(n) AS mean FROM n GROUP BY 1")
def _(spark, d):
    return pr.stats({"ref": R(spark, d), "hyp": H(spark, d)}).withColumn("geometric", F.round("geometric", 9))


@query("r_oracle", f"SELECT uri, {se()}, track, CASE WHEN label IN ('click', 'view') THEN label ELSE 'Inconnu_' || label END AS label, label NOT IN ('click', 'view') AS is_unknown FROM ref")
def _(spark, d):
    known = spark.createDataFrame([("click",), ("view",)], "label string")
    return pr.oracle(R(spark, d), known).select("uri", "start", "end", "track", "label", "is_unknown")


BUSY = f"(SELECT a.uri, a.s, a.e FROM {s_cells('ref')} a JOIN ref b ON a.uri = b.uri AND {OVL} GROUP BY ALL HAVING count(DISTINCT b.track) > 1)"


@query("r_overlap_removal", f"busy AS (SELECT * FROM {BUSY}) SELECT uri, {se()} FROM {s_gaps('busy', 'uem')}")
def _(spark, d):
    out = pr.without_overlap(R(spark, d), U(spark, d))
    return tl.timeline(out)


@query("r_evaluate_report")
def _(spark, d):
    r, u = R(spark, d), U(spark, d)
    return pr.report(pr.evaluate(r, {"shifted": H(spark, d), "same": r}, ["detection", "identification"], u))


@query("r_convert", f"SELECT uri, {se()}, (row_number() OVER (PARTITION BY uri ORDER BY s, e, label) - 1)::VARCHAR AS track, label FROM {s_islands(f'(SELECT a.uri, a.label, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM ref a JOIN uem b ON a.uri = b.uri AND {OVL})', 'uri, label')}")
def _(spark, d):
    return pr.convert(R(spark, d), U(spark, d), smooth=True, retrack=True).select("uri", "start", "end", "track", "label")


@query("r_tag")
def _(spark, d):
    return pr.tag(R(spark, d), H(spark, d), conservative=True)


@query("r_calibration_samples")
def _(spark, d):
    return pr.calibration_samples(v.scores(spark, d), R(spark, d), ["click", "view"], U(spark, d))
