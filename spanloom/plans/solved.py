"""Queries that need a solver, and those of fits, gathers and mean lags; SQL by enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.segment import SlidingWindow
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import feature as fe
from spanloom.operators import graph as gr
from spanloom.operators import matrix as mx
from spanloom.plans import views as v
from spanloom.plans.extra import GRID
from spanloom.plans.queries import BASE, s_co

Q: dict = {}
SQL: dict[str, str] = {}
R, H = v.ann_ref, v.ann_hyp


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {BASE}, {sql}"
        return f

    return add


# --- O8, P8: partitions by different objectives, one label graph a user --------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's labels with the chance that shared time gives them: s / (s + 20000)."""
    k = mx.cooccurrence(R(spark, d), R(spark, d)).where("row < col AND value > 0")
    return k.select("uri", F.col("row").alias("src"), F.col("col").alias("dst"), (F.col("value") / (F.col("value") + 20_000.0)).alias("probability"))


#: Pairs with their probability, and all partitions of the five labels.
PARTS = f"""k AS (SELECT uri, row, col, value / (value + 20000.0) AS p FROM {s_co("ref", "ref")} WHERE row < col AND value > 0),
part AS (SELECT row_number() OVER () AS n, b, c, d, e FROM range(0, 2) AS x1(b), range(0, 3) AS x2(c), range(0, 4) AS x3(d), range(0, 5) AS x4(e) WHERE c <= b + 1 AND d <= greatest(b, c) + 1 AND e <= greatest(b, c, d) + 1),
lab AS (SELECT n, 'click' AS label, 0 AS g FROM part UNION ALL SELECT n, 'error', b FROM part UNION ALL SELECT n, 'purchase', c FROM part UNION ALL SELECT n, 'signup', d FROM part UNION ALL SELECT n, 'view', e FROM part)"""
BEST = "SELECT uri, round(max(w), 6) AS worth FROM (SELECT k.uri, x.n, sum(CASE WHEN x.g = y.g THEN {w} ELSE 0 END) AS w FROM k {more} JOIN lab x ON x.label = k.row JOIN lab y ON y.n = x.n AND y.label = k.col GROUP BY 1, 2) GROUP BY 1"


def _worth(edges: DataFrame, kind: str, alpha: float = 0.5, durations: DataFrame | None = None, weight: str = "gmean") -> DataFrame:
    weights, more = gr.objective(edges, kind, alpha, durations, weight)
    return cl.worth(weights, cl.correlation(weights, **more)).withColumn("worth", F.round("worth", 6))


@query("p_objective_probability", f"{PARTS} {BEST.format(w='0.4 * p - 0.6 * (1 - p)', more='')}")
def _(spark, d):
    return _worth(_edges(spark, d), "probability", 0.4)


@query("p_objective_log", f"{PARTS} {BEST.format(w='0.7 * ln(p) - 0.3 * ln(1 - p)', more='')}")
def _(spark, d):
    return _worth(_edges(spark, d), "log", 0.3)


DURATION = "dur AS (SELECT uri, label, sum(e - s) AS d FROM ref GROUP BY 1, 2)"
_DURATION_JOIN = "JOIN dur q ON q.uri = k.uri AND q.label = k.row JOIN dur r ON r.uri = k.uri AND r.label = k.col"


@query("p_objective_weighted", f"{PARTS}, {DURATION} {BEST.format(w='sqrt(q.d * r.d) * (0.5 * p - 0.5 * (1 - p))', more=_DURATION_JOIN)}")
def _(spark, d):
    return _worth(_edges(spark, d), "weighted", 0.5, _durations(spark, d))


@query("p_objective_weighted_min", f"{PARTS}, {DURATION} {BEST.format(w='least(q.d, r.d) * (0.5 * p - 0.5 * (1 - p))', more=_DURATION_JOIN)}")
def _(spark, d):
    return _worth(_edges(spark, d), "weighted", 0.5, _durations(spark, d), "min")


def _durations(spark, d):
    return R(spark, d).groupBy("uri", F.col("label").alias("item")).agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


#: Pairs that share less than two hours must not meet; clusters as large, or as small, as that allows.
_SIZED = f"""{PARTS}, m AS (SELECT uri, row, col, p, p < 7200 / 27200.0 AS never FROM k), i AS (SELECT uri, row AS label FROM k UNION SELECT uri, col FROM k),
ok AS (SELECT x.uri, n FROM (SELECT DISTINCT uri FROM k) x, part WHERE NOT EXISTS (SELECT 1 FROM m JOIN lab a ON a.label = m.row JOIN lab b ON b.n = a.n AND b.label = m.col WHERE m.uri = x.uri AND a.n = part.n AND a.g = b.g AND never)),
sz AS (SELECT ok.uri, ok.n, lab.g, count(*) AS c FROM ok JOIN i ON i.uri = ok.uri JOIN lab ON lab.n = ok.n AND lab.label = i.label GROUP BY ALL)
SELECT uri, max(pairs)::BIGINT AS pairs FROM (SELECT uri, n, sum(c * (c - 1) / 2) AS pairs FROM sz GROUP BY 1, 2) GROUP BY 1"""


@query("p_objective_large", _SIZED)
def _(spark, d):
    p = F.col("probability")
    weights, more = gr.objective(_edges(spark, d).withColumn("probability", F.when(p < 7200 / 27_200.0, 0.0).otherwise(p)), "large")
    found = cl.correlation(weights, **more).groupBy("uri", "cluster").agg(F.count(F.lit(1)).alias("c"))
    return found.groupBy("uri").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("pairs"))


@query(
    "p_objective_modularity",
    f"""{PARTS}, t AS (SELECT uri, 2 * sum(p) AS t FROM k GROUP BY 1), g AS (SELECT uri, label, sum(p) AS kk FROM (SELECT uri, row AS label, p FROM k UNION ALL SELECT uri, col, p FROM k) GROUP BY 1, 2),
    q AS (SELECT uri, n, sum(kk * kk) AS q FROM (SELECT g.uri, n, lab.g, sum(kk) AS kk FROM g JOIN lab USING (label) GROUP BY ALL) GROUP BY 1, 2),
    s AS (SELECT k.uri, x.n, sum(CASE WHEN x.g = y.g THEN p ELSE 0 END) AS s FROM k JOIN lab x ON x.label = k.row JOIN lab y ON y.n = x.n AND y.label = k.col GROUP BY 1, 2)
    SELECT s.uri, round(max(2 * s / t - q / (t * t)), 6) + 0.0 AS modularity FROM s JOIN q ON q.uri = s.uri AND q.n = s.n JOIN t ON t.uri = s.uri GROUP BY 1""",
)
def _(spark, d):
    edges = _edges(spark, d)
    weights, more = gr.objective(edges, "modularity")
    found = cl.modularity(edges.select("uri", F.col("src").alias("row"), F.col("dst").alias("col"), F.col("probability").alias("value")), cl.correlation(weights, **more))
    return found.withColumn("modularity", F.round("modularity", 6) + F.lit(0.0))


@query(
    "p_centers",
    f"""k AS (SELECT uri, row, col, 1 - value / (value + 20000.0) AS c FROM {s_co("ref", "ref")} WHERE row < col AND value > 0), i AS (SELECT uri, row AS label FROM k UNION SELECT uri, col FROM k),
    b AS (SELECT uri, row AS x, col AS y, c FROM k WHERE c <= 0.6 UNION ALL SELECT uri, col, row, c FROM k WHERE c <= 0.6 UNION ALL SELECT uri, label, label, 0 FROM i),
    s AS (SELECT uri, n, label FROM (SELECT uri, label, row_number() OVER (PARTITION BY uri ORDER BY label) - 1 AS j FROM i), range(1, 32) AS r(n) WHERE (n >> j) & 1 = 1),
    w AS (SELECT s.uri, s.n, b.y, min(b.c) AS c FROM s JOIN b ON b.uri = s.uri AND b.x = s.label GROUP BY ALL),
    t AS (SELECT w.uri, w.n, sum(w.c) + any_value(z.z) AS cost, count(*) AS reached FROM w JOIN (SELECT uri, n, count(*) AS z FROM s GROUP BY 1, 2) z ON z.uri = w.uri AND z.n = w.n GROUP BY 1, 2)
    SELECT t.uri, round(min(cost), 6) AS cost FROM t JOIN (SELECT uri, count(*) AS n FROM i GROUP BY 1) a ON a.uri = t.uri AND a.n = t.reached GROUP BY 1""",
)
def _(spark, d):
    """Number of centers plus distances to them, none above 0.6."""
    p = _edges(spark, d).select("uri", F.col("src").alias("row"), F.col("dst").alias("col"), F.col("probability").alias("value"))
    found = cl.centers(p, 0.6)
    paid = found.where("item <> center").select("uri", F.least("item", "center").alias("row"), F.greatest("item", "center").alias("col")).join(p, ["uri", "row", "col"])
    cost = found.where("item = center").select("uri", F.lit(1.0).alias("c")).unionByName(paid.select("uri", (1 - F.col("value")).alias("c")))
    return cost.groupBy("uri").agg(F.round(F.sum("c"), 6).alias("cost"))


def _shipping(spark: SparkSession, d: str) -> DataFrame:
    """Eleven items, days of the week and quarters of shipment, for each return flag: how many orders have both
    of a pair, against the mean of all pairs that meet (times the number of these pairs, so weights are whole)."""
    when = F.col("l_shipdate").cast("date")
    names = F.array(F.concat(F.lit("day"), F.dayofweek(when) - 1), F.concat(F.lit("quarter"), F.quarter(when)))
    rows = v.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("uri"), "l_orderkey", F.explode(names).alias("item")).where("uri IS NOT NULL AND l_orderkey IS NOT NULL AND item IS NOT NULL")
    # orders with the same items are counted before pairs are spelled out: as many rows as sets of items
    sets = rows.groupBy("uri", "l_orderkey").agg(F.sort_array(F.collect_set("item")).alias("items")).groupBy("uri", "items").agg(F.count(F.lit(1)).alias("n"))
    met = sets.withColumn("row", F.explode("items")).withColumn("col", F.explode("items")).where("row < col")
    n = met.groupBy("uri", "row", "col").agg(F.sum("n").alias("n"))
    whole = n.groupBy("uri").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("pairs"))
    return n.join(whole, "uri").select("uri", "row", "col", (F.col("n") * F.col("pairs") - F.col("all")).cast("double").alias("value"))


@query(
    "o_partition_shipping",
    """u AS (SELECT DISTINCT l_returnflag AS uri, l_orderkey AS o, unnest(['day' || dayofweek(l_shipdate), 'quarter' || quarter(l_shipdate)]) AS x FROM lineitem),
    n AS (SELECT a.uri, a.x AS row, b.x AS col, count(*) AS n FROM u a JOIN u b ON a.uri = b.uri AND a.o = b.o AND a.x < b.x GROUP BY ALL),
    w AS (SELECT uri, row, col, n * count(*) OVER (PARTITION BY uri) - sum(n) OVER (PARTITION BY uri) AS w FROM n),
    i AS (SELECT uri, x, row_number() OVER (PARTITION BY uri ORDER BY x) AS j FROM (SELECT DISTINCT uri, x FROM u)),
    m AS (SELECT y.uri, y.j AS jy, list(coalesce(w, 0) ORDER BY z.j) AS ws FROM i y JOIN i z ON z.uri = y.uri AND z.j < y.j LEFT JOIN w ON w.uri = y.uri AND w.row = z.x AND w.col = y.x GROUP BY 1, 2),
    part AS (SELECT uri, 1 AS j, [0] AS g, 0::HUGEINT AS w FROM i WHERE j = 1 UNION ALL
      SELECT p.uri, p.j + 1, list_append(p.g, c.c), p.w + coalesce(list_sum(list_transform(range(1, p.j + 1), lambda k: CASE WHEN p.g[k] = c.c THEN m.ws[k] ELSE 0 END)), 0)
      FROM part p JOIN m ON m.uri = p.uri AND m.jy = p.j + 1, range(0, 11) AS c(c) WHERE c.c <= list_max(p.g) + 1)
    SELECT uri, max(w)::DOUBLE AS worth, 0.0::DOUBLE AS gap FROM part WHERE j = (SELECT max(j) FROM i WHERE i.uri = part.uri) GROUP BY 1""",
)
def _(spark, d):
    weights = _shipping(spark, d)
    found = cl.correlation(weights)
    return cl.worth(weights, found).join(found.groupBy("uri").agg(F.round(F.max("gap"), 3).alias("gap")), "uri")


# --- P10: mean probability of lags ---------------------------------------------------------------


@query("p_lag_average", f"""x AS ({GRID} ref), y AS ({GRID} hyp), m AS (SELECT l.lag, avg((x.label = y.label)::INT) AS p FROM (SELECT DISTINCT uri, label, t FROM x) x, range(-4, 5) AS l(lag), (SELECT DISTINCT uri, label, t FROM y) y WHERE x.uri = y.uri AND x.t + l.lag = y.t GROUP BY 1)
  SELECT x.uri, x.track AS a_track, y.track AS b_track, round(avg(p), 9) AS probability FROM x, m, y WHERE x.uri = y.uri AND x.t + m.lag = y.t GROUP BY 1, 2, 3""")
def _(spark, d):
    r, h = R(spark, d), H(spark, d)
    return gr.lag_average(r, h, gr.lag_fit(r, h, 7200.0, 1800.0), 7200.0, 1800.0).withColumn("probability", F.round("probability", 9))


# --- H2, H5: frames gathered along a timeline ----------------------------------------------------


@query("h_gather", "z AS (SELECT max(vec_id) AS m FROM embeddings), g AS (SELECT p AS position, 10 + p AS f FROM range(0, 10) AS r(p) UNION ALL SELECT 10 + p, m - 4 + p FROM z, range(0, 9) AS r(p)) SELECT position, least(f, m) AS frame, label::VARCHAR AS label FROM g, z JOIN embeddings ON vec_id = least(f, m)")
def _(spark, d):
    """Two islands, the second beyond the last frame, which is repeated."""
    frames = v.frames(spark, d)
    last = frames.groupBy("uri").agg(F.max("frame").alias("m"))
    spans = F.array(F.struct(F.lit(10.2).alias("start"), F.lit(15.0).alias("end")), F.struct(F.lit(14.0).alias("start"), F.lit(20.7).alias("end")), F.struct((F.col("m") - 3.2).alias("start"), (F.col("m") + 5.3).alias("end")))
    focus = last.select("uri", F.explode(spans).alias("s")).select("uri", "s.start", "s.end")
    return fe.gather(frames, focus, SlidingWindow(1.0, 1.0)).select("position", "frame", "label")


# --- N9: generalized logistic --------------------------------------------------------------------


@query(
    "n_logistic_sums",
    """c AS (SELECT n_chars / 1000.0 AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), e AS (SELECT x - 0.8 AS u, y, 1.5 * exp(-0.9 * (x - 0.8)) AS e FROM c),
    f AS (SELECT u, y, e, (1 + e) ** (-1 / 0.7) AS f FROM e), j AS (SELECT y - f AS r, f / 0.7 * e / (1 + e) * u AS a, -f / 0.7 * e / (1 + e) AS b, -f / 0.7 * e / (1 + e) * 0.9 AS c, f / 0.7 * ln(1 + e) AS d FROM f)
    SELECT round(sum(r * r), 5) AS rss, round(sum(r * a), 5) AS g0, round(sum(r * b), 5) AS g1, round(sum(r * c), 5) AS g2, round(sum(r * d), 5) AS g3, round(sum(a * a), 5) AS h00, round(sum(b * b), 5) AS h11, round(sum(d * d), 5) AS h33, round(sum(a * d), 5) AS h03 FROM j""",
)
def _(spark, d):
    """The sums of one fitting step of quality on length."""
    points = v.calib(spark, d).select((F.col("score") / 1000).alias("x"), F.col("target").cast("double").alias("y"))
    sums = ca.logistic_sums(points, 0.9, 1.5, 0.8, 0.7)
    return sums.select(*[F.round(c, 5).alias(c) for c in ("rss", "g0", "g1", "g2", "g3", "h00", "h11", "h33", "h03")])


@query("n_logistic_fit")
def _(spark, d):
    """Posterior of quality by length, from a generalized logistic fitted to binned densities."""
    samples = v.calib(spark, d).withColumn("score", F.log1p("score"))
    model = ca.fit_generalized_logistic(ca.logistic_points(samples, 20), (1.0, 1.0, 6.0, 1.0))
    return ca.apply_generalized_logistic(samples, model).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("posterior"), 6).alias("posterior"))
