"""Queries of movement, delays, targets, links and samples, registered with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import DAY, GAP, GRID, HISTORY, HORIZON, HOURS, INTERP, MIN_ROWS, STEP, TURNS, query, r6, raw, readings
from .catalog_phase import GRIDDED, night_grid
from .functions import scalar as S
from .operators import events as V
from .operators import neighbours as N
from .operators import orbits as O
from .operators import series as R

PLACED = GRIDDED + ", q AS (SELECT id, us, row_number() OVER (PARTITION BY id ORDER BY us) AS k, v FROM g)"


@query(PLACED + """, m AS (SELECT id, avg(v) AS m, var_pop(v) AS var, count(v) AS n FROM q GROUP BY id), c AS (SELECT q.id, k, v - m AS d FROM q JOIN m USING (id)), lg AS (SELECT a.id, lag, count(a.d * b.d) AS n, avg(a.d * b.d) AS p FROM c a, (SELECT unnest(range(1, 13)) AS lag), c b WHERE b.id = a.id AND b.k = a.k + lag GROUP BY ALL),
f AS (SELECT m.id, any_value(m.n) AS n, any_value(var) AS var, [1.0::DOUBLE] || list(CASE WHEN coalesce(lg.n, 0) >= 10 THEN p / nullif(var, 0) ELSE 0 END ORDER BY t.lag) AS r FROM m CROSS JOIN (SELECT unnest(range(1, 13)) AS lag) t LEFT JOIN lg ON lg.id = m.id AND lg.lag = t.lag GROUP BY m.id),
h AS (SELECT *, list_filter(range(1, 12), lambda k: r[k + 1] < 1 / exp(1) OR (len(list_filter(r[2 : k + 1], lambda v: v < 0.8)) > 0 AND r[k + 1] > r[k] AND r[k + 2] >= r[k + 1]))[1] AS k FROM f)
SELECT id, CAST(CASE WHEN n < 20 OR var <= 1e-12 THEN 1 WHEN k IS NULL THEN 12 WHEN r[k + 1] < 1 / exp(1) THEN k ELSE greatest(1, k - 1) END AS INTEGER) AS tau FROM h""")
def n03_pair_delay(spark, sf):
    return O.pair_delay(night_grid(spark, sf), 12)


MOVES = """, p AS (SELECT id, k, x, y, median(x) OVER w AS cx, median(y) OVER w AS cy, stddev_samp(x) OVER w AS sd FROM (SELECT id, k, v AS x, lead(v) OVER (PARTITION BY id ORDER BY k) AS y FROM q) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY id)),
d AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS far, lag(k) OVER o = k - 1 AS nxt, x - lag(x) OVER o AS dx, sqrt((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o)) AS step FROM p WINDOW o AS (PARTITION BY id ORDER BY k)),
e2 AS (SELECT *, CASE WHEN lag(nxt) OVER o THEN lag(far) OVER o END AS far0 FROM d WINDOW o AS (PARTITION BY id ORDER BY k))
SELECT id, round(avg(far / step) FILTER (step > 1e-9 AND dx > 0.01), 6) AS ascend, round(avg(far / step) FILTER (step > 1e-9 AND dx < -0.01), 6) AS descend, CASE WHEN any_value(sd) > 1e-9 THEN round(avg(step) FILTER (far < far0) / any_value(sd), 6) END AS recovery FROM e2 WHERE nxt GROUP BY id"""


@query(PLACED + MOVES)
def n11_friction(spark, sf):
    """Friction up and down and centripetal recovery of all points."""
    return O.friction(N.embedded(night_grid(spark, sf), 1, 2), 2).select("id", *r6("ascend", "descend", "recovery"))


@query(GRIDDED + f", q AS (SELECT id, us, row_number() OVER (PARTITION BY id ORDER BY us) AS k, v FROM g WHERE {HOURS} < 12)" + MOVES.replace("SELECT id, round(avg(far / step) FILTER (step > 1e-9 AND dx > 0.01), 6) AS ascend, round", "SELECT id, round").replace("AS descend, CASE WHEN any_value(sd) > 1e-9 THEN round(avg(step) FILTER (far < far0) / any_value(sd), 6) END AS recovery", "AS night_friction"))
def q12_night_friction(spark, sf):
    """Friction on falling steps about the core of the clock's first half."""
    night = night_grid(spark, sf).where(R.period(F.col("us"), 0, 12))
    return O.friction(N.embedded(night, 1, 2), 2).select("id", F.round("descend", 6).alias("night_friction"))


@query(PLACED + """ SELECT id, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd FROM (WITH RECURSIVE m AS (SELECT id, us, k, v AS y, v AS v, 1.0::DOUBLE AS w FROM q WHERE k = 1 UNION ALL
 SELECT q.id, q.us, q.k, CASE WHEN m.y IS NULL THEN q.v WHEN q.v IS NULL THEN m.y ELSE (m.w * 0.7 * m.y + 0.3 * q.v) / (m.w * 0.7 + 0.3) END, q.v, CASE WHEN m.y IS NULL OR q.v IS NOT NULL THEN 1.0 ELSE m.w * 0.7 END FROM m JOIN q ON q.id = m.id AND q.k = m.k + 1) SELECT id, us, CASE WHEN v IS NOT NULL THEN y END AS y FROM m) GROUP BY id""")
def w09_decaying_average(spark, sf):
    out = O.decaying_average(night_grid(spark, sf), 0.3)
    return out.groupBy("id").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).select("id", "n", *r6("mean", "sd"))


@query(""", p AS (SELECT id, max(v) AS a, count(*) AS b FROM e GROUP BY id), t AS (SELECT id, ((rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 0.5) / count(*) OVER () + (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 0.5) / count(*) OVER ()) / 2 AS target FROM p)
SELECT id, round(target, 6) AS target, target >= (SELECT quantile_cont(target, 0.75) FROM t) AS high FROM t""")
def p29_percentile_target(spark, sf):
    p = raw(spark, sf).groupBy("id").agg(F.max("v").alias("a"), F.count("*").alias("b"))
    return O.percentile_target(p, "a", "b").select("id", *r6("target"), "high")


@query(", a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM e WHERE event_id % 2 = 0), b AS (SELECT event_id AS other, v, row_number() OVER (ORDER BY event_id) AS k FROM e WHERE event_id % 2 = 1) SELECT event_id, other, v FROM a JOIN b USING (k)")
def j15_by_place(spark, sf):
    """Even events beside odd ones, in order."""
    e = raw(spark, sf).select("event_id", "v")
    return O.linked_by_place(e.where("event_id % 2 = 0").select("event_id"), e.where("event_id % 2 = 1").select(F.col("event_id").alias("other"), "v"), "event_id", "other")


@query(", f AS (SELECT id, arg_min(event_type, event_id) AS kind, arg_min(v, event_id) AS v0 FROM e GROUP BY id) SELECT id, us, round(r.v, 6) AS v, kind, v0 FROM r JOIN f USING (id)")
def j17_static(spark, sf):
    static = raw(spark, sf).select("id", "event_id", F.col("event_type").alias("kind"), F.col("v").alias("v0"))
    return O.with_static(readings(spark, sf), static, ["event_id"], ["kind", "v0"]).select("id", "us", *r6("v"), "kind", "v0")


SAMPLED = INTERP + f", s4 AS (SELECT id, seg, us, row_number() OVER w AS k, count(*) OVER (PARTITION BY id, seg) AS n, list(v) OVER (PARTITION BY id, seg ORDER BY us ROWS BETWEEN CURRENT ROW AND {HISTORY - 1} FOLLOWING) AS past, list(v) OVER (PARTITION BY id, seg ORDER BY us ROWS BETWEEN {HISTORY} FOLLOWING AND {HISTORY + HORIZON - 1} FOLLOWING) AS future FROM g WINDOW w AS (PARTITION BY id, seg ORDER BY us)), ok AS (SELECT * FROM s4 WHERE len(past) = {HISTORY} AND len(future) = {HORIZON})"


def samples(spark, sf):
    return R.samples(R.interpolate(R.segments(readings(spark, sf), GAP, MIN_ROWS), GRID), HISTORY, HORIZON)


def total(c):
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)


@query(SAMPLED + " SELECT id, CAST(seg AS BIGINT) AS seg, us, round(list_sum(past), 6) AS past, round(list_sum(future), 6) AS future FROM ok WHERE (k - 1) % 3 = 0")
def d04_backtest(spark, sf):
    return O.backtest_samples(samples(spark, sf), 3).select("id", "seg", "us", total("past").alias("past"), total("future").alias("future"))


@query(SAMPLED + f" SELECT id, CAST(seg AS BIGINT) AS seg, us + {HISTORY * STEP} AS begins, round(list_sum(past), 6) AS past, round(list_sum(future), 6) AS future FROM ok QUALIFY row_number() OVER (PARTITION BY id, seg ORDER BY us DESC) = 1")
def d03_inference(spark, sf):
    out = O.inference_samples(samples(spark, sf), HISTORY, STEP)
    return out.select("id", "seg", "begins", total("past").alias("past"), total("future").alias("future"))


@query(" SELECT id, us FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY sha256(id || ':' || us || ':0'), us) <= 5")
def d09_kept_points(spark, sf):
    return O.kept_points(readings(spark, sf), 5).select("id", "us")


@query(" SELECT id, us FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY sha256(id || ':' || us || ':1'), us) <= ceil(count(*) OVER (PARTITION BY id) * 0.25)")
def d09_kept_share(spark, sf):
    return O.kept_points(readings(spark, sf), share=0.25, seed=1).select("id", "us")


@query(" SELECT id, us FROM r QUALIFY (row_number() OVER (PARTITION BY id ORDER BY us) - 1) % greatest(1, ceil(count(*) OVER (PARTITION BY id) / 30.0)) = 0")
def t06_thinned(spark, sf):
    return O.thinned(readings(spark, sf), 30).select("id", "us")


Z = ", ".join(f"pow(avg(CAST(z <= {q!r} AS INTEGER)) - {(i + 1) / 10!r}, 2)" for i, q in enumerate(O.NORMAL_TENTHS))


@query(SAMPLED + f""", f AS (SELECT past[{HISTORY}] AS forecast, unnest(future) AS actual, unnest(range({HORIZON})) AS k FROM ok), sd AS (SELECT sqrt(avg((actual - forecast) * (actual - forecast))) AS sd FROM f), z AS (SELECT CAST(k AS INTEGER) AS k, (actual - forecast) / sd AS z FROM f, sd)
SELECT k, count(*) AS n, round(list_sum([{Z}]), 6) AS error FROM z GROUP BY k""")
def h20_calibration(spark, sf):
    """Of forecasts that repeat the last value."""
    f = samples(spark, sf).select(F.get("past", F.lit(HISTORY - 1)).alias("forecast"), F.posexplode("future").alias("k", "actual"))
    return O.gaussian_calibration(f).select("k", "n", *r6("error"))


@query(TURNS + """o AS (SELECT id, count(DISTINCT p) AS n FROM k GROUP BY id), c AS (SELECT i.id, coalesce(o.n, 0) AS n, i.sd FROM (SELECT id, stddev_samp(v) AS sd FROM r GROUP BY id) i LEFT JOIN o USING (id))
SELECT CAST(least(n, 3) AS INTEGER) AS bucket, count(*) AS ids, round(var_pop(sd), 6) AS var, (SELECT round(corr(n, sd), 6) FROM c) AS r FROM c GROUP BY 1""")
def h34_count_confound(spark, sf):
    """Whether an id's deviation follows the number of its excursions."""
    r = readings(spark, sf)
    n = V.excursions(r).groupBy("id").agg(F.count("*").alias("n"))
    c = r.groupBy("id").agg(F.stddev_samp("v").alias("sd")).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return O.count_confound(c, "sd").select("bucket", "ids", *r6("var", "r"))


@query(f", d AS (SELECT id, us // {DAY} AS date, avg(v) AS m FROM e GROUP BY ALL), k AS (SELECT id, row_number() OVER w AS k, avg(m) OVER w AS score FROM d WINDOW w AS (PARTITION BY id ORDER BY date)) SELECT id, CAST(k AS INTEGER) AS k, round(score, 9) AS score, round(abs(score - coalesce(lag(score) OVER (PARTITION BY id ORDER BY k), score)), 9) AS drift FROM k")
def w28_score_drift(spark, sf):
    """Of the mean over an id's first k days."""
    w = Window.partitionBy("id").orderBy("date")
    d = raw(spark, sf).groupBy("id", S.day_of(F.col("us")).alias("date")).agg(F.avg("v").alias("m"))
    k = d.select("id", F.row_number().over(w).alias("k"), F.avg("m").over(w).alias("score"))
    return O.score_drift(k, "k", "score").select("id", "k", *(F.round(c, 9).alias(c) for c in ("score", "drift")))


@query("SELECT event_id, id AS \"who.id\", us AS \"who.when.us\", CAST(json_extract(props, '$.k') AS DOUBLE) AS \"props.k\" FROM e")
def p30_flattened(spark, sf):
    props = F.from_json("props", "k double").alias("props")
    nested = raw(spark, sf).select("event_id", F.struct("id", F.struct("us").alias("when")).alias("who"), props)
    return O.flattened(nested)
