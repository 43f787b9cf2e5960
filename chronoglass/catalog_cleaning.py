"""Queries of cleaning, selection and small statistics, registered with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import DAY, HOUR, HOURS, MINUTE, query, r6, raw, readings, table
from .functions import scalar as S
from .operators import cleaning as C
from .operators import series as R

NULLED = ", x AS (SELECT id, us, event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE v END AS v FROM e)"
DAYS = f", d AS (SELECT id, CAST(floor(us / {DAY}) AS BIGINT) AS date, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL)"


def nulled(spark, sf):
    """Readings whose value is unknown where the event is an error."""
    return raw(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("v")))


def days(spark, sf):
    return raw(spark, sf).groupBy("id", S.day_of(F.col("us")).alias("date")).agg(F.count("*").alias("n"), F.avg("v").alias("m"))


@query("SELECT event_id, epoch_us(coalesce(try_strptime(s, '%d/%m/%Y %H:%M'), try_strptime(s, '%d/%m/%Y %H:%M:%S'))) AS us FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS s FROM events)")
def p05_two_formats(spark, sf):
    x = table(spark, sf, "events")
    s = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return x.select("event_id", F.unix_micros(C.two_formats(s)).alias("us"))


@query(f", c AS (SELECT id, event_id, us, (us % {DAY}) // 1000000 AS clock FROM e), d AS (SELECT *, CASE WHEN clock - lag(clock) OVER (PARTITION BY id ORDER BY event_id) <= 0 THEN 1 ELSE 0 END AS nw FROM c) SELECT event_id, CAST(clock + 86400 * sum(nw) OVER (PARTITION BY id ORDER BY event_id) AS BIGINT) AS seconds FROM d")
def p09_rollover(spark, sf):
    x = raw(spark, sf).withColumn("clock", F.floor(F.col("us") % DAY / 1_000_000).cast("long"))
    return C.rollover(x, "clock", "event_id").select("event_id", "seconds")


@query(f"SELECT event_id, CAST(1704067200000000 + (event_id % 30) * {DAY} + us % {DAY} AS BIGINT) AS us FROM e")
def p10_day_and_clock(spark, sf):
    return raw(spark, sf).select("event_id", C.day_and_clock(F.col("event_id") % 30 + 1, F.col("us") % DAY, 1704067200000000).alias("us"))


@query(NULLED + " SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY id)), 6) AS mean_filled, coalesce(v, 0) AS zero_filled FROM x")
def p13_fill(spark, sf):
    x = nulled(spark, sf).withColumn("zero_filled", F.coalesce("v", F.lit(0.0)))
    return C.fill_mean(x, "v", ["id"]).select("event_id", F.round("v", 6).alias("mean_filled"), "zero_filled")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS code FROM e")
def p14_recode(spark, sf):
    return raw(spark, sf).select("event_id", C.recode(F.col("event_type"), {"view": 0, "click": 1, "purchase": 2}).alias("code"))


@query("SELECT id, round(coalesce(avg(v) FILTER (event_type = 'purchase'), avg(v) FILTER (event_type = 'view')), 6) AS v FROM e GROUP BY id")
def p15_sensor(spark, sf):
    of = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("v")))
    return raw(spark, sf).groupBy("id").agg(F.round(F.coalesce(of("purchase"), of("view")), 6).alias("v"))


@query("SELECT event_id, 1000 - CASE WHEN v > 10 THEN 100 ELSE 0 END - CASE WHEN v > 50 THEN 250 ELSE 0 END - CASE WHEN event_type = 'error' THEN 50 ELSE 0 END AS score FROM e")
def p20_penalties(spark, sf):
    v = F.col("v")
    return raw(spark, sf).select("event_id", C.penalty_score([(v > 10, 100), (v > 50, 250), (F.col("event_type") == "error", 50)]).alias("score"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, 0.8 * ln(1 + greatest(0, least(60, v))) - 0.02 * v - 1.5)))), 6) AS score FROM e")
def p21_formula(spark, sf):
    v = F.col("v")
    return raw(spark, sf).select("event_id", F.round(C.linear_score([(F.log1p(F.greatest(F.lit(0.0), F.least(F.lit(60.0), v))), 0.8), (v, -0.02)], -1.5), 6).alias("score"))


@query(NULLED + " SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM x")
def w05_forward_fill(spark, sf):
    return C.forward_fill(nulled(spark, sf), "v", "event_id").select("event_id", "v")


@query("SELECT event_id, round(v * CASE event_type WHEN 'view' THEN 2.20462 WHEN 'click' THEN 0.393701 ELSE 1.0 END, 6) AS v FROM e")
def p28_units(spark, sf):
    return raw(spark, sf).select("event_id", F.round(C.to_unit(F.col("v"), F.col("event_type"), {"view": 2.20462, "click": 0.393701}), 6).alias("v"))


@query(", a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) NOT IN (1, 6)) SELECT event_id FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) NOT IN (1, 6)")
def f03_positions(spark, sf):
    return C.drop_positions(raw(spark, sf), "event_id", [0, 5]).select("event_id")


@query("SELECT event_id FROM e WHERE event_type NOT IN ('error', 'signup')")
def f04_not_in(spark, sf):
    return raw(spark, sf).where(~F.col("event_type").isin("error", "signup")).select("event_id")


@query(f", x AS (SELECT id, us, v, {HOURS} >= 6 AS k FROM r), y AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY id ORDER BY us), true) AS p FROM x) SELECT id, us, CASE WHEN k THEN round(v, 6) END AS v FROM y WHERE k OR p")
def f08_gap_marker(spark, sf):
    return C.one_gap_marker(readings(spark, sf), F.col("us") % DAY / HOUR >= 6).select("id", "us", *r6("v"))


@query(DAYS + ", g AS (SELECT id, date, date - lag(date) OVER (PARTITION BY id ORDER BY date) AS gap FROM (SELECT id, date FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY date) <= 6)) SELECT id, count(*) = 6 AND max(date) - min(date) <= 14 AND coalesce(max(gap), 0) <= 5 AS ok FROM g GROUP BY id")
def f13_continuity(spark, sf):
    return C.continuous(C.at_most(days(spark, sf), "id", ["date"], 6), 6, 14, 5)


@query("SELECT id, round(avg(v) FILTER (event_type = 'view'), 6) AS low, round(avg(v) FILTER (event_type = 'error'), 6) AS high FROM e GROUP BY id HAVING low IS NOT NULL AND high IS NOT NULL")
def f15_pairs(spark, sf):
    of = lambda k: F.round(F.avg(F.when(F.col("event_type") == k, F.col("v"))), 6)
    return raw(spark, sf).groupBy("id").agg(of("view").alias("low"), of("error").alias("high")).where("low IS NOT NULL AND high IS NOT NULL")


@query("SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def j02_one_to_one(spark, sf):
    return C.one_to_one(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"])


@query(f", p AS (SELECT id, CAST(floor(us / {7 * DAY}) AS BIGINT) AS week, event_id % 2 AS k, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL) SELECT a.id, a.week, round(a.v, 6) AS v_odd, a.n AS n_odd, round(b.v, 6) AS v_even, b.n AS n_even FROM p a JOIN p b ON a.id = b.id AND a.week = b.week AND a.k = 1 AND b.k = 0")
def j03_suffixes(spark, sf):
    p = raw(spark, sf).groupBy("id", F.floor(F.col("us") / (7 * DAY)).cast("long").alias("week"), (F.col("event_id") % 2).alias("k")).agg(F.round(F.avg("v"), 6).alias("v"), F.count("*").alias("n"))
    half = lambda k, name: p.where(F.col("k") == k).select("id", "week", F.col("v").alias(f"v_{name}"), F.col("n").alias(f"n_{name}"))
    return half(1, "odd").join(half(0, "even"), ["id", "week"])


@query(DAYS + f" SELECT e.event_id, d.n FROM e LEFT JOIN (SELECT id, date, n FROM d WHERE n >= 2) d ON e.id = d.id AND CAST(floor(us / {DAY}) AS BIGINT) = d.date")
def j08_phase(spark, sf):
    phases = days(spark, sf).where("n >= 2").select("id", "date", "n").dropDuplicates(["id", "date"])
    return raw(spark, sf).withColumn("date", S.day_of(F.col("us"))).join(phases, ["id", "date"], "left").select("event_id", "n")


@query("SELECT event_id FROM e WHERE id NOT IN (SELECT id FROM e WHERE event_type = 'signup' AND v > 60)")
def j10_anti(spark, sf):
    x = raw(spark, sf)
    return x.join(x.where("event_type = 'signup' AND v > 60").select("id"), "id", "left_anti").select("event_id")


@query(NULLED + " SELECT id, arg_min(event_type, event_id) AS event_type, arg_min(v, event_id) FILTER (v IS NOT NULL) AS v FROM x GROUP BY id")
def a03_first_rows(spark, sf):
    return C.first_rows(nulled(spark, sf), ["event_id"], ["event_type", "v"])


@query(f"SELECT id, CAST(floor(us / {HOUR}) AS BIGINT) AS hour, round(sum(v), 6) AS total, min(v) AS least, count(*) AS n FROM e GROUP BY ALL")
def a05_by_time(spark, sf):
    return raw(spark, sf).groupBy("id", F.floor(F.col("us") / HOUR).cast("long").alias("hour")).agg(F.round(F.sum("v"), 6).alias("total"), F.min("v").alias("least"), F.count("*").alias("n"))


@query(", g AS (SELECT id, event_type, avg(v) AS m, count(*) AS n FROM e GROUP BY ALL) SELECT id, round(avg(m), 6) AS plain, round(sum(m * n) / sum(n), 6) AS weighted FROM g GROUP BY id")
def a12_group_means(spark, sf):
    g = raw(spark, sf).groupBy("id", "event_type").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return g.groupBy("id").agg(F.round(F.avg("m"), 6).alias("plain"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("SELECT event_type, count(*) AS n_total, count(*) FILTER (v > 5) AS n_success, count(*) FILTER (NOT v > 5) AS n_failed FROM e GROUP BY event_type")
def a18_summary(spark, sf):
    return raw(spark, sf).groupBy("event_type").agg(F.count("*").alias("n_total"), F.count_if(F.col("v") > 5).alias("n_success"), F.count_if(~(F.col("v") > 5)).alias("n_failed"))


@query("SELECT event_id, row_number() OVER (PARTITION BY id ORDER BY event_id) - 1 AS position FROM e")
def w04_position(spark, sf):
    return raw(spark, sf).select("event_id", (F.row_number().over(Window.partitionBy("id").orderBy("event_id")) - 1).cast("long").alias("position"))


@query(", x AS (SELECT event_id, id, v - 5 AS v FROM e) SELECT event_id FROM x QUALIFY v > 0 AND coalesce(lag(v) OVER (PARTITION BY id ORDER BY event_id), 0) <= 0")
def w15_onsets(spark, sf):
    return C.onsets(raw(spark, sf).withColumn("v", F.col("v") - 5), "event_id").select("event_id")


@query(DAYS + " SELECT id, date, (row_number() OVER (PARTITION BY id ORDER BY date) - 1) % 2 = 0 AS odd FROM d WHERE n >= 1")
def w21_alternate(spark, sf):
    d = days(spark, sf).where("n >= 1").select("id", "date")
    return C.every(d, 2, 0, "date").withColumn("odd", F.lit(True)).unionByName(C.every(d, 2, 1, "date").withColumn("odd", F.lit(False)))


@query("SELECT event_id FROM e QUALIFY (row_number() OVER (PARTITION BY id ORDER BY event_id) - 1) % 5 = 0")
def w27_every_fifth(spark, sf):
    return C.every(raw(spark, sf), 5, 0, "event_id").select("event_id")


@query("SELECT event_id FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY v, event_id) <= greatest(1, ceil(0.25 * count(*) OVER (PARTITION BY id)))")
def t03_lowest_share(spark, sf):
    return C.lowest_share(raw(spark, sf), ["v", "event_id"], 0.25).select("event_id")


@query("SELECT event_id FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 24")
def t05_cap(spark, sf):
    return C.at_most(raw(spark, sf), "event_type", ["event_id"], 24).select("event_id")


@query("SELECT id, 'high' AS context, count(*) AS n FROM e WHERE v > 20 GROUP BY id UNION ALL SELECT id, 'low', count(*) FROM e WHERE v < 5 GROUP BY id")
def u05_contexts(spark, sf):
    of = lambda c, name: raw(spark, sf).where(c).groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(name).alias("context"), "n")
    return of("v > 20", "high").unionByName(of("v < 5", "low"))


@query(NULLED + """, n AS (SELECT *, row_number() OVER w AS k FROM x WINDOW w AS (PARTITION BY id ORDER BY event_id)), f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS a, last_value(v IGNORE NULLS) OVER b AS av, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER c AS z, first_value(v IGNORE NULLS) OVER c AS zv FROM n
 WINDOW b AS (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN round(CASE WHEN a = z THEN av ELSE av + (zv - av) * (k - a) / (z - a) END, 6) END AS v FROM f""")
def r08_fill_by_row(spark, sf):
    return C.fill_by_row(nulled(spark, sf), "event_id").select("event_id", *r6("v"))


CURVE = f", p AS (SELECT id, CAST(floor(us / {MINUTE}) AS BIGINT) // 60 * 10 AS minute, avg(v) AS v FROM e GROUP BY ALL)"


@query(CURVE + ", q AS (SELECT *, lead(minute) OVER w AS m2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY id ORDER BY minute)), t AS (SELECT *, unnest(generate_series(minute, CASE WHEN m2 IS NULL THEN minute ELSE m2 - 1 END)) AS t FROM q) SELECT id, t AS minute, round(CASE WHEN m2 IS NULL THEN v ELSE v + (v2 - v) * (t - minute) / (m2 - minute) END, 9) AS v FROM t")
def r10_curve(spark, sf):
    p = raw(spark, sf).groupBy("id", (F.floor(F.floor(F.col("us") / MINUTE) / 60) * 10).cast("long").alias("minute")).agg(F.avg("v").alias("v"))
    return C.curve_at_minutes(p).select("id", "minute", F.round("v", 9).alias("v"))


@query(f", x AS (SELECT id, us, v, lead(v) OVER (PARTITION BY id ORDER BY us) AS y, {HOURS} < 6 AS n FROM r), m AS (SELECT id, median(v) AS v, median(y) AS y, median(v) FILTER (n) AS nv, median(y) FILTER (n) AS ny FROM x WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY id) SELECT id, round(sqrt((v - nv) * (v - nv) + (y - ny) * (y - ny)), 6) AS distance FROM m")
def n21_core_distance(spark, sf):
    return C.core_distance(readings(spark, sf), R.period(F.col("us"), 0, 6)).select("id", *r6("distance"))


@query(f", x AS (SELECT id, us, v, CAST(floor(us / {7 * DAY}) AS BIGINT) AS d FROM r), y AS (SELECT *, (us - min(us) OVER n) / {float(DAY)} AS x, count(*) OVER n AS c FROM x WINDOW n AS (PARTITION BY id, d)), z AS (SELECT *, v - regr_intercept(v, x) OVER n - regr_slope(v, x) OVER n * x AS r FROM y WHERE c >= 4 WINDOW n AS (PARTITION BY id, d)), q AS (SELECT id, r, lag(r) OVER (PARTITION BY id, d ORDER BY us) AS q FROM z) SELECT id, CASE WHEN count(*) >= 6 THEN round(sum(q * r) / sum(q * q), 6) END AS ar1, count(*) AS pairs FROM q WHERE q IS NOT NULL GROUP BY id")
def n23_detrended_ar1(spark, sf):
    """Weeks stand in for nights, four points a week and six pairs, as events are sparse."""
    return C.detrended_ar1(readings(spark, sf), F.floor(F.col("us") / (7 * DAY)).cast("long"), 4, 6).select("id", *r6("ar1"), "pairs")


@query(f", s AS (SELECT id, avg(v) FILTER ({HOURS} < 6) AS night, avg(v) FILTER ({HOURS} >= 6 AND {HOURS} < 18) AS day FROM r GROUP BY id) SELECT id, round(day - night, 9) AS difference, CASE WHEN day > 0 AND night > 0 THEN round(ln(day / night), 6) END AS log_ratio FROM s")
def g11_contrasts(spark, sf):
    of = lambda a, z: F.avg(F.when(R.period(F.col("us"), a, z), F.col("v")))
    s = readings(spark, sf).groupBy("id").agg(of(0, 6).alias("night"), of(6, 18).alias("day"))
    return s.select("id", F.round(F.col("day") - F.col("night"), 9).alias("difference"), F.round(S.safe_log_ratio(F.col("day"), F.col("night")), 6).alias("log_ratio"))


@query("SELECT event_type, round(avg(CASE WHEN v >= 15 THEN 1.0 ELSE 0 END), 6) AS ceiling_rate, round(avg(least(v, 15)), 6) AS mean FROM e GROUP BY event_type")
def h25_ceiling(spark, sf):
    return raw(spark, sf).groupBy("event_type").agg(F.round(F.avg((F.col("v") >= 15).cast("double")), 6).alias("ceiling_rate"), F.round(F.avg(F.least("v", F.lit(15.0))), 6).alias("mean"))


@query(", p AS (SELECT id, count(*) AS n, max(v) AS v FROM e GROUP BY id), h AS (SELECT v, n > (SELECT median(n) FROM p) AS high FROM p), k AS (SELECT high, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM h) SELECT round((sum(r) FILTER (high) - count(*) FILTER (high) * (count(*) FILTER (high) + 1) / 2) / (count(*) FILTER (high) * count(*) FILTER (NOT high)), 6) AS auc, median(v) FILTER (high) AS high, median(v) FILTER (NOT high) AS low FROM k")
def h33_median_split(spark, sf):
    p = raw(spark, sf).groupBy("id").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    return C.median_split_auc(p, "n", "v").select(*r6("auc"), "high", "low")


@query(f", n AS (SELECT id, avg(v) FILTER ({HOURS} < 6) AS night FROM r GROUP BY id), p AS (SELECT id, 1 / (1 + exp(-greatest(-40, least(40, 1.064314 * night - 6.746364)))) AS p FROM n WHERE night IS NOT NULL) SELECT id, round(p, 6) AS risk, CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.5 THEN 'medium' ELSE 'high' END AS tier FROM p")
def m16_night_risk(spark, sf):
    n = readings(spark, sf).where(R.period(F.col("us"), 0, 6)).groupBy("id").agg(F.avg("v").alias("night")).where("night IS NOT NULL")
    p = n.select("id", C.night_risk(F.col("night")).alias("p"))
    return p.select("id", F.round("p", 6).alias("risk"), S.tier(F.col("p")).alias("tier"))
