"""Queries that write the tables in each source's form and read them back, and of declared columns and their coercion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r6, raw, readings, table
from .functions import scalar as S
from .plans.spec import ColumnSpec, conform
from .sources import tables as T
from .sources.scratch import place

EVENTS = "event_id long, user_id long, event_type string, value double"


def plain(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM events")
def s01_csv(spark, sf):
    path = place(spark, "csv")
    T.write_csv(plain(spark, sf), path)
    return T.delimited(spark, path, EVENTS)


@query("SELECT event_id, user_id, event_type, value FROM events")
def s03_tabs(spark, sf):
    path = place(spark, "tabs")
    T.delimited_out(plain(spark, sf), path, "\t")
    return T.delimited(spark, path, EVENTS, "\t")


@query("SELECT event_id, value, event_type AS id FROM events")
def s04_named_files(spark, sf):
    """A folder for each event type, whose name is the id of its files' rows."""
    path = place(spark, "folders")
    plain(spark, sf).select("event_id", "value", "event_type").write.partitionBy("event_type").option("header", True).csv(path)
    return T.named_files(spark, f"{path}/*", "event_id long, value double", r"event_type=([^/]+)/")


@query("SELECT 'c' || user_id % 3 AS cohort, CAST(user_id AS VARCHAR) AS id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s08_cohorts(spark, sf):
    """A nested document for each cohort, with its subjects' times and values."""
    path = place(spark, "cohorts")
    rows = table(spark, sf, "events").select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("cohort"), F.col("user_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.col("value").alias("v"))
    subject = rows.groupBy("cohort", "id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x"))
    subject = subject.select("cohort", F.struct("id", F.transform("x", lambda r: r["t"]).alias("timestamps"), F.transform("x", lambda r: r["v"]).alias("values")).alias("s"))
    subject.groupBy("cohort").agg(F.collect_list("s").alias("subjects")).write.option("maxRecordsPerFile", 1).json(path)
    found = T.cohort_documents(spark, path)
    return found.groupBy("cohort", "id").agg(F.count("time").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT user_id AS id, CAST(hour(ts) * 60 AS INTEGER) AS minute, round(avg(value), 6) AS v FROM events GROUP BY ALL")
def s12_wide_minutes(spark, sf):
    x = table(spark, sf, "events").select(F.col("user_id").alias("id"), (F.hour("ts") * 60).alias("m"), "value")
    wide = x.groupBy("id").pivot("m", [h * 60 for h in range(24)]).agg(F.avg("value"))
    return T.wide_minutes(wide, ["id"]).where("v IS NOT NULL").select("id", "minute", *r6("v"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events")
def k01_json(spark, sf):
    path = place(spark, "json")
    T.write_json(plain(spark, sf).select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")), path)
    return spark.read.schema("event_id long, v double").json(path)


@query("SELECT max(event_id) AS event_id FROM events WHERE user_id % 4 = 3")
def s11_latest(spark, sf):
    """Of four results, the last by name."""
    path = place(spark, "results")
    plain(spark, sf).groupBy((F.col("user_id") % 4).alias("run")).agg(F.max("event_id").alias("event_id")).write.partitionBy("run").parquet(path)
    return spark.read.parquet(T.latest(spark, f"{path}/run=*"))


SPEC = [ColumnSpec("user_id", "categorical", "id"), ColumnSpec("ts", "date", "time"), ColumnSpec("reading", "real_valued", "target"), ColumnSpec("event_type", "categorical", "static_input")]


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS us, value AS reading, event_type FROM events WHERE event_id % 7 <> 0")
def p01_conform(spark, sf):
    """Declared columns, cast; rows whose target is no number go."""
    x = table(spark, sf, "events").withColumn("reading", F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.col("value").cast("string")))
    return conform(x, SPEC).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "reading", "event_type")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 40.0 WHEN 1 THEN 400.0 WHEN 2 THEN NULL ELSE value END AS v FROM events")
def p12_sentinels(spark, sf):
    k = F.col("event_id") % 5
    return plain(spark, sf).select("event_id", S.numeric(F.when(k == 0, "Low").when(k == 1, "High").when(k == 2, "n/a").otherwise(F.col("value").cast("string"))).alias("v"))


@query("SELECT event_id, round(CASE WHEN value > 5 THEN ln(value / (value - 5)) END, 6) AS ratio FROM events")
def p19_log_ratio(spark, sf):
    return plain(spark, sf).select("event_id", F.round(S.safe_log_ratio(F.col("value"), F.col("value") - 5), 6).alias("ratio"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE CAST(event_id AS DOUBLE) * 1000 + 0.5 END AS dose FROM events")
def p27_doses(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, "as needed").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(",000.5 units")))
    return plain(spark, sf).select("event_id", S.leading_number(text).alias("dose"))


@query(", c AS (SELECT id, covar_pop(v, w) / nullif(var_pop(v), 0) AS ar1, sum(abs(v - w)) AS work, avg(abs(v - w)) AS step FROM (SELECT id, v, lag(v) OVER (PARTITION BY id ORDER BY us) AS w FROM r) WHERE w IS NOT NULL GROUP BY id) SELECT id, round(work / greatest(step, 1e-6), 6) AS leverage, ar1 > 0.99 AS critical, ar1 + 0.9 > 0.85 AS locked, work > 80 OR work / greatest(step, 1e-6) > 5 AS overloaded FROM c")
def q11_flags(spark, sf):
    w = F.lag("v").over(Window.partitionBy("id").orderBy("us"))
    x = readings(spark, sf).withColumn("w", w).where("w IS NOT NULL")
    c = x.groupBy("id").agg((F.covar_pop("v", "w") / F.nullif(F.var_pop("v"), F.lit(0.0))).alias("ar1"), F.sum(F.abs(F.col("v") - F.col("w"))).alias("work"), F.avg(F.abs(F.col("v") - F.col("w"))).alias("step"))
    c = c.withColumn("lev", S.leverage(F.col("work"), F.col("step")))
    return c.select("id", F.round("lev", 6).alias("leverage"), *S.routing_flags(F.col("ar1"), F.col("ar1") + 0.9, F.col("work"), F.col("lev")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT id) AS ids, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY event_type")
def a16_shares(spark, sf):
    n = raw(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per type


FEATURES = ", f AS (SELECT id, CASE id % 3 WHEN 0 THEN 'kobe_' WHEN 1 THEN 'shanghai_' ELSE 'hall_' END || id AS cohort, avg(v) / 10 AS night, stddev_samp(v) AS work, min(v) AS friction, max(v) / 50 AS ascend, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM e GROUP BY id)"


def features(spark, sf):
    """Per id, metrics that stand in for those of a phase record."""
    v, name = F.col("v"), F.when(F.col("id") % 3 == 0, "kobe_").when(F.col("id") % 3 == 1, "shanghai_").otherwise("hall_")
    f = raw(spark, sf).groupBy("id").agg((F.avg(v) / 10).alias("night"), F.stddev_samp(v).alias("work"), F.min(v).alias("friction"), (F.max(v) / 50).alias("ascend"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.count("*").alias("n"))
    return f.withColumn("cohort", F.concat(name, F.col("id").cast("string")))


@query(FEATURES + """ SELECT id, round(1 / (1 + exp(-CASE WHEN starts_with(cohort, 'kobe_') THEN -6.772379 + 0.701805 * night + 0.008823 * work + 0.103079 * ascend
 WHEN starts_with(cohort, 'shanghai_') THEN -2.103627 + 0.404453 * night - 0.050432 * friction - 0.102868 * ascend ELSE 1.064314 * night - 6.746364 END)), 6) AS risk FROM f""")
def m16_regime_risk(spark, sf):
    risk = S.regime_risk(F.col("cohort"), F.col("night"), F.col("work"), F.col("friction"), F.col("ascend"))
    return features(spark, sf).select("id", F.round(risk, 6).alias("risk"))


@query(FEATURES + """, z AS (SELECT id, s / m / 30 AS rr, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS a, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS b, (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS c, (ascend - avg(ascend) OVER ()) / stddev_samp(ascend) OVER () AS d FROM f)
SELECT id, CAST(a > 0.5 AS INTEGER) + CAST(b > 0.5 AS INTEGER) + CAST(-c > 0.5 AS INTEGER) + CAST(abs(d) - 1 > 0.5 AS INTEGER) >= 3 AND rr BETWEEN 0.015 AND 0.025 AS gate FROM z""")
def f16_phase_gate(spark, sf):
    f = features(spark, sf)
    names = ["m", "s", "n", "ascend"]
    fit = f.agg(*(F.avg(c).alias(f"a_{c}") for c in names), *(F.stddev_samp(c).alias(f"d_{c}") for c in names))
    z = {c: (F.col(c) - F.col(f"a_{c}")) / F.nullif(F.col(f"d_{c}"), F.lit(0.0)) for c in names}
    evidence = [S.directed_evidence(z[c], way) for c, way in zip(names, (1, 1, -1, 0), strict=True)]
    return f.join(F.broadcast(fit)).select("id", S.phase_gate(evidence, F.col("s") / F.col("m") / 30).alias("gate"))  # fit is one row
