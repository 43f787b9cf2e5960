"""Faults that a review found on larger tables, each on the smallest rows that show it."""

import hashlib
import math

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from chronoglass import catalog
from chronoglass.functions import scalar
from chronoglass.operators import metrics, neighbours, resampling, stats

MINUTE = 60_000_000


def test_night_of_one_value(spark):
    rows = [(1, 0, 4.0), (1, 10 * MINUTE, 4.0), (1, 1440 * MINUTE, 1.0), (1, 1450 * MINUTE, 3.0), (2, 0, 5.0), (2, MINUTE, 5.0)]
    got = {r.id: r for r in metrics.night_slowing(spark.createDataFrame(rows, "id long, us long, v double"), 2).collect()}
    assert (got[1].ar1, got[1].var, got[1].skew, got[1].nights) == (-0.5, 1.0, 0.0, 2)
    assert (got[2].ar1, got[2].var, got[2].skew, got[2].nights) == (None, 0.0, None, 1)


def test_shuffles_by_hash_order(spark):
    """Places and the statistic by a plain sort, and no join in which all rows of all shuffles are broadcast."""
    rows = [(i, float(i % 17), int(i % 5 == 0)) for i in range(300)] + [(None, 3.0, 1)]
    df = spark.createDataFrame(rows, "k long, x double, y int").repartition(3)
    order = lambda rep: sorted(rows, key=lambda r: (r[0] is None, r[0] is not None and hashlib.sha256(f"{r[0]}:{rep}".encode()).hexdigest()[:15], r[0] or 0))
    placed = resampling.shuffled(df, "k", 12)
    got = {(r.rep, r.place): r.k for r in placed.collect()}
    assert got == {(rep, p + 1): r[0] for rep in range(12) for p, r in enumerate(order(rep))}
    rank = pd.Series([r[1] for r in rows]).rank()
    of = {r[0]: rank[k] for k, r in enumerate(rows)}
    n1 = sum(r[2] for r in rows)
    want = {rep: (sum(of[r[0]] for r in order(rep)[:n1]) - n1 * (n1 + 1) / 2) / (n1 * (301 - n1)) for rep in range(12)}
    got = {r.rep: r.value for r in resampling.permuted_separation(df, "k", "x", "y", 12).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    plan = resampling.shuffled(df, "k", 12).groupBy("rep").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan


def test_ties_of_means(spark):
    """Equal means are equal in whatever order they are added up, and ties can take their least rank."""
    rows = [(1, k, v) for k, v in enumerate([0.1, 0.2, 0.3])] + [(2, k, v) for k, v in enumerate([0.3, 0.2, 0.1])] + [(3, 0, 1e-9), (3, 1, 3e-9), (4, 0, None)]
    df = spark.createDataFrame(rows, "id long, k long, v double").coalesce(1).sortWithinPartitions("k")
    got = {r.id: r.m for r in df.groupBy("id").agg(stats.exact_mean(F.col("v")).alias("m")).collect()}
    assert got[1] == got[2] == 0.6 / 3 and math.isclose(got[3], 2e-9) and got[4] is None
    pairs = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0), (5.0, 3.0), (9.0, 2.0), (4.0, 4.0)], "a double, b double")
    assert (stats.paired(pairs, "a", "b").first().signed, stats.paired(pairs, "a", "b", "least").first().signed) == (8.0, 6.0)


def test_rounding_after_scaling(spark):
    """Numbers whose digits end in 5 and that are a little under it once scaled, as SQL does."""
    x = [k + 0.5005 for k in range(3000)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in [*x, -1.25, 2.0, None]], "x double").select(scalar.rounded("x", 3).alias("x")).collect()]
    assert got[:3000] == [math.floor(v * 1000 + 0.5) / 1000 for v in x] and got[3000:] == [-1.25, 2.0, None]
    assert any(v * 1000 < math.floor(v) * 1000 + 500.5 for v in x)


def test_small_ids_meet_in_one_cell(spark, monkeypatch):
    """Ids of few points make no cells of any level, and find what grids find."""
    rows = [(i, k, [float((k * k * 31 + i * 7) % 101), float((k * 17) % 97)]) for i, n in ((1, 100), (2, 200)) for k in range(n)]
    points = spark.createDataFrame(rows, "id long, idx long, pt array<double>")
    made, cut = {}, neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df, tag: made.update({tag: cut(df, tag)}) or made[tag])
    found = {tuple(r) for r in neighbours.nearest(points).collect()}
    assert [r.id for r in made["starts"].collect()] == [2] and {r.id for r in made["candidates"].collect()} == {2}
    monkeypatch.setattr(neighbours, "cut", cut)
    monkeypatch.setattr(neighbours, "MEET", 4)
    assert len(found) == 300 and found == {tuple(r) for r in neighbours.nearest(points).collect()}


def test_radius_rounds_as_the_sql_does(spark, tmp_path):
    """Readings on a line have many equal distances; rounding then decides whether those at the radius recur."""
    rows = [(k * 1000 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=5 * i), k, "view", s * i, "{}") for k, (n, s) in enumerate((n, s) for n in (51, 60, 71) for s in (0.37, 1.13, 2.0)) for i in range(n)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as db:
        db.register("events", events)
        want = sorted(db.sql(catalog.SQL["n07_recurrence"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["n07_recurrence"](spark, str(tmp_path)).collect()))
    assert got == want and len(want) == 9


def in_slices(spark, path, name, rows):
    """The query over events (id, type, microseconds, value) whose files hold every fifth row each, and its SQL over them in order."""
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=us), i, kind, v, "{}") for k, (i, kind, us, v) in enumerate(rows)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    made = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    for k in range(5):
        made.where(F.col("event_id") % 5 == k).coalesce(1).write.mode("append").parquet(str(path / "events.parquet"))
    with duckdb.connect(config={"threads": 1}) as db:
        db.register("events", events)
        want = sorted(db.sql(catalog.SQL[name]).fetchall(), key=str)
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(path)).collect()), key=str), want


def test_means_at_a_half_add_up_in_order(spark, tmp_path):
    """Means that are a half but for rounding go up or down as they do when rows are added up in their order."""
    value = lambda i, t, k: ((i * 7919 + t * 104729 + k * 15485863) % 6007) / 100
    rows = []
    for i in range(60):
        for t in range(5):
            x = [value(i, t, k) for k in range(11)]
            rows += [(i, "abcde"[t], 0, v) for v in [*x, round(12 * (20.5 + (i + t) % 3) - sum(x) + 600, 2)]]
    got, want = in_slices(spark, tmp_path, "h10_friedman", rows)
    assert got == want and want[0][1:] == (60, 5)


def test_readings_of_a_minute_add_up_in_order(spark, tmp_path):
    """Peaks that are just 1.5 over their valley, but for the rounding of six rows of a minute, are found as the SQL finds them."""
    apart = (-0.5, 0.3, 0.2, -0.1, 0.4, -0.3)
    low = lambda i, minute: ((i * 7919 + minute // 2 * 104729) % 97) / 100 + 1
    rows = [(i, "view", minute * MINUTE, round(low(i, minute) + 1.5 * (minute % 2) + d, 2)) for minute in range(40) for i in range(60) for d in apart]
    got, want = in_slices(spark, tmp_path, "v01_excursions", rows)
    assert got == want and 100 < len(want) < 60 * 20
