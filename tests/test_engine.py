"""The engine's queries against DuckDB, and kernels and edge cases against closed forms."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoglass import catalog
from chronoglass.functions.scalar import DAY, MINUTE
from chronoglass.operators import cleaning as C
from chronoglass.operators import dynamics as D
from chronoglass.operators import models as M
from chronoglass.operators import dynamics, events, joins, models, series, stats
from chronoglass.plans.spec import ColumnSpec, assert_complete, conform, validate
from chronoglass.sources import tables
from chronoglass.streaming import live


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(df):
    def one(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return x if isinstance(x, str) else round(float(x), 5)

    return sorted(str(tuple(map(one, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["g00_metric_row", "e02_split", "r02_interpolate", "r04_densify", "w16_merge_events", "j04_nearest", "j05_interval", "n14_box_dimension", "h05_agreement", "h17_thresholds", "w13_phase_runs", "v01_excursions", "v03_decay", "v06_challenges", "v08_curves", "v10_envelope", "h09_paired", "h10_rank_sum", "h10_friedman", "h14_partial_spearman", "h15_redundancy", "h31_screening"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert plain(catalog.QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.sql(catalog.SQL[name]).df())


def grid_of(spark, values, step=5, start=0):
    return spark.createDataFrame([(1, (start + i * step) * MINUTE, None if v is None else float(v)) for i, v in enumerate(values)], "id long, us long, v double")


def test_gap_equal_to_threshold_stays(spark):
    rows = [(1, 0, 1.0), (1, 45 * MINUTE, 2.0), (1, 91 * MINUTE, 3.0)]
    got = series.segments(spark.createDataFrame(rows, "id long, us long, v double"), 45).orderBy("us").collect()
    assert [r.seg for r in got] == [0, 0, 1]
    assert series.segments(spark.createDataFrame(rows, "id long, us long, v double"), 45, 2).count() == 2


def test_densify_edges(spark):
    rows = [(i, u * MINUTE // 10, 1.0) for i, g in enumerate((40, 45, 75, 150, 151)) for u in (0, g)]
    got = series.densify(spark.createDataFrame(rows, "id long, us long, v double"), 3, 4, 15).groupBy("id").agg(F.count("*").alias("n"), F.count("v").alias("k")).orderBy("id").collect()
    assert [(r.n, r.k) for r in got] == [(2, 2), (3, 3), (3, 3), (6, 6), (3, 2)]


def test_regularize_lone_reading(spark):
    got = series.regularize(spark.createDataFrame([(1, 2 * MINUTE, 5.0)], "id long, us long, v double"), 5, 15).collect()
    assert [(r.us, r.v) for r in got] == [(0, 5.0), (5 * MINUTE, None)]


def test_spec():
    spec = [ColumnSpec("id", "categorical", "id"), ColumnSpec("time", "date", "time"), ColumnSpec("gl", "real_valued", "target")]
    validate(spec)
    with pytest.raises(ValueError):
        validate(spec[1:])


def test_sources(spark, tmp_path):
    (tmp_path / "s7.csv").write_text("time,gl\n2026-01-01 00:00:00,5.5\n2026-01-01 00:05:00,\n")
    df = tables.named_files(spark, f"{tmp_path}/*.csv", "time string, gl double", r"([^/]+)\.csv$")
    spec = [ColumnSpec("id", "categorical", "id"), ColumnSpec("time", "date", "time"), ColumnSpec("gl", "real_valued", "target")]
    out = assert_complete(conform(df, spec))
    assert [(r.id, r.gl) for r in out.collect()] == [("s7", 5.5)]
    doc = tmp_path / "c.json"
    doc.write_text('{"cohort": "x", "subjects": [{"id": "a", "label": 1, "timestamps": ["2026-01-01T00:00:00", "2026-01-01T00:05:00"], "values": [5.0, null]}]}')
    rows = tables.cohort_documents(spark, str(doc)).orderBy("pos").collect()
    assert [r.v for r in rows] == [5.0, None]
    wide = tables.wide_minutes(spark.createDataFrame([("a", 1.0, 2.0)], "ID string, `0` double, `5` double"), ["ID"])
    assert {(r.minute, r.v) for r in wide.collect()} == {(0, 1.0), (5, 2.0)}


def test_nearest_takes_the_earlier_on_ties(spark):
    e = spark.createDataFrame([(1, 9, 100)], "id long, ev long, at long")
    r = spark.createDataFrame([(1, 95, 1.0), (1, 105, 2.0), (1, 300, 3.0)], "id long, us long, v double")
    assert [tuple(x) for x in joins.nearest(e, r, 5).collect()] == [(1, 9, 100, 95, 1.0)]
    assert joins.nearest(e, r, 4).count() == 0


def test_kernels():
    sine = 6 + np.sin(2 * np.pi * np.arange(576) / 72.3)  # no whole period: equal distances would tie at the threshold
    noise = 6 + np.random.default_rng(0).normal(0, 0.4, 576)
    assert dynamics.rqa(sine, 18, 2)["det"] >= 0.95 > dynamics.rqa(noise, 1, 2)["det"]
    assert 10 < dynamics.tau_of(sine, 60, 30) < 20 and dynamics.tau_of(noise, 60, 30) == 1
    assert dynamics.sample_entropy(sine) < dynamics.sample_entropy(noise)
    assert np.allclose(dynamics.low_pass(np.full(50, 7.0)), 7.0)
    assert np.allclose(np.abs(np.fft.rfft(dynamics.surrogate(noise, 1))), np.abs(np.fft.rfft(noise)))
    assert dynamics.simplex(sine, 3) > 0.99 and dynamics.rqa(np.full(100, 6.0), 1, 2)["det"] == 0.0


def test_constant_series_metrics(spark):
    row = dynamics.permutation_entropy(grid_of(spark, [6.0] * 50)).first()
    assert row.entropy == 0
    assert dynamics.angular_velocity(grid_of(spark, [6.0] * 50)).first() is None


def test_statistics():
    assert stats.sign_test(np.array([1, 1, 1, 1, -1])) == pytest.approx(0.375)
    lo, hi = stats.clopper_pearson(0, 10)
    assert lo == 0 and hi == pytest.approx(0.3085, abs=1e-3)
    x = np.random.default_rng(1).normal(size=(200, 3))
    assert np.allclose(models.ridge(x, 1 + x @ [1, 2, 3], 1e-9), [1, 1, 2, 3])
    assert (models.nonnegative_ridge(x, x @ [1, -1, 2], 0.1) >= 0).all()
    y = (x[:, 0] > 0).astype(float)
    assert models.logistic(x, y)[1] > 1


def test_excursion_of_known_decay(spark):
    """Up 4 in 12 steps, then an exponential decay of 45 minutes."""
    values = [5.5] * 6 + [5.5 + 4 * k / 12 for k in range(1, 13)] + [5.5 + 4 * math.exp(-5 * k / 45) for k in range(1, 30)]
    row = events.excursions(grid_of(spark, values)).first()
    assert row.amplitude == pytest.approx(4) and row.tau == pytest.approx(45, rel=1e-6) and row.r2 == pytest.approx(1)
    assert row.relax == 35 and row.crossing == pytest.approx(45 * math.log(2), abs=0.3)
    assert events.excursions(grid_of(spark, [6.0] * 20)).count() == 0


def test_rise_and_its_rest(spark):
    hump = [6 + 2 * math.exp(-(((k - 20) / 6) ** 2)) for k in range(60)]
    got = events.rise_rows(grid_of(spark, [6.0] * 12 + hump + [6.0] * 60, start=8 * 60), 5).collect()
    assert len(got) == 1 and got[0].recovered and 1.5 < got[0].amplitude <= 2 and got[0].debt > 0
    assert events.rise_rows(grid_of(spark, [6.0] * 12 + hump + [6.0] * 60, start=22 * 60), 5).count() == 0


def test_paired_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (4.0, 4.0), (7.0, 2.0), (None, 1.0)], "a double, b double")
    row = stats.paired(df, "a", "b").first()
    assert (row.n, row.up, row.down, row.signed) == (4, 2, 1, 5.0)
    assert stats.rank_sum(spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x double, y int"), "x", "y").first().u == 4


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    os.symlink(f"{sf_dir}/events.parquet", tmp_path / "in" / "a.parquet")
    rows = lambda df: df.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    q = live.tumbling(rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "ts", "6 hours", "60 days").writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        q.processAllAvailable()
        got = {(r.id, r.start, r.n) for r in spark.table("live").collect()}
    finally:
        q.stop()
    batch = rows(spark.read.parquet(f"{sf_dir}/events.parquet")).groupBy("id", F.window("ts", "6 hours").alias("w")).count()
    assert got == {(r.id, r.w.start, r["count"]) for r in batch.collect()}


def test_day_constant():
    assert DAY == 1440 * MINUTE


def test_effective_dimension_of_trivial_signals():
    i = np.arange(576)
    sine = 6 + np.sin(2 * np.pi * i / 72)
    noise = 6 + np.random.default_rng(0).normal(0, 0.4, 576)
    assert D.effective_dimension(sine, 18, 5) == 2 and D.effective_dimension(noise, 1, 5) == 5
    assert D.effective_dimension(np.full(100, 6.0), 1, 3) is None and D.effective_dimension(sine[:3], 1, 4) is None
    assert D.rqa(sine, 18, 2)["det"] >= 0.9 > D.rqa(noise, 1, 2)["det"]


def test_recurrence_lines_against_every_cell():
    rng = np.random.default_rng(4)
    v = np.cumsum(rng.normal(size=90))
    v[[20, 55, 56]] = np.nan
    p, at = D.points(v, 2, 2)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    far = at[None, :] - at[:, None] > 5
    rec, lines = (d < np.quantile(d[far], 0.05)) & far, []
    for k in range(6, len(p)):
        run = 0
        for i in range(len(p) - k):
            if run and (not rec[i, i + k] or at[i] - at[i - 1] != 1 or at[i + k] - at[i + k - 1] != 1):
                lines.append(run)
                run = 0
            run += int(rec[i, i + k])
        lines += [run] if run else []
    got = D.rqa(v, 2, 2)
    assert np.isclose(got["det"], sum(x for x in lines if x > 1) / sum(lines)) and np.isclose(got["rr"], rec.sum() / far.sum())


def test_nonnegative_ridge_meets_its_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x @ np.array([2, 0, -1, 0.5, 0, -3]) + rng.normal(size=200)
    w = M.nonnegative_ridge(x, y, 0.7)
    slope = x.T @ (x @ w - y) + 0.7 * w
    assert (w >= 0).all() and np.abs(slope[w > 0]).max() < 1e-6 and (slope[w == 0] >= -1e-6).all()


@pytest.mark.parametrize("name", [k for k, f in catalog.QUERIES.items() if f.__module__.endswith("catalog_cleaning")])
def test_cleaning_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = lambda x: sorted((tuple(r) for r in x), key=lambda r: [(v is None, 0 if v is None else v) for v in r])
    mine, theirs = rows(got.select(*columns).collect()), rows(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True))


def test_one_to_one_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, a string"), spark.createDataFrame([(1, "x"), (1, "y")], "k long, b string")
    with pytest.raises(Exception, match="comes twice"):
        C.one_to_one(left, right, ["k"]).collect()


def test_positions_are_dropped_twice(spark):
    rows = spark.createDataFrame([(1, k, float(k)) for k in range(6)], "id long, us long, v double")
    assert [r.us for r in C.drop_positions(rows, "us", [0, 2]).orderBy("us").collect()] == [3, 5]
    assert [r.us for r in C.drop_positions(rows, "us", [0, 2], times=1).orderBy("us").collect()] == [1, 3, 4, 5]
