import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators.timejoins import as_of_join, interval_join, interval_totals

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def latest(left, right, equal, tolerance):
    out = []
    for i, key, t in left:
        fit = [(u, v) for k, u, v in right if None not in (key, t, k, u) and k == key and (u <= t if equal else u < t)]
        best = max(fit, default=None)
        out.append((i, best[1] if best and (tolerance is None or (t - best[0]) * 60 <= tolerance) else None))
    return sorted(out)


@pytest.mark.parametrize("equal,tolerance,slice_rows", [(True, None, 10**6), (True, 1800, 7), (False, None, 25), (False, 600, 1)])
def test_as_of_join_is_as_brute_force(spark, equal, tolerance, slice_rows):
    rng = random.Random(slice_rows)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(0, 300)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(0, 300, 7)]), rng.randint(0, 99)) for _ in range(200)]
    ldf = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i int, k string, t timestamp").withColumn("V", F.lit("clash"))
    rdf = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, u timestamp, v int")
    made = as_of_join(ldf, rdf, ["k"], "t", "u", ["v"], tolerance, equal, slice_rows)
    assert made.columns == ["i", "k", "t", "v"]
    assert sorted((r.i, r.v) for r in made.collect()) == latest(left, right, equal, tolerance)


def test_as_of_join_cuts_a_hot_key(spark):
    """A key that holds most rows is dealt to many runs, of about slice_rows rows each."""
    from pagewright.operators.slices import sliced

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("__k"), (F.col("id") * F.col("id")).alias("__t"))
    sizes = sliced(rows, 1000).groupBy("__k", "__slice").count().where("__k = 'hot'").collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) < 1500


def test_as_of_join_of_empty_tables(spark):
    ldf, rdf = spark.createDataFrame([(1, "a", DAY)], "i int, k string, t timestamp"), spark.createDataFrame([("a", DAY, 1)], "k string, u timestamp, v int")
    assert as_of_join(ldf.limit(0), rdf, ["k"], "t", "u", ["v"]).count() == 0
    assert [r.v for r in as_of_join(ldf, rdf.limit(0), ["k"], "t", "u", ["v"]).collect()] == [None]


@pytest.mark.parametrize("by,cell", [([], 4096), (["k"], 4096), ([], 3), (["k"], 2)])
def test_interval_join_is_as_brute_force(spark, by, cell):
    rng = random.Random(cell)
    points = [(i, rng.choice("aab") if i % 9 else None, rng.choice([None, *range(-50, 1000)])) for i in range(200)] + [(500, "a", 5)] * 3
    spans = []
    for j in range(150):
        s = rng.randint(-60, 900)
        spans.append((j, rng.choice("aab") if j % 8 else None, s if j % 11 else None, s + rng.choice([0, -3, 1, 2, 40, 5000])))
    pdf = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "i int, k string, t timestamp")
    sdf = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in spans], "j int, k string, s timestamp, e timestamp")
    if not by:
        pdf, sdf = pdf.drop("k"), sdf.drop("k")
    made = interval_join(pdf, sdf, "t", "s", "e", by, cell)
    same = lambda a, b: not by or (a is not None and a == b)
    expected = sorted((i, j) for i, k, t in points for j, m, s, e in spans if None not in (t, s) and s <= t < e and same(k, m))
    assert sorted((r.i, r.j) for r in made.collect()) == expected and expected


def test_interval_join_bounds_a_cell(spark):
    """Spans that all cover one moment, and points that all lie there, meet in cells of bounded size; a span lies in two bins at most."""
    pdf = spark.range(3000).select(F.col("id").alias("i"), F.timestamp_micros(F.col("id") + 10**12).alias("t"))
    sdf = spark.range(2000).select(F.col("id").alias("j"), F.timestamp_micros(F.lit(10**12) - F.col("id")).alias("s"), F.timestamp_micros(F.lit(10**12 + 3000)).alias("e"))
    made = interval_join(pdf, sdf, "t", "s", "e", cell=100)
    assert made.count() == 3000 * 2000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_interval_join_of_empty_tables(spark):
    pdf, sdf = spark.createDataFrame([(1, DAY)], "i int, t timestamp"), spark.createDataFrame([(1, DAY, at(1))], "j int, s timestamp, e timestamp")
    assert interval_join(pdf.limit(0), sdf, "t", "s", "e").count() == 0 == interval_join(pdf, sdf.limit(0), "t", "s", "e").count()
    assert interval_join(pdf, sdf, "t", "s", "e").count() == 1


@pytest.mark.parametrize("slice_rows", [10**6, 20])
def test_interval_totals_are_as_brute_force(spark, slice_rows):
    rng = random.Random(slice_rows)
    points = [(i, rng.choice([None, *range(-50, 1000)])) for i in range(200)] + [(500, 5)] * 3
    spans = [(rng.choice([None, *range(-9, 9)]), s if rng.random() < 0.9 else None, s + rng.choice([0, -3, 1, 2, 40, 300])) for s in (rng.randint(-60, 900) for _ in range(80))]
    pdf = spark.createDataFrame([(i, at(t)) for i, t in points], "i int, t timestamp").withColumn("N", F.lit("clash"))
    sdf = spark.createDataFrame([(v, at(s), at(e)) for v, s, e in spans], "v int, s timestamp, e timestamp")
    made = interval_totals(pdf, sdf, "t", "s", "e", "n", ["v"], slice_rows)
    assert made.columns == ["i", "t", "n", "v"]
    over = [(i, [v for v, s, e in spans if None not in (t, s) and s <= t < e]) for i, t in points]
    total = lambda x: sum(v for v in x if v is not None) if set(x) - {None} else None
    expected = sorted((i, len(x), str(total(x))) for i, x in over if x)
    assert sorted((r.i, r.n, str(r.v)) for r in made.collect()) == expected and expected
    assert interval_totals(pdf.limit(0), sdf, "t", "s", "e", "n", ["v"]).count() == 0 == interval_totals(pdf, sdf.limit(0), "t", "s", "e", "n", ["v"]).count()


def test_interval_totals_make_no_pairs(spark):
    """20,000 spans over all of 20,000 points are 400 million pairs."""
    pdf = spark.range(20_000).select(F.col("id").alias("i"), F.timestamp_micros(F.col("id") + 10**12).alias("t"))
    sdf = spark.range(20_000).select(F.col("id").alias("v"), F.timestamp_micros(F.lit(10**12) - F.col("id")).alias("s"), F.timestamp_micros(F.lit(2 * 10**12)).alias("e"))
    made = interval_totals(pdf, sdf, "t", "s", "e", "n", ["v"], 1000)
    assert made.agg(F.min("n"), F.max("n"), F.count("*"), F.max("v")).collect() == [(20_000, 20_000, 20_000, 199_990_000)]


def test_interval_join_shuffles_what_may_meet(spark):
    """Spans of keys without points, and points in bins without spans, are gone before the shuffle; keys of two types still meet."""
    pdf = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 10).alias("k"), F.timestamp_micros(F.col("id") * 10**9).alias("t"))
    sdf = spark.range(5000).select(F.col("id").alias("j"), F.col("id").alias("k"), F.timestamp_micros(F.lit(10**9)).alias("s"), F.timestamp_micros(F.lit(2 * 10**9)).alias("e"))
    made = interval_join(pdf, sdf, "t", "s", "e", ["k"])
    assert [(r.i, r.j) for r in made.collect()] == [(1, 1)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2
    assert "SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.i, r.j) for r in interval_join(pdf, sdf.withColumn("k", F.col("k").cast("int")), "t", "s", "e", ["k"]).collect()] == [(1, 1)]
