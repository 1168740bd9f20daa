import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.operators import summaries as sm

ROWS = "a string, b string, x long, v double"


def sample(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["p", "p", "p", "q", None]), rng.choice("st"), rng.choice([None, *range(12)]), rng.choice([None, 1.0, 2.5])) for _ in range(n)]


@pytest.mark.parametrize("sets", [sm.cube_sets(["a", "b"]), sm.rollup_sets(["a", "b"]), [("b",), ()]])
def test_subtotals_are_as_brute_force(spark, sets):
    rows = sample()
    made = sm.subtotals(spark.createDataFrame(rows, ROWS), ["a", "b"], sets, {"n": F.lit(1), "v": F.col("v")}, {"xs": F.col("x"), "vs": F.col("v")})
    expected = {}
    for s in sets:
        level = sum(bit for d, bit in (("a", 2), ("b", 1)) if d not in s)
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(r["ab".index(d)] if d in s else None for d in "ab")].append(r)
        for k, g in groups.items():
            vs = [r[3] for r in g if r[3] is not None]
            expected[(*k, level)] = (len(g), sum(vs) if vs else None, len({r[2] for r in g} - {None}), len(set(vs)))
    assert {(r.a, r.b, r.level): (r.n, r.v, r.xs, r.vs) for r in made.collect()} == expected


def test_subtotals_expand_groups_and_not_rows(spark):
    rows = spark.range(50_000).select(F.lit("hot").alias("a"), F.lit("s").alias("b"), (F.col("id") % 10).alias("x"))
    made = sm.subtotals(rows, ["a", "b"], sm.cube_sets(["a", "b"]), {"n": F.lit(1)}, {"xs": F.col("x")})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan and all("Aggregate" in plan[plan.index(part) :] for part in plan.split() if part.startswith("Expand"))
    assert sorted((r.level, r.n, r.xs) for r in made.collect()) == [(i, 50_000, 10) for i in range(4)]
    assert sm.subtotals(rows.limit(0), ["a", "b"], sm.rollup_sets(["a", "b"]), {"n": F.lit(1)}).where("level < 3").count() == 0


def test_sketches_merge_to_those_of_one_pass(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("source"), (F.xxhash64("id") % 20_000).alias("user"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("value"))
    sm.sketched(rows, ["day", "source"], F.col("user"), F.col("value")).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    merged = {r.source: r for r in sm.estimates(sm.merged_sketches(kept, ["source"]), [0.1, 0.5, 0.99]).collect()}
    once = {r.source: r for r in sm.estimates(sm.sketched(rows, ["source"], F.col("user"), F.col("value")), [0.1, 0.5, 0.99]).collect()}
    for source, r in merged.items():
        mine = rows.where(F.col("source") == source)
        true = mine.agg(F.count_distinct("user")).first()[0]
        assert r.n == once[source].n == mine.count()
        assert r.distinct_estimate == once[source].distinct_estimate and abs(r.distinct_estimate - true) <= sm.DISTINCT_ERROR * true
        known = mine.where("value is not null")
        for rank, q in zip((0.1, 0.5, 0.99), r.quantiles, strict=True):
            below, upto = known.agg(F.avg((F.col("value") < q).cast("int")), F.avg((F.col("value") <= q).cast("int"))).first()
            assert below - sm.RANK_ERROR <= rank <= upto + sm.RANK_ERROR


@pytest.mark.parametrize("salts,k", [(1, 3), (7, 3), (64, 1)])
def test_best_of_each(spark, salts, k):
    rows = [(i, *r) for i, r in enumerate(sample(300, 5))]
    made = sm.best_of_each(spark.createDataFrame(rows, f"i int, {ROWS}"), ["a"], [F.col("v").desc_nulls_last(), F.col("i")], k, salts)
    expected = []
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
        expected += [(r[0], n) for n, r in enumerate(mine[:k], 1)]
    assert sorted((r.i, r["rank"]) for r in made.collect()) == sorted(expected)


def test_best_of_a_hot_key_meets_in_few_rows(spark):
    """Of 100,000 rows of one key the last task ranks salts * k at most."""
    rows = spark.range(100_000).withColumn("k", F.lit(1)).repartition(8)
    made = sm.best_of_each(rows, ["k"], [F.col("id").desc()], 5, 16)
    assert [r.id for r in made.orderBy("rank").collect()] == list(range(99_999, 99_994, -1))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "__salt" in plan


def test_multisets_are_as_counters(spark):
    left, right = [r[:3] for r in sample(200, 2)], [r[:3] for r in sample(150, 3)]
    kind = "a string, b string, x long"
    ldf, rdf = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind).select("x", "b", "a")
    one, two = Counter(left), Counter(right)
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(sm.left_over(ldf, rdf)) == one - two and rows(sm.in_both(ldf, rdf)) == one & two
    assert rows(sm.without_match(ldf, rdf.where("x < 5 or x is null"), ["a", "x"])) == Counter(r for r in left if (r[0], r[2]) not in {(q[0], q[2]) for q in right if q[2] is None or q[2] < 5})
    assert rows(sm.reconciled(ldf, rdf)) == Counter((*r, one[r], two[r]) for r in {*one, *two} if one[r] != two[r])
    assert sm.left_over(ldf.limit(0), rdf).count() == 0 and rows(sm.reconciled(ldf, rdf.limit(0))) == Counter((*r, n, 0) for r, n in one.items())


def test_filters_of_reconciled_rows_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(sample(), ROWS).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t").select("a", "x")
    plan = sm.reconciled(table, table.where("x > 3")).where("a = 'q'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(a,q)") >= 2
