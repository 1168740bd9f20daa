import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators.joins import merge_template, with_ground_truth
from pagewright.operators.slices import with_place

ROW = "pos long, code string, name_th string, name_en string, credits string, year int, semester int"


@pytest.mark.parametrize("slice_rows", [10**6, 20, 1])
def test_places_within_a_key(spark, slice_rows):
    rng = random.Random(slice_rows)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None])) for i in rng.sample(range(-500, 500), 300)]
    made = with_place(spark.createDataFrame(rows, "t long, k string"), F.col("k"), F.col("t"), "n", slice_rows)
    assert made.columns == ["t", "k", "n"]
    expected = {(t, k): sum(1 for u, m in rows if m == k and u <= t) for t, k in rows}
    assert {(r.t, r.k): r.n for r in made.collect()} == expected


@pytest.mark.parametrize("slice_rows", [10**6, 10])
def test_template_takes_the_nth_of_its_code(spark, slice_rows):
    rng = random.Random(1)
    code = lambda: rng.choice([None, None, "c1", "c2", "c3"])
    template = [(i, code(), rng.choice(["", None, "own"]), None, None, rng.choice([None, 1]), None) for i in range(80)]
    parsed = [(i, code(), f"th{i}", f"en{i}", rng.choice(["", "3"]), 9, None) for i in range(60)]
    made = merge_template(spark.createDataFrame(template, ROW), spark.createDataFrame(parsed, ROW), slice_rows)
    expected, seen = [], {}
    for pos, c, th, en, cr, year, sem in template:
        nth = seen[c] = seen.get(c, 0) + 1
        match = next((p for k, p in enumerate((q for q in parsed if q[1] == c), 1) if k == nth), None)
        given = lambda mine, i: mine or (match[i] or None if match else None) or mine  # noqa: E731, B023
        expected.append((pos, c, given(th, 2), given(en, 3), given(cr, 4), year if year is not None else match and match[5], sem))
    assert sorted(map(tuple, made.collect())) == sorted(expected)


@pytest.mark.parametrize("placed", [True, False])
def test_truth_by_name_then_stem(spark, placed):
    truth = [(1, "a.pdf", "first"), (2, "a.pdf", "last"), (3, "b.pdf", ""), (4, "b", "stem b"), (5, "c", ""), (6, "d", None), (7, "e.pdf", "was"), (8, "e.pdf", ""), (9, "e", "stem e"), (10, None, "no key")]
    frame = spark.createDataFrame(truth, "at long, key string, reference string")
    paths = ["in/a.pdf", "x/a.pdf", "in/b.pdf", "in/c.pdf", "d.pdf", "e.pdf", "none.pdf", None, "in/a.pdf"]
    predictions = spark.createDataFrame([(p, f"text {i}") for i, p in enumerate(paths)], "source_path string, text string").withColumn("reference", F.lit("clash"))
    made = with_ground_truth(predictions, frame if placed else frame.drop("at"), strict=False)
    found = {"in/a.pdf": "last", "x/a.pdf": "last", "in/b.pdf": "stem b", "in/c.pdf": "", "e.pdf": "stem e" if placed else "was"}
    assert sorted((r.text, r.reference) for r in made.collect()) == [(f"text {i}", found.get(p)) for i, p in enumerate(paths)]


def test_truth_is_fetched_once(spark):
    """Texts of truth and of predictions pass one join by path; keys are settled without them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        truth = spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("reference"))
        predictions = spark.range(100).select(F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("source_path"), F.lit("t").alias("text"))
        plan = with_ground_truth(predictions, truth, strict=False)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("text#") > 0 and plan.count("Join") == 4


def test_missing_truth_is_an_error(spark):
    truth = spark.createDataFrame([("a", "x")], "key string, reference string")
    predictions = spark.createDataFrame([("b.pdf", "t")], "source_path string, text string")
    with pytest.raises(Exception, match="No ground truth found for b.pdf"):
        with_ground_truth(predictions, truth).collect()
