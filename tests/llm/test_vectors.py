import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann, topk, vectors

KIND = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 24))
    x = (centres[rng.integers(0, 8, 900)] + 0.7 * rng.standard_normal((900, 24))).astype(np.float32)
    x[100:140] = x[99]  # copies: ties
    return x


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2050, [0.0] * 24), (None, data[0].tolist())]
    return spark.createDataFrame(rows, KIND).repartition(5)


def test_top_k_is_exact(frame, data, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 5)
    made = [tuple(r) for r in topk.top_k(frame, F.col("id") % 50 == 0, 10).orderBy("query_id", "rank").collect()]
    x = np.vstack([np.floor(1024 * data.astype(float)), np.zeros((1, 24))]).astype(np.int64)
    ids = np.array([*range(len(data)), 2050])
    expected = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:10]
        expected += [(int(ids[i]), r, int(ids[j]), int(score[j])) for r, j in enumerate(order, 1)]
    assert made == expected


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    x = np.floor(100 * rng.exponential(size=(3000, 3)))
    lists = np.argsort(x, axis=0, kind="stable")
    q = np.array([[9.0, 1.0, 1.0], [1.0, -5.0, 0.0]])
    scores, read = topk.threshold_search(q, np.array([-1, -2]), x, np.arange(3000), lists, 5, np.full(2, -np.inf))
    assert read < 2 * 3 * 3000 / 2
    for i in range(2):
        assert sorted(scores[i])[-5:] == sorted(x @ q[i])[-5:]


def test_large_components(spark):
    rows = spark.createDataFrame([(0, [1e9, 3.0]), (1, [2e5, 1.0]), (2, [-1e5, 7.0])], "vec_id long, embedding array<double>")
    made = topk.top_k(rows, F.col("id") == 0, 5, scale=1.0).collect()
    assert [(r.vec_id, r.score) for r in made] == [(1, 200000000000003), (2, -99999999999979)]


def test_nearest_recall_and_scores(frame, data, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 200)
    made = ann.nearest(frame, F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 20):
        mine = [r for r in made if r.query_id == q]
        score = unit @ unit[q]
        score[q] = -2
        best = np.sort(score)[::-1][:5]
        assert len(mine) == 5 and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) and r.vec_id != q for r in mine)
        hits += sum(r.score >= best[-1] - 1e-12 for r in mine)
        total += 5
    assert hits / total >= 0.9
    assert {r.query_id for r in made} <= set(range(0, 900, 20))


def test_copies_are_ordered_by_id(frame):
    made = ann.nearest(frame, F.col("id") == 120, 5).orderBy("rank").collect()
    assert [r.vec_id for r in made] == [99, 100, 101, 102, 103]


def test_few_or_no_rows(spark, frame):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0, 1.0])], KIND)
    assert [(r.query_id, r.vec_id) for r in topk.top_k(few, F.col("id") % 50 == 0, 10).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    assert ann.nearest(few, F.col("id") % 50 == 0, 5).count() == 2
    assert topk.top_k(frame.limit(0), F.col("id") % 50 == 0, 10).count() == 0
    assert ann.nearest(frame.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_estimates_are_near():
    rng = np.random.default_rng(3)
    for dim in (64, 100):
        x, q = rng.standard_normal((2000, dim)), rng.standard_normal((20, dim))
        code, correction = ann.codes(x)
        guess, error = ann.estimates(ann.planes(q), slice(None), code, correction)
        true = (q / ann.lengths(q)[:, None]) @ (x / ann.lengths(x)[:, None]).T
        assert code.shape == (2000, -(-dim // 64)) and (np.abs(guess - true) <= error).mean() > 0.94


def test_bit_planes_give_the_products_of_rounded_queries():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((50, 70)), rng.standard_normal((6, 70))
    code, correction = ann.codes(x)
    made = ann.planes(q)
    turned = (q / ann.lengths(q)[:, None]) @ ann.rotation(70)
    rounded = made.low[:, None] + made.step[:, None] * np.rint((turned - made.low[:, None]) / made.step[:, None])
    signs = np.where((x / ann.lengths(x)[:, None]) @ ann.rotation(70) > 0, 1, -1)
    naive = (2 * (rounded @ (signs > 0).T) - turned.sum(1, keepdims=True)) / np.sqrt(70) / correction
    assert np.allclose(ann.estimates(made, slice(None), code, correction)[0], naive)


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_repeated_query_rows_have_lists_of_their_own(spark, search):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16)).astype(np.float32)
    ids = [*range(1, 58), 100, 100, 100]
    x[58] = x[57]  # one row twice, and one more vector under the same id
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], KIND).withColumn("id", F.lit("clash"))
    made = [tuple(r) for r in search(rows.repartition(3), F.col("id") == 100, 4).collect()]
    wide = np.floor(1024 * x.astype(float)) if search is topk.top_k else x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    expected = []
    for q in (57, 58, 59):
        score = wide[:57] @ wide[q]
        expected += [(100, r, ids[j]) for r, j in enumerate(np.argsort(-score)[:4], 1)]
    assert sorted(r[:3] for r in made) == sorted(expected)


def test_repeated_candidates_count_each(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.1, 0.0])], KIND)
    assert [r.vec_id for r in topk.top_k(rows, F.col("id") == 0, 10).orderBy("rank").collect()] == [1, 1, 1, 2]


def test_ordered_ids_fall_on_many_shelves(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rows = spark.range(4096).select(F.col("id"), F.array(F.lit(1.0)).alias("v")).coalesce(2)
    packed = vectors.blocks(rows.select(F.lit(0).alias("chunk"), "id", "v"))
    shelf = F.pmod(F.xxhash64("longs"), F.lit(16))
    assert packed.count() == 64 and packed.select(shelf).distinct().count() >= 12


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_both_ways_of_scoring_agree(monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(6)
    x = np.floor(50 * rng.standard_normal((500, 8)))
    q = np.floor(50 * rng.standard_normal((7, 8)))
    lists = np.argsort(x, axis=0, kind="stable")
    scores, _ = topk.threshold_search(q, np.arange(7), x, np.arange(500), lists, 5, np.full(7, -np.inf))
    for i in range(7):
        true = x @ q[i]
        true[i] = -np.inf
        assert np.array_equal(np.sort(scores[i])[-5:], np.sort(true)[-5:])
