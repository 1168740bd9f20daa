import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import edits, metrics
from pagewright.operators.fuzzy import candidates, fuzzy_join, fuzzy_pairs, texts_of


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pair(rng, n, letters="abc"):
    a = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    b = list(a)
    for _ in range(rng.randint(0, max(1, len(a) // 3))):
        at = rng.randint(0, len(b))
        b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
    return a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))


@pytest.mark.parametrize("kept", [edits.KEPT, 60, 1])
def test_edits_are_as_the_table(monkeypatch, kept):
    monkeypatch.setattr(edits, "KEPT", kept)
    rng = random.Random(kept)
    for n in [3, 12, 40, 90] * 40 + [700]:
        a, b = pair(rng, n)
        d = plain(a, b)
        assert edits.distance(a, b) == d == edits.distance(list(a), list(b))
        put, gone, new = edits.counts(a, b)
        assert put + gone + new == d and gone - new == len(a) - len(b) and min(put, gone, new) >= 0
        for most in (0, d - 1, d, d + 1):
            assert edits.distance(a, b, most) == (d if d <= most else None) or most < 0


def test_edits_of_long_texts():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij ") for _ in range(100_000))
    b = "".join("" if rng.random() < 0.02 else c + "q" * (rng.random() < 0.03) for c in a)
    began = time.perf_counter()
    d = edits.distance(a, b)
    assert time.perf_counter() - began < 30
    assert 3000 < d < 6000 and edits.distance(a, b, 2000) is None and edits.distance(a, b[: 90_000], 3000) is None
    assert sum(edits.counts(a[:20_000], b[:20_000])) == edits.distance(a[:20_000], b[:20_000])


def test_edit_columns(spark):
    rng = random.Random(5)
    rows = [(i, *pair(rng, 60, "aกé😀")) for i in range(200)] + [(900, None, "a"), (901, "a", None), (902, "", ""), (903, "", "abc")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    letters = lambda c: F.split(c, "")
    made = df.select("i", "a", "b", F.levenshtein("a", "b").alias("native"), edits.edit_distance(F.col("a"), F.col("b")).alias("d"), edits.edit_distance(F.col("a"), F.col("b"), 3).alias("near"), edits.edit_counts(F.col("a"), F.col("b")).alias("c"), edits.edit_distance(letters("a"), letters("b")).alias("words")).collect()
    for r in made:
        assert r.d == r.native and r.near == (r.native if r.native is not None and r.native <= 3 else None)
        assert r.c is None if r.native is None else (r.c.distance == r.native == r.c.substitutions + r.c.deletions + r.c.insertions)
        assert r.words == r.native or "" in (r.a, r.b)


def test_error_rates_of_short_and_long_texts_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, *(t.replace("c", " ") for t in pair(rng, 80))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    rates = lambda: df.select("i", metrics.char_error_rate(F.col("a"), F.col("b")).alias("cer"), metrics.word_error_rate(F.col("a"), F.col("b")).alias("wer"), metrics.word_error_rate(F.col("a"), F.col("b"), "whitespace").alias("plain")).collect()
    before = rates()
    monkeypatch.setattr(metrics, "SHORT_CELLS", 0)
    assert rates() == before


def names(rng, n, longest):
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return base + [pair_of[1] for pair_of in ((b, "".join(c for c in b if rng.random() > 0.03) + rng.choice(["", "z"])) for b in base)]


@pytest.mark.parametrize("most,short,longest", [(1, 40, 12), (2, 40, 9), (2, 5, 60), (1, 3, 30), (0, 4, 6), (3, 7, 50)])
def test_fuzzy_pairs_are_as_brute_force(spark, most, short, longest):
    rng = random.Random(most * 100 + longest)
    left, right = names(rng, 60, longest), names(rng, 60, longest)
    right += left[::3]
    ldf, rdf = (spark.createDataFrame([(x,) for x in [*side, None]], f"{n} string") for side, n in ((left, "a"), (right, "b")))
    made = {(r.left_text, r.right_text): r.edits for r in fuzzy_pairs(ldf, rdf, "a", "b", most, short).collect()}
    expected = {(a, b): d for a in set(left) for b in set(right) if abs(len(a) - len(b)) <= most and (d := plain(a, b)) <= most}
    assert made == expected and expected


def test_fuzzy_candidates_are_few(spark):
    """Of 4 million pairs of names, those compared are few more than those alike."""
    rng = random.Random(3)
    left = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([12, 60]))),) for _ in range(2000)], "text string")
    right = left.select(F.concat(F.substring("text", 1, 5), F.expr("substring(text, 7, 100)")).alias("text"))
    assert candidates(texts_of(left, "text"), texts_of(right, "text"), 2).count() < 2200


def test_fuzzy_keys_are_never_broadcast(spark, tmp_path):
    path = f"{tmp_path}/texts"
    spark.range(500).selectExpr("concat('label ', id) as a", "concat('lobel ', id) as b").write.parquet(path)
    rows = spark.read.parquet(path)
    made = fuzzy_pairs(rows.select("a"), rows.select("b"), "a", "b")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("replace(left_text, 'a', 'o') = right_text and edits = 1").count() == 500


def test_fuzzy_join_of_rows(spark):
    ldf = spark.createDataFrame([(1, "anna"), (1, "anna"), (2, "bo"), (3, None)], "i int, a string")
    rdf = spark.createDataFrame([(7, "ana"), (8, "bo"), (9, None)], "j int, b string")
    assert sorted(tuple(r) for r in fuzzy_join(ldf, rdf, "a", "b", 1).select("i", "j", "edits").collect()) == [(1, 7, 1), (1, 7, 1), (2, 8, 0)]
    assert fuzzy_join(ldf.limit(0), rdf, "a", "b").count() == 0
