import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import fields, metrics
from pagewright.functions import text as tx


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    alphabet = "ab 09\t\n\r\x0b\x1c\x85 -/+@._กาที่๐๑é:|"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(3000)] + ["0" * 9 + "12", "+66123456789", "a1/2/34"]


def test_strip_and_lines_are_as_in_python(spark, strings):
    assert column(spark, strings, tx.strip) == [s.strip() for s in strings]
    assert column(spark, strings, tx.without_space) == [re.sub(r"\s+", "", s) for s in strings]
    assert column(spark, strings, tx.split_lines) == [s.splitlines() for s in strings]


@pytest.mark.parametrize(
    ("make", "pattern"),
    [
        (fields.date, r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"),
        (fields.numeric_id, r"\b\d{8,12}\b"),
        (fields.phone, r"(?:\+?66|0)\d{8,9}\b"),
    ],
)
def test_fields_are_as_in_python(spark, strings, make, pattern):
    rng = random.Random(2)
    digits = ["".join(rng.choice("0123456789-/กที่ ๓+6") for _ in range(rng.randint(6, 20))) for _ in range(3000)]
    whole = strings + digits
    found = [re.search(pattern, s.replace("-", "") if make is fields.phone else s) for s in whole]
    assert column(spark, whole, make) == [m[0] if m else None for m in found]


def test_ids_next_to_thai(spark):
    given = ["01236048 ปฏิ", "๐๑๒๓๔๕๖๗", "รหัส01236048", "ที่01236048", "_01236048", "01236048ก"]
    assert column(spark, given, fields.numeric_id) == ["01236048", "๐๑๒๓๔๕๖๗", None, "01236048", None, None]
    assert column(spark, ["วันที่12/05/2560", "๑๒/๐๕/๒๕๖๐"], fields.date) == ["12/05/2560", "๑๒/๐๕/๒๕๖๐"]


def test_fields_that_are_missing_leave_no_key(spark):
    assert column(spark, ["", "id 12345678", None], fields.fields_json) == ["{}", '{"numeric_id":"12345678"}', "{}"]


def test_normalized(spark):
    given = ["a\r\nb", "a \t b", "a\n\n\n\nb", " \n a", None]
    assert column(spark, given, metrics.normalized) == ["a\n\nb", "a b", "a\n\nb", "a", None]
    once = column(spark, given, metrics.normalized)
    assert column(spark, once, metrics.normalized) == once


def rates(spark, pairs, make):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r[1] for r in rows.select("i", make(F.col("a"), F.col("b"))).orderBy("i").collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_char_error_rate(spark):
    pairs = [("", ""), ("", "x"), ("a b", "ab"), ("กา", "ก"), ("a", "bcd"), ("same text", "same text")]
    assert rates(spark, pairs, metrics.char_error_rate) == [0.0, 1.0, 0.0, 0.5, 3.0, 0.0]


@pytest.mark.parametrize("tokenizer", ["compat", "whitespace"])
def test_word_error_rate_against_brute_force(spark, tokenizer):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["a", "b", "cc", "d\ne", "f"]) for _ in range(rng.randint(1, 60)))
    pairs = [(text(), text()) for _ in range(60)]
    cut = (lambda s: re.sub(r"\s{2,}", " ", s).strip().split(" ")) if tokenizer == "compat" else str.split
    expected = [distance(cut(a), cut(b)) / len(cut(a)) for a, b in pairs]
    assert rates(spark, pairs, lambda a, b: metrics.word_error_rate(a, b, tokenizer)) == expected


def test_paths(spark):
    given = ["/a/b.pdf", "x.tar.gz", ".hidden", "a/.b.PNG", "dir/", "noext"]
    assert column(spark, given, tx.file_name) == ["b.pdf", "x.tar.gz", ".hidden", ".b.PNG", "dir", "noext"]
    assert column(spark, given, tx.file_stem) == ["b", "x.tar", ".hidden", ".b", "dir", "noext"]
    assert column(spark, given, tx.is_image) == [False, False, False, True, False, False]
    assert column(spark, given, tx.is_pdf) == [True, False, False, False, False, False]


def test_word_error_rate_of_long_turns_by_brute_force(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 3)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    pairs = []
    for _ in range(12):
        ref = [word() for _ in range(rng.randint(1, 400))]
        pairs.append((" ".join(ref), " ".join(w for w in ref if rng.random() > 0.2)))
    rows = spark.createDataFrame(pairs, "ref string, hyp string")
    made = rows.select("ref", "hyp", metrics.word_error_rate(F.col("ref"), F.col("hyp")).alias("wer")).collect()
    for r in made:
        assert r.wer == pytest.approx(distance(r.ref.split(), r.hyp.split()) / len(r.ref.split()))


def test_the_words_of_a_pair_are_parted_once(spark, tmp_path):
    rows = [(" ".join(f"w{i % 90}" for i in range(150)), " ".join(f"w{i % 70}" for i in range(150)))] * 400
    spark.createDataFrame(rows, "a string, b string").write.parquet(path := f"{tmp_path}/pairs")
    pairs = spark.read.parquet(path)

    def body(node, inside=False):
        """Patterns replaced within the function of an array's elements, where they are once for each element."""
        name = node.getClass().getSimpleName()
        children = [node.children().apply(i) for i in range(node.children().size())]
        return (inside and name == "RegExpReplace") + sum(body(c, inside or name == "LambdaFunction") for c in children)

    for rate in (metrics.word_error_rate, metrics.char_error_rate):
        made = pairs.select(rate(F.col("a"), F.col("b")).alias("r"))
        plan = made._jdf.queryExecution().analyzed()
        assert sum(body(plan.expressions().apply(i)) for i in range(plan.expressions().size())) == 0
        assert made.distinct().count() == 1
