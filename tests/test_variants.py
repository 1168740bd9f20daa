import json

from pagewright.operators import variants as va
from pagewright.sources import readers


def test_rules_of_any_shape(spark):
    rule = {"category": "c", "present": True, "values": [{"value": "1", "label": "one"}, {"label": "bare"}], "summary": "s"}
    texts = [
        {"programs": {"A": [rule, {"category": "d"}], "B": {"category": "e", "present": "no", "values": 7}}},
        {"programs": [{"program": "C", "rules": [{"category": "f", "present": "perhaps", "values": ["x", 2.5, None, {"value": [1]}]}]}, {"program": "D"}]},
        {"programs": None}, {"other": 1}, [], 7,
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(90, "no json"), (91, None), (92, "")]
    made = va.flat_rules(spark.createDataFrame(rows, "i int, t string"), "t", ["i"]).collect()
    assert sorted(map(tuple, made), key=repr) == sorted([
        (0, "A", "c", True, "one", "1", "s"), (0, "A", "c", True, "bare", None, "s"), (0, "A", "d", None, None, None, None), (0, "B", "e", False, None, "7", None),
        (1, "C", "f", None, None, "x", None), (1, "C", "f", None, None, "2.5", None), (1, "C", "f", None, None, None, None), (1, "C", "f", None, None, "[1]", None),
    ], key=repr)


def test_rules_of_the_plain_shape_are_those_of_the_schema(spark, tmp_path):
    nested = {"programs": {"P": [{"category": "c", "present": True, "values": [{"value": "1", "label": "l"}], "summary": None}, {"category": "d", "present": None, "values": [], "summary": "s"}]}}
    (tmp_path / "r.json").write_text(json.dumps(nested))
    text = spark.read.text(f"{tmp_path}/r.json", wholetext=True)
    assert sorted(map(tuple, va.flat_rules(text, "value").collect()), key=repr) == sorted(map(tuple, readers.rules(spark, f"{tmp_path}/r.json").collect()), key=repr)


def test_keys_of_payloads(spark):
    rows = [(1, '{"k": 5, "new": {"a": 1}}'), (2, '{"k": "five"}'), (3, "[1]"), (4, "{}"), (5, None), (6, "bad")]
    made = va.payload_keys(spark.createDataFrame(rows, "i int, t string"), "t", ["i"]).collect()
    assert sorted(map(tuple, made)) == [(1, "k", "BIGINT", "5"), (1, "new", "OBJECT<a: BIGINT>", '{"a":1}'), (2, "k", "STRING", "five")]
    assert va.payload_keys(spark.createDataFrame([], "i int, t string"), "t").count() == 0
