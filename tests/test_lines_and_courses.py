import pytest
from pyspark.sql import functions as F

from pagewright.operators import courses, joins, lines
from pagewright.plans import workflows
from pagewright.sources import readers

LINES = "doc string, page int, seq int, text string, confidence double, box array<array<double>>, engine string"


def test_merge_keeps_the_best_at_the_first_place(spark):
    rows = [("A", 0.5), ("B", None), ("A ", 0.9), ("B", 0.0), ("A", 0.9), (" ", 1.0)]
    made = lines.merge_engines(spark.createDataFrame([("d", 1, i, t, c, None, "e") for i, (t, c) in enumerate(rows)], LINES), None).orderBy("seq")
    assert [(r.text, r.confidence) for r in made.collect()] == [("A ", 0.9), ("B", None)]


def test_merge_orders_by_top(spark):
    boxes = [None, [[0.0, 5.0], [9.0, 2.0]], [[1.0]], [], [[3.0, 1.0]]]
    rows = spark.createDataFrame([("d", 1, i, f"t{i}", 0.5, b, "e") for i, b in enumerate(boxes)], LINES)
    assert [r.text for r in lines.merge_engines(rows).orderBy("seq").collect()] == ["t4", "t1", "t0", "t2", "t3"]
    assert [r[0] for r in rows.orderBy("seq").select(lines.box_top(F.col("box"))).collect()] == [1e9, 2.0, 1e9, 1e9, 1.0]


def test_merge_puts_earlier_engines_first(spark):
    one = spark.createDataFrame([("d", 1, 1, "x", 0.5, None, "one")], LINES)
    two = spark.createDataFrame([("d", 1, 1, "x", 0.5, None, "two"), ("d", 1, 2, "y", 0.5, None, "two")], LINES)
    assert [(r.text, r.engine) for r in lines.merge_engines(one, two).orderBy("seq").collect()] == [("x", "one"), ("y", "two")]


@pytest.mark.parametrize(("least", "kept"), [(0.5, [None, 0.5]), (0.0, [None, 0.5, 0.49])])
def test_min_confidence(spark, least, kept):
    rows = spark.createDataFrame([(None,), (0.5,), (0.49,)], "confidence double")
    assert [r[0] for r in lines.min_confidence(rows, least).collect()] == kept


def test_pages_come_back_from_a_document(spark):
    rows = [("d", 1, 1, "x", None, None, "e"), ("d", 1, 2, " ", None, None, "e"), ("d", 2, 1, " ", None, None, "e"), ("d", 3, 1, " y", None, None, "e")]
    docs = lines.document_texts(lines.page_texts(spark.createDataFrame(rows, LINES)))
    assert docs.first().text == "--- Page 1 ---\nx\n\n--- Page 2 ---\n\n\n--- Page 3 ---\n y"
    whole = lines.documents(spark.createDataFrame(rows, LINES)).first()
    assert whole.text == docs.first().text
    assert [[x.text for x in p.lines] for p in whole.pages] == [["x", " "], [" "], [" y"]]
    back = lines.split_pages(docs).orderBy("page_index").select("page", "body").collect()
    assert [(r.page, r.body.strip("\n")) for r in back] == [(1, "x"), (2, ""), (3, " y")]


def test_split_pages_edges(spark):
    docs = spark.createDataFrame([(1, "pre--- Page 7 ---a"), (2, "no marker")], "i int, text string")
    assert [(r.i, r.page, r.body) for r in lines.split_pages(docs).orderBy("i").collect()] == [(1, 7, "a"), (2, 1, "no marker")]


def one(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_course_patterns(spark):
    given = ["12345678", "12345xxx", "1234XXXX", "xxxx", "xxx", "1234 5678", "12345678 a"]
    assert one(spark, given, courses.is_code) == [True, True, True, True, False, True, False]
    assert one(spark, ["3 (3-0-6)", "(3-0-6)", "3(3-0-6))", "a 3(2 - 3 - 6) b"], courses.credits_of) == ["3(3-0-6)", None, "3(3-0-6)", "3(2-3-6)"]
    assert one(spark, ["ab", "a", "abกขคงจฉช", "abก"], courses.looks_english) == [True, False, False, True]
    assert one(spark, ["รวม", " Total ", "x รวมตลอด", "มคอ 2", "คณะ", "totals"], courses.ends_block) == [True, True, True, True, False, False]
    assert one(spark, ["คณะ", "สจล.", "x"], lambda t: courses.ends_block(t, repair=True)) == [True, True, False]


def test_terms(spark):
    rows = spark.createDataFrame([(1,), (4,), (7,), (8,)], "i int")
    assert [tuple(r) for r in rows.select(*courses.term(F.col("i"))).collect()] == [(1, 1), (2, 2), (4, 1), (None, None)]


def test_courses_of_a_text(spark):
    text = "before\n0123 6049\nชื่อไทย\n12\n3 (3-0-6)\nDATA  structures\nก\n01236050\n01236051\nname only\nรวม\nlost\n"
    found = readers.text_lines(spark.createDataFrame([("d", text)], "doc string, text string"))
    made = workflows.extract_curriculum(found).first()
    assert made.description == "Extracted academic plan from OCR for DSBA (no_coop)"
    rows = [(c.code, c.credits, c.name_th, c.name_en, c.year, c.semester, c.note) for c in made.courses]
    assert rows == [("01236049", "3(3-0-6)", "ชื่อไทย", "DATA STRUCTURES", 1, 1, None), ("01236051", None, "name only", None, 1, 1, None)]


def test_lines_of_text_count_blank_lines(spark):
    docs = spark.createDataFrame([("d", "a\r\n\r\n b \n--- Page 3 ---\nc")], "doc string, text string")
    assert readers.text_lines(docs).count() == 1  # what stands before the first heading is left out
    rows = readers.text_lines(docs.withColumn("text", F.lit("a\r\n\r\n b "))).orderBy("seq").collect()
    assert [(r.text, r.box[0][1], r.page) for r in rows] == [("a", 0.0, 1), ("b", 2.0, 1)]


def test_template_takes_rows_in_turn(spark):
    kind = "pos int, code string, name_th string, name_en string, credits string, year int, semester int"
    template = spark.createDataFrame([(1, "A", None, "", None, None, 2), (2, "A", None, "", "9", None, None), (3, None, "t", None, None, None, None)], kind)
    parsed = spark.createDataFrame([(1, "A", "th", "X", "3", 1, 1), (2, None, "u", "", "4", 2, 2), (3, "B", "x", "y", "z", 1, 1)], kind)
    made = [tuple(r) for r in joins.merge_template(template, parsed).orderBy("pos").collect()]
    assert made == [(1, "A", "th", "X", "3", 1, 2), (2, "A", None, "", "9", None, None), (3, None, "t", None, "4", 2, 2)]


def test_ground_truth_by_name_then_stem(spark):
    predictions = spark.createDataFrame([("in/a.pdf", "x"), ("b.jpg", "y")], "source_path string, text string")
    truth = spark.createDataFrame([("a.pdf", ""), ("a", "by stem"), ("b.jpg", "by name")], "key string, reference string")
    made = joins.with_ground_truth(predictions, truth).orderBy("source_path").collect()
    assert [r.reference for r in made] == ["by name", "by stem"]
    with pytest.raises(Exception, match="No ground truth found for b.jpg"):
        joins.with_ground_truth(predictions, truth.where("key <> 'b.jpg'")).collect()
    assert joins.with_ground_truth(predictions, truth.limit(0), strict=False).where("reference is null").count() == 2


def test_template_query_joins_the_whole_table(spark, monkeypatch):
    from pagewright.operators import joins
    from pagewright.plans import queries

    sf_dir, seen, merge = "/root/testdata/sf0.001", [], joins.merge_template
    monkeypatch.setattr(joins, "merge_template", lambda template, parsed: seen.append(parsed) or merge(template, parsed))
    made, part = queries.template_merge(spark, sf_dir), queries.table(spark, sf_dir, "part")
    assert seen[0].count() == part.count() == made.count()
    assert seen[0].where("pos % 4 = 1").join(made, "code", "left_semi").count() == 0


@pytest.mark.parametrize("name", ["code_rows", "segment_blocks", "trim_blocks", "course_table", "curriculum"])
def test_pages_are_dealt_and_put_in_order_once(spark, name):
    from pagewright.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1  # items, before there are seven lines of each
    assert plan.count("Sort [") == plan.count("Window [") == 2  # of items, and of lines


def test_what_stands_between_code_and_total_on_a_page(spark):
    texts = ["x x x X", "a b", "TOTAL　", "lost", "1234 5xxx", "th", "2(1-1-2)", "EN gb", "7(7-7-7)", "รวมตลอด", "12345678", "\x1c", "12345678 9", "xxx", "x มคอ"]
    rows = [("d", 1, i, t, 0.0, float(i)) for i, t in enumerate(texts)] + [("d", 2, 0, "3(3-0-6)", 0.0, 0.0), ("d", 2, 1, "xxxx", 0.0, 1.0), ("d", 2, 2, "late", 0.0, 1.0)]
    made = courses.courses(spark.createDataFrame(rows[::-1], "doc string, page int, seq int, text string, x double, y double")).orderBy("page", "blk").collect()
    assert [(r.page, r.blk, r.code, r.credits, r.name_th, r.name_en) for r in made] == [
        (1, 1, "xxxx", None, "a b", None), (1, 2, "12345xxx", "2(1-1-2)", "th", "EN GB"), (1, 3, "12345678", None, "12345678 9 xxx", None), (2, 1, "xxxx", None, "late", None),
    ]
