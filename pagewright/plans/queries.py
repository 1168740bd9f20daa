"""Registered queries, one or more for each operator, over the tables the driver provides.

Those tables are no recognised documents, so lines, pages and texts are derived from
them, in the same way here and in the SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import fields, metrics
from pagewright.functions import text as tx
from pagewright.operators import courses, joins, lines, recognise
from pagewright.sources import readers, writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fields


def _order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as short texts with a date, an id and a phone number."""
    orders = table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    style = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.concat(F.lit("order "), key, F.lit(" of "), style, F.lit(" call 08-"), F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 4), F.lit(" or a"), key, F.lit("@mail.example.com"))
    return orders.select("o_orderkey", text.alias("text"))


def fields_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.email(F.col("text")).alias("email"))


def fields_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.phone(F.col("text")).alias("phone"))


def fields_date(spark, sf_dir):
    return _order_notes(spark, sf_dir).select("o_orderkey", fields.date(F.col("text")).alias("date"))


def fields_id(spark, sf_dir):
    return _order_notes(spark, sf_dir).select("o_orderkey", fields.numeric_id(F.col("text")).alias("numeric_id"))


def fields_all(spark, sf_dir):
    return fields.with_fields(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def fields_orders(spark, sf_dir):
    return fields.with_fields(_order_notes(spark, sf_dir)).drop("text")


def fields_json(spark, sf_dir):
    return _order_notes(spark, sf_dir).select("o_orderkey", fields.fields_json(F.col("text")).alias("fields"))


# Accuracy


def _marked(text):
    """Carriage returns, tabs and blank runs put into a text."""
    return F.concat(F.lit(" \t\r\n"), F.replace(F.replace(text, F.lit(" of "), F.lit(" \t of\r\n\n\n ")), F.lit(". "), F.lit(".\t\t")), F.lit("\n\n \t"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in ASCII as references, and as a poor recogniser would read them."""
    turns = readers.spread(table(spark, sf_dir, "conversations"))
    ref = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    hyp = F.replace(F.replace(ref, F.lit("rn"), F.lit("m")), F.lit("e"), F.lit("c"))
    return turns.select("conv_id", "turn", ref.alias("ref"), hyp.alias("hyp"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = readers.spread(table(spark, sf_dir, "part"))
    hyp = F.concat(F.replace("p_name", F.lit("a"), F.lit("o")), F.when(F.col("p_partkey") % 3 == 0, F.lit(" more words")).otherwise(F.lit("")))
    return part.select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")).alias("ref"), F.concat(hyp, F.lit(" "), F.col("p_type")).alias("hyp"))


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metrics.normalized(_marked(F.col("text"))).alias("normalized"))


def cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", metrics.char_error_rate(F.col("ref"), F.col("hyp")).alias("cer"))


def cer_empty(spark, sf_dir):
    blank = lambda c: F.when(F.col("turn") % 2 == 0, F.lit(" \n")).otherwise(F.col(c))
    return _pairs(spark, sf_dir).select("conv_id", "turn", metrics.char_error_rate(blank("ref"), F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.col("hyp"))).alias("cer"))


def wer(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", metrics.word_error_rate(F.col("ref"), F.col("hyp")).alias("wer"))


def wer_turns(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", metrics.word_error_rate(F.col("ref"), F.col("hyp")).alias("wer"))


def exact_match(spark, sf_dir):
    same = (metrics.normalized(F.col("ref")) == metrics.normalized(F.col("hyp"))).alias("exact_match")
    return _pairs(spark, sf_dir).select("conv_id", "turn", same)


def evaluate(spark, sf_dir):
    name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return _names(spark, sf_dir).select(*metrics.evaluation(name, F.col("ref"), F.col("hyp")))


def gt_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key, even, seventh = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 7 == 0
    predictions = docs.select("doc_id", F.concat(F.lit("scans/doc_"), key, F.lit(".pdf")).alias("source_path"))
    name, stem = F.concat(F.lit("doc_"), key, F.lit(".pdf")), F.concat(F.lit("doc_"), key)
    by_name = docs.where(even | seventh).select(name.alias("key"), F.when(seventh, F.lit("")).otherwise(F.col("text")).alias("reference"))
    by_stem = docs.where(~even | seventh).select(stem.alias("key"), F.col("text").alias("reference"))
    found = joins.with_ground_truth(predictions, by_name.unionByName(by_stem), strict=False)
    return found.select("doc_id", tx.file_name(F.col("source_path")).alias("file"), F.length("reference").cast("long").alias("chars"), F.md5(F.col("reference").cast("binary")).alias("digest"))


# Assembly


def _turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages from 1, lines as lines."""
    turns = table(spark, sf_dir, "conversations")
    each = turns.select(F.col("conv_id").cast("string").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return each.select("doc", "page", (F.col("i") + 1).alias("seq"), "text", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<array<double>>").alias("box"), F.lit("turns").alias("engine"))


def page_text(spark, sf_dir):
    return lines.page_texts(_turn_lines(spark, sf_dir))


def doc_text(spark, sf_dir):
    return lines.document_texts(lines.page_texts(_turn_lines(spark, sf_dir)))


def doc_nested(spark, sf_dir):
    docs = lines.documents(_turn_lines(spark, sf_dir))
    count = F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p["lines"]))
    return docs.select("doc", F.size("pages").alias("n_pages"), count.alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("digest"))


def doc_json(spark, sf_dir):
    docs = lines.documents(_turn_lines(spark, sf_dir))
    made = F.from_json(writers.as_json(F.struct("doc", "text", "pages")), "doc string, text string, pages array<struct<page:int,text:string>>")
    return docs.select(made.alias("j")).select("j.doc", F.md5(F.col("j.text").cast("binary")).alias("digest"), F.size("j.pages").alias("n_pages"))


def split_pages(spark, sf_dir):
    return lines.split_pages(lines.document_texts(lines.page_texts(_turn_lines(spark, sf_dir)))).select("doc", "page_index", "page", "body")


def text_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return readers.text_lines(docs).select("doc", "page", "seq", "text", F.col("box")[0][1].alias("y"))


def page_numbers(spark, sf_dir):
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("pages"))
    return lines.numbered_pages(listed).select("conv_id", "page", F.col("item.role").alias("role"))


def min_confidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("confidence"))
    return lines.min_confidence(events, 50.0)


# Merge


def _engine_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as the lines of two recognisers: users are pages, values confidences, some without a box."""
    events = table(spark, sf_dir, "events")
    y = F.when(F.col("event_id") % 5 == 0, None).otherwise((F.col("event_id") % 17).cast("double"))
    point = F.when(F.col("event_id") % 11 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), y))
    rows = events.select(
        F.lit("events").alias("doc"), F.col("user_id").cast("int").alias("page"), F.col("event_id").alias("seq"),
        F.concat(F.lit(" "), F.col("event_type"), F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.lit(" "))).alias("text"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("confidence"),
        F.when(F.col("event_id") % 5 != 0, F.array(point)).alias("box"), (F.col("event_id") % 2).alias("side"),
    )
    one, two = (rows.where(F.col("side") == i).drop("side").withColumn("engine", F.lit(name)) for i, name in enumerate(("left", "right")))
    return one, two


def ensemble_union(spark, sf_dir):
    return lines.union_engines(*_engine_lines(spark, sf_dir)).select("page", "seq", "text", "confidence", "engine")


def ensemble_merge(spark, sf_dir):
    return lines.merge_engines(*_engine_lines(spark, sf_dir)).select("page", "seq", "text", "confidence", "engine")


def box_top(spark, sf_dir):
    one, two = _engine_lines(spark, sf_dir)
    return one.unionByName(two).select(F.col("seq").alias("event_id"), lines.box_top(F.col("box")).alias("top"))


# Courses


#: Sixth lines of items: totals and footers in all their forms, some more than once, and lines that end no block.
_ENDS = (
    " Total ", "12345 6", "รวม", "เธฃเธงเธก", "รวม 3", "รวมตลอด 120", "x เธฃเธงเธกเธ•เธฅเธญเธ” y", "วท.บ.",
    "เธงเธ— 2560", "เธ\x84เธ“เธฐ", "เธชเธ\x88เธฅ", "มคอ 2", "คณะ", "สจล", "total 9", "12345 6",
)


def _plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as lines in reading order: a code, a name, noise, a credit tuple, an English name, and now and then a total or a footer.

    Items are numbered by document, so that they lie together for what reads pages before there are seven lines of each.
    """
    order = Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    items = table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey").cast("string")).withColumn("rn", F.row_number().over(order))
    q = F.col("l_quantity").cast("int")
    credit = F.concat(q.cast("string"), F.lit(" ("), q.cast("string"), F.lit(" - 0 - 6))"))
    texts = F.array(
        F.concat(F.lit(" "), F.substring(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), 1, 4), F.lit(" "), F.substring(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), 5, 4)),
        F.concat(F.lit("name "), F.col("l_suppkey").cast("string")),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("77")).when(F.col("l_partkey") % 3 == 1, F.lit("|")).otherwise(F.lit(" ")),
        F.when(F.col("l_suppkey") % 5 == 0, F.lit("(3-0-6)")).otherwise(credit),
        F.concat(F.lit("flag  "), F.col("l_returnflag"), F.lit(" status "), F.col("l_linestatus")),
        F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("l_partkey") % 16 + 1).cast("int")),
        F.lit("last line"),
    )
    each = items.select("doc", (F.col("l_orderkey") % 9).cast("int").alias("page"), "rn", F.posexplode(texts).alias("i", "text"))
    return each.select("doc", "page", (F.col("rn") * 10 + F.col("i")).alias("seq"), "text", F.lit(0.0).alias("x"), (F.col("rn") * 10 + F.col("i")).cast("double").alias("y"))


def code_rows(spark, sf_dir):
    rows = courses.reading_order(_plan_lines(spark, sf_dir)).where("code_row")
    return rows.select("doc", "pos", courses.code_of(F.col("t")).alias("code"))


def segment_blocks(spark, sf_dir):
    return courses.blocks(courses.reading_order(_plan_lines(spark, sf_dir))).groupBy("doc", "blk").agg(F.count("*").alias("n_lines"))


def trim_blocks(spark, sf_dir):
    return courses.trimmed(courses.blocks(courses.reading_order(_plan_lines(spark, sf_dir)))).groupBy("doc", "blk").agg(F.count("*").alias("n_lines"))


def credits(spark, sf_dir):
    rows = _plan_lines(spark, sf_dir)
    return rows.select("doc", "seq", courses.credits_of(F.col("text")).alias("credits"))


def course_table(spark, sf_dir):
    made = courses.full_courses(_plan_lines(spark, sf_dir))
    return made.select("doc", "blk", "code", "credits", "name_th", "name_en", "year", "semester", "note")


def curriculum(spark, sf_dir):
    made = courses.curriculum(courses.full_courses(_plan_lines(spark, sf_dir)))
    codes = F.array_join(F.transform("courses", lambda c: c["code"]), ",")
    return made.select("doc", "source", "description", "program", "plan", F.size("courses").alias("n_courses"), F.md5(codes.cast("binary")).alias("codes"))


def line_places(spark, sf_dir):
    box = F.when(F.col("event_id") % 5 != 0, F.array(F.array(F.col("value"), F.col("user_id").cast("double")), F.array(F.lit(40.0), F.lit(20.0)), F.array(F.lit(1.0))))
    rows = table(spark, sf_dir, "events").select("event_id", box.alias("box"))
    return courses.placed(rows).select("event_id", "x", "y")


def looks_english(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", courses.looks_english(F.col("text")).alias("english"))


def year_semester(spark, sf_dir):
    year, semester = courses.term(F.col("turn") + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", year.alias("year"), semester.alias("semester"))


# Joins


def template_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    code = F.concat(F.lit("c"), (F.col("p_partkey") % 400).cast("string"))
    template = part.select(
        F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 50 != 0, code).alias("code"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name_th"), F.lit(None).cast("string").alias("name_en"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("3(3-0-6)")).alias("credits"), F.when(F.col("p_partkey") % 5 == 0, F.lit(1)).alias("year"), F.lit(None).cast("int").alias("semester"),
    )
    unmatched = F.concat(F.lit("none "), code)  # no template row has it
    parsed = part.select(
        F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 4 == 1, unmatched).when(F.col("p_partkey") % 60 != 0, code).alias("code"), F.upper("p_name").alias("name_th"), F.col("p_brand").alias("name_en"),
        F.lit("1(1-0-2)").alias("credits"), F.lit(4).alias("year"), (F.col("p_size") % 2 + 1).cast("int").alias("semester"),
    )
    return joins.merge_template(template, parsed)


def template_heading(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    template = nation.select(key.alias("doc"), F.col("n_name").alias("source"), F.lit("template").alias("description"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("IT")).alias("program"), F.lit(None).cast("string").alias("plan"))
    return joins.merge_heading(template, nation.select(key.alias("doc"), F.lit("DSBA").alias("program"), F.lit("no_coop").alias("plan")))


def rules_flatten(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.struct(F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit(">= "), F.col("n_nationkey").cast("string"))).alias("value"), F.col("n_name").alias("label"))
    rule = F.struct(F.lit("nations").alias("category"), F.lit(True).alias("present"), F.collect_list(value).alias("values"), F.lit(None).cast("string").alias("summary"))
    bare = F.struct(F.lit("empty").alias("category"), F.lit(None).cast("boolean").alias("present"), F.array().cast("array<struct<value:string,label:string>>").alias("values"), F.lit("none").alias("summary"))
    nested = both.groupBy("r_name").agg(F.create_map(F.col("r_name"), F.array(rule, bare)).alias("programs")).select("programs")
    shaped = nested.select(F.from_json(F.to_json("programs"), schemas.RULES["programs"].dataType).alias("programs"))
    return readers.flat_rules(shaped)


# Paths and pages


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".PNG", ".tar.gz", "", ".jpeg", ".Tiff", ".webp2")]), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in/dir.x/.page_"), F.col("page_id").cast("string"), suffix).alias("path"))


def file_kind(spark, sf_dir):
    path = F.col("path")
    kind = F.when(tx.is_pdf(path), "pdf").when(tx.is_image(path), "image").otherwise("other")
    return _paths(spark, sf_dir).select("page_id", kind.alias("kind"))


def path_stem(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", tx.file_name(path).alias("name"), tx.file_stem(path).alias("stem"))


def recognise_blocks(spark, sf_dir):
    """The table function of recognisers, over pages drawn from all of the HTML's bytes, 64 to a row."""
    def draw(batches):
        import io

        import numpy as np
        import pyarrow as pa

        def image(html: str) -> bytes:
            whole = (html or "").encode()
            height = max(-(-len(whole) // 64), 1)
            raw = np.frombuffer(whole.ljust(height * 64, b" "), np.uint8).reshape(height, 64)
            np.save(out := io.BytesIO(), np.where((raw == 10).any(axis=1)[:, None], 0, 255).astype(np.uint8).repeat(64, axis=1))
            return out.getvalue()

        for batch in batches:
            drawn, held = [], 0
            for i in range(batch.num_rows):  # about 4 MB of images leave together
                drawn.append(image(batch["html"][i].as_py()))
                held += len(drawn[-1])
                if held >= 4 << 20 or i + 1 == batch.num_rows:
                    first = i + 1 - len(drawn)
                    yield pa.RecordBatch.from_arrays([batch["doc"].slice(first, len(drawn)), batch["page"].slice(first, len(drawn)), pa.array(drawn, pa.binary())], ["doc", "page", "content"])
                    drawn, held = [], 0

    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("doc"), F.col("page_id").cast("int").alias("page"), "html")
    return recognise.recognise(pages.mapInArrow(draw, "doc string, page int, content binary"), recognise.Settings(engine="blocks", preprocess=False))


_NAMES = (
    "fields_email fields_phone fields_date fields_id fields_all fields_orders fields_json normalize_text cer cer_empty wer wer_turns exact_match evaluate gt_lookup "
    "page_text doc_text doc_nested doc_json split_pages text_lines page_numbers min_confidence ensemble_union ensemble_merge box_top "
    "code_rows segment_blocks trim_blocks credits course_table curriculum line_places looks_english year_semester template_merge template_heading rules_flatten file_kind path_stem recognise_blocks"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}
