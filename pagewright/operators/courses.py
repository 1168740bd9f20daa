"""Course tables from lines in reading order.

A line that is a course code opens a block, which ends before the next code or at a
total or footer. In a block, the first line with a credit tuple parts the Thai name
before it from the English name after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import DIGIT as D
from pagewright.functions.text import SPACE, first_match, single_spaces, strip, without_space

#: What codes, credits and totals look like, and footers. The second of the totals, of the
#: grand totals, and the first three footers are Thai words whose bytes were once read in a Thai code page.
_D, _X = rf"(?:{D}{SPACE}*+)", rf"(?:x{SPACE}*+)"
SPACED_CODE = rf"(?iU)\A{SPACE}*+(?:{_D}{{8}}|{_D}{{5}}{_X}{{3}}|{_D}{{4}}{_X}{{4}}|{_X}{{4,8}})\z"
NOT_BLANK = rf"(?U)[^{SPACE[1:]}"
CREDITS = rf"{D}+\({D}+-{D}+-{D}+\)"
TOTALS = ("รวม", "เธฃเธงเธก", "total")
GRAND_TOTALS = ("รวมตลอด", "เธฃเธงเธกเธ•เธฅเธญเธ”")
FOOTERS = ("เธงเธ—", "เธ\x84เธ“เธฐ", "เธชเธ\x88เธฅ", "มคอ")
#: The same footers, read rightly.
TRUE_FOOTERS = ("วท", "คณะ", "สจล")
NOISE = ("|", ".", "a")
#: Year and semester of a document's pages, from the first.
TERMS = ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1))


def code_of(text: Column) -> Column:
    return F.lower(without_space(text))


def is_code(text: Column) -> Column:
    """Digits and x's as codes have them, with white space anywhere; most lines differ in their first character."""
    return text.rlike(SPACED_CODE)


def credits_of(text: Column) -> Column:
    """The first credit tuple, without spaces; doubled closing brackets are one. Null without one."""
    return F.when(text.contains("("), first_match(F.replace(without_space(text), F.lit("))"), F.lit(")")), CREDITS))


def looks_english(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return letters >= F.greatest(F.lit(2), F.floor(F.length(strip(text)) / 3).cast("int"))


def is_footer(text: Column, repair: bool = False) -> Column:
    found = F.lit(False)
    for token in FOOTERS + TRUE_FOOTERS * repair:
        found = found | text.contains(token)
    return found


def ends_block(text: Column, repair: bool = False) -> Column:
    total = text.rlike(rf"(?iU)\A{SPACE}*+(?:{'|'.join(TOTALS)}){SPACE}*+\z")
    for token in GRAND_TOTALS:
        total = total | text.contains(token)
    return total | is_footer(text, repair)


def is_noise(text: Column) -> Column:
    return (text == "") | text.rlike(rf"\A{D}+\z") | text.isin(*NOISE)


def term(page_index: Column) -> tuple[Column, Column]:
    """Year and semester of a page by its place in the document; nulls beyond the seventh."""
    known = {part: F.array(*[F.lit(t[part]) for t in TERMS]) for part in (0, 1)}
    at = F.when(page_index.between(1, len(TERMS)), page_index).cast("int")
    return F.try_element_at(known[0], at), F.try_element_at(known[1], at)


def placed(lines: DataFrame, box: str = "box") -> DataFrame:
    """lines with x and y, the least of the points that have both; 0 without any."""
    sound = F.filter(box, lambda p: F.size(p) >= 2)
    least = lambda i: F.coalesce(F.array_min(F.transform(sound, lambda p: F.try_element_at(p, F.lit(i)))), F.lit(0.0))
    return lines.withColumns({"x": least(1), "y": least(2)})


def reading_order(lines: DataFrame, repair_footers: bool = False) -> DataFrame:
    """Lines (doc, page, seq, text, x, y) that are not blank, stripped as t, by y, then x, then seq, with what that order says.

    pos is the place on the page, code_row whether the line is a code, blk the number of codes so far, stopped whether
    a total or footer lies between the last code and this line or is this line, credit the credits of a line that is no
    code, credited whether there are some since the last code. Pages are sorted once, for one window of all of these.
    """
    text, t = F.col("text"), F.col("t")
    bare = (text >= "!") & (text < "\x7f") & F.substring(text, -1, 1).between("!", "~")  # begins and ends in ASCII without white space
    rows = lines.where(text.rlike(NOT_BLANK)).withColumn("t", F.when(bare, text).otherwise(strip(text))).withColumn("code_row", is_code(t))
    rows = rows.withColumn("credit", F.when(~F.col("code_row"), credits_of(t)))
    since_code = lambda mark: F.when(F.col("code_row"), False).when(mark, True)
    rows = rows.withColumns({"code_n": F.col("code_row").cast("int"), "stop": since_code(ends_block(t, repair_footers)), "paid": since_code(F.col("credit").isNotNull())})
    so_far = Window.partitionBy("doc", "page").orderBy("y", "x", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name: F.coalesce(F.last(name, ignorenulls=True).over(so_far), F.lit(False))
    found = {"pos": F.row_number().over(so_far), "blk": F.sum("code_n").over(so_far).cast("int"), "stopped": last("stop"), "credited": last("paid")}
    return rows.withColumns(found).drop("code_n", "stop", "paid")


def blocks(ordered: DataFrame) -> DataFrame:
    """ordered without the lines before the first code of a page."""
    return ordered.where("blk > 0")


def trimmed(blocked: DataFrame) -> DataFrame:
    """Blocks up to their first total or footer."""
    return blocked.where("not stopped")


def courses(lines: DataFrame, repair_footers: bool = False) -> DataFrame:
    """doc, page, blk, code, credits, name_th, name_en from lines (doc, page, seq, text, x, y).

    Blocks without a line after the code give nothing. One shuffle, on (doc, page) and its extensions.
    """
    t, code_row, credit = F.col("t"), F.col("code_row"), F.col("credit")
    thai = ~code_row & ~F.col("credited") & ~is_noise(t)
    english = F.col("credited") & credit.isNull() & looks_english(t)
    rows = trimmed(blocks(reading_order(lines, repair_footers))).withColumn("name", F.when(thai, "th").when(english, "en"))
    joined = lambda name: F.array_join(F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("pos", "t"))))["t"], " ")
    made = rows.groupBy("doc", "page", "blk").agg(
        F.max(F.when(code_row, code_of(t))).alias("code"),
        F.min_by("credit", F.when(credit.isNotNull(), F.col("pos"))).alias("credits"),
        F.nullif(strip(joined("th")), F.lit("")).alias("name_th"),
        F.nullif(F.upper(single_spaces(strip(joined("en")))), F.lit("")).alias("name_en"),
        F.count_if(~code_row).alias("rest"),
    )
    return made.where("rest > 0").drop("rest")


def full_courses(lines: DataFrame, page_index: str = "page", repair_footers: bool = False) -> DataFrame:
    """courses with year and semester by page, and the columns that are always null."""
    year, semester = term(F.col(page_index))
    empty = {name: F.lit(None).cast("string") for name in ("category", "type", "prerequisite", "flexible_year_semester", "note")}
    return courses(lines, repair_footers).withColumns({"year": year, "semester": semester, **empty})


def curriculum(found: DataFrame, program: str = "DSBA", plan: str = "no_coop", source: str | None = None) -> DataFrame:
    """doc and one struct of the document: source, description, program, plan and its courses in order."""
    names = ("code", "name_th", "name_en", "credits", "year", "semester", "category", "type", "prerequisite", "flexible_year_semester", "note")
    course = F.struct("page", "blk", F.struct(*names).alias("course"))
    rows = F.sort_array(F.collect_list(course))["course"]
    head = [F.col("doc") if source is None else F.lit(source), F.lit(f"Extracted academic plan from OCR for {program} ({plan})"), F.lit(program), F.lit(plan)]
    return found.groupBy("doc").agg(rows.alias("courses")).select("doc", *[c.alias(n) for c, n in zip(head, ("source", "description", "program", "plan"), strict=True)], "courses")
