"""Schemas of recognised documents and what is read with them."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

LINE = _fields(text=S, confidence=D, box=T.ArrayType(T.ArrayType(D)), engine=S, page=I)
PAGE = _fields(page=I, text=S, lines=T.ArrayType(LINE), image_path=S)
DOCUMENT = _fields(source_path=S, engine=S, text=S, pages=T.ArrayType(PAGE))
EVALUATION = _fields(file=S, cer=D, wer=D, exact_match=B, reference_chars=I, prediction_chars=I)
COURSE = _fields(code=S, name_th=S, name_en=S, credits=S, year=I, semester=I, category=S, type=S, prerequisite=S, flexible_year_semester=S, note=S)
CURRICULUM = _fields(source=S, description=S, program=S, plan=S, courses=T.ArrayType(COURSE))
RULE = _fields(category=S, present=B, values=T.ArrayType(_fields(value=S, label=S)), summary=S)
RULES = _fields(source=S, description=S, programs=T.MapType(S, T.ArrayType(RULE)))
GROUND_TRUTH = T.MapType(S, S)

#: The fact table: one row for each recognised line; seq is its place on the page.
LINES = "doc string, page int, seq int, text string, confidence double, box array<array<double>>, engine string"
