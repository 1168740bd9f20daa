"""Common fields of a document: the first e-mail address, date, numeric id and phone number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import DIGIT as D
from pagewright.functions.text import WORD_END, WORD_START, first_match

#: What each field looks like.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DATE = rf"{WORD_START}(?:{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}|{D}{{4}}-{D}{{2}}-{D}{{2}}){WORD_END}"
NUMERIC_ID = rf"{WORD_START}{D}{{8,12}}{WORD_END}"
PHONE = rf"(?:\+?66|0){D}{{8,9}}{WORD_END}"


def email(text: Column) -> Column:
    return first_match(text, EMAIL)


def date(text: Column) -> Column:
    """As written; no calendar is consulted."""
    return first_match(text, DATE)


def numeric_id(text: Column) -> Column:
    return first_match(text, NUMERIC_ID)


def phone(text: Column) -> Column:
    """Hyphens are left out everywhere first."""
    return first_match(F.replace(text, F.lit("-"), F.lit("")), PHONE)


FIELDS = {"email": email, "date": date, "numeric_id": numeric_id, "phone": phone}


def with_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column for each field, null where there is none."""
    return docs.withColumns({name: field(F.col(text)) for name, field in FIELDS.items()})


def fields_json(text: Column) -> Column:
    """One JSON object of the fields that were found."""
    return F.to_json(F.struct(*[field(text).alias(name) for name, field in FIELDS.items()]))
