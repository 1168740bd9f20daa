"""Operators as table functions for SQL: pages of a text, best lines of a page, lines of an image.

After register(spark):

    SELECT d.doc, p.* FROM docs d, LATERAL pagewright_pages(d.text) p
    SELECT * FROM pagewright_best_lines(TABLE(lines) PARTITION BY (doc, page) ORDER BY (engine_rank, seq))
    SELECT * FROM pagewright_recognise(TABLE(pages), 'tesseract')

Each says its columns itself, from the arguments that it is given, and refuses others when a
query is planned. Spark deals the rows of a table argument by its PARTITION BY; a partition,
a page here, is what a function holds at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagewright.operators import lines, recognise

_KINDS = {"doc": T.StringType(), "content": T.BinaryType(), "body": T.StringType(), "text": T.StringType(), "confidence": T.DoubleType(), "box": T.ArrayType(T.ArrayType(T.DoubleType())), "engine": T.StringType()}
_LINE = ("text", "confidence", "box", "engine")


def _schema(*names: str) -> T.StructType:
    """Columns of these names; those not among the kinds are whole numbers."""
    return T.StructType([T.StructField(n, _KINDS.get(n, T.IntegerType())) for n in names])


#: The heading of a page as Python spells it: \d is a digit of any script.
_HEADING = re.compile(r"--- Page (\d+) ---")


def _columns(table: AnalyzeArgument, *needed: str) -> None:
    """Fails unless the table argument has the needed columns, of those types."""
    if not table.isTable:
        raise ValueError("a table is needed: TABLE(...)")
    given = {f.name: f.dataType.simpleString() for f in table.dataType.fields}
    for f in _schema(*needed).fields:
        if given.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"the table needs a column {f.name} {f.dataType.simpleString()}, not {given.get(f.name)}")


class Pages:
    """Pages of a text with page headings; without any, the whole text is page 1. Null has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType.simpleString() not in ("string", "void"):
            raise ValueError(f"a text is needed, not {text.dataType.simpleString()}")
        return AnalyzeResult(_schema("page_index", "page", "body"))

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        parts = _HEADING.split(text)
        if len(parts) == 1:
            yield 1, 1, text
        for i in range(1, len(parts), 2):
            yield (i + 1) // 2, int(parts[i]), parts[i + 1]


class BestLines:
    """Of the lines of a page, in order, one for each text: that of highest confidence; ordered by their top."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _columns(table, "doc", "page", "engine_rank", "seq", *_LINE)
        return AnalyzeResult(_schema("doc", "page", "seq", *_LINE))

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.best: dict[str, Row] = {}
        self.n = 0

    def eval(self, line: Row) -> None:
        self.n += 1
        key = (line["text"] or "").strip()
        if not key:
            return
        self.first.setdefault(key, self.n)
        if key not in self.best or (line["confidence"] or 0.0) > (self.best[key]["confidence"] or 0.0):
            self.best[key] = line

    @staticmethod
    def _top(box: list | None) -> float:
        ys = [p[1] if p and len(p) > 1 else None for p in box or []]
        return lines.NO_TOP if not ys or None in ys else min(ys)

    def terminate(self) -> Iterator[tuple]:
        order = sorted(self.best, key=lambda k: (self._top(self.best[k]["box"]), self.first[k]))
        for seq, key in enumerate(order, 1):
            x = self.best[key]
            yield x["doc"], x["page"], seq, x["text"], x["confidence"], x["box"], x["engine"]


class Recognise:
    """Lines of page images by one engine, made once in a task."""

    @staticmethod
    def analyze(table: AnalyzeArgument, engine: AnalyzeArgument, preprocess: AnalyzeArgument | None = None) -> AnalyzeResult:
        _columns(table, "doc", "page", "content")
        if not engine.isConstantExpression:
            raise ValueError("the engine is to be a constant")
        if engine.value not in recognise.ENGINES:
            raise ValueError(f"Unknown OCR engine: {engine.value}")
        return AnalyzeResult(_schema("doc", "page", "seq", *_LINE))

    def __init__(self) -> None:
        self.engine = None

    def eval(self, page: Row, engine: str, preprocess: bool = True) -> Iterator[tuple]:
        if self.engine is None:
            self.engine = recognise.ENGINES[engine](recognise.Settings(engine=engine))
        image = recognise.decode(page["content"])
        image = recognise.imaging.prepared(image, True) if preprocess else image
        for seq, x in enumerate(self.engine.recognise(image, page["page"]), 1):
            box = x.box and [[float(v) for v in point] for point in x.box]  # whole numbers would become null
            yield page["doc"], page["page"], seq, x.text, x.confidence, box, self.engine.name


FUNCTIONS = {"pagewright_pages": Pages, "pagewright_best_lines": BestLines, "pagewright_recognise": Recognise}


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL of this session."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(made))
