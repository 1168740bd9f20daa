"""Recognisers: from page images to lines, as a distributed table function.

A recogniser is made once in a Python task and sees page after page. Real engines import
their libraries only when they are made, so that none is needed for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import imaging
from pagewright.operators.lines import best_lines, min_confidence, numbered


@dataclass(frozen=True)
class Line:
    text: str
    confidence: float | None = None
    box: list[list[float]] | None = None


class Recogniser(Protocol):
    name: str

    def recognise(self, image: np.ndarray, page: int) -> list[Line]: ...


@dataclass(frozen=True)
class Settings:
    """How documents are recognised; the defaults of the command line."""

    engine: str = "ensemble"
    languages: str = "tha+eng"
    paddle_lang: str = "th"
    trocr_model: str = "microsoft/trocr-base-printed"
    device: str = "cpu"
    dpi: int = 300
    preprocess: bool = True
    deskew: bool = True
    min_confidence: float = 0.0
    save_debug_images: bool = False


def rectangle(left: float, top: float, width: float, height: float) -> list[list[float]]:
    """Corners clockwise from the upper left."""
    right, bottom = left + width, top + height
    return [[left, top], [right, top], [right, bottom], [left, bottom]]


class Blocks:
    """Needs no library: a line for each band of rows with ink, saying where it is. For tests and dry runs."""

    name = "blocks"

    def __init__(self, settings: Settings):
        pass

    def recognise(self, image: np.ndarray, page: int) -> list[Line]:
        ink = imaging.grey(image) < 128
        rows = np.flatnonzero(np.diff(np.concatenate([[0], ink.any(axis=1).astype(np.int8), [0]])))
        return [Line(f"band {a}-{b}", float(ink[a:b].mean()), rectangle(0, float(a), float(image.shape[1]), float(b - a))) for a, b in rows.reshape(-1, 2).tolist()]


class Paddle:
    name = "paddle"

    def __init__(self, settings: Settings):
        from paddleocr import PaddleOCR

        self.engine = PaddleOCR(use_angle_cls=True, lang=settings.paddle_lang)

    def recognise(self, image: np.ndarray, page: int) -> list[Line]:
        found = self.engine.ocr(image, cls=True) or []
        return [Line(text, float(confidence), np.asarray(box, float).tolist()) for block in found for box, (text, confidence) in block or []]


class Tesseract:
    """A line for each word that is not blank; its confidence as a share of 1."""

    name = "tesseract"

    def __init__(self, settings: Settings):
        import pytesseract

        self.engine, self.languages = pytesseract, settings.languages

    def recognise(self, image: np.ndarray, page: int) -> list[Line]:
        rgb = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., ::-1]
        table = self.engine.image_to_data(rgb, lang=self.languages, config="--oem 3 --psm 6", output_type=self.engine.Output.DICT)
        return tesseract_lines(table)


def tesseract_lines(table: dict[str, list[Any]]) -> list[Line]:
    """Lines of a table of words, as columns text, conf, left, top, width, height."""
    made = []
    for text, score, *place in zip(*(table[k] for k in ("text", "conf", "left", "top", "width", "height")), strict=True):
        if word := (text or "").strip():
            try:
                confidence = float(score) / 100
            except ValueError:
                confidence = None
            made.append(Line(word, confidence, rectangle(*map(float, place))))
    return made


class TrOCR:
    """At most one line a page, without confidence or box."""

    name = "trocr"

    def __init__(self, settings: Settings):
        import torch
        from transformers import TrOCRProcessor, VisionEncoderDecoderModel

        self.torch, self.device = torch, settings.device
        self.processor = TrOCRProcessor.from_pretrained(settings.trocr_model)
        self.model = VisionEncoderDecoderModel.from_pretrained(settings.trocr_model).to(settings.device)

    def recognise(self, image: np.ndarray, page: int) -> list[Line]:
        rgb = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., ::-1]
        with self.torch.no_grad():
            made = self.model.generate(self.processor(images=rgb, return_tensors="pt").pixel_values.to(self.device))
        text = self.processor.batch_decode(made, skip_special_tokens=True)[0].strip()
        return [Line(text)] if text else []


class EasyOCR:
    """Thai and English on the CPU, whatever the settings; corners cut to whole numbers."""

    name = "easyocr"

    def __init__(self, settings: Settings):
        import easyocr

        self.engine = easyocr.Reader(["th", "en"], gpu=False)

    def recognise(self, image: np.ndarray, page: int) -> list[Line]:
        return [Line(text, float(confidence), [[int(v) for v in point] for point in box]) for box, text, confidence in self.engine.readtext(np.asarray(image))]


#: Engines by name. `ensemble` is two of them, merged.
ENGINES: dict[str, Callable[[Settings], Recogniser]] = {e.name: e for e in (Blocks, Paddle, Tesseract, TrOCR, EasyOCR)}
ENSEMBLE = ("paddle", "tesseract")


def decode(content: bytes) -> np.ndarray:
    """Pixels (blue, green, red) of an encoded image, with whichever image library is there; numpy's own format needs none."""
    import io

    if content[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(content))
    try:
        import cv2

        image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)
    except ImportError:
        from PIL import Image

        image = np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))[..., ::-1]
    if image is None:
        raise ValueError("Cannot read image")
    return image


#: So many rows, or bytes of images, leave a task together at least.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
PAGE_ROWS = "doc string, page int, image_path string, engine_rank int, seq int, text string, confidence double, box array<array<double>>, engine string, image binary"


def engine_names(settings: Settings) -> tuple[str, ...]:
    names = ENSEMBLE if settings.engine == "ensemble" else (settings.engine,)
    for name in names:
        if name not in ENGINES:
            raise ValueError(f"Unknown OCR engine: {name}")
    return names


def page_rows(pages: DataFrame, settings: Settings = Settings(), images: bool = False) -> DataFrame:
    """Rows PAGE_ROWS of pages (doc, page, content, and image_path if known): lines of all engines of the settings, from one pass.

    A page is decoded and prepared once, and every engine sees the same image. Besides its
    lines a page has one row without an engine, of rank -1 and without text, so that pages
    without lines stay; with `images` that row has what the engines saw, as PNG, if prepared.
    """
    makers = [ENGINES[name] for name in engine_names(settings)]
    path = F.col("image_path") if "image_path" in pages.columns else F.lit(None).cast("string")
    columns = [part.split()[0] for part in PAGE_ROWS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        engines = [make(settings) for make in makers]
        made, held = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                image = decode(row.content)
                image = imaging.prepared(image, settings.deskew) if settings.preprocess else image
                place = (row.doc, row.page, row.image_path)
                png = imaging.png(image) if images and settings.preprocess else None
                made.append((*place, -1, 0, "", None, None, None, png))
                for rank, engine in enumerate(engines):
                    made += [(*place, rank, seq, x.text, x.confidence, x.box, engine.name, None) for seq, x in enumerate(engine.recognise(image, row.page), 1)]
                held += len(png or b"")
                if len(made) >= OUT_ROWS or held >= OUT_BYTES:
                    yield pd.DataFrame(made, columns=columns)
                    made, held = [], 0
        if made:
            yield pd.DataFrame(made, columns=columns)

    return pages.select("doc", "page", path.alias("image_path"), "content").mapInPandas(run, PAGE_ROWS)


def chosen_lines(rows: DataFrame, settings: Settings) -> DataFrame:
    """Of page_rows: the lines of the engine, or the ensemble's best, those below the least confidence left out; pages keep the rows that stand for them."""
    rows = rows.drop("image")
    lines = best_lines(numbered(rows)) if settings.engine == "ensemble" else rows.drop("engine_rank")
    return min_confidence(lines, settings.min_confidence)


def recognise(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Lines of pages by the engine of the settings, those below its least confidence left out."""
    lines = page_rows(pages, settings).where("engine is not null")
    return chosen_lines(lines, settings).drop("image_path")
