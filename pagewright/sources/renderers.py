"""Renderers of PDF pages: functions from a PDF's bytes and a resolution to its pages as JPEG, one after another."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterator

Renderer = Callable[[bytes, int], Iterator[bytes]]


def poppler(content: bytes, dpi: int) -> Iterator[bytes]:
    """By the pdf2image library, page by page, so that no task holds all pages of a long document."""
    import pdf2image

    pages = pdf2image.pdfinfo_from_bytes(content)["Pages"]
    for n in range(1, pages + 1):
        for image in pdf2image.convert_from_bytes(content, dpi=dpi, first_page=n, last_page=n):
            image.save(out := io.BytesIO(), "JPEG")
            yield out.getvalue()


def named(name: str) -> Renderer:
    """The renderer that module:function names; poppler by its name alone."""
    if name == "poppler":
        return poppler
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"unknown renderer: {name}")
    return getattr(importlib.import_module(module), function)
