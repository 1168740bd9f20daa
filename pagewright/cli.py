"""Command line: recognise documents, evaluate predictions, extract a curriculum."""

from __future__ import annotations

import argparse
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.recognise import ENGINES, Settings
from pagewright.plans import workflows
from pagewright.sources import renderers, writers
from pagewright.sources.writers import as_json

#: Rows that a command prints at most.
SHOWN = 20


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright", description="Recognition, evaluation and extraction of documents on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    ocr = commands.add_parser("ocr", help="recognise images or PDFs")
    ocr.add_argument("input_path")
    ocr.add_argument("--output-dir", default="outputs")
    ocr.add_argument("--engine", choices=["ensemble", *sorted(ENGINES)], default="ensemble")
    ocr.add_argument("--languages", default="tha+eng")
    ocr.add_argument("--paddle-lang", default="th")
    ocr.add_argument("--dpi", default=300, type=int)
    ocr.add_argument("--min-confidence", default=0.0, type=float)
    ocr.add_argument("--device", default="cpu")
    ocr.add_argument("--renderer", default="poppler", help="of PDF pages: poppler, or module:function")
    ocr.add_argument("--no-preprocess", action="store_true")
    ocr.add_argument("--no-deskew", action="store_true")
    ocr.add_argument("--save-debug-images", action="store_true")
    ocr.add_argument("--no-text-files", action="store_true", help="only JSON lines, for large corpora")
    evaluate = commands.add_parser("evaluate", help="compare a prediction with ground truth")
    evaluate.add_argument("ground_truth_json")
    evaluate.add_argument("prediction_json")
    evaluate.add_argument("--output", default="outputs/evaluation_result.json")
    evaluate.add_argument("--strip-page-markers", action="store_true")
    extract = commands.add_parser("curriculum", help="extract courses from recognised lines")
    extract.add_argument("input_path", nargs="?", default="outputs/sample_ocr.json")
    extract.add_argument("--output", help="beside the input unless given")
    return top


def settings_of(args: argparse.Namespace) -> Settings:
    return Settings(
        engine=args.engine, languages=args.languages, paddle_lang=args.paddle_lang, device=args.device, dpi=args.dpi,
        preprocess=not args.no_preprocess, deskew=not args.no_deskew, min_confidence=args.min_confidence, save_debug_images=args.save_debug_images,
    )


def show(rows: DataFrame) -> None:
    """Prints rows as JSON, the first SHOWN of them: all are written to files."""
    for row in rows.select(as_json(F.struct(*rows.columns)).alias("value")).limit(SHOWN).collect():
        print(row.value)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    if args.command == "ocr":
        made = workflows.run_recognition(spark, args.input_path, args.output_dir, settings_of(args), renderers.named(args.renderer), not args.no_text_files)
        show(made.select("source_path", "email", "date", "numeric_id", "phone"))
    elif args.command == "evaluate":
        result = workflows.evaluate_files(spark, args.ground_truth_json, args.prediction_json, args.strip_page_markers)
        writers.save_json(result, args.output)
        show(result)
    else:
        made = workflows.extract_curriculum_from_file(spark, args.input_path)
        writers.save_json(made.drop("doc"), args.output or posixpath.join(posixpath.dirname(args.input_path), "extracted_curriculum.json"))
        show(made.select("source", "program", "plan", F.size("courses").alias("courses")))


if __name__ == "__main__":
    main()
