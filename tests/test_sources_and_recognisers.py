import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.functions import imaging
from pagewright.operators import recognise
from pagewright.plans import workflows
from pagewright.sources import readers, writers


def encoded(image):
    np.save(out := io.BytesIO(), image)
    return out.getvalue()


@pytest.fixture
def scan(tmp_path):
    image = np.full((60, 80), 255, np.uint8)
    image[10:14], image[30:33] = 0, 60
    (tmp_path / "scan.png").write_bytes(encoded(image))
    return tmp_path


def test_documents_from_images(spark, scan, tmp_path):
    settings = recognise.Settings(engine="blocks", preprocess=False)
    made = workflows.run_recognition(spark, f"{scan}/*.png", str(tmp_path / "out"), settings).first()
    assert made.text == "--- Page 1 ---\nband 10-14\nband 30-33"
    assert [x.box[0] for x in made.pages[0].lines] == [[0.0, 10.0], [0.0, 30.0]]
    back = spark.read.text(str(tmp_path / "out/fields")).first()[0]
    assert json.loads(back) == {}


def test_documents_that_share_a_stem(spark, tmp_path):
    for name, rows in (("a", 4), ("b", 7)):
        (tmp_path / name).mkdir()
        image = np.full((60, 80), 255, np.uint8)
        image[10 : 10 + rows] = 0
        (tmp_path / name / "x.png").write_bytes(encoded(image))
    settings = recognise.Settings(engine="blocks", preprocess=False)
    made = workflows.run_recognition(spark, f"{tmp_path}/*/x.png", str(tmp_path / "out"), settings, text_files=True).collect()
    assert sorted((r.source_path[-7:], r.text[-10:]) for r in made) == [("a/x.png", "band 10-14"), ("b/x.png", "band 10-17")]
    texts = sorted(p.read_text()[-10:] for p in (tmp_path / "out/text").glob("x-*_ocr.txt"))
    assert texts == ["band 10-14", "band 10-17"]


def test_renderers_by_name(spark, tmp_path):
    from pagewright.sources import renderers

    assert renderers.named("poppler") is renderers.poppler and renderers.named("json:dumps") is json.dumps
    with pytest.raises(ValueError, match="unknown renderer: none"):
        renderers.named("none")


def test_texts_of_a_loose_reader(spark, tmp_path):
    lines = [{"text": None, "box": [[1, 2], [3, 4]]}, {"text": "a", "confidence": 0.5}, {"engine": "e"}]
    (tmp_path / "l.json").write_text(json.dumps({"pages": [{"page": 1, "lines": lines}]}))
    made = readers.read_lines(spark, str(tmp_path / "l.json")).orderBy("seq").collect()
    assert [(r.text, r.confidence, r.box, r.engine) for r in made] == [("None", None, [[1.0, 2.0], [3.0, 4.0]], None), ("a", 0.5, None, None), ("", None, None, "e")]


def test_the_curriculum_lies_beside_its_input(spark, tmp_path):
    line = {"text": "01236049", "box": [[0, 1]]}
    (tmp_path / "o.json").write_text(json.dumps({"pages": [{"page": 1, "lines": [line, {"text": "NAME", "box": [[0, 2]]}]}]}))
    cli.main(["curriculum", str(tmp_path / "o.json")])
    made = "".join(p.read_text() for p in (tmp_path / "extracted_curriculum.json").glob("part-*"))
    assert json.loads(made)["courses"][0]["code"] == "01236049"


def test_page_headings_may_be_stripped(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"doc.pdf": "old", "doc.pdf": "a b"}')
    (tmp_path / "p.json").write_text(json.dumps({"source_path": "x/doc.pdf", "text": "--- Page 1 ---\na b"}))
    paths = str(tmp_path / "gt.json"), str(tmp_path / "p.json")
    assert not workflows.evaluate_files(spark, *paths).first().exact_match
    assert workflows.evaluate_files(spark, *paths, strip_page_markers=True).first().exact_match


def test_debug_images_of_all_documents(spark, tmp_path):
    import zlib

    image = np.full((16, 400), 255, np.uint8)
    image[6:10, 20:200] = 0
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scan.png").write_bytes(encoded(image if name == "a" else image[:, ::-1]))
    settings = recognise.Settings(engine="blocks", save_debug_images=True)
    workflows.run_recognition(spark, f"{tmp_path}/*/scan.png", str(tmp_path / "out"), settings)
    made = [p.read_bytes() for p in sorted((tmp_path / "out/debug").glob("scan-*/page_001_preprocessed.png"))]
    pixels = [zlib.decompress(x[x.index(b"IDAT") + 4 : -16]) for x in made]
    want = [imaging.prepared(x, True) for x in (image, image[:, ::-1])]
    assert sorted(pixels) == sorted(b"".join(b"\0" + row.tobytes() for row in x) for x in want)
    workflows.run_recognition(spark, f"{tmp_path}/a/scan.png", str(tmp_path / "off"), recognise.Settings(engine="blocks", preprocess=False, save_debug_images=True))
    assert not (tmp_path / "off/debug").exists()


def test_blank_pages_keep_their_heading(spark, scan):
    (scan / "scan.png").write_bytes(encoded(np.full((9, 9), 255, np.uint8)))
    pages = readers.document_pages(spark, f"{scan}/*.png")
    made = workflows.recognised_documents(pages, recognise.Settings(engine="blocks", preprocess=False)).first()
    assert made.text == "--- Page 1 ---\n" and made.pages[0].lines == []


def test_pdf_pages_are_named_and_numbered(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"two")
    made = readers.document_pages(spark, f"{tmp_path}/*", lambda content, dpi: iter([content, b"second"])).orderBy("page").collect()
    assert [(r.page, r.image_path, bytes(r.content)) for r in made] == [(1, "a_page_001.jpg", b"two"), (2, "a_page_002.jpg", b"second")]


def test_other_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"x")
    with pytest.raises(Exception, match="Unsupported input type: .docx"):
        readers.document_pages(spark, f"{tmp_path}/*").collect()


def test_engines(spark):
    with pytest.raises(ValueError, match="Unknown OCR engine: none"):
        recognise.page_rows(spark.createDataFrame([], "doc string, page int, content binary"), recognise.Settings(engine="none"))
    table = {"text": [" a ", "", None, "b"], "conf": ["95", "1", "2", "x"], "left": [1, 0, 0, 2], "top": [2, 0, 0, 3], "width": [3, 0, 0, 4], "height": [4, 0, 0, 5]}
    made = recognise.tesseract_lines(table)
    assert [(x.text, x.confidence) for x in made] == [("a", 0.95), ("b", None)]
    assert made[0].box == [[1, 2], [4, 2], [4, 6], [1, 6]]


def test_json_keeps_nulls_and_thai(spark, tmp_path):
    rows = spark.createDataFrame([("กา", None)], "a string, b string")
    writers.save_json(rows, str(tmp_path / "j"))
    whole = "".join(r[0] for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect())
    assert json.loads(whole) == {"a": "กา", "b": None} and "กา" in whole


def test_evaluate_files(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"doc": "a b"}))
    (tmp_path / "p.json").write_text(json.dumps({"source_path": "x/doc.pdf", "text": "a c"}))
    made = workflows.evaluate_files(spark, str(tmp_path / "gt.json"), str(tmp_path / "p.json")).first()
    assert tuple(made) == ("doc.pdf", 0.5, 0.5, False, 3, 3)


def test_results_are_printed_as_json(spark, tmp_path, capsys):
    (tmp_path / "truth.json").write_text(json.dumps({"a.pdf": "one two"}))
    (tmp_path / "p.json").write_text(json.dumps({"source_path": "x/a.pdf", "text": "one tvo", "pages": []}))
    cli.main(["evaluate", str(tmp_path / "truth.json"), str(tmp_path / "p.json"), "--output", str(tmp_path / "out")])
    printed = json.loads(capsys.readouterr().out)
    assert (printed["file"], printed["wer"], printed["exact_match"]) == ("a.pdf", 0.5, False)


def test_curriculum_from_json(spark, tmp_path):
    line = lambda t, x, y: {"text": t, "box": [[x, y], [x + 1, y + 1]]}
    pages = [{"page": 5, "lines": [line("3(3-0-6)", 5, 2), line("01236049", 0, 1), line("ชื่อ", 0, 2), line("NAME", 0, 3)]}]
    (tmp_path / "o.json").write_text(json.dumps({"pages": pages}))
    made = workflows.extract_curriculum_from_file(spark, str(tmp_path / "o.json")).first()
    assert [(c.code, c.credits, c.name_th, c.name_en, c.year) for c in made.courses] == [("01236049", "3(3-0-6)", "ชื่อ", "NAME", 1)]


def test_rules(spark, tmp_path):
    rule = {"category": "c", "present": None, "values": [{"value": None, "label": "l"}], "summary": None}
    (tmp_path / "r.json").write_text(json.dumps({"source": "s", "programs": {"P": [rule], "Q": []}}))
    assert [tuple(r) for r in readers.rules(spark, str(tmp_path / "r.json")).collect()] == [("P", "c", None, "l", None, None)]


def test_field_stream(spark, tmp_path):
    from pagewright.streaming.fields import field_stream

    spark.createDataFrame([(1, "id 12345678")], "i int, text string").write.parquet(str(tmp_path / "in"))
    stream = field_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = stream.writeStream.format("memory").queryName("fields_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select numeric_id from fields_out").first()[0] == "12345678"


def test_command_line():
    args = cli.parser().parse_args(["ocr", "x.pdf", "--engine", "blocks", "--no-deskew", "--min-confidence", "0.5"])
    made = cli.settings_of(args)
    assert (made.engine, made.deskew, made.preprocess, made.min_confidence, made.dpi) == ("blocks", False, True, 0.5, 300)


def test_images():
    assert imaging.enlarged(np.zeros((10, 600, 3), np.uint8)).shape == (20, 1200, 3)
    assert imaging.grey(np.full((2, 2, 3), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]
    page = np.full((200, 300), 255, np.uint8)
    page[90:110, 50:250] = 0
    assert imaging.otsu(page) < 255 and abs(imaging.skew(page)) < 0.1
    turned = imaging.rotated(page, 5.0)
    assert turned.shape > page.shape and 4 < abs(imaging.skew(turned)) < 6
    assert abs(imaging.skew(imaging.rotated(turned, imaging.skew(turned)))) < 1.5
    assert imaging.skew(np.full((50, 50), 255, np.uint8)) == 0
    assert set(np.unique(imaging.prepared(page[:60, :60]))) <= {0, 255}


def mirrored(i, n):
    return -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def test_denoising_by_brute_force():
    image = np.random.default_rng(1).integers(0, 256, (11, 13)).astype(np.uint8)
    h, w = image.shape
    plain, want = image.astype(float), np.empty((h, w))
    at = lambda y, x: plain[mirrored(y, h), mirrored(x, w)]
    for y in range(h):
        for x in range(w):
            total = weights = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    apart = 0.0
                    for i in range(-1, 2):
                        for j in range(-1, 2):
                            a, b = mirrored(y + i, h), mirrored(x + j, w)
                            apart += (at(a + dy, b + dx) - plain[a, b]) ** 2 / 9
                    weight = np.exp(-apart / 60.0**2)
                    total, weights = total + weight * at(y + dy, x + dx), weights + weight
            want[y, x] = total / weights
    made = imaging.denoised(image, strength=60, patch=3, search=5)
    assert np.abs(made - want).max() <= 0.5 + 1e-9


def test_local_contrast_by_brute_force():
    image = np.random.default_rng(2).integers(60, 120, (16, 24)).astype(np.uint8)
    maps, limit = {}, max(1, int(3.0 * 8 * 12 / 256))
    for i in range(2):
        for j in range(2):
            tile = image[i * 8 : i * 8 + 8, j * 12 : j * 12 + 12].ravel().tolist()
            counts = [tile.count(v) for v in range(256)]
            spare = sum(max(c - limit, 0) for c in counts) / 256
            total, maps[i, j] = 0.0, []
            for c in counts:
                total += min(c, limit) + spare
                maps[i, j].append(total * 255 / 96)
    want = np.empty(image.shape)
    for y in range(16):
        for x in range(24):
            fy, fx = min(max((y + 0.5) / 8 - 0.5, 0), 1), min(max((x + 0.5) / 12 - 0.5, 0), 1)
            v = image[y, x]
            want[y, x] = (maps[0, 0][v] * (1 - fx) + maps[0, 1][v] * fx) * (1 - fy) + (maps[1, 0][v] * (1 - fx) + maps[1, 1][v] * fx) * fy
    assert np.abs(imaging.equalized(image, clip=3.0, tiles=2).astype(float) - np.clip(want, 0, 255)).max() <= 0.5 + 1e-9


def test_threshold_by_brute_force():
    image = np.random.default_rng(3).integers(0, 256, (9, 10)).astype(np.uint8)
    sigma = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
    weights = {(i, j): np.exp(-(i * i + j * j) / (2 * sigma**2)) for i in range(-2, 3) for j in range(-2, 3)}
    mean = lambda y, x: sum(v * float(image[min(max(y + i, 0), 8), min(max(x + j, 0), 9)]) for (i, j), v in weights.items()) / sum(weights.values())
    want = [[255 if image[y, x] > round(mean(y, x)) - 4 else 0 for x in range(10)] for y in range(9)]
    assert imaging.thresholded(image, block=5, less=4).tolist() == want


def test_decoded_images(spark, tmp_path):
    image = np.arange(30, dtype=np.uint8).reshape(5, 6)
    (tmp_path / "good.png").write_bytes(imaging.png(image))
    made = readers.decoded_images(spark, f"{tmp_path}/good.png").first()
    assert (made.height, made.width, made.origin[-8:]) == (5, 6, "good.png") and bytes(made.data)[:: made.nChannels] == image.tobytes()
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert readers.decoded_images(spark, f"{tmp_path}/*.png", invalid="drop").count() == 1
    with pytest.raises(Exception, match="Cannot read image: .*bad.png"):
        readers.decoded_images(spark, f"{tmp_path}/*.png").select("origin").collect()


def test_blocks_are_drawn_from_whole_pages(spark, tmp_path):
    from pagewright.plans.queries import recognise_blocks

    html = {1: "x" * 100 + "\n" + "é" * 3000 + "\n" + "y" * 60000 + "\n", 2: None, 3: "", 4: "z" * 4096 + "\n"}
    rows = [(i, f"u{i}", text) for i, text in html.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = sorted((r.page, r.seq, r.text) for r in recognise_blocks(spark, str(tmp_path)).collect())
    breaks = {i: [at // 64 for at, byte in enumerate((text or "").encode()) if byte == 10] for i, text in html.items()}
    assert made == [(i, n, f"band {at}-{at + 1}") for i, rows in breaks.items() for n, at in enumerate(rows, 1)]


def test_every_query_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    missing = set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())
    assert not missing
    assert F.lit(1) is not None


def encoded(image):
    np.save(out := io.BytesIO(), image)
    return out.getvalue()


@pytest.fixture
def counted(tmp_path, monkeypatch):
    """Two engines and a renderer that leave a mark each time they are called."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def mark(kind):
        import uuid

        (marks / f"{kind}-{uuid.uuid4().hex}").touch()

    def render(content, dpi):
        for i in range(2):
            mark("render")
            np.save(out := io.BytesIO(), np.full((40, 60), 255 if i else int(content[0]), np.uint8))
            yield out.getvalue()

    def engine(named, text):
        class Engine:
            name = named

            def __init__(self, settings):
                pass

            def recognise(self, image, page):
                mark(named)
                seen = "white" if image.mean() > 250 else "grey"
                return [] if page == 2 else [recognise.Line(f"{seen} {text}", 0.5), recognise.Line("both", 0.4 if text == "one" else 0.9)]

        return Engine

    monkeypatch.setattr(recognise, "ENGINES", {"paddle": engine("paddle", "one"), "tesseract": engine("tesseract", "two")})
    return render, lambda: {k: len(list(marks.glob(f"{k}-*"))) for k in ("render", "paddle", "tesseract")}


@pytest.mark.parametrize("debug", [False, True])
def test_each_page_is_seen_once(spark, tmp_path, counted, debug):
    """6 PDFs of 2 pages: 12 renderings and 12 calls of each engine, for documents, fields and texts; and each page once with debug images."""
    render, calls = counted
    n = 1 if debug else 6
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"d{i}.pdf").write_bytes(bytes([100 + i]))
    settings = recognise.Settings(preprocess=debug, deskew=False, save_debug_images=debug)
    workflows.run_recognition(spark, f"{tmp_path}/in/*.pdf", str(tmp_path / "out"), settings, render, True).collect()
    assert calls() == {"render": 2 * n, "paddle": 2 * n, "tesseract": 2 * n}
    found = readers.recognised_json(spark, f"{tmp_path}/out/json").collect()
    assert len(found) == n
    for doc in found:
        first, second = doc.pages
        kind = "white" if debug else "grey"
        assert [(x.text, x.engine) for x in first.lines] == [(f"{kind} one", "paddle"), ("both", "tesseract"), (f"{kind} two", "tesseract")] and second.lines == [] and second.text == ""
        assert first.image_path.endswith("_page_001.jpg") and doc.text.endswith("--- Page 2 ---\n")
    assert len(list((tmp_path / "out").glob("debug/*/*.png"))) == (2 * n if debug else 0)


def test_the_ensemble_reads_its_pages_in_one_plan(spark, counted):
    pages = spark.createDataFrame([("d", 1, "d_1", b"x")], "doc string, page int, image_path string, content binary")
    plan = workflows.recognised_documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_confidence_leaves_pages_without_lines(spark, counted):
    pages = spark.createDataFrame([("d", 1, "d_1", encoded(np.full((9, 9), 7, np.uint8)))], "doc string, page int, image_path string, content binary")
    settings = recognise.Settings(preprocess=False, min_confidence=0.95)
    made = workflows.recognised_documents(pages, settings).first()
    assert made.text == "--- Page 1 ---\n" and made.pages[0].lines == [] and recognise.recognise(pages, settings).count() == 0


class Captured:
    """Stands for a table: keeps the function that its batches would go through."""

    columns = ()

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    mapInPandas = mapInArrow


def test_pages_leave_their_batch_a_few_at_a_time(spark, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from pagewright.operators import recognise
    from pagewright.plans import queries

    drawn = Captured()
    monkeypatch.setattr(queries, "table", lambda *where: drawn)
    monkeypatch.setattr(recognise, "recognise", lambda pages, settings: pages)
    queries.recognise_blocks(spark, "")
    texts = ["x" * 6400 + "\n" + "y" * (i % 70) for i in range(3000)] + [None, ""]
    whole = pa.table({"doc": [str(i) for i in range(3002)], "page": pa.array(range(3002), pa.int32()), "html": texts}).to_batches()[0]
    made = list(drawn.run(iter([whole, whole.slice(0, 0)])))
    assert max(b.nbytes for b in made) < 5 << 20 and len(made) > 3
    assert [x for b in made for x in b["page"].to_pylist()] == list(range(3002))

    read, left = Captured(), []
    recognise.page_rows(read, recognise.Settings(engine="blocks", preprocess=False))
    given = pd.DataFrame({"doc": ["d"] * 9000, "page": range(9000), "image_path": None, "content": [made[0]["content"][0].as_py()] * 9000})
    monkeypatch.setattr(recognise, "decode", lambda content, decode=recognise.decode: left.append(1) or decode(content))
    rows = read.run(iter([given]))
    first = len(next(rows))  # many pages at once, and the rest of the batch still to be decoded
    assert 4096 <= first <= 4098 and len(left) < 5000
    assert first + sum(map(len, rows)) == 18000 and len(left) == 9000
