import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import imaging  # noqa: F401
from pagewright.operators import lines, recognise, table_functions
from pagewright.sources import store


@pytest.fixture
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def test_pages_in_sql_are_those_of_frames(spark, sql):
    texts = ["--- Page 1 ---\na\n\n--- Page ๒ ---\n", "plain", "", None, "before --- Page 7 --- x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    docs.createOrReplaceTempView("docs")
    made = sql("SELECT d.doc, p.* FROM docs d, LATERAL pagewright_pages(d.text) p")
    want = lines.split_pages(docs.where("text is not null")).select("doc", "page_index", "page", "body")
    assert made.schema == want.select("doc", F.col("page_index").cast("int").alias("page_index"), "page", "body").schema or made.columns == want.columns
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="a text is needed, not int"):
        sql("SELECT * FROM pagewright_pages(1)")


def test_best_lines_in_sql_are_those_of_frames(spark, sql):
    rng = np.random.default_rng(1)
    parts = []
    for engine in ("one", "two"):
        rows = [("d" if i % 4 else "e", int(rng.integers(1, 4)), i, str(rng.choice([" a", "a ", "b", " ", "c", None])), None if rng.random() < 0.2 else float(rng.integers(0, 4)), None if rng.random() < 0.3 else [[0.0, float(rng.integers(0, 3))]], engine) for i in range(80)]
        rows = [(*r[:3], None if r[3] == "None" else r[3], *r[4:]) for r in rows]
        parts.append(spark.createDataFrame(rows, "doc string, page int, seq int, text string, confidence double, box array<array<double>>, engine string"))
    lines.ranked(*parts).createOrReplaceTempView("lines")
    made = sql("SELECT * FROM pagewright_best_lines(TABLE(lines) PARTITION BY (doc, page) ORDER BY (engine_rank, seq))")
    want = lines.merge_engines(*parts)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.select(made.columns).collect())) and made.count() > 10
    with pytest.raises(Exception, match="the table needs a column engine_rank"):
        sql("SELECT * FROM pagewright_best_lines(TABLE(SELECT doc, page FROM lines) PARTITION BY (doc, page))")


def test_recognisers_in_sql_are_those_of_frames(spark, sql):
    import io

    rows = []
    for i in range(3):
        image = np.full((20, 30), 255, np.uint8)
        image[4 : 6 + i, 3:9] = 0
        np.save(out := io.BytesIO(), image)
        rows.append(("d", i, out.getvalue()))
    pages = spark.createDataFrame(rows, "doc string, page int, content binary")
    pages.createOrReplaceTempView("pages")
    made = sql("SELECT * FROM pagewright_recognise(TABLE(pages), 'blocks', false)")
    want = recognise.recognise(pages, recognise.Settings(engine="blocks", preprocess=False))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.select(made.columns).collect())) and made.count() == 3
    with pytest.raises(Exception, match="Unknown OCR engine: none"):
        sql("SELECT * FROM pagewright_recognise(TABLE(pages), 'none')")


SCHEMA = "source_path string, text string, pages array<struct<page:int,text:string>>"


def documents(spark, ids, parts=3):
    return spark.createDataFrame([(f"d{i}", None if i % 5 == 0 else f"ก {i}", [(1, f"p{i}")] if i % 2 else None) for i in ids], SCHEMA).repartition(parts)


@pytest.fixture
def stored(spark, tmp_path):
    store.register(spark)
    path = str(tmp_path / "store")
    read = lambda: sorted(map(repr, spark.read.format(store.NAME).load(path).collect()))
    return spark, path, read


def rows(df):
    return sorted(map(repr, df.collect()))


def test_store_keeps_what_is_committed(stored):
    spark, path, read = stored
    one, two = documents(spark, range(20)), documents(spark, range(20, 25))
    one.write.format(store.NAME).mode("append").save(path)
    assert read() == rows(one) and spark.read.format(store.NAME).load(path).schema == one.schema
    two.write.format(store.NAME).mode("append").save(path)
    assert read() == sorted(rows(one) + rows(two))
    two.write.format(store.NAME).mode("overwrite").save(path)
    assert read() == rows(two)
    two.limit(0).write.format(store.NAME).mode("append").save(path)
    assert read() == rows(two)
    with pytest.raises(Exception, match="nothing has been committed"):
        spark.read.format(store.NAME).load(path + "-none")


def test_a_task_that_fails_midway_leaves_nothing(stored):
    spark, path, read = stored
    one = documents(spark, range(10))
    one.write.format(store.NAME).mode("append").save(path)
    files = set(os.listdir(path))

    def fails(batches):
        for batch in batches:
            if (batch["source_path"] == "d77").any():
                raise RuntimeError("lost")
            yield batch

    bad = documents(spark, range(60, 90), 4).mapInPandas(fails, SCHEMA)
    with pytest.raises(Exception, match="lost"):
        bad.write.format(store.NAME).mode("append").save(path)
    assert read() == rows(one)
    left = set(os.listdir(path)) - files  # the failed task's own file at most: an abort deletes what tasks reported
    named = {f for m in store.Folder(path).manifests() for f in m["files"]}
    assert not left & named and len(store.Folder(path).manifests()) == 1


def test_commits_are_whole_and_in_order(tmp_path):
    folder = store.Folder(str(tmp_path / "s"))
    folder.commit(["a"], "{}", "q", 0)
    folder.commit(["b"], "{}", "q", 0)
    folder.commit(["c"], "{}", "q", 1)
    assert [m["files"] for m in folder.manifests()] == [["a"], ["c"]] and folder.size() == 2
    (tmp_path / "s" / "_manifests" / "half.tmp").write_text("{")
    assert folder.size() == 2 and store.visible(folder.manifests()) == ["a", "c"]


def test_commits_at_once_are_never_lost(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = store.Folder(str(tmp_path / "s"))

    def commit(i):
        try:
            folder.commit([f"f{i}"], "{}")
            return f"f{i}"
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = [x for x in pool.map(commit, range(60)) if x]
    assert sorted(store.visible(folder.manifests())) == sorted(done) and done
    assert not [f for f in os.listdir(tmp_path / "s" / "_manifests") if f.endswith(".tmp")]


def test_streams_into_and_out_of_a_store(stored, tmp_path):
    spark, path, read = stored
    copy = str(tmp_path / "copy")

    def run():
        source = spark.readStream.format(store.NAME).schema(documents(spark, [1]).schema).load(path)
        query = source.writeStream.format(store.NAME).option("path", copy).option("query", "copy").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return rows(spark.read.format(store.NAME).load(copy))

    one, two = documents(spark, range(12)), documents(spark, range(12, 20))
    one.write.format(store.NAME).mode("append").save(path)
    assert run() == rows(one)
    two.write.format(store.NAME).mode("append").save(path)
    assert run() == sorted(rows(one) + rows(two))
    batches = [m["batch"] for m in store.Folder(copy).manifests()]
    assert batches == sorted(set(batches))
    store.StoreStreamWriter(copy, one.schema, query="copy").commit([store.Files(["again"])], 0)  # a batch that is run again
    assert rows(spark.read.format(store.NAME).load(copy)) == sorted(rows(one) + rows(two))
