import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    text = lambda n=40: " ".join(word() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(240):
        t = text()
        if i % 6 == 0:
            t += " you " + rng.choice(["schurke", "grobian"]) + ". " + text(5)
        rows.append((i, t, "en", rng.choice(["a", "b", None]), len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    twin = text(60)
    rows += [(300, twin, "en", "a", 1), (301, twin + " end", "en", "b", 1), (302, None, None, None, None), (303, "", "en", "a", 0)]
    rows += [(304, 'key token = "' + "0f" * 20 + '" ' + text(), "en", "a", 1)] * 2
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert tuple(docs.columns) == cp.COLUMNS
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(0, 240, 6)}
    assert len(toxic & set(seen["toxicity"])) <= 1
    assert len((set(range(240)) - toxic) - set(seen["toxicity"])) <= 1
    assert {300, 302, 303, 304} <= set(seen["near_duplicates"]) and 301 not in seen["near_duplicates"]
    hidden = seen["secrets"][304]
    assert "0f0f" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert seen["secrets"][300] == seen["near_duplicates"][300] and seen["secrets"][302].n_chars is None
    last = cp.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_one_row_of_a_group_stays_with_ids_or_without(spark):
    import corpus_pipeline as cp

    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    pairs = [(7, text("u")), (7, text("t")), (3, text("t")), (9, text("v")), (9, text("w") + " end"), (5, text("w"))]
    pairs += [(11, text("x")), (11, text("y")), (11, text("x")), (8, text("z")), (8, text("y") + " end"), (None, text("u")), (9, None)]
    pairs += [(3, text("c")), (5, text("c")), (5, text("only")), (None, text("n")), (None, text("n")), (None, text("n") + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").withColumn("gone", F.lit(1))
    kept = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    gone = [(7, text("t")), (9, text("w") + " end"), (11, text("y")), (11, text("x")), (None, text("u")), (5, text("c")), (None, text("n"))]
    left = list(pairs)
    for p in gone:  # each once: of rows alike one stays
        left.remove(p)
    twin = (None, text("n") + " end")
    alike = [sorted([p for p in x if p[0] is not None or p[1] is None or p[1][:2] != "n0"], key=str) for x in (kept, left)]
    assert alike[0] == alike[1]
    assert [p for p in kept if p[0] is None and p[1] and p[1].startswith("n0")] in ([twin], [(None, text("n"))])


def test_run_and_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as cp

    assert cp.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
