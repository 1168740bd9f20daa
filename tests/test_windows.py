import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, amount long, batch int"


def rows_of(rng, batches, per):
    out = []
    for b in range(batches):
        for _ in range(per):
            late = rng.choice([0, 0, 0, 1, 5, 40])
            at = START + dt.timedelta(minutes=10 * b - late * 10 + rng.randint(0, 9), microseconds=rng.choice([0, 1, 999_999]))
            out.append((rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.03 else at, rng.randint(0, 9), b))
    # one row far ahead, and another so that its watermark is that of the batch before the last
    out += [("end", START + dt.timedelta(days=30 + i), 0, batches + i) for i in range(2)]
    return out


def put(spark, rows, folder, batches):
    """One file for each batch, in order of their times."""
    os.makedirs(folder, exist_ok=True)
    for b in batches:
        spark.createDataFrame([r for r in rows if r[3] == b], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}-{b}")
        part = next(f for f in os.listdir(f"{folder}-{b}") if f.startswith("part-"))
        os.rename(f"{folder}-{b}/{part}", f"{folder}/b{b:04d}.parquet")
        os.utime(f"{folder}/b{b:04d}.parquet", (1_700_000_000 + b, 1_700_000_000 + b))


@pytest.fixture
def streaming(spark):
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", windows.STATE_STORE[0]: windows.STATE_STORE[1]}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None


def replayed(spark, rows, folder, make, restart_after):
    """All rows that the stream returns, over two runs from one checkpoint."""
    batches = sorted({r[3] for r in rows})
    for some in (batches[:restart_after], batches[restart_after:]):
        put(spark, rows, f"{folder}/in", some)
        run(make(windows.event_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1)), folder)
    return spark.read.parquet(f"{folder}/out").where("key <> 'end'")


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect())) and a.count() > 0


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows_replayed(streaming, tmp_path, slide):
    rows = rows_of(random.Random(1), 9, 40)
    measures = [F.count("*").alias("n"), F.sum("amount").alias("total")]
    made = replayed(streaming, rows, str(tmp_path), lambda s: windows.windowed_stream(s, "ts", ["key"], measures, "20 minutes", "30 minutes", slide), 5)
    batch = windows.windowed_batches(streaming.createDataFrame(rows, SCHEMA), "ts", ["key"], measures, "20 minutes", 1800, "batch", slide).where("key <> 'end'")
    assert same(made, batch)
    plain = windows._named(windows._windows(streaming.createDataFrame(rows, SCHEMA).where("key is not null and ts is not null"), "ts", "20 minutes", slide).groupBy("__w", "key").agg(*measures)).where("key <> 'end'")
    assert made.agg(F.sum("n")).first()[0] < plain.agg(F.sum("n")).first()[0]  # some rows were late


def brute_sessions(rows, gap, delay):
    out, top = {}, None
    for b in sorted({r[3] for r in rows}):
        for key, ts, amount, batch in rows:
            if batch == b and None not in (key, ts) and (top is None or ts.replace(microsecond=ts.microsecond // 1000 * 1000) > top - delay):
                out.setdefault(key, []).append((ts, amount))
        now = max((r[1].replace(microsecond=r[1].microsecond // 1000 * 1000) for r in rows if r[3] == b and None not in r[:2]), default=None)
        top = max((t for t in (top, now) if t), default=None)
    made = []
    for key, seen in out.items():
        seen.sort()
        held = [seen[:1]]
        for s in seen[1:]:
            held.append([s]) if s[0] >= held[-1][-1][0] + gap else held[-1].append(s)
        made += [(key, h[0][0], h[-1][0] + gap, len(h), sum(a for _, a in h)) for h in held]
    return sorted(made)


@pytest.mark.parametrize("no_data", ["false", "true"])
def test_sessions_replayed(streaming, tmp_path, no_data):
    streaming.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", no_data)
    rows = rows_of(random.Random(2), 7, 12)
    made = replayed(streaming, rows, str(tmp_path), lambda s: windows.session_stream(s, "ts", "key", "amount", 240, "30 minutes"), 4)
    frame = streaming.createDataFrame(rows, SCHEMA)
    batch = windows.session_batches(frame, "ts", "key", "amount", 240, 1800, "batch", 900).where("key <> 'end'")
    expected = [r for r in brute_sessions(rows, dt.timedelta(seconds=240), dt.timedelta(minutes=30)) if r[0] != "end"]
    assert sorted(tuple(r) for r in batch.select("key", "start", "end", "n", "total").collect()) == expected
    assert same(made, batch)


def test_windows_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert windows.session_batches(none, "ts", "key", "amount", 60, 60, "batch").count() == 0
    assert windows.windowed_batches(none, "ts", ["key"], [F.count("*").alias("n")], "1 hour", 60, "batch").count() == 0
