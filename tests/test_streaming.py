"""Streams that are cut off, tried again and continued give each row once and the tables of one run."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _rows(first: int, n: int):
    draw = random.Random(first)
    start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * first)
    return [(first + i, start + dt.timedelta(minutes=20 * i), i % 5, "hot" if i % 3 else "cold", None if i % 7 == 3 else draw.uniform(-400, 400)) for i in range(n)]


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _forget_last_commit(folder):
    """What a driver leaves that dies after it wrote a batch and before it said so."""
    commits = f"{folder}/state/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = _rows(0, 40) + _rows(40, 30)
    _write(spark, rows[:40], path)
    _write(spark, rows[40:], path)
    return path, rows


def test_a_batch_tried_again_is_written_once(spark, events, tmp_path):
    path, rows = events
    folder = str(tmp_path / "out")
    assert jobs.run_available(_stream(spark, path), "t", folder=folder).count() == len(rows)
    _forget_last_commit(folder)
    _write(spark, _rows(70, 10), path)
    got = [r[0] for r in jobs.run_available(_stream(spark, path), "t", folder=folder).select("event_id").collect()]
    assert sorted(got) == list(range(80))


def test_enriched_rows_of_a_batch_tried_again_are_written_once(spark, events, tmp_path):
    path, rows = events
    folder = str(tmp_path / "out")
    facts = spark.createDataFrame([(1, dt.date(2023, 1, 1), 5.0)], "user_id long, available date, price double")
    run = lambda: jobs.enriched(_stream(spark, path).withColumn("day", F.to_date("ts")), facts, "t", by=["user_id"], ts="day", available="available", folder=folder)
    run()
    _forget_last_commit(folder)
    out = run().select("event_id", "user_id", "r_price").collect()
    assert sorted(r[0] for r in out) == list(range(len(rows)))
    assert all((r[2] == 5.0) == (r[1] == 1) for r in out)


def test_a_table_goes_on_from_an_earlier_run(spark, events, tmp_path):
    path, rows = events
    folder = str(tmp_path / "out")
    run = lambda: jobs.last_wins(_stream(spark, path), ["user_id"], "event_id", "t", folder=folder)
    run()
    _forget_last_commit(folder)
    more = _rows(70, 3)
    _write(spark, more, path)
    want = {r[2]: r[0] for r in rows + more}
    assert {r["user_id"]: r["event_id"] for r in run().collect()} == want


def test_ewma_over_batches_equals_a_loop(spark, events, tmp_path):
    path, rows = events
    want = {}
    for _, _, _, k, x in rows:
        if x is not None:
            n, v = want.get(k, (0, 0.0))
            want[k] = (n + 1, x * x if n == 0 else 0.94 * v + 0.06 * x * x)
    got = jobs.ewma_state(_stream(spark, path), "t", folder=str(tmp_path / "out")).collect()
    assert {r["event_type"]: r["n"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        assert r["ewma"] == pytest.approx(want[r["event_type"]][1])


def test_throttle_over_batches_equals_a_loop(spark, events, tmp_path):
    path, rows = events
    want = {}
    for _, _, _, k, x in rows:
        if x is not None:
            n, e, index, peak = want.get(k, (0, 1.0, 1.0, 1.0))
            index *= 1 + e * (x - 25.0) / 10000.0
            peak = max(peak, index)
            dd = index / peak - 1
            want[k] = (n + 1, 0.5 if dd < -0.02 else 1.0 if dd > -0.01 else e, index, peak)
    got = jobs.throttle_state(_stream(spark, path), "t", cut=0.02, restore=0.01, folder=str(tmp_path / "out")).collect()
    assert {r["event_type"]: (r["n"], r["exposure"]) for r in got} == {k: v[:2] for k, v in want.items()}
    for r in got:
        assert (r["index"], r["peak"]) == pytest.approx(want[r["event_type"]][2:])


def test_no_input_gives_empty_tables(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert jobs.run_available(_stream(spark, path), "t").count() == 0
    assert jobs.ewma_state(_stream(spark, path), "t").count() == 0
    assert jobs.throttle_state(_stream(spark, path), "t").count() == 0
